"""Mixing sources to target weights by pivotal dependent rounding.

Each row is due total * weight / rows-of-its-source copies. The whole part is certain; the fractions are rounded so that every
source's sum stays within one of its due: two rows with fractions p and q duel, and mass moves between them at random until
one of the two is 0 or 1. Rows are spread over leaves by a hash of their identifier; a leaf leaves at most one row of each
source with a fraction, these residuals duel in the next level of a tree, and so on to a root. Only keys and fractions travel;
random numbers are hashes of the duelling rows' keys, so a lost task repeats its decisions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._shared import free_name, sized, written
from ._text import mix
from .neardup import by_group

FAN = 64  # residuals of a source that one task of the next level receives
LEAF_ROWS = 65_536


def duel(p: np.ndarray, key: np.ndarray, seed: int, eps: float = 1e-9) -> np.ndarray:
    """Pivotal rounding of the fractions p in order: all but at most one of the results are 0 or 1, and the sum is kept."""
    out = np.array(p, np.float64)
    u = (mix(key.view(np.uint64) ^ mix(np.full(len(key), seed, np.uint64))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    at, a = -1, 0.0
    for i in np.flatnonzero((out > eps) & (out < 1 - eps)).tolist():
        if at < 0:
            at, a = i, out[i]
            continue
        b, s = out[i], a + out[i]
        if s < 1:  # one gets all, the other nothing
            if u[i] * s < a:
                out[i], out[at], a = 0.0, s, s
            else:
                out[at], out[i] = 0.0, s
                at, a = i, s
        else:  # one becomes 1, the other keeps the rest
            rest = s - 1
            if u[i] * (2 - s) < 1 - b:
                out[at], out[i] = 1.0, rest
                at, a = i, rest
            else:
                out[i], out[at], a = 1.0, rest, rest
        if a <= eps or a >= 1 - eps:
            out[at] = round(a)
            at = -1
    return out


def tempered_weights(docs: DataFrame, *, source_col: str = "source", temperature: float = 0.7) -> DataFrame:
    """(source, weight): each source's share of the rows to the power of `temperature`, summing to 1; over all rows.

    Defined cases: a null source is a source of its own; repeated rows count as often as they occur; texts, identifiers and extra
    columns don't matter; an empty table gives an empty one.
    """
    n = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    w = F.pow(F.col("n").cast("double"), F.lit(temperature))
    total = n.agg(F.sum(w).alias("all"))
    return n.crossJoin(F.broadcast(total)).select("source", (w / F.col("all")).alias("weight"))


def _level(rows: DataFrame, leaf: Column, seed: int) -> DataFrame:
    """One level of the tree: duels within each (source, leaf), in order of the key; the other columns come along."""
    ordered = rows.withColumn("leaf", leaf).repartition("s", "leaf").sortWithinPartitions("s", "leaf", "h")
    at = ordered.columns.index("p")

    def run(batches):
        for t, cut in by_group(batches, 2):
            p, h = t.column(at).to_numpy().copy(), t.column(2).to_numpy()
            for a, b in zip(cut[:-1], cut[1:]):
                p[a:b] = duel(p[a:b], h[a:b], seed)
            columns = [t.column(i).combine_chunks() for i in range(t.num_columns)]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            columns[at] = pa.array(p)
            yield pa.RecordBatch.from_arrays(columns, names=t.column_names)

    return ordered.mapInArrow(run, ordered.schema)


def source_copies(
    docs: DataFrame, weights: DataFrame, *, total: int | None = None, seed: int = 17,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """(id, source, key, number, copies): how often each row is taken, so that source s has total * weight(s) / sum(weights) copies, give or take less than one.

    `key` is a hash of identifier, source and text, `number` counts the rows that agree in it; mix_sources joins the copies
    back by them. total defaults to the number of rows.

    Defined cases: weights that are null or negative count as 0; the sum of the weights is over the sources present, and a
    source without a weight gets no copies; a null source is a source of its own and takes the weight listed for null; null and
    repeated identifiers are told apart by their text, wholly repeated rows by their number; null and empty texts count like any
    other; if all weights are 0, or the table is empty, there are no copies.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _key(id_col, source_col, text_col).alias("key"))
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(1))))
    n = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    w = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    w = weights.select(F.col("source").alias("ws"), w.alias("w")).groupBy("ws").agg(F.sum("w").alias("w"))
    due = n.join(w, n.source.eqNullSafe(w.ws), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    sums = due.agg(F.sum("w").alias("all"), F.sum("n").alias("rows"))
    each = F.lit(total).cast("double") if total is not None else F.col("rows").cast("double")
    due = due.crossJoin(F.broadcast(sums)).select("source", "n", F.when(F.col("all") > 0, each * F.col("w") / F.col("all") / F.col("n")).otherwise(0.0).alias("due"))
    # a row a source, numbered: bounded by the number of sources
    due = written(due.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_first()))), "sources")
    largest = due.agg(F.max("n")).first()[0] or 0
    width = max(1, -(-largest // LEAF_ROWS))
    keyed = rows.join(sized(due.select(F.col("source").alias("_s"), "s", "due")), F.col("source").eqNullSafe(F.col("_s")))
    keyed = keyed.withColumn("h", F.xxhash64("key", "number"))
    keyed = keyed.select("s", F.pmod(F.col("h"), F.lit(width)).cast("bigint").alias("leaf"), "h", (F.col("due") - F.floor("due")).alias("p"), "id", "key", "number")
    level = written(_level(keyed, F.col("leaf"), seed), "mixing")
    inside = "p > 1e-9 and p < 1 - 1e-9"
    parts, rest = [level.where(f"not ({inside})")], level.where(inside)
    while width > 1:
        width = -(-width // FAN)
        seed += 1
        level = written(_level(rest, (F.col("leaf") / F.lit(FAN)).cast("bigint"), seed), "mixing")
        parts.append(level.where(f"not ({inside})"))
        rest = level.where(inside)
    # at most one fraction a source is left: a last draw makes it whole
    draw = (F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)) < F.col("p")
    whole = rest.withColumn("p", F.when(draw, 1.0).otherwise(0.0))
    for x in parts:
        whole = whole.unionAll(x)
    return whole.join(sized(due), "s").select("id", "source", "key", "number", (F.floor("due") + F.round("p")).cast("bigint").alias("copies"))


def _key(id_col: str, source_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(id_col).isNull(), F.col(source_col), F.col(source_col).isNull(), F.col(text_col))


def mix_sources(docs: DataFrame, weights: DataFrame, *, total: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows, each as many times as source_copies says; its defined cases hold. Columns as they came, extra ones too, whatever their names.

    The keys of rows that aren't repeated are broadcast if there are few enough and shuffled otherwise; rows that share their
    key with another, as wholly repeated ones do, are numbered by a window first.
    """
    key, number, copies, each, k, n = (free_name(docs, x) for x in ("row_key", "row_number", "copies", "copy", "copy_key", "copy_number"))
    counts = source_copies(docs, weights, total=total, seed=seed, id_col=id_col, source_col=source_col, text_col=text_col)
    counts = written(counts.select(F.col("key").alias(k), F.col("number").alias(n), F.col("copies").alias(copies)), "copies")
    twice = free_name(docs, "repeated_key")
    repeated = written(counts.where(F.col(n) > 1).select(F.col(k).alias(twice)).distinct(), "repeated")
    keyed = docs.withColumn(key, _key(id_col, source_col, text_col))
    some = sized(repeated)
    once = counts.join(some, F.col(k) == F.col(twice), "left_anti").where(F.col(copies) > 0).select(k, copies)
    single = keyed.join(sized(once), F.col(key) == F.col(k))
    more = keyed.join(some, F.col(key) == F.col(twice), "left_semi")
    more = more.withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1))))
    more = more.join(sized(counts.join(some, F.col(k) == F.col(twice), "left_semi").where(F.col(copies) > 0)), (F.col(key) == F.col(k)) & (F.col(number) == F.col(n)))
    out = [x.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns) for x in (single, more)]
    return out[0].unionAll(out[1])
