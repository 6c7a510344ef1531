"""Term weighting and cosine similarity in long form (key, term, w)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType
from pyspark.sql.window import Window

from ..sources.shared import remove, written
from .dimred import RowMatrix


def term_counts(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, c) of a token array."""
    return docs.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("c"))


def tfidf(counts: DataFrame, key: str, n: DataFrame, *, min_df: int, max_share: float, terms: int, smooth: bool) -> DataFrame:
    """(key, term, w): (1 + ln c) * idf, scaled to length 1 a key.

    The vocabulary has the `terms` terms of the highest document frequency, alphabetically among equals, of those in at least
    min_df documents and in less than max_share of them; n has the one number of documents. idf is ln(N / df), or
    ln((1 + N) / (1 + df)) + 1 if smooth. The vocabulary is bounded by `terms`, so it is broadcast.
    """
    known = _vocabulary(counts.select("term"), n, min_df, max_share, terms, smooth)
    rows = counts.join(F.broadcast(known), "term").withColumn("w", (1 + F.ln("c")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return rows.select(key, "term", F.when(norm > 0, F.col("w") / norm).otherwise(0.0).alias("w"))


def _vocabulary(found: DataFrame, n: DataFrame, min_df: int, max_share: float, terms: int, smooth: bool) -> DataFrame:
    """(term, idf) from a row for each term of each document, as tfidf takes them."""
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n.toDF("n")))
    vocabulary = df.where((F.col("df") >= min_df) & (F.col("df") < max_share * F.col("n"))).orderBy(F.desc("df"), "term").limit(terms)
    return vocabulary.select("term", (F.ln((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1 if smooth else F.ln(F.col("n") / F.col("df"))).alias("idf"))


def tfidf_matrix(docs: DataFrame, key: str, tokens: Column, n: DataFrame, *, min_df: int, max_share: float, terms: int, smooth: bool) -> RowMatrix:
    """The weights of tfidf by rows, one for each key that has a term of the vocabulary; texts are split once, and only document frequencies are shuffled."""
    schema = StructType([docs.schema[key]]).add("term", ArrayType(StringType())).add("c", ArrayType(LongType()))
    counts = written(docs.select(key, tokens.alias("tokens")).mapInArrow(_counted(key), schema), "counts")
    if counts.groupBy(key).count().where("count > 1").limit(1).count():  # texts of one key in several rows
        pairs = counts.select(key, F.explode(F.arrays_zip("term", "c")).alias("e")).groupBy(key, "e.term").agg(F.sum("e.c").alias("c"))
        parts, counts = counts, written(pairs.groupBy(key).agg(F.collect_list(F.struct("term", "c")).alias("e")).select(key, "e.term", "e.c"), "counts")
        remove(docs.sparkSession, parts)
    known = _vocabulary(counts.select(F.explode("term").alias("term")), n, min_df, max_share, terms, smooth).toArrow().sort_by("term")
    names, idf = known["term"].combine_chunks(), known["idf"].to_numpy()

    def weights(batches):
        for b in batches:
            found = pc.index_in(b.column(1).flatten(), value_set=names)
            keep = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            of = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))[keep]
            at, c = found.take(pa.array(keep)).to_numpy(), b.column(2).flatten().to_numpy()[keep]
            w = (1 + np.log(c)) * idf[at]
            norm, lengths = np.sqrt(np.bincount(of, w * w, minlength=b.num_rows))[of], np.bincount(of, minlength=b.num_rows)
            w = np.divide(w, norm, out=np.zeros(len(w)), where=norm > 0)
            ends = pa.array(np.concatenate(([0], np.cumsum(lengths[lengths > 0]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(lengths > 0)), pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(w))], names=[key, "at", "x"])

    schema = StructType([counts.schema[0]]).add("at", ArrayType(IntegerType())).add("x", ArrayType(DoubleType()))
    rows = written(counts.mapInArrow(weights, schema), "svd")
    remove(docs.sparkSession, counts)
    return RowMatrix(rows, names)


def _counted(key: str):
    """For batches of (key, tokens) the different tokens of each row and how often they occur; rows without tokens are left out."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                codes = b.column(1).flatten().dictionary_encode()
                if not len(codes):
                    continue
                names, of = codes.dictionary, np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(1)).fill_null(0).to_numpy())
                pairs, c = np.unique(of * len(names) + codes.indices.to_numpy(), return_counts=True)
                lengths = np.bincount(pairs // len(names), minlength=b.num_rows)
                ends = pa.array(np.concatenate(([0], np.cumsum(lengths[lengths > 0]))).astype(np.int32))
                terms = names.take(pa.array(pairs % len(names)))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(lengths > 0)), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(c))], names=[key, "term", "c"])

    return run


def corpus(docs: DataFrame, key: str, order: str, text: str, *, most: int = 15, chars: int = 250) -> DataFrame:
    """(key, text): the first `most` texts of each key, cut to `chars` characters, joined by blanks in order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    part = docs.withColumn("_k", place).where(F.col("_k") <= most).select(key, "_k", F.substring(text, 1, chars).alias("_t"))
    return part.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_t"))), lambda s: s["_t"]), " ").alias("text"))


def cosine_top_k(vectors: DataFrame, key: str, k: int) -> DataFrame:
    """(a, b, cosine, place): each key's k most similar others, by a join on terms of rows of length 1."""
    a, b = vectors.select(F.col(key).alias("a"), "term", F.col("w").alias("wa")), vectors.select(F.col(key).alias("b"), "term", F.col("w").alias("wb"))
    s = a.join(b, "term").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("place") <= k)
