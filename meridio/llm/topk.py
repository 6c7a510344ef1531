"""Exact top-k search by a three-phase uniform threshold.

A score is the sum of its partial scores over shards of the dimensions; a block of vectors has one list of partial scores a
shard. Vectors are laid out by their nearest of a few pivots, so that a block holds vectors that are close to each other, and a
block knows the centre and radius of what each of its lists holds.

1. For each query the lists of its own block are gathered, the best entries of each are resolved, and the k-th best score among
   them is a safe cutoff: the true k-th can only be higher.
2. Queries and cutoffs are broadcast, in chunks of a fixed size. By the pigeonhole principle an entry that reaches the cutoff
   has a partial score of at least cutoff / shards in some list, the uniform threshold. A block is passed over if the bounds
   of its lists together don't reach the cutoff, and a list isn't opened if its bound doesn't reach the threshold; of the lists
   that are opened, the entries above it are collected. Nothing is multiplied out for blocks and lists that are ruled out.
3. The collected entries' scores are resolved exactly, in double precision; the best k raise the cutoff for the blocks that a
   task meets after, and one shuffle merges the tasks' lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._shared import remove, sized, written

BLOCK = 2048  # vectors of a block at most
SHARDS = 4
PIVOTS = 256  # of the layout at most; a bounded sample, on which no result depends
CHUNK_BYTES = 64 << 20  # of queries that are broadcast at a time
TILE = 2048  # queries of a chunk that are compared with a block at once
SLACK = 1e-5  # what single precision may lose of a score


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """The unit vectors of a list column; short lists are filled up, nulls and non-finite components are 0."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    m = np.zeros((len(n), dim))
    m[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    m[~np.isfinite(m)] = 0.0
    length = np.linalg.norm(m, axis=1, keepdims=True)
    np.divide(m, length, out=m, where=length > 0)
    return m


def _shards(dim: int) -> list[np.ndarray]:
    return np.array_split(np.arange(dim), min(SHARDS, dim))


def _nearest(pivots, dim: int):
    """Rows with the number of their nearest pivot."""

    def run(batches):
        p = pivots.value.astype(np.float32)
        for batch in batches:
            m = _matrix(batch.column(2), dim)
            near = np.concatenate([(m[a : a + 8192].astype(np.float32) @ p.T).argmax(1) for a in range(0, len(m), 8192)] or [np.empty(0, np.int64)])
            unit = pa.array([x.tobytes() for x in m], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), unit], names=["number", "is_query", "pivot", "unit"])

    return run


def _pack(dim: int, most: int = BLOCK):
    """Blocks of rows that come sorted by group: numbers, query marks, vectors, and each list's centre and radius."""
    shards = _shards(dim)

    def block(number, asks, m) -> pa.RecordBatch:
        centre = m.mean(axis=0)
        radius = np.array([np.linalg.norm(m[:, g] - centre[g], axis=1).max() for g in shards])
        parts = number.tobytes(), asks.tobytes(), m.tobytes(), np.concatenate((centre, radius)).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names=["number", "asks", "vectors", "bound"])

    def run(batches):
        held, size, group = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column(0).to_numpy()
            number, asks = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            m = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.float64).reshape(-1, dim)
            cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))).tolist() + [len(of)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and of[a] != group:
                    yield block(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
                group = of[a]
                while a < b:
                    e = min(b, a + most - size)
                    held.append((number[a:e], asks[a:e], m[a:e]))
                    size, a = size + e - a, e
                    if size == most:
                        yield block(*(np.concatenate(x) for x in zip(*held)))
                        held, size = [], 0
        if held:
            yield block(*(np.concatenate(x) for x in zip(*held)))

    return run


def _unpacked(batch: pa.RecordBatch, dim: int):
    for number, asks, vectors, bound in zip(*(c.to_pylist() for c in batch.columns)):
        b = np.frombuffer(bound, np.float64)
        yield np.frombuffer(number, np.int64), np.frombuffer(asks, bool), np.frombuffer(vectors, np.float64).reshape(-1, dim), b[:dim], b[dim:]


def _exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of the pairs (i, j), in double precision and in one order of summation wherever a pair is met."""
    out = np.empty(len(i))
    for a in range(0, len(i), 100_000):
        part = slice(a, a + 100_000)
        out[part] = np.cumsum(q[i[part]] * x[j[part]], axis=1)[:, -1]
    return out


def _best(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each query, smaller row numbers first among equal scores; queries in order."""
    by = np.lexsort((row, -score, query))
    query, row, score = query[by], row[by], score[by]
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.empty(0, np.int64)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    keep = place < k
    return query[keep], row[keep], score[keep]


def cutoffs(x: np.ndarray, asks: np.ndarray, k: int) -> np.ndarray:
    """Phase one: for the vectors of a block that ask, the k-th best exact score among the entries that the block's lists have first; -inf if they are too few."""
    rows = np.flatnonzero(asks)
    n, dim = x.shape
    if n <= k or not k:
        return np.full(len(rows), -np.inf)
    single, out = x.astype(np.float32), []
    for a in range(0, len(rows), TILE):
        own = rows[a : a + TILE]
        listed = []
        for part in _shards(dim):
            s = single[np.ix_(own, part)] @ single[:, part].T
            s[np.arange(len(own)), own] = -np.inf
            listed.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
        j = np.sort(np.concatenate(listed, axis=1), axis=1)
        score = _exact(x, x, np.repeat(own, j.shape[1]), j.ravel()).reshape(j.shape)
        score[:, 1:][j[:, 1:] == j[:, :-1]] = -np.inf  # listed by two shards
        out.append(-np.partition(-score, k - 1, axis=1)[:, k - 1])
    return np.concatenate(out) if out else np.empty(0)


def _asking(dim: int, k: int):
    """The queries of each block with their cutoffs."""

    def run(batches):
        for batch in batches:
            for number, asks, x, _, _ in _unpacked(batch, dim):
                if asks.any():
                    columns = [pa.array(number[asks]), pa.array(cutoffs(x, asks, k)), pa.array([v.tobytes() for v in x[asks]], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["number", "cutoff", "unit"])

    return run


def collect(q: np.ndarray, cut: np.ndarray, x: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase two for one block: the pairs (query, entry) of which some list has at least cutoff / shards, of lists and blocks whose bounds allow it."""
    shards = _shards(x.shape[1])
    bounds = np.stack([q[:, g] @ centre[g] + np.linalg.norm(q[:, g], axis=1) * r for g, r in zip(shards, radius)], 1)
    alive = np.flatnonzero(bounds.sum(1) >= cut - SLACK)
    if not len(alive):
        return alive, alive
    threshold = cut[alive] / len(shards) - SLACK
    y, pairs = x.astype(np.float32), []
    for s, g in enumerate(shards):
        opens = bounds[alive, s] >= threshold
        own = alive[opens]
        if len(own):
            partial = q[np.ix_(own, g)].astype(np.float32) @ y[:, g].T
            i, j = np.nonzero(partial >= threshold[opens].astype(np.float32)[:, None])
            pairs.append(own[i] * len(x) + j)
    pair = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
    return pair // len(x), pair % len(x)


def _search(asked, dim: int, k: int):
    def run(batches):
        own, cut, q = asked.value
        cut = cut.copy()
        held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for batch in batches:
            for number, _, x, centre, radius in _unpacked(batch, dim):
                found = [held]
                for a in range(0, len(own), TILE):
                    i, j = collect(q[a : a + TILE], cut[a : a + TILE], x, centre, radius)
                    i = i + a
                    other = own[i] != number[j]
                    i, j = i[other], j[other]
                    score = _exact(q, x, i, j)
                    keep = score >= cut[i]
                    found.append((i[keep], number[j[keep]], score[keep]))
                if not any(len(f[0]) for f in found[1:]):
                    continue
                held = _best(*(np.concatenate(c) for c in zip(*found)), k)
                last = np.flatnonzero(np.concatenate((held[0][1:] != held[0][:-1], [True])))
                full = np.bincount(held[0], minlength=len(own)) == k
                kth = np.full(len(own), -np.inf)
                kth[held[0][last]] = held[2][last]
                cut = np.where(full, np.maximum(cut, kth), cut)
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(own[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["q", "n", "score"])

    return run


def top_k(vectors: DataFrame, *, k: int = 10, queries: Column | None = None, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, rank, neighbour, score): for every row that meets the condition `queries` (all by default) its k nearest other rows by cosine, exactly.

    Defined cases: rows with a null vector are left out; a vector shorter than the longest is filled up with zeros, as are null
    and non-finite components; zero vectors have score 0 with everything; equal scores rank by identifier, null ones last, then by
    row; repeated rows are rows of their own and each other's neighbours; with fewer than k other rows all of them are
    returned; a condition that is null is not met; `block` is the most vectors a block has; extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    asks = F.lit(True) if queries is None else F.coalesce(queries.cast("boolean"), F.lit(False))
    kept = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), asks.alias("is_query"), F.col(vector_col).alias("v"))
    # row numbers in the order of identifiers, so that ties need no look at them; a hot identifier is split by a hash
    order = [F.col("id").asc_nulls_last(), F.xxhash64("v")]
    rows = kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id())
    rows = written(rows, "vector-rows")
    n, dim, asking = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count_if("is_query")).first()
    schema = T.StructType([vectors.schema[id_col], T.StructField("rank", T.IntegerType()), T.StructField("neighbour", vectors.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    if not n or not asking:
        return spark.createDataFrame([], schema)
    dim = max(dim, 1)
    # a bounded sample for the layout: at most PIVOTS rows, spread by a hash
    most = min(PIVOTS, max(1, n // block))
    sample = rows.select(F.xxhash64("number").alias("h"), F.transform("v", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("v")).orderBy("h").limit(most).collect()
    pivots = spark.sparkContext.broadcast(_matrix(pa.array([r.v for r in sample], pa.list_(pa.float64())), dim))
    near = rows.select("number", "is_query", "v").mapInArrow(_nearest(pivots, dim), "number bigint, is_query boolean, pivot int, unit binary")
    near = written(near, "vector-pivots")
    # a pivot's rows are split evenly over as many groups as they need, however many they are
    groups = near.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / (8 * block)).alias("parts"))  # a row a pivot
    group = F.col("pivot").cast("bigint") * (1 << 40) + F.pmod(F.xxhash64("number"), F.col("parts"))
    spread = near.join(F.broadcast(groups), "pivot").select(group.alias("grp"), "number", "is_query", "unit")
    parts = int(min(max(2 * spark.sparkContext.defaultParallelism, n // (16 * block)), 100_000, max(1, n // 512)))
    spread = spread.repartition(parts, "grp").sortWithinPartitions("grp")
    blocks = written(spread.mapInArrow(_pack(dim, block), "number binary, asks binary, vectors binary, bound binary"), "vector-blocks", codec="lz4")
    wanted = written(blocks.mapInArrow(_asking(dim, k), "number bigint, cutoff double, unit binary"), "vector-queries")
    chunks = -(-asking * (8 * dim + 16) * 2 // CHUNK_BYTES)  # half full on average, so that none is over the bound
    lists = None
    for c in range(chunks):
        own = wanted.where(F.pmod(F.xxhash64("number"), F.lit(chunks)) == c).toArrow()
        if own.num_rows:
            q = np.frombuffer(b"".join(own.column("unit").to_pylist()), np.float64).reshape(-1, dim)
            asked = spark.sparkContext.broadcast((own.column("number").to_numpy(), own.column("cutoff").to_numpy(), q))
            found = written(blocks.mapInArrow(_search(asked, dim, k), "q bigint, n bigint, score double"), "lists")
            lists = found if lists is None else lists.unionAll(found)
            asked.destroy()
    remove(spark, near, blocks, wanted)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "n"))
    best = lists.withColumn("rank", rank).where(F.col("rank") <= k)
    names = rows.select("number", F.col("id").alias("name"))
    best = sized(best, asking * k).join(names.select(F.col("number").alias("n"), F.col("name").alias("neighbour")), "n")
    best = sized(best, asking * k).join(names.select(F.col("number").alias("q"), F.col("name").alias(id_col)), "q")
    return best.select(id_col, "rank", "neighbour", "score")


ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.vec_id, b.vec_id AS neighbour, CASE WHEN a.n * b.n > 0 THEN list_dot_product(a.e, b.e) / (a.n * b.n) ELSE 0 END AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, neighbour) AS rank FROM p)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour, round(s, 6) AS score FROM r WHERE rank <= 10
"""
