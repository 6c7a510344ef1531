"""Feature preparation, K-Means, DBSCAN, block-wise summaries and their evaluation, on frames (id, x ARRAY<DOUBLE>)."""

from __future__ import annotations

from itertools import chain, permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from .components import connected_components
from .packing import on_parts, packed, unpacked

#: Distances that a task holds at once; where it only adds them up, so few that they stay in the cache.
CELLS, SUM_CELLS = 2_000_000, 250_000
#: Rows of a block that meets all others, and sums that a task keeps for its block.
BLOCK, TOTALS = 8_192, 4_000_000
#: Centroids beyond which a frame of them isn't broadcast.
MOST_CENTROIDS = 10_000


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def standardised(df: DataFrame, numeric: dict[str, Column], flags: dict[str, Column], categories: dict[str, tuple[Column, list[str]]], *, missing_share: float = 0.05, id_col: str = "id") -> DataFrame:
    """(id, names, x): features with nulls imputed and columns scaled to mean 0 and population deviation 1.

    Numbers take their median for null; flags take 0, and a second column tells missing ones if more than `missing_share` are;
    categories become one column each and one for a missing value. A constant column is 0. The statistics are one pass, and the
    columns are fixed by the arguments and by which flags are often missing.
    """
    raw = df.select(id_col, *(c.cast("double").alias(f"n_{k}") for k, c in numeric.items()), *(c.cast("double").alias(f"f_{k}") for k, c in flags.items()), *(c.alias(f"c_{k}") for k, (c, _) in categories.items()))
    often = raw.agg(*(F.avg(F.col(f"f_{k}").isNull().cast("double")).alias(k) for k in flags), *(F.percentile(f"n_{k}", 0.5).alias(f"m_{k}") for k in numeric)).first()
    columns = {k: F.coalesce(F.col(f"n_{k}"), F.lit(often[f"m_{k}"])) for k in numeric}
    for k in flags:
        columns[k] = F.coalesce(F.col(f"f_{k}"), F.lit(0.0))
        if (often[k] or 0) > missing_share:
            columns[f"{k}_missing"] = F.col(f"f_{k}").isNull().cast("double")
    for k, (_, values) in categories.items():
        columns |= {f"{k}_{v}": F.coalesce((F.col(f"c_{k}") == v).cast("double"), F.lit(0.0)) for v in values} | {f"{k}_missing": F.col(f"c_{k}").isNull().cast("double")}
    names = list(columns)
    wide = raw.select(id_col, *(c.alias(f"x{i}") for i, c in enumerate(columns.values())))
    stats = wide.agg(*(F.struct(F.avg(f"x{i}").alias("mean"), F.stddev_pop(f"x{i}").alias("dev")).alias(f"s{i}") for i in range(len(names))))
    z = [F.when(F.col(f"s{i}.dev") > 0, (F.col(f"x{i}") - F.col(f"s{i}.mean")) / F.col(f"s{i}.dev")).otherwise(0.0) for i in range(len(names))]
    return wide.crossJoin(F.broadcast(stats)).select(id_col, F.array(*(F.lit(n) for n in names)).alias("names"), F.array(*z).alias("x"))


def assign(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """points with `cluster` and `d2`: the nearest centroid of (cluster, c), the lower number on a tie."""
    all_c = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster", "c"))).alias("_cs"))
    best = F.array_min(F.transform("_cs", lambda k: F.struct(squared_distance(F.col("x"), k["c"]).alias("d2"), k["cluster"].alias("cluster"))))
    return points.crossJoin(F.broadcast(all_c)).withColumn("_b", best).select(*points.columns, F.col("_b.cluster").alias("cluster"), F.col("_b.d2").alias("d2"))


def centroids_of(assigned: DataFrame) -> DataFrame:
    """(cluster, c, n): means of each cluster's points; labels below 0 are noise."""
    dims = assigned.where("cluster >= 0").select("cluster", F.posexplode("x").alias("k", "v")).groupBy("cluster", "k").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return dims.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("c"), F.max("n").alias("n"))


def sse(assigned: DataFrame) -> DataFrame:
    return assigned.where("cluster >= 0").agg(F.sum("d2").alias("sse"))


def plus_plus_many(points: DataFrame, k: int, seeds: list[int]) -> dict[int, np.ndarray]:
    """K-Means++ starting centroids for each seed, a pass over the points for each of the k draws.

    Each draw takes the point with the smallest -ln(u) / d2, u being a hash of its id and the draw (an exponential race), so no
    prefix sums are needed; without distances left there are fewer than k centroids. A task sends one point a seed.
    """
    chosen: dict[int, list] = {s: [] for s in seeds}
    for j in range(k):
        have = {s: np.array(c, float) for s, c in chosen.items() if len(c) == j}
        if not have:
            break
        u = [((F.pmod(F.xxhash64(F.col("id"), F.lit(s + j)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)).alias(f"u{i}") for i, s in enumerate(have)]
        best = points.select("id", "x", *u).mapInArrow(_race(list(have.values())), "seed int, race double, id bigint, x array<double>")
        for r in best.groupBy("seed").agg(F.min(F.struct("race", "id", "x")).alias("b")).collect():
            chosen[list(have)[r.seed]].append(list(r.b.x))
    return {s: np.array(c, float) for s, c in chosen.items()}


def _race(centres: list[np.ndarray]):
    def run(batches):
        best: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, ids = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for s, c in enumerate(centres):
                near = distances2(x, c).min(1) if len(c) else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    race = np.where(near > 0, -np.log(batch.column(2 + s).to_numpy()) / near, np.inf)
                i = np.lexsort((ids, race))[0]
                if np.isfinite(race[i]):
                    best[s] = min(best.get(s, (np.inf,)), (float(race[i]), int(ids[i]), x[i].tolist()))
        if best:
            columns = [pa.array(v, t) for v, t in zip(zip(*((s, *b) for s, b in best.items())), (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["seed", "race", "id", "x"])

    return run


def plus_plus(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(cluster, c): K-Means++ starting centroids, as plus_plus_many draws them."""
    return _frame(points.sparkSession, plus_plus_many(points, k, [seed])[seed])


def _frame(spark, centres: np.ndarray, names=None) -> DataFrame:
    names = range(len(centres)) if names is None else names
    return spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(names, centres)], "cluster int, c array<double>")


def lloyd(points: DataFrame, starts: list[np.ndarray], *, iterations: int = 100, tol: float | None = 1e-4) -> list[tuple[np.ndarray, list[float]]]:
    """Centroids and the history of the sum of squared errors for each start; all that haven't converged share each pass over the points.

    A run ends when no centroid moves by tol or more (never, if tol is None). An empty cluster takes the farthest point of that
    round, the same for all empty ones. In a pass tasks add up their points by cluster; centroids are a few rows a start, so they
    alone come to the driver.
    """
    if sum(map(len, starts)) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    held = points.select("id", "x").persist(StorageLevel.MEMORY_AND_DISK)
    centres, history, going = [np.array(s, float) for s in starts], [[] for _ in starts], list(range(len(starts)))
    for _ in range(iterations):
        after = []
        for i, (sums, n, error, far) in zip(going, _lloyd_sums(held, [centres[i] for i in going])):
            history[i].append(error)
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], far)
            moved = float(np.linalg.norm(new - centres[i], axis=1).max())
            centres[i] = new
            if tol is None or moved >= tol:
                after.append(i)
        going = after
        if not going:
            break
    held.unpersist()
    return list(zip(centres, history))


def kmeans(points: DataFrame, start: DataFrame, *, iterations: int = 100, tol: float | None = 1e-4) -> tuple[DataFrame, DataFrame, list[float]]:
    """(assigned points, centroids, history of the sum of squared errors) by Lloyd's algorithm from the given centroids, as lloyd runs it."""
    names, first = zip(*sorted((r.cluster, list(r.c)) for r in start.limit(MOST_CENTROIDS + 1).collect()))
    (centres, history), = lloyd(points, [np.array(first, float)], iterations=iterations, tol=tol)
    frame = _frame(points.sparkSession, centres, names)
    return assign(points, frame), frame, history


def _lloyd_sums(points: DataFrame, sets: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float, np.ndarray]]:
    """For each set of centroids the sums and numbers of the points nearest to each, the sum of squared distances and the farthest point."""
    dim = sets[0].shape[1]

    def run(batches):
        state = [[np.zeros((len(c), dim)), np.zeros(len(c), np.int64), 0.0, (-1.0, 0, [])] for c in sets]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _rows(batch.column(1), dim), batch.column(0).to_numpy(zero_copy_only=False)
            for own, centres in zip(state, sets):
                d = distances2(x, centres)
                label = d.argmin(1)
                d = d[np.arange(len(x)), label]
                one = np.zeros((len(centres), len(x)))
                one[label, np.arange(len(x))] = 1.0
                own[0] += one @ x
                own[1] += np.bincount(label, minlength=len(centres))
                own[2] += d.sum()
                i = min(np.flatnonzero(d == d.max()), key=lambda i: ids[i])
                own[3] = max(own[3], (float(d[i]), -int(ids[i]), x[i].tolist()))
        rows = [(k, int(c), int(n[c]), s[c].tolist(), error if c == np.flatnonzero(n)[0] else 0.0, *far) for k, (s, n, error, far) in enumerate(state) for c in np.flatnonzero(n)]
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=["k", "cluster", "n", "s", "error", "far", "id", "x"])

    parts = points.mapInArrow(run, "k int, cluster int, n bigint, s array<double>, error double, far double, id bigint, x array<double>")
    summed = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim)]
    rows = parts.groupBy("k", "cluster").agg(F.sum("n").alias("n"), F.sum("error").alias("error"), F.max(F.struct("far", "id", "x")).alias("best"), *summed).collect()
    out = []
    for k, centres in enumerate(sets):
        own = [r for r in rows if r.k == k]
        sums, n = np.zeros((len(centres), dim)), np.zeros(len(centres), np.int64)
        for r in own:
            n[r.cluster] = r.n
            sums[r.cluster] = r[5:]
        out.append((sums, n, float(sum(r.error for r in own)), np.array(max(r.best for r in own).x)))
    return out


def _rows(lists: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def k_sweep(points: DataFrame, ks: list[int], seed: int = 42, iterations: int = 100) -> DataFrame:
    """(k, iterations, sse, sse_per_point, smallest, largest, silhouette) for each k, run until it converges; silhouettes are over all points.

    The first draws of K-Means++ are the same for every k, and all k share each pass and the distances of all pairs, which their
    silhouettes need.
    """
    spark, rows = points.sparkSession, []
    first = plus_plus_many(points, max(ks), [seed])[seed]
    runs = lloyd(points, [first[:k] for k in ks], iterations=iterations)
    sets = [centres for centres, _ in runs]
    ends = _lloyd_sums(points, sets)
    labelled = points.select("id", "x").mapInArrow(_nearest(sets), "id bigint, x array<double>, clusters array<int>")
    shapes = _silhouettes(labelled, None, [np.flatnonzero(n) for _, n, _, _ in ends]).agg(*(F.avg(F.col("s")[i]) for i in range(len(ks)))).first()
    for k, (_, history), (_, n, e, _), shape in zip(ks, runs, ends, shapes):
        n = n[n > 0]
        rows.append((k, len(history), e, e / int(n.sum()), int(n.min()), int(n.max()), shape))
    return spark.createDataFrame(rows, "k int, iterations int, sse double, sse_per_point double, smallest bigint, largest bigint, silhouette double")


def _nearest(sets: list[np.ndarray]):
    """For batches of (id, x) the number of the nearest centroid of each set, the lower one on a tie."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(1), sets[0].shape[1]).astype(float)
                label = np.stack([distances2(x, c).argmin(1) for c in sets], 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(x), _lists(label)], names=["id", "x", "clusters"])

    return run


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.ravel())


def elbow(curve: DataFrame, x: str, y: str) -> DataFrame:
    """(x, distance): the point farthest from the chord of the normalised curve."""
    w = Window.partitionBy()
    nx = (F.col(x) - F.min(x).over(w)) / (F.max(x).over(w) - F.min(x).over(w))
    ny = (F.col(y) - F.min(y).over(w)) / (F.max(y).over(w) - F.min(y).over(w))
    p = curve.select(F.col(x), nx.alias("nx"), ny.alias("ny"))
    first, last = (p.agg(getattr(F, f)(F.struct("nx", "ny")).alias(a)) for f, a in (("min", "a"), ("max", "b")))
    d = F.abs((F.col("b.nx") - F.col("a.nx")) * (F.col("a.ny") - F.col("ny")) - (F.col("a.nx") - F.col("nx")) * (F.col("b.ny") - F.col("a.ny")))
    d = d / F.sqrt(F.pow(F.col("b.nx") - F.col("a.nx"), 2) + F.pow(F.col("b.ny") - F.col("a.ny"), 2))
    return p.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(last)).select(x, d.alias("distance")).orderBy(F.desc("distance"), x).limit(1)


def _dimension(points: DataFrame) -> int:
    first = points.select(F.size("x")).first()
    return first[0] if first else 1


def _blocks(n: int, block: int) -> int:
    """How many blocks of about `block` rows n rows make; smaller ones for a few tasks, if there are only a few rows."""
    return max(-(-n // block), min(24, -(-n // 500)), 1)


def against_all(points: DataFrame, fold, schema: str, *, left: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """fold(the columns of a block of one frame, an iterator of the columns of all blocks of the other) in a task for each block of the first.

    Frames are (id, x and others) and split into blocks of about `block` rows at most. The other frame's blocks are a table in the
    shared folder, which each task reads one after the other: a row is written twice at any number of blocks, and a task holds a
    few blocks and what fold keeps for its own.
    """
    def blocks(df: DataFrame) -> tuple[DataFrame, int]:
        n = _blocks(df.count(), block)
        others = [c for c in df.columns if c != "id"]
        return written(packed(df.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("b"), "id", *others), "b", ["id"]), "blocks", "uncompressed"), n

    every, n = blocks(points)
    own, parts = (every, n) if left is None else blocks(left)

    def run(batches):
        rows = ((a, b) for batch in batches for a, b in zip(batch.column(0), batch.column(1)))
        first = next(rows, None)
        if first is not None:
            others = (unpacked([b.as_py()]) for _, b in chain([first], rows))
            yield from fold(unpacked([first[0].as_py()]), others)

    # the smaller side of a product is held by a task, here its one block; the other is streamed
    mine = own.select(F.col("b"), F.col("blob").alias("own")).repartitionById(parts, F.col("b")).select("own")
    pairs = every.select(F.col("blob").alias("other")).coalesce(1).hint("shuffle_replicate_nl").crossJoin(mine)
    return pairs.select("own", "other").mapInArrow(run, schema)


def blocked_pairs(points: DataFrame, reduce, schema: str, *, left: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """reduce(ids a, matrix a, labels a, ids b, matrix b, labels b) over some rows of one frame (id, x[, cluster]) and a block of the other.

    It is given a few rows of the first at a time and puts together a whole block of the other.
    """
    none = np.empty(0, np.int64)

    def fold(a, others):
        for b in others:
            step = max(1, CELLS // len(b["id"]))
            for k in range(0, len(a["id"]), step):
                s = slice(k, k + step)
                out = reduce(a["id"][s], a["x"][s], a.get("cluster", none)[s], b["id"], b["x"], b.get("cluster", none))
                if len(out):
                    yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    def side(df: DataFrame) -> DataFrame:
        return df.select("id", F.col("x").cast("array<double>").alias("x"), *(["cluster"] if "cluster" in df.columns else []))

    return against_all(side(points), fold, schema, left=None if left is None else side(left), block=block)


def distances2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by direct differences in slices, exact where points coincide."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = ((a[i : i + step, None, :] - b[None, :, :]) ** 2).sum(-1)
    return out


def products2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product; rounding may leave coinciding points a trace apart."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.maximum(d, 0.0, out=d)


def silhouette(labelled: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """(id, cluster, s): silhouettes by Euclidean distance against all points that are no noise; a point alone in its cluster has 1; with fewer than two clusters there are none."""
    points = labelled.where("cluster >= 0").select("id", F.col("x").cast("array<double>").alias("x"), F.array(F.col("cluster").cast("int")).alias("clusters"))
    left = None if sample is None else points.join(sample.select("id"), "id", "left_semi")
    kinds = np.array(sorted(r.cluster for r in points.select(F.col("clusters")[0].alias("cluster")).distinct().collect()), np.int64)
    return _silhouettes(points, left, [kinds]).select("id", F.col("clusters")[0].alias("cluster"), F.col("s")[0].alias("s")).where("s is not null")


def _silhouettes(points: DataFrame, left: DataFrame | None, kinds: list[np.ndarray]) -> DataFrame:
    """(id, clusters, s): for points of (id, x, clusters), which has a label for each of several clusterings, a silhouette for each; null where there is one cluster only.

    kinds has the labels of each clustering in order. A task keeps its points' sums of distances to each cluster, so none are
    shuffled; blocks are smaller where there are many clusters.
    """
    many = sum(map(len, kinds))
    starts = np.cumsum([0, *map(len, kinds)])

    def columns(clusters: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(k, clusters[:, i]) for i, k in enumerate(kinds)], 1) + starts[:-1]

    def fold(a, others):
        x, own = a["x"], columns(a["clusters"])
        total, n, xx = np.zeros((len(x), many)), np.zeros(many), (x * x).sum(1)[:, None]
        for b in others:
            y, at = b["x"], columns(b["clusters"])
            member = np.zeros((len(y), many))
            member[np.arange(len(y))[:, None], at] = 1.0
            n += member.sum(0)
            twice, yy = -2 * y.T, (y * y).sum(1)
            step = max(1, SUM_CELLS // len(y))
            for k in range(0, len(x), step):
                d = x[k : k + step] @ twice
                d += xx[k : k + step]
                d += yy
                np.sqrt(np.maximum(d, 0.0, out=d), out=d)
                total[k : k + step] += d @ member
        out = np.full((len(x), len(kinds)), np.nan)
        rows = np.arange(len(x))
        for i, (s, e) in enumerate(zip(starts[:-1], starts[1:])):
            if e - s > 1:
                alone = n[own[:, i]] <= 1
                near = np.where(alone, 0.0, total[rows, own[:, i]] / np.maximum(n[own[:, i]] - 1, 1))
                mean = total[:, s:e] / n[s:e]
                mean[rows, own[:, i] - s] = np.inf
                far = mean.min(1)
                most = np.maximum(near, far)
                out[:, i] = np.where(most > 0, (far - near) / np.where(most > 0, most, 1), 0.0)
        s = pa.ListArray.from_arrays(_lists(out).offsets, pa.array(out.ravel(), from_pandas=True))
        yield pa.RecordBatch.from_arrays([pa.array(a["id"]), _lists(a["clusters"]), s], names=["id", "clusters", "s"])

    block = max(1, min(BLOCK, TOTALS // max(many, 1)))
    return against_all(points, fold, "id bigint, clusters array<int>, s array<double>", left=left, block=block)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def purity_nmi(df: DataFrame, cluster: str, truth: str) -> DataFrame:
    """(n, purity, nmi) of labels, noise (below 0) left out; NMI is 0 where both entropies are."""
    c = contingency(df.where(F.col(cluster) >= 0), cluster, truth)
    total = F.sum("n").over(Window.partitionBy())
    c = c.withColumns({"all": total, "na": F.sum("n").over(Window.partitionBy(cluster)), "nb": F.sum("n").over(Window.partitionBy(truth)), "top": F.max("n").over(Window.partitionBy(cluster))})
    p, pa, pb = (F.col(x) / F.col("all") for x in ("n", "na", "nb"))
    # each cluster's and each class's term is spread over its cells
    sums = c.agg(F.max("all").alias("n"), F.sum(p * F.ln(p / (pa * pb))).alias("mi"), (-F.sum(p * F.ln(pa))).alias("ha"), (-F.sum(p * F.ln(pb))).alias("hb"), F.sum(F.col("top") / F.col("all") * F.col("n") / F.col("na")).alias("purity"))
    return sums.select("n", "purity", F.when(F.col("ha") + F.col("hb") > 0, 2 * F.col("mi") / (F.col("ha") + F.col("hb"))).otherwise(0.0).alias("nmi"))


def k_distance(points: DataFrame, k: int) -> DataFrame:
    """(id, d): each point's distance to its k-th nearest other point, k cut to the number of others."""

    def nearest(a, others):
        ids, x = a["id"], a["x"]
        best = np.full((len(ids), k), np.inf)
        for b in others:
            y, step = b["x"], max(1, CELLS // len(b["id"]))
            for i in range(0, len(ids), step):
                s = slice(i, i + step)
                d = products2(x[s], y)
                d[ids[s][:, None] == b["id"][None, :]] = np.inf
                m = min(k, d.shape[1])
                at = np.argpartition(d, m - 1, axis=1)[:, :m]
                exact = ((x[s][:, None, :] - y[at]) ** 2).sum(-1)  # for the ones that count
                exact[~np.isfinite(np.take_along_axis(d, at, 1))] = np.inf
                best[s] = np.sort(np.concatenate((best[s], exact), 1), 1)[:, :k]
        last = np.isfinite(best).sum(1) - 1
        keep = last >= 0
        d = np.sqrt(best[np.arange(len(ids)), last])
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(d[keep])], names=["id", "d"])

    return against_all(points.select("id", F.col("x").cast("array<double>").alias("x")), nearest, "id bigint, d double")


def _within_eps(left: DataFrame, right: DataFrame, eps: float, work, schema: str, *, block: int = 32_768, half: bool = False) -> DataFrame:
    """work(rows a, rows b, their pairs within eps as places (i, j) in slices) for pairs of blocks of two frames (id, x, ...), in tasks.

    Points are put into bins by their projection on the main axis of a bounded sample, on which no result depends; projections
    shorten distances, so only bins within eps of each other can hold pairs. Bins are split by a hash into blocks of about `block` rows
    at most. In a task a second axis prunes as well. With half each two blocks meet once, for frames that are the same.
    """
    dim = _dimension(right)
    sample = np.array([r.x for r in right.orderBy(F.xxhash64("id")).limit(1000).select("x").collect()], float).reshape(-1, dim)
    axes = np.linalg.svd(sample - sample.mean(0), full_matrices=False)[2][:2] if len(sample) else np.eye(dim)[:2]
    n = max(left.count(), right.count())
    bins = max(-(-n // block), min(6, -(-n // 500)), 1)
    cuts = np.quantile(sample @ axes[0], np.arange(1, bins) / bins) if len(sample) and bins > 1 else np.empty(0)
    terms = F.zip_with("x", F.array(*(F.lit(float(v)) for v in axes[0])), lambda x, v: x * v)
    place = F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)
    edges = F.array(*(F.lit(float(c)) for c in cuts)).cast("array<double>")

    def binned(df: DataFrame):
        rows = written(df.withColumn("x", F.col("x").cast("array<double>")).withColumn("p", place).withColumn("bin", F.size(F.filter(edges, lambda c: c <= F.col("p")))), "bins")
        sizes = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("low"), F.max("p").alias("high")).collect()
        blocks = [(r.bin, k, r.low, r.high) for r in sorted(sizes) for k in range(-(-r.n // block))]
        pieces = rows.sparkSession.createDataFrame([(r.bin, -(-r.n // block)) for r in sizes], "bin int, pieces bigint")
        first = rows.sparkSession.createDataFrame([(b, k, at) for at, (b, k, *_) in enumerate(blocks)], "bin int, piece bigint, b int")
        numbered = rows.join(F.broadcast(pieces), "bin").withColumn("piece", F.pmod(F.xxhash64("id"), "pieces")).join(F.broadcast(first), ["bin", "piece"])
        return written(packed(numbered.select("b", *df.columns, "p"), "b", ["id"]), "blocks"), blocks

    (a, own), (b, others) = binned(left), binned(right)
    # a hair wider than eps, so that rounding of projections can't push a pair apart
    width = eps * (1 + 1e-9) + 1e-12 * (1 + max((abs(v) for x in own + others for v in x[2:]), default=0.0))
    pairs = [(i, j) for i, x in enumerate(own) for j, y in enumerate(others) if x[2] <= y[3] + width and y[2] <= x[3] + width and not (half and j < i)]

    def side(blobs: DataFrame, of: int) -> DataFrame:
        parts = blobs.sparkSession.createDataFrame([(x[of], k) for k, x in enumerate(pairs)], "b int, part int")
        return blobs.join(F.broadcast(parts), "b").select("part", "blob")

    def run(sides):
        x, y = sides
        if x is not None and y is not None:
            yield from work(x, y, _close(x, y, eps, width, axes[-1]))

    return on_parts([side(a, 0), side(b, 1)], max(1, len(pairs)), run, schema)


def _close(a: dict, b: dict, eps: float, width: float, axis: np.ndarray, rows: int = 256):
    """The places (i, j) of the pairs of rows of a and b within eps, in slices."""
    qa, qb = a["x"] @ axis, b["x"] @ axis
    along = np.argsort(b["p"], kind="stable")
    sorted_p = b["p"][along]
    order = np.lexsort((qa, np.floor(a["p"] / width))) if width > 0 else np.argsort(a["p"])
    step = max(1, min(rows, CELLS // len(along)))
    for k in range(0, len(order), step):
        i = order[k : k + step]
        near = along[np.searchsorted(sorted_p, a["p"][i].min() - width) : np.searchsorted(sorted_p, a["p"][i].max() + width, "right")]
        near = near[(qb[near] >= qa[i].min() - width) & (qb[near] <= qa[i].max() + width)]
        if not len(near):
            continue
        r, c = np.nonzero(products2(a["x"][i], b["x"][near]) <= eps * eps * (1 + 1e-9) + 1e-9)
        r, c = i[r], near[c]
        keep = np.concatenate([((a["x"][r[s : s + 100_000]] - b["x"][c[s : s + 100_000]]) ** 2).sum(1) <= eps * eps for s in range(0, len(r), 100_000)] or [np.empty(0, bool)])
        yield r[keep], c[keep]


def eps_pairs(points: DataFrame, eps: float, *, block: int = 32_768) -> DataFrame:
    """(src, dst): all ordered pairs within eps of each other, each point with itself too."""

    def work(a, b, pairs):
        for i, j in pairs:
            yield pa.RecordBatch.from_arrays([pa.array(a["id"][i]), pa.array(b["id"][j])], names=["src", "dst"])

    rows = points.select(F.col("id").cast("bigint").alias("id"), "x")
    return _within_eps(rows, rows, eps, work, "src bigint, dst bigint", block=block)


def _counted(a, b, pairs):
    n = np.zeros(len(a["id"]), np.int64)
    for i, _ in pairs:
        n += np.bincount(i, minlength=len(n))
    yield pa.RecordBatch.from_arrays([pa.array(a["id"][n > 0]), pa.array(n[n > 0])], names=["id", "n"])


def _linked(a, b, pairs):
    """Each point that has a pair with a root of its component within the two blocks: at most one edge a point."""
    ids, at = np.unique(np.concatenate((a["id"], b["id"])), return_inverse=True)
    root, seen = np.arange(len(ids)), np.zeros(len(ids), bool)
    for i, j in pairs:
        u, v = at[i], at[len(a["id"]) + j]
        seen[u] = seen[v] = True
        u, v = root[u], root[v]
        code = np.unique((np.minimum(u, v) * len(ids) + np.maximum(u, v))[u != v])
        for x, y in zip((code // len(ids)).tolist(), (code % len(ids)).tolist()):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(ids[seen]), pa.array(ids[root[seen]])], names=["src", "dst"])


def _nearest_cluster(a, b, pairs):
    best = np.full(len(a["id"]), np.iinfo(np.int32).max, np.int32)
    for i, j in pairs:
        np.minimum.at(best, i, b["cluster"][j])
    some = best < np.iinfo(np.int32).max
    yield pa.RecordBatch.from_arrays([pa.array(a["id"][some]), pa.array(best[some])], names=["id", "near"])


def dbscan(points: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """(id, is_core, cluster): exact DBSCAN; clusters are numbered by their least core id, a border point joins the lowest of its clusters, noise is -1.

    Pairs within eps are counted, linked and looked through in the tasks that find them; they leave them as one row a point and block.
    """
    points = points.select(F.col("id").cast("bigint").alias("id"), "x")
    n = _within_eps(points, points, eps, _counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    core = written(n.where(F.col("n") >= min_pts).select("id"), "core")
    cores = points.join(core, "id", "left_semi")
    comps = connected_components(written(_within_eps(cores, cores, eps, _linked, "src bigint, dst bigint", half=True), "links"))
    number = comps.select("component").distinct().withColumn("cluster", (F.row_number().over(Window.orderBy("component")) - 1).cast("int"))
    of_core = written(comps.join(number, "component").select("id", "cluster"), "clusters")
    border = _within_eps(points.join(core, "id", "left_anti"), points.join(of_core, "id"), eps, _nearest_cluster, "id bigint, near int").groupBy("id").agg(F.min("near").alias("near"))
    rows = points.select("id").join(of_core, "id", "left").join(border, "id", "left")
    return rows.select("id", F.col("cluster").isNotNull().alias("is_core"), F.coalesce("cluster", "near", F.lit(-1)).alias("cluster"))


def summaries(labelled: DataFrame) -> DataFrame:
    """(cluster, k, n, s, ss, mean, var): count, sum and sum of squares of each cluster and dimension, closed under adding; variance is at least 1e-6."""
    d = labelled.where("cluster >= 0").select("cluster", F.posexplode("x").alias("k", "v")).groupBy("cluster", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    mean = F.col("s") / F.col("n")
    return d.withColumns({"mean": mean, "var": F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(1e-6))})


def mahalanobis_assign(points: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, cluster, distance): the nearest summary by diagonal Mahalanobis distance, the lower number on a tie."""
    one = stats.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("k", "mean", "var"))).alias("m"))
    every = one.agg(F.array_sort(F.collect_list(F.struct("cluster", "m"))).alias("_s"))

    def distance(s: Column) -> Column:
        terms = F.zip_with(F.col("x"), s["m"], lambda v, m: (v - m["mean"]) * (v - m["mean"]) / m["var"])
        return F.struct(F.sqrt(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)).alias("distance"), s["cluster"].alias("cluster"))

    best = F.array_min(F.transform("_s", distance))
    return points.crossJoin(F.broadcast(every)).select("id", best.alias("b")).select("id", "b.cluster", "b.distance")


class _Sum:
    """Sufficient statistics of a set of points."""

    def __init__(self, x: np.ndarray):
        self.n, self.s, self.ss = len(x), x.sum(0), (x * x).sum(0)

    def add(self, o: "_Sum") -> None:
        self.n, self.s, self.ss = self.n + o.n, self.s + o.s, self.ss + o.ss

    def merged(self, o: "_Sum") -> "_Sum":
        out = _Sum(np.zeros((0, len(self.s))))
        out.add(self)
        out.add(o)
        return out

    @property
    def mean(self):
        return self.s / max(self.n, 1)

    @property
    def var(self):
        return np.maximum(self.ss / max(self.n, 1) - self.mean**2, 1e-6)

    def distance(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt((((x - self.mean) ** 2) / self.var).sum(-1))


def _lloyd(x: np.ndarray, k: int, rounds: int = 60) -> np.ndarray:
    rng, c = np.random.default_rng(42), x[:1]
    while len(c) < min(k, len(x)):  # K-Means++ draws; fewer centroids where points coincide
        near = distances2(x, c).min(1)
        if not near.sum():
            break
        c = np.vstack((c, x[rng.choice(len(x), p=near / near.sum())]))
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        new = distances2(x, c).argmin(1)
        if (new == label).all() and _:
            break
        label = new
        c = np.vstack([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(len(c))])
    return label


class BfrState:
    """Discard, compressed and retained sets between blocks; a block is assigned against the summaries as they stood before it."""

    def __init__(self, k: int, min_cs: int = 10):
        self.k, self.min_cs, self.ds, self.cs, self.rs = k, min_cs, [], [], []

    def feed(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Labels of the block's points: their discard set, or -1 as yet."""
        d = x.shape[1]
        label = np.full(len(x), -1)
        if not self.ds:
            first = _lloyd(x, self.k)
            self.ds = [_Sum(x[first == j]) for j in np.unique(first)]
            return np.searchsorted(np.unique(first), first)
        m = np.stack([s.distance(x) for s in self.ds], 1)
        near = m.min(1) <= 2 * np.sqrt(d)
        label[near] = m.argmin(1)[near]
        for j in np.unique(label[near]):
            self.ds[j].add(_Sum(x[label == j]))
        rest = x[~near]
        if len(self.cs) and len(rest):
            m = np.stack([s.distance(rest) for s in self.cs], 1)
            ok, at = m.min(1) <= 1.5 * np.sqrt(d), m.argmin(1)
            for j in np.unique(at[ok]):
                self.cs[j].add(_Sum(rest[ok & (at == j)]))
            rest = rest[~ok]
        self.rs.extend(rest)
        if len(self.rs) >= max(2 * self.k, 2 * self.min_cs):
            r = np.vstack(self.rs)
            parts = _lloyd(r, self.k)
            self.rs = []
            for j in np.unique(parts):
                own = r[parts == j]
                if len(own) >= self.min_cs:
                    self.cs.append(_Sum(own))
                else:
                    self.rs.extend(own)
        merged = True
        while merged:
            merged = False
            for i in range(len(self.cs)):
                for j in range(i + 1, len(self.cs)):
                    if self.cs[i].merged(self.cs[j]).distance(self.cs[i].mean) <= 1.5 * np.sqrt(d) and self.cs[i].distance(self.cs[j].mean) <= 1.5 * np.sqrt(d):
                        self.cs[i] = self.cs[i].merged(self.cs.pop(j))
                        merged = True
                        break
                if merged:
                    break
        return label


def bfr(points: DataFrame, k: int, *, chunk: int = 4000, min_cs: int = 10) -> DataFrame:
    """(id, cluster): Bradley-Fayyad-Reina in one ordered pass; -1 for points that no cluster takes in.

    Blocks are formed in the order of a hash of the ids. The pass is sequential by nature, so one task holds the state, which
    is a few sums a cluster, and one block; points that were put aside get the nearest set within 2 sqrt(d) at the end.
    """
    ordered = points.select("id", "x").withColumn("_h", F.xxhash64("id")).repartitionByRange(1, "_h").sortWithinPartitions("_h", "id").drop("_h")

    def run(batches):
        state, held, aside = BfrState(k, min_cs), [], []

        def blocks():
            for b in batches:
                held.append(b)
                while sum(map(len, held)) >= chunk:
                    whole = pd.concat(held)
                    held.clear()
                    held.append(whole.iloc[chunk:])
                    yield whole.iloc[:chunk]
            if held and sum(map(len, held)):
                yield pd.concat(held)

        for b in blocks():
            ids, x = b["id"].to_numpy(), np.vstack(b["x"])
            label = state.feed(ids, x)
            yield pd.DataFrame({"id": ids[label >= 0], "cluster": label[label >= 0]})
            aside.append((ids[label < 0], x[label < 0]))
        for ids, x in aside:
            if len(ids):
                m = np.stack([s.distance(x) for s in state.ds], 1)
                yield pd.DataFrame({"id": ids, "cluster": np.where(m.min(1) <= 2 * np.sqrt(x.shape[1]), m.argmin(1), -1)})

    return ordered.mapInPandas(run, "id bigint, cluster int")


def align_labels(table: list[tuple[int, int, int]], most: int = 8) -> tuple[dict[int, int], float]:
    """The renaming of the first labels that agrees best with the second, and the share of agreement, from contingency rows (a, b, n) of at most `most` labels."""
    a, b = sorted({r[0] for r in table}), sorted({r[1] for r in table})
    if max(len(a), len(b)) > most:
        raise ValueError(f"more than {most} labels")
    n = {(x, y): c for x, y, c in table}
    b = b + [None] * (len(a) - len(b))
    best = max(permutations(b, len(a)), key=lambda p: sum(n.get((x, y), 0) for x, y in zip(a, p)))
    return dict(zip(a, best)), sum(n.get((x, y), 0) for x, y in zip(a, best)) / max(1, sum(n.values()))


def cluster_profile(labelled: DataFrame, measures: list[str], kinds: list[str]) -> DataFrame:
    """(cluster, size, share, mean_*, median_*, top_*, top_share_*): noise is the row -1."""
    total = F.sum(F.count(F.lit(1))).over(Window.partitionBy())
    out = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.round(F.count(F.lit(1)) / total, 6).alias("share"),
                                          *(F.round(F.avg(m), 6).alias(f"mean_{m}") for m in measures), *(F.round(F.percentile(m, 0.5), 6).alias(f"median_{m}") for m in measures))
    for k in kinds:
        n = labelled.where(F.col(k).isNotNull()).groupBy("cluster", k).agg(F.count(F.lit(1)).alias("n"))
        n = n.withColumn("s", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("cluster")), 6)).withColumn("p", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), k)))
        out = out.join(n.where("p = 1").select("cluster", F.col(k).alias(f"top_{k}"), F.col("s").alias(f"top_share_{k}")), "cluster", "left")
    return out
