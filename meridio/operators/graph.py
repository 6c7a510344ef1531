"""Graph operators on edge frames (src, dst[, w]): ranking, distances, co-occurrence graphs, communities.

Rounds of PageRank and HITS read edges that are packed once, by number of node, and pass scores of up to HELD_NODES nodes through
the driver. Beyond that they keep ranks and edges as frames and write the ranks to the shared folder every round, which cuts the
lineage and outlives lost executors; only convergence scalars reach the driver. Betweenness, Girvan-Newman and greedy merging are for
graphs of a few hundred nodes by their cost, as everywhere; they run in tasks, not on the driver.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import remove, written
from .packing import packed, unpacked
from .relational import average_ranks

HELD_NODES = 20_000_000  # nodes up to which a round's scores, 8 bytes a node, pass through the driver
SMALL_NODES = 100_000  # nodes up to which their scores are broadcast: about 4 MB as a hash relation


def symmetrised(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; repeated edges stay repeated."""
    return edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, the smaller end first; loops are dropped."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def within_universe(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes (id)."""
    a, b = (nodes.select(F.col("id").alias(x)) for x in ("src", "dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select(*edges.columns)


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of all nodes, 0 included."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    d = ends.groupBy("x.id").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def directed_diagnostics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(n, m, n_drop, reciprocity, p50, p90, p99, isolated, dead_ends) in one row; percentiles of positive out-degrees, cut to integers."""
    inside = within_universe(edges, nodes)
    back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct().withColumn("back", F.lit(1.0))
    mutual = inside.join(back, ["src", "dst"], "left").agg(F.count(F.lit(1)).alias("m"), F.round(F.avg(F.coalesce("back", F.lit(0.0))), 6).alias("reciprocity"))
    positive = F.when(F.col("out_degree") > 0, F.col("out_degree"))
    p = [F.floor(F.coalesce(F.percentile(positive, x), F.lit(0.0))).alias(f"p{int(x * 100)}") for x in (0.5, 0.9, 0.99)]
    d = degrees(inside, nodes).agg(F.count(F.lit(1)).alias("n"), *p, F.count_if((F.col("out_degree") == 0) & (F.col("in_degree") == 0)).alias("isolated"), F.count_if(F.col("out_degree") == 0).alias("dead_ends"))
    every = edges.agg(F.count(F.lit(1)).alias("_all"))
    return d.crossJoin(mutual).crossJoin(every).select("n", "m", (F.col("_all") - F.col("m")).alias("n_drop"), "reciprocity", "p50", "p90", "p99", "isolated", "dead_ends")


def bipartite_diagnostics(rows: DataFrame, user: str, item: str) -> DataFrame:
    """(nu, nb, m, density, p50_user, p90_user, p50_item, p90_item, sinks) in one row; every item is a sink."""
    def side(c: str, name: str, n: str) -> DataFrame:
        return rows.groupBy(c).agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias(n), *(F.round(F.percentile("k", p), 6).alias(f"p{int(p * 100)}_{name}") for p in (0.5, 0.9)))

    both = side(user, "user", "nu").crossJoin(side(item, "item", "nb")).crossJoin(rows.agg(F.count(F.lit(1)).alias("m")))
    return both.withColumns({"density": F.round(F.col("m") / F.col("nu") / F.col("nb"), 9), "sinks": F.col("nb")}).select("nu", "nb", "m", "density", "p50_user", "p90_user", "p50_item", "p90_item", "sinks")


def bipartite_edges(rows: DataFrame, user: str, item: str, offset: int) -> DataFrame:
    """Undirected edges between users and items in one id space: items are shifted by the offset."""
    return symmetrised(rows.select(F.col(user).cast("bigint").alias("src"), (F.col(item) + offset).cast("bigint").alias("dst")))


def _sides(edges: DataFrame, nodes: int) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """The edges laid out by source and by target, and how a frame of node scores joins them.

    Scores of few nodes are broadcast and the edges stay where they are. Beyond that the edges are partitioned once by either end
    and kept, on disk where memory doesn't suffice, so that a round shuffles scores only.
    """
    if nodes <= SMALL_NODES:
        return edges, edges, F.broadcast
    by_src, by_dst = (edges.repartition(c).persist(StorageLevel.MEMORY_AND_DISK) for c in ("src", "dst"))
    return by_src, by_dst, lambda scores: scores


def _round(state: DataFrame, name: str, old: DataFrame | None, **sums) -> tuple[DataFrame, dict]:
    """The state of a round as a table, and sums over it that are taken while it is written; the table before it is removed."""
    seen = Observation()
    out = written(state.observe(seen, *(c.alias(k) for k, c in sums.items())), name)
    if old is not None:
        remove(state.sparkSession, old)
    return out, seen.get


class _Packed:
    """Edges (src, dst, k) between nodes whose sorted ids are given, packed by target, and sums along them; edges with another end are left out."""

    def __init__(self, edges: DataFrame, ids: np.ndarray, src: str = "src", dst: str = "dst"):
        self.sc, self.n = edges.sparkSession.sparkContext, len(ids)
        known = self.sc.broadcast(ids)
        tasks = max(1, min(256, len(ids) // 1000))
        size = -(-len(ids) // tasks)

        def number(batches):
            own = known.value
            for b in batches:
                s, d = (b.column(c).to_numpy() for c in (0, 1))
                i, j = (np.minimum(np.searchsorted(own, x), len(own) - 1) for x in (s, d))
                keep = (own[i] == s) & (own[j] == d)
                i, j = i[keep].astype(np.int32), j[keep].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(j // size, pa.int32()), pa.array(j), pa.array(i), pa.array(b.column(2).to_numpy()[keep])], names=["part", "d", "s", "k"])

        rows = edges.select(F.col(src).cast("bigint"), F.col(dst).cast("bigint"), F.col("k").cast("double")).where(F.col(src).isNotNull() & F.col(dst).isNotNull())
        numbered = rows.mapInArrow(number, "part int, d int, s int, k double")
        self.blobs = written(packed(numbered, "part", ["d", "s"]), "packed-edges")
        known.unpersist()

    def sums(self, x: np.ndarray) -> np.ndarray:
        """For each node the sum of x over the sources of its edges."""
        given = self.sc.broadcast(x)

        def run(batches):
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    e = unpacked([blob])
                    first = int(e["d"][0])
                    v = np.bincount(e["d"] - first, given.value[e["s"]] * e["k"])
                    yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([v.tobytes()])], names=["first", "v"])

        out = np.zeros(self.n)
        for r in self.blobs.select("blob").mapInArrow(run, "first bigint, v binary").toLocalIterator() if self.n > 2_000_000 else self.blobs.select("blob").mapInArrow(run, "first bigint, v binary").collect():
            v = np.frombuffer(r.v)
            out[r.first : r.first + len(v)] += v
        given.unpersist()
        return out

    def remove(self) -> None:
        remove(self.blobs.sparkSession, self.blobs)


def _held(spark, ids: np.ndarray, **scores: np.ndarray) -> DataFrame:
    """(id, scores) as a frame; the numbers reach the tasks by broadcast."""
    columns = spark.sparkContext.broadcast([ids, *scores.values()])
    names = ["id", *scores]

    def run(batches):
        for b in batches:
            at = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in columns.value], names=names)

    return spark.range(0, len(ids), 1, max(1, min(64, len(ids) // 10_000))).mapInArrow(run, ", ".join(["id bigint", *(f"{k} double" for k in scores)]))


def _ids(nodes: DataFrame) -> np.ndarray | None:
    """The sorted ids, if they are numbers and not more than are held."""
    if nodes.schema["id"].dataType.typeName() not in ("long", "integer", "short", "byte") or nodes.count() > HELD_NODES:
        return None
    return np.sort(nodes.select(F.col("id").cast("bigint").alias("id")).where("id is not null").toArrow().column("id").to_numpy())


def _pagerank_held(edges: DataFrame, ids: np.ndarray, beta: float, iterations: int, eps: float | None) -> DataFrame:
    n, deg = len(ids), np.zeros(len(ids))
    out = edges.where("src is not null").groupBy(F.col("src").cast("bigint").alias("src")).agg(F.sum("k").alias("deg")).toArrow()
    src = out.column("src").to_numpy()
    at = np.minimum(np.searchsorted(ids, src), n - 1)
    deg[at[ids[at] == src]] = out.column("deg").to_numpy()[ids[at] == src]
    wheel, rank, sinks = _Packed(edges, ids), np.full(n, 1.0 / n), deg == 0
    for _ in range(iterations):
        before = rank
        rank = beta * (wheel.sums(before / np.where(sinks, np.inf, deg)) + before[sinks].sum() / n) + (1 - beta) / n
        if eps is not None and np.abs(rank - before).sum() < eps:
            break
    wheel.remove()
    return _held(edges.sparkSession, ids, rank=rank)


def _hits_held(edges: DataFrame, ids: np.ndarray, iterations: int, eps: float | None) -> DataFrame:
    to, back = _Packed(edges, ids), _Packed(edges, ids, "dst", "src")
    hub, auth = np.ones(len(ids)), np.ones(len(ids))
    for _ in range(iterations):
        a = to.sums(hub)
        h = back.sums(a)
        a, h = (v / (np.sqrt(v @ v) or 1.0) for v in (a, h))
        moved = np.abs(h - hub).sum() + np.abs(a - auth).sum()
        hub, auth = h, a
        if eps is not None and moved < eps:
            break
    to.remove()
    back.remove()
    return _held(edges.sparkSession, ids, hub=hub, auth=auth)


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, *, beta: float = 0.85, iterations: int = 100, eps: float | None = 1e-6) -> DataFrame:
    """(id, rank) by power iteration with uniform teleport; the mass of nodes without out-edges goes to all nodes.

    Ends when the L1 change is below eps, or after `iterations`; eps None runs them all. Multi-edges count as often as they occur.
    Nodes default to the edges' ends. A round is one job: it writes the ranks and takes the sums that the next one needs.
    """
    spark = edges.sparkSession
    edges = written(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")), "pagerank-edges")
    nodes = (edges.select("src").union(edges.select("dst")).distinct() if nodes is None else nodes.select("id")).toDF("id")
    ids = _ids(nodes)
    if ids is not None and len(ids):
        rank = _pagerank_held(edges, ids, beta, iterations, eps)
        remove(spark, edges)
        return rank
    out = edges.groupBy("src").agg(F.sum("k").alias("deg"))
    base = written(nodes.join(out, nodes.id == out.src, "left").select("id", "deg"), "pagerank-nodes")
    n, sinks = base.agg(F.count(F.lit(1)), F.count_if(F.col("deg").isNull())).first()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    by_src, _, beside = _sides(edges, n)
    r, lost, old = base.select("id", "deg", F.lit(1.0 / n).alias("rank")), sinks / n, None
    for _ in range(iterations):
        given = r.where("deg is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("deg")).alias("share"))
        gain = by_src.join(beside(given), "src").groupBy("dst").agg(F.sum(F.col("share") * F.col("k")).alias("gain"))
        new = beta * (F.coalesce("gain", F.lit(0.0)) + lost / n) + (1 - beta) / n
        nxt = r.join(gain, r.id == gain.dst, "left").select("id", "deg", new.alias("rank"), F.col("rank").alias("before"))
        nxt, sums = _round(nxt, "pagerank", old, lost=F.coalesce(F.sum(F.when(F.col("deg").isNull(), F.col("rank"))), F.lit(0.0)), moved=F.sum(F.abs(F.col("rank") - F.col("before"))))
        r, old, lost = nxt.drop("before"), nxt, sums["lost"]
        if eps is not None and sums["moved"] < eps:
            break
    by_src.unpersist()
    remove(spark, base, *([edges] if n <= SMALL_NODES else []))
    return r.select("id", "rank")


def hits(edges: DataFrame, *, iterations: int = 200, eps: float | None = 1e-8) -> DataFrame:
    """(id, hub, auth): authorities from hubs, then hubs from the new authorities, each scaled to length 1.

    A round is one job, which writes unscaled sums and their squared lengths; scaling is by numbers in the next round.
    """
    edges = written(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")), "hits-edges")
    nodes = written(edges.select("src").union(edges.select("dst")).distinct().toDF("id"), "hits-nodes")
    ids = _ids(nodes)
    if ids is not None and len(ids):
        scores = _hits_held(edges, ids, iterations, eps)
        remove(edges.sparkSession, edges, nodes)
        return scores
    by_src, by_dst, beside = _sides(edges, nodes.count())
    state, old, scale = nodes.select("id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("auth")), None, (1.0, 1.0)
    for _ in range(iterations):
        h = state.select(F.col("id").alias("src"), (F.col("hub") / scale[0]).alias("x")).where("x <> 0")
        auth = by_src.join(beside(h), "src").groupBy("dst").agg(F.sum(F.col("x") * F.col("k")).alias("v"))
        hub = by_dst.join(beside(auth.select("dst", F.col("v").alias("y"))), "dst").groupBy("src").agg(F.sum(F.col("y") * F.col("k")).alias("w"))
        before = state.select("id", (F.col("hub") / scale[0]).alias("h0"), (F.col("auth") / scale[1]).alias("a0"))
        nxt = before.join(hub, before.id == hub.src, "left").join(auth, before.id == auth.dst, "left")
        nxt = nxt.select("id", F.coalesce("w", F.lit(0.0)).alias("hub"), F.coalesce("v", F.lit(0.0)).alias("auth"), "h0", "a0")
        nxt, sums = _round(nxt, "hits", old, h2=F.sum(F.col("hub") * F.col("hub")), a2=F.sum(F.col("auth") * F.col("auth")))
        state, old = nxt.select("id", "hub", "auth"), nxt
        scale = tuple((sums[k] or 0.0) ** 0.5 or 1.0 for k in ("h2", "a2"))
        if eps is not None:
            moved = nxt.agg(F.sum(F.abs(F.col("hub") / scale[0] - F.col("h0")) + F.abs(F.col("auth") / scale[1] - F.col("a0")))).first()[0]
            if moved is None or moved < eps:
                break
    by_src.unpersist()
    by_dst.unpersist()
    return state.select("id", (F.col("hub") / scale[0]).alias("hub"), (F.col("auth") / scale[1]).alias("auth"))


def top_nodes(scores: DataFrame, score: str, k: int, id_col: str = "id") -> DataFrame:
    """The k best, smaller ids first among equals; none for k <= 0."""
    return scores.orderBy(F.desc(score), id_col).limit(max(k, 0))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho): Pearson's correlation of average ranks; near 0, not null, for a constant column."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    ranked = average_ranks(average_ranks(both, "x", "rx").drop("_all"), "y", "ry")
    cov = F.covar_pop("rx", "ry") / (F.stddev_pop("rx") * F.stddev_pop("ry") + 1e-12)
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(cov, F.lit(0.0)).alias("rho"))


def cooccurrence_graph(
    rows: DataFrame, items: DataFrame, *, user: str = "u", item: str = "i", top_n: int = 150, min_shared: int | None = 15, min_jaccard: float | None = None, target_degree: float | None = None
) -> DataFrame:
    """(src, dst, shared, jaccard): pairs of the top_n items by `n` in items(item, n), with the number of users they share.

    The Jaccard index takes the items' own n. With target_degree the ceil(nodes * degree / 2) best pairs by Jaccard are kept,
    smaller ids first among equals; otherwise those that reach min_shared or min_jaccard.
    """
    nodes = items.orderBy(F.desc("n"), item).limit(top_n)
    small = F.broadcast(nodes) if top_n <= 100_000 else nodes
    kept = rows.join(small, item, "left_semi").select(user, item).distinct()
    a, b = kept.select(user, F.col(item).alias("src")), kept.select(user, F.col(item).alias("dst"))
    pairs = a.join(b, user).where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared"))
    for x in ("src", "dst"):
        names = nodes.select(F.col(item).alias(x), F.col("n").alias(f"n_{x}"))
        pairs = pairs.join(F.broadcast(names) if top_n <= 100_000 else names, x)
    pairs = pairs.select("src", "dst", "shared", (F.col("shared") / (F.col("n_src") + F.col("n_dst") - F.col("shared"))).alias("jaccard"))
    if target_degree is not None:
        size = nodes.agg(F.ceil(F.count(F.lit(1)) * target_degree / 2).alias("most"))
        place = F.row_number().over(Window.orderBy(F.desc("jaccard"), "src", "dst"))  # at most top_n squared rows
        return pairs.withColumn("place", place).crossJoin(F.broadcast(size)).where("place <= most").drop("place", "most")
    return pairs.where(F.col("shared") >= min_shared if min_shared is not None else F.col("jaccard") >= min_jaccard)


def modularity(edges: DataFrame, labels: DataFrame, weight: str = "w") -> DataFrame:
    """(m, q): modularity of labels(id, label) on undirected edges given once; 0 without edges."""
    a, b = (labels.select(F.col("id").alias(x), F.col("label").alias(f"l_{x}")) for x in ("src", "dst"))
    e = edges.join(a, "src").join(b, "dst").select("l_src", "l_dst", F.col(weight).alias("w"))
    parts = e.select(F.explode(F.array(F.struct(F.col("l_src").alias("c"), F.col("w").alias("d"), F.when(F.col("l_src") == F.col("l_dst"), F.col("w")).otherwise(0.0).alias("l")),
                                       F.struct(F.col("l_dst").alias("c"), F.col("w").alias("d"), F.lit(0.0).alias("l")))).alias("x"))
    per = parts.groupBy("x.c").agg(F.sum("x.d").alias("d"), F.sum("x.l").alias("l"))
    m = F.sum("d").over(Window.partitionBy()) / 2
    return per.withColumn("m", m).agg(F.max("m").alias("m"), F.coalesce(F.sum(F.col("l") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)), F.lit(0.0)).alias("q"))


def bfs_levels(edges: DataFrame, sources: DataFrame, max_level: int = 1000) -> DataFrame:
    """(source, id, level): distances from each source along the edges; nodes out of reach are absent."""
    frontier = written(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("level")), "bfs")
    parts = [frontier]
    known = frontier.select("source", "id")
    for level in range(1, max_level + 1):
        reached = frontier.join(edges, frontier.id == edges.src).select("source", F.col("dst").alias("id")).distinct()
        frontier = written(reached.join(known, ["source", "id"], "left_anti").withColumn("level", F.lit(level)), "bfs")
        if not frontier.limit(1).count():
            break
        parts.append(frontier)
        known = known.unionAll(frontier.select("source", "id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def double_sweep(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(source, far, diameter_bound): the farthest node from each seed, and how far anything is from that one; a lower bound of the diameter."""
    farthest = Window.partitionBy("source").orderBy(F.desc("level"), "id")
    first = bfs_levels(edges, seeds).withColumn("k", F.row_number().over(farthest)).where("k = 1").select("source", F.col("id").alias("far"))
    first = written(first, "sweep")
    second = bfs_levels(edges, first.select(F.col("far").alias("id")).distinct()).groupBy(F.col("source").alias("far")).agg(F.max("level").alias("diameter_bound"))
    return first.join(second, "far").select("source", "far", "diameter_bound")


def _brandes(adjacency: dict, sources) -> dict:
    """Edge betweenness by shortest paths from the given sources (unweighted); each undirected edge under its sorted ends."""
    score: dict = defaultdict(float)
    for s in sources:
        order, before, paths, level = [], defaultdict(list), defaultdict(float, {s: 1.0}), {s: 0}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in adjacency.get(v, ()):
                if w not in level:
                    level[w] = level[v] + 1
                    queue.append(w)
                if level[w] == level[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        load: dict = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                c = paths[v] / paths[w] * (1 + load[w])
                score[min(v, w), max(v, w)] += c
                load[v] += c
    return score


def _adjacency(pairs) -> dict:
    out = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
        out[b].append(a)
    return out


def edge_betweenness(edges: DataFrame, *, most_edges: int = 200_000) -> DataFrame:
    """(src, dst, betweenness) of an undirected graph given by canonical edges: sources are spread over tasks, which all hold the graph.

    Every task needs the whole graph, so its size is checked.
    """
    pairs = [(r.src, r.dst) for r in edges.select("src", "dst").limit(most_edges + 1).collect()]
    if len(pairs) > most_edges:
        raise ValueError(f"betweenness needs the graph in each task; it has more than {most_edges} edges")
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(pairs)

    def run(batches):
        adjacency = _adjacency(shared.value)
        for b in batches:
            score = _brandes(adjacency, b["id"].tolist())
            yield pd.DataFrame([(a, c, v) for (a, c), v in score.items()], columns=["src", "dst", "v"])

    nodes = edges.select("src").union(edges.select("dst")).distinct().toDF("id").repartition(spark.sparkContext.defaultParallelism)
    return nodes.mapInPandas(run, "src bigint, dst bigint, v double").groupBy("src", "dst").agg((F.sum("v") / 2).alias("betweenness"))


def _modularity(edges, label) -> float:
    m = sum(w for *_, w in edges)
    if not m:
        return 0.0
    inside, degree = defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        degree[label[a]] += w
        degree[label[b]] += w
        if label[a] == label[b]:
            inside[label[a]] += w
    return sum(inside[c] / m - (degree[c] / (2 * m)) ** 2 for c in degree)


def _components(adjacency, nodes) -> dict:
    label: dict = {}
    for s in sorted(nodes):
        if s not in label:
            label[s], stack = s, [s]
            while stack:
                for w in adjacency.get(stack.pop(), ()):
                    if w not in label:
                        label[w] = s
                        stack.append(w)
    return label


def _girvan_newman(edges, removals: int = 400, slack: float = 0.05) -> dict:
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    left = {(min(a, b), max(a, b)) for a, b, _ in edges}
    label = _components(_adjacency(left), nodes)
    best, best_q = label, _modularity(edges, label)
    for _ in range(min(removals, len(left))):
        score = _brandes(_adjacency(left), nodes)
        left.discard(max(sorted(score), key=lambda e: round(score[e], 9)))
        label = _components(_adjacency(left), nodes)
        q = _modularity(edges, label)
        if q > best_q:
            best, best_q = label, q
        if (q < best_q - slack and len(set(label.values())) > 3) or not left:
            break
    return best


def _greedy(edges, slack: float = 0.05) -> dict:
    """Merges the pair of adjacent communities that gains most, by closed-form gains; stops when far below the best."""
    m = sum(w for *_, w in edges)
    between, degree, own = defaultdict(float), defaultdict(float), defaultdict(set)
    for a, b, w in edges:
        degree[a] += w / (2 * m)
        degree[b] += w / (2 * m)
        own[a].add(a)
        own[b].add(b)
        if a != b:
            between[min(a, b), max(a, b)] += w / (2 * m)
    q = sum(w for a, b, w in edges if a == b) / m - sum(x * x for x in degree.values()) if m else 0.0
    best_q, best = q, {x: c for c, xs in own.items() for x in xs}
    while between:
        (a, b), gain = max(((e, 2 * (v - degree[e[0]] * degree[e[1]])) for e, v in sorted(between.items())), key=lambda x: round(x[1], 12))
        q += gain
        own[a] |= own.pop(b)
        degree[a] += degree.pop(b)
        merged = defaultdict(float)
        for (x, y), v in between.items():
            x, y = (a if x == b else x), (a if y == b else y)
            if x != y:
                merged[min(x, y), max(x, y)] += v
        between = merged
        if q > best_q:
            best_q, best = q, {x: c for c, xs in own.items() for x in xs}
        if q < best_q - slack:
            break
    return {x: min(y for y in best if best[y] == c) for x, c in best.items()}


def communities(edges: DataFrame, method: str, weight: str = "w", *, most_edges: int = 20_000) -> DataFrame:
    """(id, label) by 'girvan_newman' or 'greedy': the partition of the highest modularity met; labels are each community's least id. For small graphs, in one task."""
    algorithm = {"girvan_newman": _girvan_newman, "greedy": _greedy}[method]

    def run(batches):
        rows = [r for b in batches for r in b.itertuples(index=False, name=None)]
        if len(rows) > most_edges:
            raise ValueError(f"{method} is for graphs of at most {most_edges} edges")
        if rows:
            label = algorithm(sorted(rows))
            yield pd.DataFrame(sorted(label.items()), columns=["id", "label"])

    e = edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"), F.col(weight).cast("double").alias("w"))
    return e.coalesce(1).mapInPandas(run, "id bigint, label bigint")


def community_profile(edges: DataFrame, labels: DataFrame, facts: DataFrame, *, min_size: int = 3) -> DataFrame:
    """(label, size, density, mean_score, top_kinds, examples) of communities; facts(id, score, kind, n)."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    a, b = (labels.select(F.col("id").alias(x), F.col("label").alias(f"l_{x}")) for x in ("src", "dst"))
    inner = edges.join(a, "src").join(b, "dst").where("l_src = l_dst").groupBy(F.col("l_src").alias("label")).agg(F.count(F.lit(1)).alias("e"))
    rows = labels.join(facts, "id")
    means = rows.groupBy("label").agg(F.round(F.avg("score"), 2).alias("mean_score"))
    kinds = rows.groupBy("label", "kind").agg(F.count(F.lit(1)).alias("k")).withColumn("p", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("k"), "kind"))).where("p <= 3")
    kinds = kinds.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "kind"))), lambda x: x["kind"]), ", ").alias("top_kinds"))
    best = rows.withColumn("p", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "id"))).where("p <= 3")
    best = best.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "id"))), lambda x: x["id"].cast("string")), ", ").alias("examples"))
    density = F.round(F.coalesce("e", F.lit(0)) * 2 / (F.col("size") * (F.col("size") - 1)), 6)
    return sizes.join(inner, "label", "left").join(means, "label").join(kinds, "label").join(best, "label").select("label", "size", density.alias("density"), "mean_score", "top_kinds", "examples")
