"""Graph queries: customers and suppliers as a bipartite graph, suppliers linked by the customers they share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators.components import connected_components
from .bindings import INTER, SUPP, interactions, suppliers, t
from .registry import query

OFFSET = 1_000_000_000_000
ROUNDS = 10

_SOCIAL = "social AS (SELECT o_custkey AS src, (o_orderkey * 31 + 7) % (SELECT CAST(count(*) * 4 // 3 AS BIGINT) FROM customer) AS dst FROM orders), node AS (SELECT c_custkey AS id FROM customer)"


def _social(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    size = c.agg(F.floor(F.count(F.lit(1)) * 4 / 3).alias("k"))
    edges = t(spark, d, "orders").crossJoin(F.broadcast(size)).select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 31 + 7) % F.col("k")).alias("dst"))
    return edges, c


@query("graph_social_diagnostics", f"""WITH {_SOCIAL}, e AS (SELECT src, dst FROM social WHERE src IN (SELECT id FROM node) AND dst IN (SELECT id FROM node)),
  d AS (SELECT id, (SELECT count(*) FROM e WHERE src = id) AS o, (SELECT count(*) FROM e WHERE dst = id) AS i FROM node)
  SELECT (SELECT count(*) FROM node) AS n, (SELECT count(*) FROM e) AS m, (SELECT count(*) FROM social) - (SELECT count(*) FROM e) AS n_drop,
    (SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM e b WHERE b.src = e.dst AND b.dst = e.src) THEN 1.0 ELSE 0.0 END), 6) FROM e) AS reciprocity,
    CAST(floor(quantile_cont(o, 0.5) FILTER (WHERE o > 0)) AS BIGINT) AS p50, CAST(floor(quantile_cont(o, 0.9) FILTER (WHERE o > 0)) AS BIGINT) AS p90, CAST(floor(quantile_cont(o, 0.99) FILTER (WHERE o > 0)) AS BIGINT) AS p99,
    count(*) FILTER (WHERE o + i = 0) AS isolated, count(*) FILTER (WHERE o = 0) AS dead_ends FROM d""")
def graph_social_diagnostics(spark, d):
    return g.directed_diagnostics(*_social(spark, d))


@query("graph_bipartite_diagnostics", f"""WITH {INTER}, a AS (SELECT count(*) AS k FROM inter GROUP BY u), b AS (SELECT count(*) AS k FROM inter GROUP BY i)
  SELECT (SELECT count(*) FROM a) AS nu, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM inter) AS m,
    round((SELECT count(*) FROM inter) * 1.0 / (SELECT count(*) FROM a) / (SELECT count(*) FROM b), 9) AS density,
    (SELECT round(quantile_cont(k, 0.5), 6) FROM a) AS p50_user, (SELECT round(quantile_cont(k, 0.9), 6) FROM a) AS p90_user,
    (SELECT round(quantile_cont(k, 0.5), 6) FROM b) AS p50_item, (SELECT round(quantile_cont(k, 0.9), 6) FROM b) AS p90_item, (SELECT count(*) FROM b) AS sinks""")
def graph_bipartite_diagnostics(spark, d):
    return g.bipartite_diagnostics(interactions(spark, d), "u", "i")


@query("canonical_edges", f"WITH {_SOCIAL} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM social WHERE src <> dst AND src IN (SELECT id FROM node) AND dst IN (SELECT id FROM node)")
def canonical_edges(spark, d):
    edges, nodes = _social(spark, d)
    return g.canonical_edges(g.within_universe(edges, nodes))


def _pagerank_sql(edges: str, nodes: str, places: int = 8) -> str:
    parts = [f"e AS MATERIALIZED ({edges})", f"v AS MATERIALIZED ({nodes})", "deg AS MATERIALIZED (SELECT src, count(*) AS deg FROM e GROUP BY src)",
             "k AS MATERIALIZED (SELECT count(*) AS n FROM v)", "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS r FROM v, k)"]
    for i in range(ROUNDS):
        parts.append(f"""r{i + 1} AS MATERIALIZED (SELECT v.id, 0.85::DOUBLE * (coalesce(x.s, 0) + (SELECT coalesce(sum(r), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM deg)) / n) + 0.15::DOUBLE / n AS r
          FROM k, v LEFT JOIN (SELECT dst, sum(r / deg) AS s FROM r{i} JOIN e ON e.src = id JOIN deg ON deg.src = id GROUP BY dst) x ON v.id = x.dst)""")
    return f"{', '.join(parts)} SELECT id, round(r, {places}) AS rank FROM r{ROUNDS}"


_BIP = f"SELECT CAST(u AS BIGINT) AS src, CAST(i + {OFFSET} AS BIGINT) AS dst FROM inter UNION ALL SELECT i + {OFFSET}, u FROM inter"


@query("pagerank_bipartite", f"WITH {INTER}, " + _pagerank_sql(_BIP, "SELECT DISTINCT src AS id FROM e"))
def pagerank_bipartite(spark, d):
    edges = g.bipartite_edges(interactions(spark, d), "u", "i", OFFSET)
    return g.pagerank(edges, iterations=ROUNDS, eps=None).select("id", F.round("rank", 8).alias("rank"))


@query("pagerank_directed_dangling", f"WITH {INTER}, " + _pagerank_sql(f"SELECT CAST(u AS BIGINT) AS src, CAST(i + {OFFSET} AS BIGINT) AS dst FROM inter WHERE r = 5", "SELECT src AS id FROM e UNION SELECT dst FROM e"))
def pagerank_directed_dangling(spark, d):
    edges = interactions(spark, d).where("r = 5").select(F.col("u").cast("bigint").alias("src"), (F.col("i") + OFFSET).alias("dst"))
    return g.pagerank(edges, iterations=ROUNDS, eps=None).select("id", F.round("rank", 8).alias("rank"))


@query("pagerank_top_nodes", f"SELECT id, rank FROM (WITH {INTER}, {_pagerank_sql(_BIP, 'SELECT DISTINCT src AS id FROM e')}) ORDER BY rank DESC, id LIMIT 15")
def pagerank_top_nodes(spark, d):
    return g.top_nodes(pagerank_bipartite(spark, d), "rank", 15)


@query("pagerank_converged")
def pagerank_converged(spark, d):
    return g.pagerank(g.bipartite_edges(interactions(spark, d), "u", "i", OFFSET), eps=1e-6)


def _hits_sql() -> str:
    parts = [f"e AS MATERIALIZED (SELECT u AS src, i + {OFFSET} AS dst FROM inter)", "v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)", "h0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS x FROM v)"]
    for i in range(ROUNDS):
        parts.append(f"a{i + 1} AS MATERIALIZED (SELECT dst AS id, s / sqrt(sum(s * s) OVER ()) AS x FROM (SELECT dst, sum(x) AS s FROM e JOIN h{i} ON src = id GROUP BY dst))")
        parts.append(f"h{i + 1} AS MATERIALIZED (SELECT src AS id, s / sqrt(sum(s * s) OVER ()) AS x FROM (SELECT src, sum(x) AS s FROM e JOIN a{i + 1} ON dst = id GROUP BY src))")
    return f"WITH {INTER}, {', '.join(parts)} SELECT v.id, round(coalesce(h.x, 0), 8) AS hub, round(coalesce(a.x, 0), 8) AS auth FROM v LEFT JOIN h{ROUNDS} h USING (id) LEFT JOIN a{ROUNDS} a USING (id)"


@query("hits_bipartite", _hits_sql())
def hits_bipartite(spark, d):
    edges = interactions(spark, d).select("u", "i").select(F.col("u").alias("src"), (F.col("i") + OFFSET).alias("dst"))
    return g.hits(edges, iterations=ROUNDS, eps=None).select("id", F.round("hub", 8).alias("hub"), F.round("auth", 8).alias("auth"))


_RANKS = "SELECT (rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)"


@query("spearman_rank_compare", f"""WITH {INTER}, s AS (SELECT i, count(*) AS n, avg(r) AS m FROM inter GROUP BY i),
  k AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS a, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS b FROM s)
  SELECT count(*) AS n, round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b) + 1e-12), 6) AS rho FROM k""")
def spearman_rank_compare(spark, d):
    s = interactions(spark, d).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("m"))
    return g.spearman(s, "n", "m").select("n", F.round("rho", 6).alias("rho"))


_PAIRS = f"""{INTER}, it AS (SELECT i, count(*) AS n FROM inter GROUP BY i ORDER BY n DESC, i LIMIT 150),
  pairs AS (SELECT a.i AS src, b.i AS dst, count(*) AS shared FROM inter a JOIN inter b ON a.u = b.u AND a.i < b.i WHERE a.i IN (SELECT i FROM it) AND b.i IN (SELECT i FROM it) GROUP BY a.i, b.i),
  scored AS (SELECT src, dst, shared, shared * 1.0::DOUBLE / (x.n + y.n - shared) AS jaccard FROM pairs JOIN it x ON x.i = src JOIN it y ON y.i = dst)"""
_BACKBONE = f"{_PAIRS}, backbone AS (SELECT src, dst, shared, jaccard FROM (SELECT *, row_number() OVER (ORDER BY jaccard DESC, src, dst) AS k FROM scored) WHERE k <= (SELECT ceil(count(*) * 3.0 / 2) FROM it))"


def _cooccurrence(spark, d, **options):
    rows = interactions(spark, d)
    return g.cooccurrence_graph(rows, rows.groupBy("i").agg(F.count(F.lit(1)).alias("n")), **options)


def _backbone(spark, d):
    return g.written(_cooccurrence(spark, d, target_degree=3.0), "backbone")


@query("coreview_count_graph", f"WITH {_PAIRS} SELECT src, dst, shared, round(jaccard, 6) AS jaccard FROM scored WHERE shared >= 150")
def coreview_count_graph(spark, d):
    return _cooccurrence(spark, d, min_shared=150).withColumn("jaccard", F.round("jaccard", 6))


@query("coreview_jaccard_graph", f"WITH {_BACKBONE} SELECT src, dst, shared, round(jaccard, 6) AS jaccard FROM backbone")
def coreview_jaccard_graph(spark, d):
    return _cooccurrence(spark, d, target_degree=3.0).withColumn("jaccard", F.round("jaccard", 6))


@query("modularity_by_label", f"""WITH {_PAIRS}, {SUPP}, e AS (SELECT shared * 1.0::DOUBLE AS w, a.market AS x, b.market AS y FROM scored JOIN supp a ON a.i = src JOIN supp b ON b.i = dst),
  m AS (SELECT sum(w) AS m FROM e), c AS (SELECT c, sum(w) AS d, sum(l) AS l FROM (SELECT x AS c, w, CASE WHEN x = y THEN w ELSE 0 END AS l FROM e UNION ALL SELECT y, w, 0 FROM e) GROUP BY c)
  SELECT round(max(m), 6) AS m, round(sum(l / m - pow(d / (2 * m), 2)), 6) AS q FROM c, m""")
def modularity_by_label(spark, d):
    labels = suppliers(spark, d).select(F.col("i").alias("id"), F.col("market").alias("label"))
    edges = _cooccurrence(spark, d, min_shared=0).select("src", "dst", F.col("shared").cast("double").alias("w"))
    return g.modularity(edges, labels).select(F.round("m", 6).alias("m"), F.round("q", 6).alias("q"))


_UNDIRECTED = f"{_BACKBONE}, e AS MATERIALIZED (SELECT src, dst FROM backbone UNION ALL SELECT dst, src FROM backbone), v AS (SELECT DISTINCT src AS id FROM e)"
_REACH = f"WITH RECURSIVE {_UNDIRECTED}, reach(a, b) AS (SELECT id, id FROM v UNION SELECT a, e.dst FROM reach JOIN e ON b = e.src)"
_LEVELS = f"WITH RECURSIVE {_UNDIRECTED}, walk(source, id, level) AS (SELECT id, id, 0 FROM v UNION SELECT source, e.dst, level + 1 FROM walk JOIN e ON id = e.src WHERE level < 40), dist AS (SELECT source, id, min(level) AS level FROM walk GROUP BY source, id)"


@query("connected_components", f"{_REACH} SELECT a AS id, min(b) AS component FROM reach GROUP BY a")
def components(spark, d):
    return connected_components(_backbone(spark, d))


@query("giant_component", f"{_REACH}, c AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a), s AS (SELECT count(*) AS k FROM c GROUP BY component) SELECT (SELECT count(*) FROM c) AS nodes, count(*) AS components, max(k) AS giant FROM s")
def giant_component(spark, d):
    sizes = connected_components(_backbone(spark, d)).groupBy("component").agg(F.count(F.lit(1)).alias("k"))
    return sizes.agg(F.sum("k").alias("nodes"), F.count(F.lit(1)).alias("components"), F.max("k").alias("giant"))


@query("bfs_levels", f"{_LEVELS} SELECT id, CAST(level AS INTEGER) AS level FROM dist WHERE source = (SELECT min(id) FROM v)")
def bfs(spark, d):
    e = _backbone(spark, d).select("src", "dst")
    return g.bfs_levels(g.symmetrised(e), e.agg(F.least(F.min("src"), F.min("dst")).alias("id"))).select("id", "level")


@query("diameter_double_sweep", f"""{_LEVELS}, seeds AS (SELECT id FROM v ORDER BY id LIMIT 4),
  far AS (SELECT source, id AS far FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY level DESC, id) AS k FROM dist WHERE source IN (SELECT id FROM seeds)) WHERE k = 1)
  SELECT far.source, far.far, CAST(max(dist.level) AS INTEGER) AS diameter_bound FROM far JOIN dist ON dist.source = far.far GROUP BY far.source, far.far""")
def diameter_double_sweep(spark, d):
    e = g.symmetrised(_backbone(spark, d).select("src", "dst"))
    return g.double_sweep(e, e.select(F.col("src").alias("id")).distinct().orderBy("id").limit(4))


@query("edge_betweenness")
def edge_betweenness(spark, d):
    return g.edge_betweenness(_backbone(spark, d)).withColumn("betweenness", F.round("betweenness", 6))


@query("girvan_newman")
def girvan_newman(spark, d):
    return g.communities(_backbone(spark, d), "girvan_newman", "jaccard")


@query("greedy_modularity")
def greedy_modularity(spark, d):
    return g.communities(_backbone(spark, d), "greedy", "jaccard")


@query("community_profile", f"""WITH {_BACKBONE}, {SUPP}, lab AS (SELECT i AS id, s_nationkey % 5 AS label FROM supp JOIN supplier ON i = s_suppkey), sz AS (SELECT label, count(*) AS size FROM lab GROUP BY label HAVING count(*) >= 3),
  f AS (SELECT i AS id, count(*) AS n FROM inter GROUP BY i), rows AS (SELECT lab.label, lab.id, balance, city, f.n FROM lab JOIN supp ON supp.i = lab.id JOIN f ON f.id = lab.id),
  inn AS (SELECT a.label, count(*) AS e FROM backbone JOIN lab a ON a.id = src JOIN lab b ON b.id = dst WHERE a.label = b.label GROUP BY a.label),
  kinds AS (SELECT label, string_agg(city, ', ' ORDER BY p) AS top_kinds FROM (SELECT label, city, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, city) AS p FROM rows GROUP BY label, city) WHERE p <= 3 GROUP BY label),
  ex AS (SELECT label, string_agg(CAST(id AS VARCHAR), ', ' ORDER BY p) AS examples FROM (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY n DESC, id) AS p FROM rows) WHERE p <= 3 GROUP BY label)
  SELECT label, size, round(coalesce(e, 0) * 2.0 / (size * (size - 1)), 6) AS density, round((SELECT avg(balance) FROM rows WHERE rows.label = sz.label), 2) AS mean_score, top_kinds, examples
  FROM sz LEFT JOIN inn USING (label) JOIN kinds USING (label) JOIN ex USING (label)""")
def community_profile(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).alias("label"))
    n = interactions(spark, d).groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    facts = suppliers(spark, d).select(F.col("i").alias("id"), F.col("balance").alias("score"), F.col("city").alias("kind")).join(n, "id")
    return g.community_profile(_backbone(spark, d), s, facts)
