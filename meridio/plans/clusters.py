"""Clustering and dimensionality queries on the embeddings and on features of parts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import r6
from ..operators import cluster as c
from ..operators import dimred
from ..sources.shared import written
from .bindings import t
from .registry import query

PTS = "pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
EPS = 1.16  # embeddings are unit vectors: chords of some 70 degrees
START = "c0 AS (SELECT CAST(label AS INTEGER) AS cluster, x AS c FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS k FROM pts) WHERE k = 1)"
D2 = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def points(spark, d):
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def start(spark, d):
    first = points(spark, d).groupBy("label").agg(F.min_by("x", "id").alias("c"))
    return first.select(F.col("label").cast("int").alias("cluster"), "c")


def by_label(spark, d):
    return points(spark, d).withColumnRenamed("label", "cluster")


@query("feature_matrix_standardised", """WITH raw AS (SELECT p_partkey AS id, ln(1 + p_retailprice) AS a, CAST(p_size AS DOUBLE) AS b, CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_size > 25 THEN 1.0 ELSE 0.0 END AS big, p_type FROM part),
  f AS (SELECT id, a AS x0, b AS x1, coalesce(big, 0) AS x2, CASE WHEN big IS NULL THEN 1.0 ELSE 0 END AS x3, CASE WHEN p_type = 'ECONOMY' THEN 1.0 ELSE 0 END AS x4, CASE WHEN p_type = 'SMALL' THEN 1.0 ELSE 0 END AS x5 FROM raw)
  SELECT id, round((x0 - avg(x0) OVER ()) / stddev_pop(x0) OVER (), 6) AS price, round((x1 - avg(x1) OVER ()) / stddev_pop(x1) OVER (), 6) AS size, round((x2 - avg(x2) OVER ()) / stddev_pop(x2) OVER (), 6) AS big,
    round((x3 - avg(x3) OVER ()) / stddev_pop(x3) OVER (), 6) AS big_missing, round((x4 - avg(x4) OVER ()) / stddev_pop(x4) OVER (), 6) AS economy, round((x5 - avg(x5) OVER ()) / stddev_pop(x5) OVER (), 6) AS small FROM f""")
def feature_matrix_standardised(spark, d):
    p = t(spark, d, "part").withColumnRenamed("p_partkey", "id")
    flag = F.when(F.col("id") % 10 != 0, F.col("p_size") > 25)
    m = c.standardised(p, {"price": F.log1p("p_retailprice"), "size": F.col("p_size")}, {"big": flag}, {"type": (F.col("p_type"), ["ECONOMY", "SMALL"])})
    names = ["price", "size", "big", "big_missing", "economy", "small"]  # the column for missing types is constant
    return m.select("id", *(r6(F.col("x")[i]).alias(n) for i, n in enumerate(names)))


_ASSIGN = "(SELECT id, arg_min(cluster, ({d2}, cluster)) AS cluster, min({d2}) AS d2 FROM pts, {c} GROUP BY id)"


@query("kmeans_assign", f"WITH {PTS}, {START} SELECT id, cluster, round(d2, 6) AS d2 FROM {_ASSIGN.format(d2=D2.format('x', 'c'), c='c0')}")
def kmeans_assign(spark, d):
    return c.assign(points(spark, d).drop("label"), start(spark, d)).select("id", "cluster", r6(F.col("d2")).alias("d2"))


def _lloyd_sql(rounds: int) -> str:
    parts = [PTS, START]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED {_ASSIGN.format(d2=D2.format('x', 'c'), c=f'c{i}')}")
        parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT cluster, list(m ORDER BY k) AS c FROM (SELECT cluster, k, avg(v) AS m FROM (
          SELECT a.cluster, unnest(p.x) AS v, generate_subscripts(p.x, 1) AS k FROM a{i} a JOIN pts p USING (id)) GROUP BY cluster, k) GROUP BY cluster)""")
    return f"WITH {', '.join(parts)} SELECT id, cluster, round(d2, 6) AS d2 FROM {_ASSIGN.format(d2=D2.format('x', 'c'), c=f'c{rounds}')}"


@query("kmeans_lloyd_fixed_init", _lloyd_sql(5))
def kmeans_lloyd(spark, d):
    return c.kmeans(points(spark, d).drop("label"), start(spark, d), iterations=5, tol=None)[0].select("id", "cluster", r6(F.col("d2")).alias("d2"))


@query("kmeans_plus_plus")
def kmeans_plus_plus(spark, d):
    p = points(spark, d).drop("label")
    return c.kmeans(p, c.plus_plus(p, 6), iterations=20)[0].select("id", "cluster", "d2")


@query("kmeans_init_stability")
def kmeans_init_stability(spark, d):
    p, seeds = written(points(spark, d).drop("label"), "points"), list(range(1, 11))
    draws = p.select("x", *(F.xxhash64("id", F.lit(s)).alias(f"h{s}") for s in seeds))
    random = [np.array([r.x for r in draws.orderBy(f"h{s}").select("x").limit(6).collect()]) for s in seeds]
    runs = c.lloyd(p, [*c.plus_plus_many(p, 6, seeds).values(), *random])
    rows = [(name, s, history[-1]) for (name, s), (_, history) in zip([(n, s) for n in ("plus_plus", "random") for s in seeds], runs)]
    return spark.createDataFrame(rows, "init string, seed int, sse double").groupBy("init").agg(F.avg("sse").alias("mean_sse"), F.stddev("sse").alias("dev_sse"), F.min("sse").alias("best_sse"))


@query("kmeans_k_sweep")
def kmeans_k_sweep(spark, d):
    return c.k_sweep(t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")), list(range(2, 11)))


_CURVE = "curve AS (SELECT CAST(day(ts) AS INTEGER) AS k, sum(value) AS sse FROM events GROUP BY 1)"


@query("elbow_point", f"""WITH {_CURVE}, n AS (SELECT k, (k - min(k) OVER ()) * 1.0 / (max(k) OVER () - min(k) OVER ()) AS x, (sse - min(sse) OVER ()) / (max(sse) OVER () - min(sse) OVER ()) AS y FROM curve),
  e AS (SELECT arg_min(x, k) AS ax, arg_min(y, k) AS ay, arg_max(x, k) AS bx, arg_max(y, k) AS b_y FROM n)
  SELECT k, round(abs((bx - ax) * (ay - y) - (ax - x) * (b_y - ay)) / sqrt(pow(bx - ax, 2) + pow(b_y - ay, 2)), 6) AS distance FROM n, e ORDER BY distance DESC, k LIMIT 1""")
def elbow_point(spark, d):
    curve = t(spark, d, "events").groupBy(F.dayofmonth("ts").alias("k")).agg(F.sum("value").alias("sse"))
    return c.elbow(curve, "k", "sse").withColumn("distance", r6(F.col("distance")))


@query("silhouette_full", f"""WITH {PTS}, p AS (SELECT a.id, a.label AS cluster, b.label AS other, sum(sqrt({D2.format('a.x', 'b.x')})) AS t, count(*) AS n FROM pts a, pts b GROUP BY a.id, a.label, b.label),
  ab AS (SELECT id, cluster, max(CASE WHEN other = cluster THEN CASE WHEN n > 1 THEN t / (n - 1) ELSE 0 END END) AS a, min(CASE WHEN other <> cluster THEN t / n END) AS b FROM p GROUP BY id, cluster)
  SELECT id, cluster, round((b - a) / greatest(a, b), 6) AS s FROM ab""")
def silhouette_full(spark, d):
    return c.silhouette(by_label(spark, d)).withColumn("s", r6(F.col("s")))


@query("silhouette_by_cluster", f"""WITH {PTS}, p AS (SELECT a.id, a.label AS cluster, b.label AS other, sum(sqrt({D2.format('a.x', 'b.x')})) AS t, count(*) AS n FROM pts a, pts b GROUP BY a.id, a.label, b.label),
  ab AS (SELECT id, cluster, max(CASE WHEN other = cluster THEN CASE WHEN n > 1 THEN t / (n - 1) ELSE 0 END END) AS a, min(CASE WHEN other <> cluster THEN t / n END) AS b FROM p GROUP BY id, cluster)
  SELECT cluster, count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS s FROM ab GROUP BY cluster""")
def silhouette_by_cluster(spark, d):
    return c.silhouette(by_label(spark, d)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("s")).alias("s"))


_LABELLED = f"{PTS}, {START}, lab AS (SELECT a.id, a.cluster, p.label FROM {_ASSIGN.format(d2=D2.format('x', 'c'), c='c0')} a JOIN pts p USING (id))"


def _labelled(spark, d):
    return c.assign(points(spark, d), start(spark, d)).select("id", "cluster", "label")


@query("purity_nmi", f"""WITH {_LABELLED}, k AS (SELECT cluster, label, count(*) * 1.0::DOUBLE AS n FROM lab GROUP BY cluster, label), m AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY cluster) AS a, sum(n) OVER (PARTITION BY label) AS b FROM k)
  SELECT CAST(max(t) AS BIGINT) AS n, round((SELECT sum(x) / max(t) FROM (SELECT max(n) AS x, max(t) AS t FROM m GROUP BY cluster)), 6) AS purity,
    round(2 * sum(n / t * ln(n * t / (a * b))) / ((SELECT -sum(a / t * ln(a / t)) FROM (SELECT DISTINCT cluster, a, t FROM m)) + (SELECT -sum(b / t * ln(b / t)) FROM (SELECT DISTINCT label, b, t FROM m))), 6) AS nmi FROM m""")
def purity_nmi(spark, d):
    return c.purity_nmi(_labelled(spark, d), "cluster", "label").select("n", r6(F.col("purity")).alias("purity"), r6(F.col("nmi")).alias("nmi"))


@query("label_contingency", f"WITH {_LABELLED} SELECT cluster, label, count(*) AS n FROM lab GROUP BY cluster, label")
def label_contingency(spark, d):
    return c.contingency(_labelled(spark, d), "cluster", "label")


@query("label_alignment", f"WITH {PTS} SELECT CAST((label + 1) % 5 AS INTEGER) AS cluster, CAST(label % 5 AS INTEGER) AS truth, 1.0::DOUBLE AS agreement FROM pts GROUP BY label % 5, (label + 1) % 5")
def label_alignment(spark, d):
    p = points(spark, d).select((F.col("label") % 5).alias("b"), ((F.col("label") + 1) % 5).alias("a"))
    names, share = c.align_labels([(r.a, r.b, r.n) for r in c.contingency(p, "a", "b").collect()])  # at most 64 cells
    return spark.createDataFrame([(k, v, share) for k, v in names.items()], "cluster int, truth int, agreement double")


@query("k_distance", f"WITH {PTS}, p AS (SELECT a.id, {D2.format('a.x', 'b.x')} AS d2 FROM pts a JOIN pts b ON a.id <> b.id) SELECT id, round(sqrt(d2), 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2) AS k FROM p) WHERE k = 4")
def k_distance(spark, d):
    return c.k_distance(points(spark, d), 4).withColumn("d", r6(F.col("d")))


_EPS = f"{PTS}, near AS MATERIALIZED (SELECT a.id AS src, b.id AS dst FROM pts a, pts b WHERE {D2.format('a.x', 'b.x')} <= {EPS} * {EPS}), core AS MATERIALIZED (SELECT src AS id FROM near GROUP BY src HAVING count(*) >= 4)"


@query("dbscan_core_noise", f"WITH {_EPS} SELECT id, id IN (SELECT id FROM core) AS is_core, id NOT IN (SELECT src FROM near WHERE dst IN (SELECT id FROM core)) AS is_noise FROM pts")
def dbscan_core_noise(spark, d):
    return c.dbscan(points(spark, d), EPS, 4).select("id", "is_core", (F.col("cluster") < 0).alias("is_noise"))


@query("dbscan_labels", f"""WITH RECURSIVE {_EPS}, link AS (SELECT src, dst FROM near WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)), reach(a, b) AS (SELECT id, id FROM core UNION SELECT a, dst FROM reach JOIN link ON b = src),
  comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a), num AS (SELECT id, dense_rank() OVER (ORDER BY component) - 1 AS cluster FROM comp),
  edge AS (SELECT src AS id, min(cluster) AS cluster FROM near JOIN num ON num.id = dst GROUP BY src)
  SELECT pts.id, CAST(coalesce(num.cluster, edge.cluster, -1) AS INTEGER) AS cluster FROM pts LEFT JOIN num USING (id) LEFT JOIN edge USING (id)""")
def dbscan_labels(spark, d):
    return c.dbscan(points(spark, d), EPS, 4).select("id", "cluster")


_SUMS = f"{PTS}, sums AS (SELECT label AS cluster, k, count(*) AS n, sum(v) AS s, sum(v * v) AS ss, greatest(sum(v * v) / count(*) - pow(sum(v) / count(*), 2), 1e-6) AS var FROM (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS k FROM pts) GROUP BY label, k)"


@query("bfr_summaries", f"WITH {_SUMS} SELECT cluster, CAST(k AS INTEGER) AS k, n, round(s, 6) AS s, round(ss, 6) AS ss, round(var, 6) AS var FROM sums")
def bfr_summaries(spark, d):
    return c.summaries(by_label(spark, d)).select("cluster", "k", "n", *(r6(F.col(x)).alias(x) for x in ("s", "ss", "var")))


@query("bfr_mahalanobis_assign", f"""WITH {_SUMS}, m AS (SELECT cluster, list(s / n ORDER BY k) AS mu, list(var ORDER BY k) AS v FROM sums GROUP BY cluster),
  p AS (SELECT id, cluster, sqrt(list_sum(list_transform(list_zip(x, mu, v), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / z[3]))) AS distance FROM pts, m)
  SELECT id, CAST(arg_min(cluster, (distance, cluster)) AS INTEGER) AS cluster, round(min(distance), 6) AS distance FROM p GROUP BY id""")
def bfr_mahalanobis_assign(spark, d):
    return c.mahalanobis_assign(points(spark, d), c.summaries(by_label(spark, d))).withColumn("distance", r6(F.col("distance")))


@query("bfr_blocks")
def bfr_blocks(spark, d):
    return c.bfr(points(spark, d), 6, chunk=400)


@query("cluster_profile", """SELECT cluster, size, share, mean_p_size, median_p_size, top_p_type, top_share_p_type FROM (
  SELECT CAST(p_partkey % 4 AS INTEGER) - 1 AS cluster, count(*) AS size, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share, round(avg(p_size), 6) AS mean_p_size, round(median(p_size), 6) AS median_p_size FROM part GROUP BY 1)
  JOIN (SELECT cluster, p_type AS top_p_type, round(n * 1.0 / t, 6) AS top_share_p_type FROM (SELECT CAST(p_partkey % 4 AS INTEGER) - 1 AS cluster, p_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_partkey % 4) AS t,
    row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY count(*) DESC, p_type) AS k FROM part GROUP BY p_partkey % 4, p_type) WHERE k = 1) USING (cluster)""")
def cluster_profile(spark, d):
    return c.cluster_profile(t(spark, d, "part").withColumn("cluster", (F.col("p_partkey") % 4 - 1).cast("int")), ["p_size"], ["p_type"])


@query("cluster_z_profile", f"""WITH {PTS}, f AS (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS k FROM pts), g AS (SELECT k, avg(v) AS m, stddev_pop(v) AS s FROM f GROUP BY k)
  SELECT label AS cluster, CAST(f.k AS INTEGER) AS k, round((avg(v) - max(m)) / max(s), 6) AS z FROM f JOIN g USING (k) GROUP BY label, f.k""")
def cluster_z_profile(spark, d):
    f = points(spark, d).select("label", F.posexplode("x").alias("k", "v"))
    g = f.groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return f.groupBy(F.col("label").alias("cluster"), "k").agg(F.avg("v").alias("a")).join(F.broadcast(g), "k").select("cluster", "k", r6((F.col("a") - F.col("m")) / F.col("s")).alias("z"))


@query("covariance_matrix", f"""WITH {PTS}, f AS (SELECT id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS k FROM pts) SELECT CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, round(covar_samp(a.v, b.v), 6) + 0.0 AS cov FROM f a JOIN f b ON a.id = b.id AND a.k <= b.k GROUP BY a.k, b.k""")
def covariance_matrix(spark, d):
    return dimred.covariance(points(spark, d)).withColumn("cov", r6(F.col("cov")))


@query("pca_components")
def pca_components(spark, d):
    p = dimred.fit_pca(points(spark, d))
    rows = [(i, k, float(v), float(v * np.sqrt(p.variances[i]))) for i in range(5) for k, v in enumerate(p.components[i])]
    return spark.createDataFrame(rows, "component int, feature int, weight double, loading double")


@query("pca_top_loadings")
def pca_top_loadings(spark, d):
    w = Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature")
    return pca_components(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 8")


@query("pca_curve")
def pca_curve(spark, d):
    p = dimred.fit_pca(points(spark, d))
    cum = np.cumsum(p.ratio)
    return spark.createDataFrame([(i + 1, float(x), float(np.sqrt(max(0, 1 - x)))) for i, x in enumerate(cum)], "k int, captured double, error double")


@query("pca_projection")
def pca_projection(spark, d):
    pts = points(spark, d)
    return dimred.fit_pca(pts).transform(pts, 2).select("id", F.col("y")[0].alias("pc1"), F.col("y")[1].alias("pc2"))
