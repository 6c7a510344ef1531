"""Audit queries on suppliers, customers and recommendation slots."""

from __future__ import annotations

import time

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import name_key, r6
from ..operators import audit
from ..operators import cluster as cl
from ..operators import graph as g
from .bindings import INTER, SUPP, interactions, suppliers, t
from .recs import HYBRID, lists, lists_sql
from .registry import query

_N = "n AS (SELECT o_custkey AS id, count(*) AS x FROM orders GROUP BY o_custkey)"


def _counts(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("x"))


@query("gini", f"WITH {_N}, r AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM n) SELECT count(*) AS n, round(sum(2.0 * i * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*), 6) AS gini FROM r")
def gini(spark, d):
    return audit.gini(_counts(spark, d), "x").select("n", r6(F.col("gini")).alias("gini"))


@query("gini_trapezoid", f"""WITH {_N}, r AS (SELECT row_number() OVER w AS i, sum(x) OVER (ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS c, count(*) OVER () AS n, sum(x) OVER () AS t FROM n WINDOW w AS (ORDER BY x, id))
  SELECT round(1 - 2 * sum(CASE WHEN i IN (1, n) THEN 0.5 ELSE 1.0 END * c / t) / max(n), 6) AS gini FROM r""")
def gini_trapezoid(spark, d):
    return audit.gini_trapezoid(_counts(spark, d), "x").select(r6(F.col("gini")).alias("gini"))


@query("lorenz_curve", f"WITH {_N} SELECT DISTINCT round(count(*) OVER w * 1.0 / (SELECT count(*) FROM n), 6) AS population, round(sum(x) OVER w * 1.0 / (SELECT sum(x) FROM n), 6) AS share FROM n WINDOW w AS (ORDER BY x)")
def lorenz_curve(spark, d):
    return audit.lorenz(_counts(spark, d), "x").select(r6(F.col("population")).alias("population"), r6(F.col("share")).alias("share"))


@query("top_share", f"WITH {_N}, r AS (SELECT x, row_number() OVER (ORDER BY x DESC) AS i, greatest(1, ceil(count(*) OVER () * 0.1)) AS k FROM n) SELECT CAST(max(k) AS BIGINT) AS k, round(sum(CASE WHEN i <= k THEN x END) * 1.0 / sum(x), 6) AS share FROM r")
def top_share(spark, d):
    return audit.top_share(_counts(spark, d), "x", 0.1).select("k", r6(F.col("share")).alias("share"))


_SLOTS = f"{HYBRID}, {lists_sql('0.5::DOUBLE')}, slots AS (SELECT i FROM li WHERE pos <= 10)"


@query("concentration_summary", f"""WITH {_SLOTS}, c AS (SELECT i, count(*) AS n FROM slots GROUP BY i), r AS (SELECT n, row_number() OVER (ORDER BY n) AS k FROM c)
  SELECT (SELECT count(*) FROM slots) AS slots, count(*) AS uniques, round(count(*) * 1.0 / sum(n), 6) AS unique_share, round((SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC, i LIMIT 10)) * 1.0 / sum(n), 6) AS top_share,
    round(sum(2.0 * k * n) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*), 6) AS gini FROM r""")
def concentration_summary(spark, d):
    return audit.concentration(lists(spark, d).where("pos <= 10"), "i").select("slots", "uniques", *(r6(F.col(c)).alias(c) for c in ("unique_share", "top_share", "gini")))


_QUART = "CASE WHEN pct IS NULL THEN 'no data' WHEN pct <= 0.25 THEN 'Q1' WHEN pct <= 0.5 THEN 'Q2' WHEN pct <= 0.75 THEN 'Q3' ELSE 'Q4' END"


def _pct(x: str) -> str:
    return f"(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0) / count(*) OVER ()"


@query("visibility_quartiles", f"SELECT p_partkey, {_QUART} AS quartile FROM (SELECT p_partkey, {_pct('p_size')} AS pct FROM part)")
def visibility_quartiles(spark, d):
    return audit.quartile_class(t(spark, d, "part"), "p_size").select("p_partkey", "quartile")


@query("name_multiplicity", """SELECT p_partkey, CASE WHEN n = 1 THEN 'single' WHEN n < 5 THEN 'few' ELSE 'chain' END AS places FROM (
  SELECT p_partkey, count(*) OVER (PARTITION BY trim(regexp_replace(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^a-z0-9]+', ' ', 'g'))) AS n FROM part)""")
def name_multiplicity(spark, d):
    return audit.multiplicity(t(spark, d, "part"), name_key(F.concat_ws(" ", "p_name", "p_brand", "p_type"))).select("p_partkey", "places")


_REP = "UNION ALL".join(f"""
  SELECT '{s}' AS score, {f}::DOUBLE AS fraction, '{dim}' AS dimension, grp, c / sum(c) OVER () AS catalogue, s / sum(s) OVER () AS selected, e / sum(e) OVER () AS exposure FROM (
    SELECT {dim} AS grp, count(*) * 1.0::DOUBLE AS c, count(*) FILTER (WHERE k <= m) * 1.0::DOUBLE AS s, sum(CASE WHEN k <= m THEN 1 / log2(k + 1) ELSE 0 END) AS e FROM (SELECT *, row_number() OVER (ORDER BY {s} DESC, i) AS k, greatest(1, ceil(count(*) OVER () * {f})) AS m FROM b) GROUP BY {dim})"""
  for s in ("n", "mean", "balance") for f in (0.1, 0.25) for dim in ("market", "city"))


@query("representation_audit", f"WITH {INTER}, {SUPP}, b AS (SELECT supp.*, n, mean FROM supp JOIN (SELECT i, count(*) AS n, avg(r) AS mean FROM inter GROUP BY i) USING (i)) SELECT score, fraction, dimension, grp, round(catalogue, 6) AS catalogue, round(selected, 6) AS selected, round(exposure, 6) AS exposure, round(selected / catalogue, 6) AS ratio FROM ({_REP})")
def representation_audit(spark, d):
    stats = interactions(spark, d).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"))
    out = audit.representation(suppliers(spark, d).join(stats, "i"), ["n", "mean", "balance"], [0.1, 0.25], ["market", "city"], "i")
    return out.select("score", "fraction", "dimension", "grp", *(r6(F.col(c)).alias(c) for c in ("catalogue", "selected", "exposure", "ratio")))


@query("exposure_audit", f"""WITH {_SLOTS}, c AS (SELECT market AS grp, count(*) * 1.0 / sum(count(*)) OVER () AS catalogue FROM supp GROUP BY market), s AS (SELECT market AS grp, count(*) * 1.0 / sum(count(*)) OVER () AS shown FROM slots JOIN supp USING (i) GROUP BY market)
  SELECT grp, round(catalogue, 6) AS catalogue, round(coalesce(shown, 0), 6) AS shown, round(coalesce(shown, 0) / catalogue, 6) AS ratio FROM c LEFT JOIN s USING (grp)""")
def exposure_audit(spark, d):
    out = audit.exposure(lists(spark, d).where("pos <= 10").select("i"), suppliers(spark, d).select("i", "market"), "i", "market")
    return out.select("grp", *(r6(F.col(c)).alias(c) for c in ("catalogue", "shown", "ratio")))


_ITEMS = f"{INTER}, it AS (SELECT i, count(*) AS n, avg(r) AS mean FROM inter GROUP BY i), q AS (SELECT it.*, {_QUART} AS quartile FROM (SELECT *, {_pct('n')} AS pct FROM it) it)"


def _items(spark, d):
    return audit.quartile_class(interactions(spark, d).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean")), "n")


@query("rating_attack_stress", f"""WITH {_ITEMS}, a AS (SELECT *, (n * mean + attack * added) / (n + added) AS mean_after FROM q, (VALUES (1), (5)) x(attack), (VALUES (5), (20), (100)) y(added)), f AS (SELECT *, mean_after - mean AS delta, (mean >= 4) <> (mean_after >= 4) AS crosses FROM a)
  SELECT attack, added, quartile, count(*) AS n_items, round(median(delta), 6) AS median_delta, round(quantile_cont(abs(delta), 0.9), 6) AS p90_delta, round(avg(CASE WHEN crosses THEN 1.0 ELSE 0 END), 6) AS crossing FROM f GROUP BY 1, 2, 3""")
def rating_attack_stress(spark, d):
    out = audit.attack_summary(audit.rating_attack(_items(spark, d)), "quartile")
    return out.select("attack", "added", "quartile", "n_items", *(r6(F.col(c)).alias(c) for c in ("median_delta", "p90_delta", "crossing")))


@query("voice_sensitivity", f"""WITH {INTER}, act AS (SELECT u, count(*) AS k FROM inter GROUP BY u), loud AS (SELECT u FROM act WHERE k > (SELECT quantile_cont(k, 0.9) FROM act)),
  g AS (SELECT i, count(*) AS n_all, count(*) FILTER (WHERE u NOT IN (SELECT u FROM loud)) AS n_rest, avg(r) AS mean_all, avg(r) FILTER (WHERE u NOT IN (SELECT u FROM loud)) AS mean_rest FROM inter GROUP BY i)
  SELECT i, n_all, n_rest, round(mean_rest - mean_all, 6) + 0.0 AS delta FROM g WHERE n_all >= 20 AND n_rest >= 5""")
def voice_sensitivity(spark, d):
    return audit.voice_sensitivity(interactions(spark, d)).select("i", "n_all", "n_rest", r6(F.col("delta")).alias("delta"))


@query("voice_by_volume", f"""WITH {INTER}, act AS (SELECT u, count(*) AS k FROM inter GROUP BY u), loud AS (SELECT u FROM act WHERE k > (SELECT quantile_cont(k, 0.9) FROM act)),
  g AS (SELECT i, count(*) AS n_all, count(*) FILTER (WHERE u NOT IN (SELECT u FROM loud)) AS n_rest, avg(r) AS mean_all, avg(r) FILTER (WHERE u NOT IN (SELECT u FROM loud)) AS mean_rest FROM inter GROUP BY i),
  v AS (SELECT *, abs(mean_rest - mean_all) AS d FROM g WHERE n_all >= 20 AND n_rest >= 5), q AS (SELECT d, {_QUART} AS quartile FROM (SELECT d, {_pct('n_all')} AS pct FROM v))
  SELECT quartile, count(*) AS n, round(median(d), 6) AS median_delta, round(quantile_cont(d, 0.95), 6) AS p95_delta FROM q GROUP BY quartile""")
def voice_by_volume(spark, d):
    v = audit.quartile_class(audit.voice_sensitivity(interactions(spark, d)), "n_all")
    return v.groupBy("quartile").agg(F.count(F.lit(1)).alias("n"), r6(F.median(F.abs("delta"))).alias("median_delta"), r6(F.percentile(F.abs("delta"), 0.95)).alias("p95_delta"))


@query("missingness_by_context", """SELECT lang, 'quality' AS attribute, round(avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0 END), 6) AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
  UNION ALL SELECT lang, 'toxic', round(avg(CASE WHEN toxic IS NULL THEN 1.0 ELSE 0 END), 6) FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def missingness_by_context(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id", "left")
    return audit.missingness(rows, ["quality", "toxic"], "lang").withColumn("share", r6(F.col("share")))


@query("cluster_context_ratio", """WITH k AS (SELECT label AS cluster, CAST(vec_id % 4 AS INTEGER) AS context, count(*) * 1.0::DOUBLE AS n FROM embeddings GROUP BY 1, 2)
  SELECT cluster, context, round(n / sum(n) OVER (PARTITION BY cluster), 6) AS share, round(n / sum(n) OVER (PARTITION BY cluster) / (sum(n) OVER (PARTITION BY context) / sum(n) OVER ()), 6) AS ratio FROM k""")
def cluster_context_ratio(spark, d):
    rows = t(spark, d, "embeddings").select(F.col("label").alias("cluster"), (F.col("vec_id") % 4).cast("int").alias("context"))
    return audit.context_ratio(rows, "cluster", "context").select("cluster", "context", r6(F.col("share")).alias("share"), r6(F.col("ratio")).alias("ratio"))


_COLS = ("l_quantity", "l_discount", "l_tax", "l_extendedprice")
_R = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _COLS)
_MATRIX = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b}) + 1e-12), 6) + 0.0 AS rho FROM r" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :])


@query("spearman_matrix", f"WITH r AS (SELECT {_R} FROM lineitem) {_MATRIX}")
def spearman_matrix(spark, d):
    rows, out = t(spark, d, "lineitem").select(*_COLS), None
    for i, a in enumerate(_COLS):
        for b in _COLS[i + 1 :]:
            part = g.spearman(rows, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), r6(F.col("rho")).alias("rho"))
            out = part if out is None else out.unionAll(part)
    return out


@query("growth_table", "SELECT kernel, factor::DOUBLE AS factor, round(pow(factor, e), 6) AS cost FROM (VALUES ('linear', 1.0), ('quadratic', 2.0)) k(kernel, e), (VALUES (10.0), (100.0)) f(factor)")
def growth_table(spark, d):
    return spark.createDataFrame(audit.growth_factors([10.0, 100.0], {"linear": 1.0, "quadratic": 2.0}), "kernel string, factor double, cost double")


@query("kernel_benchmark")
def kernel_benchmark(spark, d):
    """Seconds of an O(n k d) and an O(n^2 d) kernel at growing n, and the slope of their logarithms."""
    pts = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    n, rows = pts.count(), []
    centres = pts.orderBy("id").limit(6).select((F.row_number().over(Window.orderBy("id")) - 1).alias("cluster"), F.col("x").alias("c"))
    for part in (4, 2, 1):
        some = pts.orderBy("id").limit(n // part)
        for name, work in (("assign", lambda s: cl.assign(s, centres)), ("neighbours", lambda s: cl.eps_pairs(s, 0.5))):
            seconds = []
            for _ in range(3):
                began = time.perf_counter()
                work(some).write.format("noop").mode("overwrite").save()
                seconds.append(time.perf_counter() - began)
            rows.append((name, n // part, min(seconds)))
    times = spark.createDataFrame(rows, "kernel string, n bigint, seconds double")
    slope = times.groupBy("kernel").agg(F.regr_slope(F.ln("seconds"), F.ln("n")).alias("slope"))
    return times.join(slope, "kernel")
