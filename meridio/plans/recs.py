"""Recommendation queries: customers rate suppliers, markets are regions; train to 1999, validate on 2000, test after it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import recommend as rec
from ..operators import text
from ..sources.shared import written
from .bindings import INTER, SUPP, interactions, suppliers, t
from .registry import query

SPLIT = f"{INTER}, tr AS (SELECT * FROM inter WHERE year(d) <= 1999), va AS (SELECT * FROM inter WHERE year(d) = 2000), te AS (SELECT * FROM inter WHERE year(d) > 2000), wu AS (SELECT u FROM tr GROUP BY u HAVING count(*) >= 3), wi AS (SELECT DISTINCT i FROM tr)"
BASE = "mu AS (SELECT avg(r) AS m FROM tr), bi AS (SELECT i, sum(r - m) / (10 + count(*)) AS b FROM tr, mu GROUP BY i), bu AS (SELECT u, sum(r - m - b) / (15 + count(*)) AS b FROM tr JOIN bi USING (i), mu GROUP BY u)"
SIM = """cx AS (SELECT u, i, r - avg(r) OVER (PARTITION BY i) AS x FROM tr),
  sim AS MATERIALIZED (SELECT i, j, n, n * 1.0::DOUBLE / (n + 50) * num / sqrt(di * dj + 1e-12) AS s FROM (SELECT a.i AS i, b.i AS j, count(*) AS n, sum(a.x * b.x) AS num, sum(a.x * a.x) AS di, sum(b.x * b.x) AS dj
    FROM cx a JOIN cx b ON a.u = b.u AND a.i < b.i GROUP BY a.i, b.i HAVING count(*) >= 5)),
  nb AS MATERIALIZED (SELECT i, j, s FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS k FROM (SELECT i, j, s FROM sim UNION ALL SELECT j, i, s FROM sim)) WHERE k <= 40)"""
PRED = """pred AS (SELECT te.u, te.i, te.r, m + coalesce(bi.b, 0) + coalesce(bu.b, 0) AS base, coalesce(f.fix, 0) AS fix FROM te CROSS JOIN mu LEFT JOIN bi ON bi.i = te.i LEFT JOIN bu ON bu.u = te.u
    LEFT JOIN (SELECT te.u, te.i, sum(s * (tr.r - m - bj.b - bv.b)) / sum(abs(s)) AS fix FROM te JOIN nb ON nb.i = te.i JOIN tr ON tr.u = te.u AND tr.i = nb.j JOIN bi bj ON bj.i = nb.j JOIN bu bv ON bv.u = te.u, mu GROUP BY te.u, te.i) f ON f.u = te.u AND f.i = te.i
  WHERE te.u IN (SELECT u FROM wu) AND te.i IN (SELECT i FROM wi))"""


def cands_sql(future: str) -> str:
    return f"""good AS MATERIALIZED (SELECT u, i FROM {future} WHERE r >= 4 AND u IN (SELECT u FROM wu) AND i IN (SELECT i FROM wi)),
  home AS (SELECT u, market FROM (SELECT u, market, row_number() OVER (PARTITION BY u ORDER BY count(*) DESC, market) AS k FROM tr JOIN supp USING (i) WHERE u IN (SELECT u FROM good) GROUP BY u, market) WHERE k = 1),
  bad AS (SELECT u, i FROM (SELECT home.u, supp.i, row_number() OVER (PARTITION BY home.u ORDER BY md5(concat(home.u, '-', supp.i))) AS k FROM home JOIN supp USING (market)
    WHERE supp.i IN (SELECT i FROM wi) AND NOT EXISTS (SELECT 1 FROM tr WHERE tr.u = home.u AND tr.i = supp.i) AND NOT EXISTS (SELECT 1 FROM good g WHERE g.u = home.u AND g.i = supp.i)) WHERE k <= 99),
  cand AS MATERIALIZED (SELECT u, i, 1 AS rel FROM good UNION ALL SELECT u, i, 0 FROM bad)"""


VEC = """cnt AS (SELECT i, term, count(*) AS c FROM (SELECT l_suppkey AS i, unnest([lower(p_brand), lower(p_type)]) AS term FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY i, term),
  nd AS (SELECT count(DISTINCT i) AS n FROM cnt), vw AS (SELECT i, term, (1 + ln(c)) * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS w FROM cnt JOIN (SELECT term, count(*) AS df FROM cnt GROUP BY term) USING (term), nd),
  vec AS MATERIALIZED (SELECT i, term, w / sqrt(sum(w * w) OVER (PARTITION BY i)) AS w FROM vw)"""
SCORED = """cf AS (SELECT cand.u, cand.i, sum(s) AS cf FROM cand JOIN nb ON nb.i = cand.i JOIN tr ON tr.u = cand.u AND tr.i = nb.j WHERE tr.r >= 4 GROUP BY cand.u, cand.i),
  pr AS (SELECT u, term, sum(w) AS p FROM tr JOIN vec USING (i) WHERE r >= 4 AND u IN (SELECT u FROM cand) GROUP BY u, term), pn AS (SELECT u, term, p / sqrt(sum(p * p) OVER (PARTITION BY u)) AS p FROM pr),
  co AS (SELECT cand.u, cand.i, sum(w * p) AS content FROM cand JOIN vec USING (i) JOIN pn ON pn.u = cand.u AND pn.term = vec.term GROUP BY cand.u, cand.i),
  sc AS MATERIALIZED (SELECT cand.u, cand.i, rel, coalesce(cf, 0) AS cf, coalesce(content, 0) AS content FROM cand LEFT JOIN cf ON cf.u = cand.u AND cf.i = cand.i LEFT JOIN co ON co.u = cand.u AND co.i = cand.i),
  z AS MATERIALIZED (SELECT *, (cf - avg(cf) OVER w) / (stddev_pop(cf) OVER w + 1e-9) AS zc, (content - avg(content) OVER w) / (stddev_pop(content) OVER w + 1e-9) AS zt FROM sc WINDOW w AS (PARTITION BY u))"""


def lists_sql(alpha: str) -> str:
    return f"li AS MATERIALIZED (SELECT u, i, rel, score, row_number() OVER (PARTITION BY u ORDER BY score DESC, i) AS pos FROM (SELECT *, round({alpha} * zc + (1 - {alpha}) * zt, 9) AS score FROM z))"


METRICS = """mt AS (SELECT u, sum(CASE WHEN pos <= 10 THEN rel ELSE 0 END) AS hit, sum(rel) AS n_rel, sum(CASE WHEN pos <= 10 THEN rel / log2(pos + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 10 THEN rel / log2(ideal + 1) ELSE 0 END) AS best
  FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY rel DESC, pos) AS ideal FROM li) GROUP BY u)"""
HYBRID = f"{SPLIT}, {SUPP}, {SIM}, {cands_sql('te')}, {VEC}, {SCORED}"


def split(spark, d, kept=False):
    """The parts by year; with `kept` the interactions are written, for queries that read them several times."""
    rows = interactions(spark, d)
    return rec.split_by_year(written(rows, "interactions") if kept else rows, 1999, 2000)


def near(train):
    return rec.neighbours(rec.item_similarity(train))


def vectors(spark, d):
    rows = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counts = text.term_counts(rows.withColumnRenamed("l_suppkey", "i"), "i", F.array(F.lower("p_brand"), F.lower("p_type")))
    counts = written(counts, "counts")
    return text.tfidf(counts, "i", counts.agg(F.count_distinct("i")), min_df=1, max_share=2.0, terms=5000, smooth=True)


def scored(spark, d, future="test"):
    """Candidates with their scores; interactions, neighbours and candidates enter several steps, so they are written once."""
    s = split(spark, d, kept=True)
    cands = written(rec.candidates(s["train"], s[future], suppliers(spark, d)), "candidates")
    nb = written(near(s["train"]), "neighbours")
    return written(rec.scores(cands, s["train"], nb, written(vectors(spark, d), "vectors")), "scored")


def lists(spark, d, alpha=0.5):
    return rec.ranked(rec.blend(scored(spark, d), alpha)).select("u", "i", "rel", "pos")


@query("temporal_split_counts", f"WITH {SPLIT} SELECT 'train' AS part, count(*) AS n, count(DISTINCT u) AS users, count(DISTINCT i) AS items FROM tr UNION ALL SELECT 'validation', count(*), count(DISTINCT u), count(DISTINCT i) FROM va UNION ALL SELECT 'test', count(*), count(DISTINCT u), count(DISTINCT i) FROM te")
def temporal_split_counts(spark, d):
    part = F.when(F.year("d") <= 1999, "train").when(F.year("d") == 2000, "validation").otherwise("test")
    return interactions(spark, d).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("users"), F.count_distinct("i").alias("items"))


@query("cold_start_cohorts", f"WITH {SPLIT} SELECT CASE WHEN u IN (SELECT u FROM wu) THEN CASE WHEN i IN (SELECT i FROM wi) THEN 'warm' ELSE 'cold_item' END ELSE CASE WHEN i IN (SELECT i FROM wi) THEN 'cold_user' ELSE 'cold_both' END END AS cohort, count(*) AS n FROM te GROUP BY 1")
def cold_start_cohorts(spark, d):
    s = split(spark, d)
    return rec.cohorts(s["test"], *rec.warm(s["train"])).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))


@query("baseline_biases", f"WITH {SPLIT}, {BASE} SELECT 'item' AS side, i AS id, round(b, 6) + 0.0 AS bias FROM bi UNION ALL SELECT 'user', u, round(b, 6) + 0.0 FROM bu")
def baseline_biases(spark, d):
    _, bi, bu = rec.baseline(split(spark, d)["train"])
    return bi.select(F.lit("item").alias("side"), F.col("i").alias("id"), r6(F.col("bi")).alias("bias")).unionAll(bu.select(F.lit("user"), "u", r6(F.col("bu"))))


@query("item_item_pearson", f"WITH {SPLIT}, {SIM} SELECT i, j, n, round(s, 6) + 0.0 AS s FROM sim")
def item_item_pearson(spark, d):
    return rec.item_similarity(split(spark, d)["train"]).withColumn("s", r6(F.col("s")))


@query("item_neighbours_topk", f"WITH {SPLIT}, {SIM} SELECT i, j, round(s, 6) + 0.0 AS s FROM nb")
def item_neighbours_topk(spark, d):
    return near(split(spark, d)["train"]).withColumn("s", r6(F.col("s")))


@query("predict_rating", f"WITH {SPLIT}, {BASE}, {SIM}, {PRED} SELECT u, i, r, round(base, 6) AS base, round(least(greatest(base + fix, 1), 5), 6) AS pred FROM pred")
def predict_rating(spark, d):
    s = split(spark, d, kept=True)
    rows = rec.cohorts(s["test"], *rec.warm(s["train"])).where("cohort = 'warm'").select("u", "i", "r")
    return rec.predict(rows, s["train"], written(near(s["train"]), "neighbours"), 1.0, 5.0).select("u", "i", "r", r6(F.col("base")).alias("base"), r6(F.col("pred")).alias("pred"))


@query("rmse_mae", f"""WITH {SPLIT}, {BASE}, {SIM}, {PRED} SELECT 'baseline' AS model, count(*) AS n, round(sqrt(avg((base - r) * (base - r))), 6) AS rmse, round(avg(abs(base - r)), 6) AS mae FROM pred
  UNION ALL SELECT 'item_cf', count(*), round(sqrt(avg(pow(least(greatest(base + fix, 1), 5) - r, 2))), 6), round(avg(abs(least(greatest(base + fix, 1), 5) - r)), 6) FROM pred""")
def rmse_mae(spark, d):
    s = split(spark, d, kept=True)
    rows = rec.cohorts(s["test"], *rec.warm(s["train"])).where("cohort = 'warm'").select("u", "i", "r")
    p = written(rec.predict(rows, s["train"], written(near(s["train"]), "neighbours"), 1.0, 5.0), "predicted")
    both = rec.errors(p, "base").withColumn("model", F.lit("baseline")).unionByName(rec.errors(p, "pred").withColumn("model", F.lit("item_cf")))
    return both.select("model", "n", r6(F.col("rmse")).alias("rmse"), r6(F.col("mae")).alias("mae"))


@query("popularity_topn", f"WITH {SPLIT} SELECT i, count(*) AS n FROM tr GROUP BY i ORDER BY n DESC, i LIMIT 10")
def popularity_topn(spark, d):
    return split(spark, d)["train"].groupBy("i").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "i").limit(10)


@query("user_history", f"WITH {SPLIT} SELECT u, count(*) AS n, array_to_string(list(i ORDER BY d, i), ',') AS items FROM tr GROUP BY u")
def user_history(spark, d):
    g = split(spark, d)["train"].groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("d", "i"))).alias("h"))
    return g.select("u", "n", F.array_join(F.transform("h", lambda x: x["i"].cast("string")), ",").alias("items"))


@query("ranking_candidates", f"WITH {SPLIT}, {SUPP}, {cands_sql('te')} SELECT u, i, rel FROM cand")
def ranking_candidates(spark, d):
    s = split(spark, d, kept=True)
    return rec.candidates(s["train"], s["test"], suppliers(spark, d))


@query("cf_rank_scores", f"WITH {HYBRID} SELECT u, i, rel, round(cf, 6) + 0.0 AS cf, round(content, 6) + 0.0 AS content FROM sc")
def cf_rank_scores(spark, d):
    return scored(spark, d).select("u", "i", "rel", r6(F.col("cf")).alias("cf"), r6(F.col("content")).alias("content"))


@query("hybrid_zscore_blend", f"WITH {HYBRID}, {lists_sql('0.5::DOUBLE')} SELECT u, i, rel, CAST(pos AS INTEGER) AS pos FROM li WHERE pos <= 10")
def hybrid_zscore_blend(spark, d):
    return lists(spark, d).where("pos <= 10").select("u", "i", "rel", "pos")


@query("ranking_metrics_at_k", f"WITH {HYBRID}, {lists_sql('0.5::DOUBLE')}, {METRICS} SELECT count(*) AS users, round(avg(hit / 10), 6) AS precision, round(avg(hit * 1.0 / n_rel), 6) AS recall, round(avg(dcg / best), 6) AS ndcg FROM mt")
def ranking_metrics_at_k(spark, d):
    m = rec.ranking_metrics(lists(spark, d))
    return m.agg(F.count(F.lit(1)).alias("users"), *(r6(F.avg(x)).alias(x) for x in ("precision", "recall", "ndcg")))


_GRID = "\nUNION ALL ".join(f"SELECT {a}::DOUBLE AS alpha, ndcg FROM (WITH {lists_sql(f'{a}::DOUBLE')}, {METRICS} SELECT round(avg(dcg / best), 6) AS ndcg FROM mt)" for a in (0.0, 0.25, 0.5, 0.75, 1.0))


@query("hybrid_alpha_grid", f"WITH {SPLIT}, {SUPP}, {SIM}, {cands_sql('va')}, {VEC}, {SCORED} {_GRID}")
def hybrid_alpha_grid(spark, d):
    rows, out = scored(spark, d, "validation"), None
    for a in (0.0, 0.25, 0.5, 0.75, 1.0):
        part = rec.ranking_metrics(rec.ranked(rec.blend(rows, a))).agg(r6(F.avg("ndcg")).alias("ndcg")).select(F.lit(a).alias("alpha"), "ndcg")
        out = part if out is None else out.unionAll(part)
    return out


@query("coverage_novelty", f"""WITH {HYBRID}, {lists_sql('0.5::DOUBLE')}, pop AS (SELECT i, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM tr GROUP BY i)
  SELECT count(*) AS slots, round(count(DISTINCT li.i) * 1.0 / (SELECT count(*) FROM pop), 6) AS coverage, round(avg(-log2(share + 1e-12)), 6) AS novelty FROM li JOIN pop USING (i) WHERE pos <= 10""")
def coverage_novelty(spark, d):
    return rec.coverage_novelty(lists(spark, d), split(spark, d)["train"]).select("slots", r6(F.col("coverage")).alias("coverage"), r6(F.col("novelty")).alias("novelty"))


@query("explain_recommendation", f"""WITH {HYBRID}, {lists_sql('1.0::DOUBLE')}, why AS (SELECT li.u, li.i, nb.j, s, row_number() OVER (PARTITION BY li.u, li.i ORDER BY s DESC, nb.j) AS k FROM li JOIN nb ON nb.i = li.i JOIN tr ON tr.u = li.u AND tr.i = nb.j WHERE tr.r >= 4 AND pos <= 5)
  SELECT li.u, li.i, CAST(pos AS INTEGER) AS pos, j AS because, round(s, 6) + 0.0 AS similarity FROM li LEFT JOIN (SELECT * FROM why WHERE k = 1) w ON w.u = li.u AND w.i = li.i WHERE pos <= 5""")
def explain_recommendation(spark, d):
    train = split(spark, d, kept=True)["train"]
    return rec.explained(lists(spark, d, 1.0), train, written(near(train), "neighbours")).withColumn("similarity", r6(F.col("similarity")))


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    return rec.bootstrap_interval(rec.ranking_metrics(lists(spark, d)), "ndcg", "u")
