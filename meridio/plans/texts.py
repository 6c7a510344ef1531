"""Text queries: corpora, term weights, cosine neighbours, truncated SVD."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import STOP, r6, tokens_apostrophe, tokens_plain
from ..operators import dimred, text
from .bindings import t
from .registry import query

STOPS = ", ".join(f"'{w}'" for w in STOP)


def _sql(pattern: str, extra: str, min_df: int, share: float, terms: int, idf: str, source: str = "documents", key: str = "doc_id", where: str = "") -> str:
    return f"""tok AS (SELECT {key} AS id, unnest(list_concat(list_filter(regexp_extract_all(lower(text), '{pattern}'), lambda x: {where}x NOT IN ({STOPS})), {extra})) AS term FROM {source}),
  cnt AS (SELECT id, term, count(*) AS c FROM tok GROUP BY id, term), nd AS (SELECT count(*) AS n FROM {source}), dfs AS (SELECT term, count(*) AS df FROM cnt GROUP BY term),
  voc AS (SELECT term, {idf} AS idf FROM dfs, nd WHERE df >= {min_df} AND df < {share} * n ORDER BY df DESC, term LIMIT {terms}),
  wt AS (SELECT id, term, (1 + ln(c)) * idf AS w FROM cnt JOIN voc USING (term)), vec AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM wt)"""


PLAIN = _sql("[a-z]+", "[lang, source]", 10, 0.6, 5000, "ln(n * 1.0::DOUBLE / df)", where="length(x) > 2 AND ")
SMOOTH = _sql("[a-z][a-z'']{2,}", "[]::VARCHAR[]", 10, 0.55, 3000, "ln((1.0::DOUBLE + n) / (1 + df)) + 1")
CORPUS = "corpus AS (SELECT source, string_agg(substring(text, 1, 250), ' ' ORDER BY doc_id) AS text FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 15 GROUP BY source)"


def _by_document(spark, d):
    """Documents laid out by key: counts and lengths are then taken where the texts are, and both readings share the exchange."""
    return t(spark, d, "documents").select("doc_id", "text", "lang", "source").repartition("doc_id")


def plain(spark, d):
    docs = _by_document(spark, d)
    counts = text.term_counts(docs, "doc_id", F.concat(tokens_plain(F.col("text")), F.array("lang", "source")))
    return text.tfidf(counts, "doc_id", t(spark, d, "documents").agg(F.count(F.lit(1))), min_df=10, max_share=0.6, terms=5000, smooth=False)


def smooth(spark, d):
    docs = _by_document(spark, d)
    return text.tfidf(text.term_counts(docs, "doc_id", tokens_apostrophe(F.col("text"))), "doc_id", t(spark, d, "documents").agg(F.count(F.lit(1))), min_df=10, max_share=0.55, terms=3000, smooth=True)


@query("corpus_snippets", f"WITH {CORPUS} SELECT source, text FROM corpus")
def corpus_snippets(spark, d):
    return text.corpus(t(spark, d, "documents"), "source", "doc_id", "text")


@query("tfidf_plain", f"WITH {PLAIN} SELECT id AS doc_id, term, round(w, 6) AS w FROM vec")
def tfidf_plain(spark, d):
    return plain(spark, d).withColumn("w", r6(F.col("w")))


@query("tfidf_smooth", f"WITH {SMOOTH} SELECT id AS doc_id, term, round(w, 6) AS w FROM vec")
def tfidf_smooth(spark, d):
    return smooth(spark, d).withColumn("w", r6(F.col("w")))


@query("content_cosine_topk", f"WITH {CORPUS}, " + _sql("[a-z][a-z'']{2,}", "[]::VARCHAR[]", 2, 0.9, 3000, "ln((1.0::DOUBLE + n) / (1 + df)) + 1", "corpus", "source") + """,
  s AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS cosine FROM vec a JOIN vec b ON a.term = b.term AND a.id <> b.id GROUP BY a.id, b.id)
  SELECT a, b, round(cosine, 6) AS cosine, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS place FROM s) WHERE place <= 3""")
def content_cosine_topk(spark, d):
    docs = text.corpus(t(spark, d, "documents"), "source", "doc_id", "text")
    v = text.tfidf(text.term_counts(docs, "source", tokens_apostrophe(F.col("text"))), "source", docs.agg(F.count(F.lit(1))), min_df=2, max_share=0.9, terms=3000, smooth=True)
    return text.cosine_top_k(v, "source", 3).withColumn("cosine", r6(F.col("cosine")))


def _svd(spark, d, k=8):
    n = t(spark, d, "documents").agg(F.count(F.lit(1)))
    m = text.tfidf_matrix(t(spark, d, "documents"), "doc_id", tokens_apostrophe(F.col("text")), n, min_df=10, max_share=0.55, terms=3000, smooth=True)
    return m, dimred.randomised_svd(m, k, col="term")


@query("svd_energy")
def svd_energy(spark, d):
    m, (sigma, _, _) = _svd(spark, d)
    (energy, n, _), terms = m.size(), len(m.names)
    part = np.cumsum(sigma**2) / (energy or 1.0)
    rows = [(k + 1, float(sigma[k]), float(part[k]), float(np.sqrt(max(0, 1 - part[k]))), int((n + terms + 1) * (k + 1)), float(n * terms / ((n + terms + 1) * (k + 1)))) for k in range(len(sigma))]
    return spark.createDataFrame(rows, "k int, sigma double, captured double, error double, parameters bigint, dense_ratio double")


@query("svd_factor_terms")
def svd_factor_terms(spark, d):
    _, (_, _, v) = _svd(spark, d)
    rows = v.select("term", F.posexplode("v").alias("factor", "weight"))
    ends = [F.row_number().over(Window.partitionBy("factor").orderBy(o, "term")).alias(n) for o, n in ((F.desc("weight"), "top"), (F.asc("weight"), "bottom"))]
    return rows.select("*", *ends).where("top <= 8 or bottom <= 8")


@query("svd_representatives")
def svd_representatives(spark, d):
    _, (sigma, u, _) = _svd(spark, d)
    rows = u.select("doc_id", F.posexplode("v").alias("factor", "x")).withColumn("score", F.col("x") * F.element_at(F.array(*(F.lit(float(s)) for s in sigma)), F.col("factor") + 1))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("factor").orderBy(F.desc("score"), "doc_id"))).where("place <= 5").drop("x")
