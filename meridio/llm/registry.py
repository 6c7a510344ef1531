"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exactdup, licences, mixing, neardup, quality, secretscan, topk, toxicity, warc
from ._shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = quality.quality_scores(docs, trusted(spark, sf_dir), carry=["doc_id", "lang", "source"])
    return scores.where("kept").drop("kept")


@query(
    "op3_exact_dedup",
    r"""
    WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS content FROM documents),
    g AS (SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM c WHERE content IS NOT NULL GROUP BY content)
    SELECT doc_id, n_copies FROM g UNION ALL SELECT doc_id, CAST(1 AS BIGINT) FROM c WHERE content IS NULL
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_minhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(table(spark, sf_dir, "documents"))


@query("op6_mix_sources")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.source_copies(docs, mixing.tempered_weights(docs)).select(F.col("id").alias("doc_id"), "source", "copies")


@query("op9_bpe_encode_decode")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(table(spark, sf_dir, "documents"), carry=["doc_id"], check_col="round_trip")
    return rows.withColumn("n_tokens", F.size("token_ids"))


@query("op5_warc", "SELECT page_id, url, html FROM pages")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, sf_dir)


@query("op7_secret_scan", secretscan.ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan_secrets(table(spark, sf_dir, "documents"))


@query("op10_license_scan", licences.oracle())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licenses(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn_lexicon(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, lexicon=lexicon, carry=["doc_id", "lang", "source"])


@query("op1_exact_top_k", topk.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=10, queries=F.col("vec_id") % 100 == 0).withColumn("score", F.round("score", 6))
