"""The corpus pipeline: five filters and transforms over `documents`, each stage on all that the one before kept.

quality classifier -> exact dedup -> MinHash near-dedup -> mixing sources to target weights -> BPE encoding. Every stage is
written as Parquet into the shared folder and read again as the next one's input. Null, empty and very long texts, repeated
rows and empty tables behave as the operators' docstrings define: the quality stage drops null and empty texts, so later
stages don't meet them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridio.llm import bpe, exactdup, mixing, neardup, quality
from meridio.llm._shared import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier, trained on the rows labelled as good, does not reject.

    Null and empty texts go, documents of a language without trusted text stay, repeated rows are judged one by one, null
    identifiers are never trusted, an empty table gives an empty one; columns as they came, whatever their names.
    """
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.quality_filter(docs, trusted).select(*docs.columns)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each content, that with the smallest identifier.

    A null identifier counts as the largest, of repeated rows one stays, null texts all stay, empty ones equal each other; texts of
    any length are compared whole; an empty table gives an empty one; columns as they came.
    """
    return exactdup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest identifier.

    A null identifier counts as the largest, of repeated rows one stays, texts without words (null, empty) all stay; an empty
    table gives an empty one; columns as they came.
    """
    return neardup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's tempered weight asks for.

    A null source is one of its own, repeated rows are drawn one by one, null and empty texts count like any other; an empty
    table gives an empty one; columns as they came.
    """
    return mixing.mix_sources(docs, mixing.tempered_weights(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, in a column that gets underscores appended if its name is taken.

    A null text has null ids, an empty one an empty list; texts of any length are encoded whole; an empty table gives an empty one.
    """
    return bpe.encode(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_exact),
    ("minhash_near_dedup", drop_near),
    ("mix_sources", mix),
    ("bpe_encode", encode),
]

#: No stage but the second can be stated in SQL; tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
