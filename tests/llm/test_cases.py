"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

from meridio.llm import bpe, exactdup, licences, mixing, neardup, quality, secretscan, topk, toxicity, warc
from meridio.sources.shared import new_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = ["water", "river", "stone", "light", "garden", "winter", "story", "letter", "music", "window", "market", "bridge", "summer", "paper", "voice"]


def prose(seed: int, n: int = 60) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def awkward(spark):
    """Nulls in every column, an empty and a very long text, repeated rows and equal identifiers."""
    rows = [(i, prose(i), "en", f"s{i % 3}", 10) for i in range(40)]
    rows += [(None, prose(1), "en", "s0", 1), (100, None, "en", "s1", 1), (101, "", None, "s1", None), (102, prose(102), None, None, None), (None, None, None, None, None)]
    rows += [(103, prose(103, 60_000), "en", "s2", 9), (5, prose(5), "en", "s2", 10), (5, prose(5), "en", "s2", 10), (6, prose(77), "en", "s0", 10), (104, " \n\t ", "en", "s0", 4)]
    return spark.createDataFrame(rows, DOCS)


def trusted(spark):
    return spark.createDataFrame([(i,) for i in range(30)] + [(None,)], "doc_id bigint")


def labels(spark):
    return spark.createDataFrame([(i, 1, int(i < 3)) for i in range(30)] + [(None, 1, 1), (31, None, None)], "doc_id bigint, quality int, toxic int")


def applied(spark, docs):
    """Every operator on documents, by name."""
    return {
        "quality": quality.quality_filter(docs, trusted(spark)),
        "exact": exactdup.drop_exact_duplicates(docs),
        "exact_groups": exactdup.exact_duplicate_groups(docs),
        "near": neardup.drop_near_duplicates(docs),
        "near_groups": neardup.near_duplicate_groups(docs),
        "near_classes": neardup.near_duplicate_classes(docs),
        "mix": mixing.mix_sources(docs, mixing.tempered_weights(docs)),
        "bpe": bpe.encode(docs, check_col="ok"),
        "secrets": secretscan.scan_secrets(docs),
        "licenses": licences.scan_licenses(docs),
        "toxicity": toxicity.toxicity(docs, lexicon=toxicity.learn_lexicon(docs, labels(spark)), threshold=0.0),
    }


CLASHES = ["content", "row", "node", "sig", "bands", "row_key", "row_number", "copies", "copy", "token_ids", "perplexity", "kept", "sum_logp", "n_symbols", "trusted", "trusted_id", "toxicity", "toxic_clauses", "worst_clause", "ok", "leaf", "h", "p", "s", "id", "_text", "_row", "_k", "_n", "_r", "_mean", "_q", "_least", "_id", "_group", "_component", "judged", "encoded", "copy_key", "copy_number", "repeated_key", "gone", "n", "r", "model", "split", "mean_logp", "quantiles", "doc", "of", "group", "class_id", "n_links"]


def test_awkward_rows_with_clashing_columns(spark):
    docs = awkward(spark).select("*", *(F.lit(f"x-{c}").alias(c) for c in CLASHES))
    out = {k: v.cache() for k, v in applied(spark, docs).items()}
    n = {k: v.count() for k, v in out.items()}
    assert n["exact"] == n["exact_groups"] and n["near"] == n["near_groups"]
    assert n["bpe"] == n["toxicity"] == docs.count()
    for k in ("quality", "exact", "near", "mix"):
        assert out[k].columns == docs.columns
        assert out[k].where(F.col("content") != "x-content").count() == 0
    assert "token_ids_" in out["bpe"].columns and "toxicity_" in out["toxicity"].columns
    # null texts: kept by exact dedup, rejected by the classifier
    assert out["exact"].where("text is null").count() == 2 and out["quality"].where("text is null or text = ''").count() == 0
    assert out["bpe"].where("text is null and token_ids_ is not null").count() == 0
    assert out["bpe"].where("text is not null and not ok_").count() == 0
    assert out["bpe"].where("text = '' and size(token_ids_) = 0").count() == 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    for name, df in applied(spark, empty).items():
        assert df.count() == 0, name
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    folder = new_path(spark, "test-warc")
    warc.write_pages(spark.createDataFrame([], "page_id bigint, url string, html string"), folder)
    assert warc.read_pages(spark, folder).count() == 0


def test_ties_keep_the_smallest_identifier(spark):
    rows = [(9, "a b c d", "en", "s", 1), (3, "a  b\tc d ", "en", "s", 1), (3, "a b c d", "en", "s", 1), (None, "a b c d", "en", "s", 1), (4, "A b c d", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id, r.n_copies) for r in exactdup.exact_duplicate_groups(docs).collect())
    assert got == [(3, 4), (4, 1)]  # case counts, white space doesn't
    near = neardup.near_duplicate_groups(docs).collect()
    assert [(r.doc_id, r.n_members) for r in near] == [(3, 5)]
    assert neardup.drop_near_duplicates(docs).count() == 1


def test_only_null_identifiers(spark):
    docs = spark.createDataFrame([(None, prose(1), "en", "s", 1), (None, prose(1), "en", "s", 1), (None, prose(2), "en", "s", 1)], DOCS)
    assert exactdup.drop_exact_duplicates(docs).count() == 2
    assert neardup.drop_near_duplicates(docs).count() == 2
    assert mixing.source_copies(docs, mixing.tempered_weights(docs)).agg(F.sum("copies")).first()[0] == 3


def test_vectors(spark):
    v = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (None, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [])]
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<float>").withColumn("row", F.lit("x")).withColumn("number", F.lit("y"))
    got = topk.top_k(df, k=3)
    rows = got.collect()
    assert len(rows) == 8 * 3  # the null vector is left out
    first = {(r.vec_id, r.rank): (r.neighbour, round(r.score, 6)) for r in rows if r.vec_id in (1, 4, 5)}
    assert first[1, 1] == (2, 1.0) and first[1, 2] == (2, 1.0) and first[1, 3] == (5, 1.0)
    assert first[4, 1] == (1, 0.0)
    assert topk.top_k(df.limit(1), k=3).count() == 0


def test_pages(spark):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(i, f"http://h/{i}", inner * (i % 4) + "x" * (i * 37)) for i in range(50)]
    rows += [(None, "http://n", "null id"), (60, None, "null url"), (61, "http://p", None), (62, "http://e", ""), (63, "http://l\r\nX: y", "y" * 300_000), (1, "http://h/1", inner), (1, "http://h/1", inner), (64, "http://u", "é🙂\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("block", F.lit(1))
    for gzip in (False, True):
        folder = new_path(spark, "test-warc")
        wrote = warc.write_pages(pages.repartition(3), folder, gzip=gzip)
        assert wrote.agg(F.sum("records")).first()[0] == len(rows)
        for size in (300, 5000, 1 << 20):
            back = warc.read_pages(spark, folder, range_bytes=size, id_type="bigint")
            assert sorted(map(repr, (tuple(r) for r in back.collect()))) == sorted(map(repr, rows))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    awkward(spark).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("row", F.lit("extra"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns, name
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("text", ["", "   ", "one", "one one one one", "日本語テキスト", "🙂", "a" * 5000, "\u0000\u0001", "İstanbul ẞ"])
def test_odd_texts(spark, text):
    h, n = neardup.words([text, "plain words here", text])
    sh, m = neardup.shingles(h, n)
    assert len(sh) == m.sum() and m[0] == m[2]
    code, size = quality.encode([text, "plain words here", text])
    assert len(code) == size.sum() and size[0] == size[2]
    coder = bpe.Encoder(bpe.VOCAB)
    ids, k = coder.encode([text, "x", text])
    flat, _ = coder.decode(ids, k)
    assert flat.tobytes().decode() == text + "x" + text
    toxicity.Matcher(toxicity.LEXICON).score(text)
