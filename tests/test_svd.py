"""SVD by rows against the form that shuffles entries, and what it shuffles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridio.functions.columns import tokens_plain
from meridio.operators import dimred, text


@pytest.fixture(scope="module")
def sparse(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(200, 40)) * (rng.random((200, 40)) < 0.2) * np.linspace(3, 0.2, 40)
    rows = [(f"r{i}", f"c{j:02}", float(a[i, j])) for i in range(200) for j in range(40) if a[i, j]]
    return a, spark.createDataFrame(rows, "row string, col string, value double").repartition(7)


def test_svd_by_rows_is_svd_by_entries(sparse):
    a, m = sparse
    s, u, v = dimred.randomised_svd(dimred.row_matrix(m, "row", "col", "value", 40), 5, powers=1)
    entries = dimred.row_matrix(m, "row", "col", "value", 39)
    assert entries.columns == m.columns and sorted(entries.collect()) == sorted(m.collect())
    t, x, y = dimred._svd_by_entries(entries, 5, 17, 1, 42, "row", "col", "value")
    assert s == pytest.approx(t, rel=1e-9) and s == pytest.approx(np.linalg.svd(a)[1][:5], rel=0.05)
    for one, other, key in ((u, x, "row"), (v, y, "col")):
        one, other = ({r[key]: np.array(r.v) for r in f.collect()} for f in (one, other))
        assert one.keys() == other.keys() and max(np.abs(one[i] - other[i]).max() for i in one) < 1e-7


def test_svd_by_rows_shuffles_no_products(sparse, monkeypatch):
    monkeypatch.setattr(dimred, "multiply", lambda *a: pytest.fail("products are shuffled by entries"))
    a, m = sparse
    rows = dimred.row_matrix(m, "row", "col", "value")
    assert rows.size() == (pytest.approx((a * a).sum()), (a != 0).any(1).sum(), (a != 0).sum())
    z = np.random.default_rng(0).normal(size=(40, 3))
    b, g = rows.products(z)
    assert np.abs(b - a.T @ (a @ z)).max() < 1e-9 and np.abs(g - (a @ z).T @ (a @ z)).max() < 1e-9
    sigma, u, v = dimred.randomised_svd(rows, 4)
    assert len(sigma) == 4 and u.count() == (a != 0).any(1).sum() and v.count() == 40


@pytest.mark.parametrize("smooth", [True, False])
def test_weights_by_rows_are_tfidf(spark, smooth):
    texts = ["ape bee ape cat", "bee cat ape", "cat dog", "", None, "dog emu emu emu", "the", "cat ape", "zzz"]
    rows = [*enumerate(texts), (2, "ape"), (5, "dog bee")]  # texts of one key in several rows
    docs = spark.createDataFrame(rows, "id bigint, text string").repartition(5)
    how = {"min_df": 2, "max_share": 0.5, "terms": 3, "smooth": smooth}
    n, tokens = docs.agg(F.count(F.lit(1))), tokens_plain(F.col("text"))
    want = {(r.id, r.term): r.w for r in text.tfidf(text.term_counts(docs, "id", tokens), "id", n, **how).collect()}
    m = text.tfidf_matrix(docs, "id", tokens, n, **how)
    got = {(r.id, m.names[i].as_py()): x for r in m.rows.collect() for i, x in zip(r.at, r.x)}
    assert len(want) > 8 and got == pytest.approx(want)
    assert sorted(r.id for r in m.rows.collect()) == sorted({i for i, _ in want})
