"""The driver contract: names, column agreement, and values against DuckDB for a spread of queries of every module."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as e  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SPREAD = [
    "scan_pruned_pushdown", "clean_json_props", "column_profile", "crosstab_normalised", "gapfill_hourly", "topk_per_group", "canonical_edges", "pagerank_bipartite",
    "modularity_by_label", "kmeans_assign", "dbscan_labels", "covariance_matrix", "item_item_pearson", "predict_rating", "tfidf_smooth", "cms_table", "weekly_index",
    "stream_tumbling", "gini", "rating_attack_stress", "json_scan_inferred", "csv_scan_typed", "holiday_calendar", "asof_join_events", "rollup_orders", "lorenz_curve", "hits_bipartite",
]


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "quantize"):
        v = float(v)
        return "nan" if math.isnan(v) else f"{round(v, 6) + 0.0:.6f}"
    if isinstance(v, dict):
        return str([plain(x) for x in v.values()])
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(SPREAD) <= set(e.oracle_sql())


def test_entry_runs(spark):
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", SPREAD)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = e.queries()[name](spark, SF)
    cur = con.execute(e.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(cols)) for r in df.collect()) == want
