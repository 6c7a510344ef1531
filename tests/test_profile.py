"""Profiles with values spread over many tasks."""

from meridio.operators import relational


def test_profile_counts_each_value_once_over_tasks(spark):
    df = spark.createDataFrame([(i % 7, None if i % 2 else f"n{i % 10}", None) for i in range(60)], "a bigint, b string, c double")
    got = {r.column_name: (r.null_share, r.n_distinct, r.example) for r in relational.column_profile(df, rows=4).collect()}
    assert got == {"a": (0.0, 7, "0"), "b": (0.5, 5, "n0"), "c": (1.0, 0, None)}
