"""Sliding windows over events of the same time."""

from meridio.operators import windows


def test_events_of_one_time_count_for_each_other_without_a_tie(spark):
    df = spark.createDataFrame([("a", 5, 1.0, 1), ("a", 5, 2.0, 2), ("a", 7, 4.0, 3)], "k string, t bigint, v double, n bigint")
    rows = windows.sliding(df, ["k"], "t", "v", 3, []).orderBy("n").collect()
    assert [(r["count"], r["total"]) for r in rows] == [(2, 3.0), (2, 3.0), (3, 7.0)]
