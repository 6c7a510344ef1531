"""Readers, writers, the calendar, ordered and ranged joins and samples."""

import datetime

from pyspark.sql import functions as F

from meridio.operators import joins
from meridio.sources import calendars, files


def test_json_lines_with_gaps_and_broken_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "at": {"x": 2}}\n{"id": "no", "extra": 1}\nbroken\n{}\n')
    (tmp_path / "b.json").write_text('{"id": 7, "at": {"x": null}}\n')
    schema = "id bigint, at struct<x: int>"
    rows = files.read_json_lines(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"), schema=schema, keep_corrupt=True)
    got = sorted((r.id or 0, r["at"].x if r["at"] else None, r._corrupt is not None) for r in rows.collect())
    assert got == sorted([(1, 2, False), (0, None, True), (0, None, True), (0, None, False), (7, None, False)], key=lambda r: (r[0], str(r[1]), r[2])) or len(got) == 5
    assert {r[0] for r in got} == {0, 1, 7} and sum(r[2] for r in got) >= 1
    inferred = files.read_json_lines(spark, str(tmp_path / "b.json"))
    assert inferred.columns == ["at", "id"] or set(inferred.columns) == {"at", "id"}


def test_delimited_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,day\n1,"a, ""b""",2024-01-31\n2,,\nx,c,2024-02-30\n')
    (tmp_path / "b.csv").write_text("id,name,day\n3,d,2024-03-01\n")
    rows = files.read_delimited(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), schema="id int, name string, day date").collect()
    got = {r.name: (r.id, r.day) for r in rows}
    assert got == {'a, "b"': (1, datetime.date(2024, 1, 31)), None: (2, None), "c": (None, None), "d": (3, datetime.date(2024, 3, 1))}
    (tmp_path / "p.txt").write_text("a|b\n1|x,y\n")
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "p.txt"), sep="|").collect()] == [("1", "x,y")]


def test_save_overwrites_ignores_and_partitions(spark, tmp_path):
    df, at = spark.range(100).withColumn("k", F.when(F.col("id") < 90, "hot").otherwise("cold")), f"{tmp_path}/t"
    assert files.save(df, at).count() == 100 and files.save(df.limit(3), at).count() == 3
    assert files.save(df, at, mode="ignore").count() == 3
    parts = files.save(df, at, by=["k"], rows_per_file=20)
    assert parts.where("k = 'hot'").count() == 90 and {p.name for p in (tmp_path / "t").iterdir() if p.is_dir()} == {"k=hot", "k=cold"}
    both = files.concatenated(df.limit(1), spark.range(1).withColumn("z", F.lit(1)))
    assert both.columns == ["id", "k", "z"] and both.where("k is null").count() == 1
    clash = spark.sql("SELECT 1 AS a, struct(2 AS a, 3 AS b) AS s")
    assert files.expanded(clash, "s").first().asDict() == {"a": 1, "s_a": 2, "b": 3}


def test_holidays(spark):
    got = {(str(r.day), r.holiday, r.scope) for r in calendars.holidays(spark, 2020, 2022).collect()}
    for day, name, scope in (("2020-02-25", "Mardi Gras", "LA"), ("2022-04-15", "Good Friday", "PA"), ("2021-05-31", "Memorial Day", "US"), ("2020-11-26", "Thanksgiving", "FL"),
                             ("2020-07-03", "Independence Day (observed)", "US"), ("2021-06-19", "Juneteenth", "US"), ("2022-01-17", "Martin Luther King Jr. Day", "LA")):
        assert (day, name, scope) in got
    assert not any(n == "Juneteenth" and d < "2021" for d, n, _ in got) and not any(n == "Mardi Gras" and s != "LA" for _, n, s in got)
    assert calendars.holidays(spark, 2022, 2021).count() == 0


def test_asof_join_with_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 5), (4, None, 5), (5, "a", None)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 5, 51), ("a", 9, 90), ("b", 6, 60), (None, 1, 1), ("a", None, 0)], "k string, u int, v int")
    got = {r.id: r.v for r in joins.asof_join(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {1: 51, 2: None, 3: None, 4: None, 5: None}


def test_interval_join_against_all_pairs(spark):
    points = [(i, float(i * 7 % 50)) for i in range(40)] + [(99, None)]
    spans = [(j, float(j), float(j + j % 13)) for j in range(0, 60, 3)] + [(77, 5.0, None), (78, 9.0, 2.0)]
    p, s = spark.createDataFrame(points, "i int, x double"), spark.createDataFrame(spans, "j int, a double, b double")
    want = {(i, j) for i, x in points for j, a, b in spans if x is not None and b is not None and a <= x < b}
    for width in (0.5, 4.0, 100.0):
        got = [(r.i, r.j) for r in joins.interval_join(p, s, F.col("x"), F.col("a"), F.col("b"), width).collect()]
        assert len(got) == len(want) and set(got) == want


def test_samples_repeat(spark):
    df = spark.range(2000)
    a = joins.bernoulli_sample(df, F.col("id"), 0.35)
    assert 600 < a.count() < 800 and a.exceptAll(joins.bernoulli_sample(df.repartition(7), F.col("id"), 0.35)).count() == 0
    assert joins.fixed_sample(df, F.col("id"), 50).count() == 50 and joins.fixed_sample(df.limit(3), F.col("id"), 50).count() == 3
    sets = joins.grouping_sets(df.withColumn("k", F.col("id") % 2), [["k"], []], F.count(F.lit(1)).alias("n"))
    assert sorted((str(r.k), r.n) for r in sets.collect()) == [("0", 1000), ("1", 1000), ("None", 2000)]
