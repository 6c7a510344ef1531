"""Joins on order and ranges, grouping sets and samples that are the same on every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with the `values` of the last row of right of the same `by` columns that isn't later; null where there is none.

    Both sides are merged by one sort within each key, so nothing is paired that doesn't match. Of rows of right with one time the
    one with the largest values counts; null times and null keys match nothing.
    """
    mark = "asof_side"
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns), *(F.col(c).alias(f"k_{i}") for i, c in enumerate(by)), F.col(left_time).alias("k_time"), F.lit(1).alias(mark))
    b = right.where(F.col(right_time).isNotNull()).select(*(F.col(c).alias(f"k_{i}") for i, c in enumerate(by)), F.col(right_time).alias("k_time"), F.lit(0).alias(mark), F.struct(*values).alias("k_values"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*(f"k_{i}" for i in range(len(by)))).orderBy(F.col("k_time").asc_nulls_first(), mark, "k_values").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("k_time").isNotNull()
    for i in range(len(by)):
        known = known & F.col(f"k_{i}").isNotNull()
    found = both.withColumn("k_found", F.when(known, F.last("k_values", ignorenulls=True).over(w))).where(F.col(mark) == 1)
    return found.select(*(F.col(f"l_{c}").alias(c) for c in left.columns), *(F.col("k_found")[v].alias(v if v not in left.columns else f"right_{v}") for v in values))


def interval_join(points: DataFrame, intervals: DataFrame, at: Column, start: Column, end: Column, width: float) -> DataFrame:
    """Pairs of rows with start <= at < end, numbers all of them, by an equi-join on cells of the given width.

    An interval enters each cell that it touches and a point its own, so a width near the usual length of an interval is best.
    Nulls match nothing. The two frames must not share column names.
    """
    cell = lambda c: F.floor(c / width)
    p = points.withColumn("cell_of_point", cell(at)).where(F.col("cell_of_point").isNotNull())
    i = intervals.where((start < end)).withColumn("cell_of_interval", F.explode(F.sequence(cell(start), cell(end))))
    return p.join(i, F.col("cell_of_point") == F.col("cell_of_interval")).where((start <= at) & (at < end)).drop("cell_of_point", "cell_of_interval")


def interval_totals(points: DataFrame, intervals: DataFrame, at: str, value: str, start: str, end: str) -> DataFrame:
    """intervals with n and total, the number of points with start <= at < end and the sum of their values; intervals without any are left out.

    Each is a difference of two prefix sums, so no pairs are made: points are added up by time, prefix sums go by range partitions, and
    an interval takes its two from one sorted pass. Times are integers. Sums are of decimals, which subtract without an error, of
    values to ten places and below 1e16; nulls add nothing to total, which is null where there are only such.
    """
    exact = "decimal(38,10)"
    own = points.where(F.col(at).isNotNull()).groupBy(F.col(at).alias("k_time"))
    own = own.agg(F.count(F.lit(1)).alias("k_n"), F.count(value).alias("k_v"), F.sum(F.col(value).cast("decimal(28,10)")).cast(exact).alias("k_s"))
    names = [f"l_{c}" for c in intervals.columns]
    # an id of the contents finds an interval's two ends again; equal intervals have equal results and are counted
    each = intervals.where(F.col(start) < F.col(end)).groupBy(*intervals.columns).agg(F.count(F.lit(1)).alias("k_copies")).toDF(*names, "k_copies")
    ends = each.select(*names, "k_copies", F.explode(F.array(F.struct(F.col(f"l_{start}").alias("t"), F.lit(-1).alias("sign")), F.struct(F.col(f"l_{end}").alias("t"), F.lit(1).alias("sign")))).alias("x"))
    ends = ends.select(*names, "k_copies", F.col("x.t").alias("k_time"), F.col("x.sign").alias("k_sign"))
    both = own.withColumn("k_sign", F.lit(0)).unionByName(ends, allowMissingColumns=True)
    # a range partition holds all rows of its times; sums before it are added after, a few rows of one number each
    ordered = written(both.repartitionByRange("k_time").withColumn("k_part", F.spark_partition_id()), "interval-ends")
    parts = ordered.groupBy("k_part").agg(*(F.sum(c).alias(f"p_{c}") for c in ("k_n", "k_v", "k_s")))
    before = Window.orderBy("k_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("k_part", *(F.coalesce(F.sum(f"p_{c}").over(before), F.lit(0)).alias(f"o_{c}") for c in ("k_n", "k_v", "k_s")))
    # at one time ends come before points: the sums are of what is earlier
    w = Window.partitionBy("k_part").orderBy("k_time", F.when(F.col("k_sign") == 0, 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, 0)
    sums = ordered.withColumns({f"s_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in ("k_n", "k_v", "k_s")}).where("k_sign <> 0")
    sums = sums.join(F.broadcast(offsets), "k_part")
    total = [F.sum(F.col("k_sign") * (F.col(f"s_{c}") + F.col(f"o_{c}")).cast(exact if c == "k_s" else "bigint")).alias(f"d_{c}") for c in ("k_n", "k_v", "k_s")]
    out = sums.groupBy(*names, "k_copies").agg(*total).where("d_k_n > 0")
    out = out.withColumn("k_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("k_copies"))))
    return out.select(*(F.col(f"l_{c}").alias(c) for c in intervals.columns), F.col("d_k_n").cast("bigint").alias("n"), F.when(F.col("d_k_v") > 0, F.col("d_k_s").cast("double")).alias("total"))


def full_outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of both sides, paired where the keys agree; keys are merged."""
    return left.join(right, keys, "full")


def grouping_sets(df: DataFrame, sets: list[list[str]], *aggregates: Column) -> DataFrame:
    """Aggregates for each of the sets of columns; columns that are not in a row's set are null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in columns)).agg(*aggregates)


def _draw(key: Column, seed: int) -> Column:
    """A number from 0 to 1 by MD5 of the key, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def bernoulli_sample(df: DataFrame, key: Column, share: float, seed: int = 42) -> DataFrame:
    """Each row with probability `share`, decided by its key, so that a repeated or lost task decides alike."""
    return df.where(_draw(key, seed) < share)


def fixed_sample(df: DataFrame, key: Column, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, or all if there are fewer: those with the smallest draws, by a distributed top-n."""
    return df.orderBy(_draw(key, seed), key).limit(max(n, 0))
