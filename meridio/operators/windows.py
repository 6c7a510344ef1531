"""Exact windows over event time, activity indices and event studies, in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import hourly_counts


def trailing_hours(events: DataFrame, ts: str, widths: tuple[int, ...] = (1, 4, 24)) -> DataFrame:
    """(hour, n, total_w, mean_w): sums and means of the last w hours, 0 for hours without events; at the start over the hours there are."""
    out = hourly_counts(events, ts)
    for w in widths:
        rows = Window.orderBy("hour").rowsBetween(-(w - 1), 0)  # one row an hour
        out = out.withColumns({f"total_{w}": F.sum("n").over(rows), f"mean_{w}": F.avg("n").over(rows)})
    return out


def sliding(events: DataFrame, keys: list[str], t: str, value: str, width: int, tie: list[str]) -> DataFrame:
    """Rows with count, total and average of the key's events in (t - width, t]; t is an integer time.

    Of events at the same time each sees those before it in the order of `tie` and itself, as in a one-pass replay; without a
    `tie` each sees all of them.
    """
    w = Window.partitionBy(*keys).orderBy(t).rangeBetween(-(width - 1), 0)
    if not tie:
        return events.withColumns({"count": F.count(F.lit(1)).over(w), "total": F.sum(value).over(w)}).withColumn("average", F.col("total") / F.col("count"))
    later = Window.partitionBy(*keys, t).orderBy(*[F.desc(c) for c in tie]).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(value).over(w) - F.coalesce(F.sum(value).over(later), F.lit(0))
    count = F.count(F.lit(1)).over(w) - F.count(F.lit(1)).over(later)
    return events.withColumns({"count": count, "total": total}).withColumn("average", F.col("total") / F.col("count"))


def activity_bits(events: DataFrame, key: str, ts: str, base_end: str, q: float = 0.75) -> DataFrame:
    """(key, hour, n, bit): 1 where an hour's count exceeds the q-quantile of the same hour of the week before base_end; every hour from first to last has a row."""
    counts = events.groupBy(key, F.date_trunc("hour", ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).where("a is not null")
    grid = counts.select(key).distinct().crossJoin(F.broadcast(span)).select(key, F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour"))
    full = grid.join(counts, [key, "hour"], "left").select(key, "hour", F.coalesce("n", F.lit(0)).alias("n"), (F.weekday("hour") * 24 + F.hour("hour")).alias("slot"))
    base = full.where(F.col("hour") < F.lit(base_end).cast("timestamp")).groupBy(key, "slot").agg(F.percentile("n", q).alias("limit"))
    return full.join(base, [key, "slot"]).select(key, "hour", "n", (F.col("n") > F.col("limit")).cast("int").alias("bit"))


def weekly_index(events: DataFrame, key: str, ts: str, base_end: str) -> DataFrame:
    """(key, week, n, activity): counts of weeks that end on Sunday, the median of the weeks before base_end being 100."""
    day = F.to_date(ts)
    week = F.date_add(day, 6 - F.weekday(day))
    n = events.groupBy(key, week.alias("week")).agg(F.count(F.lit(1)).alias("n"))
    span = n.agg(F.min("week").alias("a"), F.max("week").alias("b")).where("a is not null")
    grid = n.select(key).distinct().crossJoin(F.broadcast(span)).select(key, F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week"))
    full = grid.join(n, [key, "week"], "left").select(key, "week", F.coalesce("n", F.lit(0)).alias("n"))
    base = full.where(F.col("week") < F.lit(base_end).cast("date")).groupBy(key).agg(F.median("n").alias("m"))
    return full.join(base, key).select(key, "week", "n", F.try_divide(100.0 * F.col("n"), F.col("m")).alias("activity"))


def event_study(daily: DataFrame, key: str, days: DataFrame, *, reach: int = 14, weeks: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """(key, rel, v, baseline, activity) around each of days(key, day0): counts of daily(key, day, n) against the median of the same weekday some weeks before and after.

    Days without a count are 0, in the baseline too; a baseline of 0 is dropped.
    """
    shifts = [7 * s * w for w in weeks for s in (-1, 1)]
    grid = days.select(key, "day0", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("rel"))
    grid = grid.withColumn("shift", F.explode(F.array(*(F.lit(x) for x in [0, *shifts]))))
    asked = grid.withColumn("day", F.date_add("day0", F.col("rel") + F.col("shift")))
    rows = asked.join(daily, [key, "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    g = rows.groupBy(key, "day0", "rel").agg(F.max(F.when(F.col("shift") == 0, F.col("n"))).alias("v"), F.median(F.when(F.col("shift") != 0, F.col("n"))).alias("baseline"))
    return g.where("baseline > 0").withColumn("activity", 100.0 * F.col("v") / F.col("baseline"))


def share_of_peak(rows: DataFrame, key: str, day: str, total: str) -> DataFrame:
    """(key, week, new, peak_share): weekly new counts of a running total, and their share of the key's highest week."""
    before = F.lag(total).over(Window.partitionBy(key).orderBy(day))
    new = rows.select(key, F.date_add(day, 6 - F.weekday(day)).alias("week"), F.greatest(F.col(total) - F.coalesce(before, F.col(total)), F.lit(0)).alias("new"))
    weekly = new.groupBy(key, "week").agg(F.sum("new").alias("new"))
    return weekly.withColumn("peak_share", F.try_divide(100.0 * F.col("new"), F.max("new").over(Window.partitionBy(key))))
