"""Relational building blocks: profiles, checks, ranks, gap filling, keyed windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written


def column_profile(df: DataFrame, exact: bool = True, rows: int = 250_000) -> DataFrame:
    """(column_name, type, null_share, n_distinct, example): a row a column, from one pass over the frame, and one over each column for exact numbers.

    For those a column's values are spread by value over tasks of about `rows` rows before any are put together, so a task's table
    of values doesn't grow with the input.
    """
    fields = df.schema.fields
    stats = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), F.round(F.avg(F.col(f.name).isNull().cast("double")), 6).alias("null_share"),
                      *([] if exact else [F.approx_count_distinct(f.name).alias("n_distinct")]), F.min(f.name).cast("string").alias("example")).alias(f"c{i}") for i, f in enumerate(fields)]
    out = df.agg(*stats).select(F.inline(F.array(*(f"c{i}" for i in range(len(fields))))))
    if not exact:
        return out
    parts, distinct = max(1, -(-df.count() // rows)), None
    for f in fields:
        one = df.select(F.col(f.name).alias("v")).where("v is not null").repartition(parts, "v").distinct().agg(F.count(F.lit(1)).alias("n_distinct")).withColumn("column_name", F.lit(f.name))
        distinct = one if distinct is None else distinct.unionAll(one)
    return out.join(F.broadcast(distinct), "column_name").select("column_name", "type", "null_share", "n_distinct", "example")


def count_checks(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """(check_name, n): how many rows meet each predicate, in one pass."""
    counts = df.agg(*(F.count_if(F.expr(p)).alias(name) for name, p in checks.items()))
    return counts.select(F.explode(F.create_map(*(x for name in checks for x in (F.lit(name), F.col(name))))).alias("check_name", "n"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows without a parent."""
    return df.join(parent.select(F.col(parent_key).alias("_parent")), F.col(key) == F.col("_parent"), "left_anti")


def universe_sensitivity(rows: DataFrame, universes: dict[str, DataFrame], key: str) -> DataFrame:
    """(definition, items, n_rows, intensity): what each choice of items keeps."""
    members = None
    for name, ids in universes.items():
        part = ids.select(F.lit(name).alias("definition"), key).distinct()
        members = part if members is None else members.unionByName(part)
    per_item = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    out = members.join(per_item, key, "left").groupBy("definition").agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    return out.withColumn("intensity", F.round(F.col("n_rows") / F.col("items"), 6))


def coverage(df: DataFrame, columns: list[str], least: float) -> DataFrame:
    """(attribute, share, kept): the share of rows with a value, and whether it reaches the least."""
    shares = df.agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns))
    rows = shares.select(F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c))))).alias("attribute", "s"))
    return rows.select("attribute", F.round("s", 6).alias("share"), (F.col("s") >= least).alias("kept"))


def value_shares(df: DataFrame, columns: list[str], within: list[str] | None = None) -> DataFrame:
    """The columns' combinations with their share of all rows, or of the rows that agree in `within`."""
    n = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    return n.select(*columns, F.round(F.col("_n") / F.sum("_n").over(Window.partitionBy(*(within or []))), 6).alias("share"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "_k") -> DataFrame:
    """The first k rows of each group; the order must be total for a defined result."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def average_ranks(df: DataFrame, column: str, rank: str, keys: list[str] | None = None) -> DataFrame:
    """Ranks from 1, ties sharing their mean rank; nulls have none.

    Ranks are found on the distinct values with their counts, so rows are never all sorted in one place unless all differ.
    """
    keys = keys or []
    values = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = values.withColumn(rank, before + (F.col("_n") + 1) / 2.0).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys))).drop("_n")
    return df.join(ranked, [*keys, column], "left")


def percent_ranks(df: DataFrame, column: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """Average ranks divided by the number of non-null values."""
    return average_ranks(df, column, "_rank", keys).withColumn(out, F.col("_rank") / F.col("_all")).drop("_rank", "_all")


def running_sums(df: DataFrame, order: str, sums: dict[str, Column]) -> DataFrame:
    """df with prefix sums up to and including each row in the order of a column of distinct values, without bringing rows to one task.

    A range partitioning puts the rows in order; the partitions' sums, a few numbers each, give what comes before each partition.
    """
    part = "running_part"
    rows = df.withColumns({f"of_{k}": c for k, c in sums.items()}).repartitionByRange(F.col(order)).withColumn(part, F.spark_partition_id())
    rows = written(rows, "running")  # the partitions' numbers must not change between the two uses
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    totals = rows.groupBy(part).agg(*(F.sum(f"of_{k}").alias(f"all_{k}") for k in sums))
    totals = totals.select(part, *(F.coalesce(F.sum(f"all_{k}").over(before), F.lit(0)).alias(f"before_{k}") for k in sums))
    within = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({k: F.sum(f"of_{k}").over(within) for k in sums}).join(F.broadcast(totals), part)
    return out.select(*(c for c in df.columns if c not in sums), *((F.col(k) + F.col(f"before_{k}")).alias(k) for k in sums))


def ccdf(df: DataFrame, column: str) -> DataFrame:
    """(value, ccdf): the empirical complementary distribution, a point a row.

    Only distinct values are put in order; the points of equal values are counted out from their number.
    """
    k = df.groupBy(column).agg(F.count(F.lit(1)).alias("k"))
    ranked = running_sums(k, column, {"i": F.col("k")})
    total = k.agg(F.sum("k").alias("all"))
    place = F.explode(F.sequence(F.col("i") - F.col("k"), F.col("i") - 1)).alias("place")
    return ranked.crossJoin(F.broadcast(total)).select(column, "all", place).select(column, (1 - F.col("place") / F.col("all")).alias("ccdf"))


def new_from_cumulative(df: DataFrame, keys: list[str], order: str, total: str, out: str) -> DataFrame:
    """Increments of a running total; the first and every fall give 0."""
    before = F.lag(total).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn(out, F.greatest(F.col(total) - F.coalesce(before, F.col(total)), F.lit(0)))


def trailing_mean(df: DataFrame, keys: list[str], order: str, value: str, rows: int, out: str) -> DataFrame:
    """The mean of the last `rows` rows, null until there are as many."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(out, F.when(F.count(F.lit(1)).over(w) == rows, F.avg(value).over(w)))


def hourly_counts(df: DataFrame, ts: str) -> DataFrame:
    """(hour, n) for every hour from the first to the last, 0 where there are no rows."""
    counts = df.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).where("a is not null")
    grid = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour"))
    return grid.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def dense_keys(df: DataFrame, key: str, out: str) -> DataFrame:
    """(key, out): distinct keys numbered from 0 in their order, without bringing them to one task.

    A range partitioning puts them in order; partition sizes, a few numbers, give each partition's first number.
    """
    ordered = df.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).withColumn("_p", F.spark_partition_id())
    ordered = written(ordered, "dense-keys")  # the partitions' numbers must not change between the two uses
    within = ordered.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(key)))
    sizes = within.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_first"))
    return within.join(F.broadcast(first), "_p").select(key, (F.col("_first") + F.col("_k") - 1).alias(out))
