"""Concentration, exposure and robustness audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import percent_ranks, running_sums

NO_DATA = "no data"


def _ranked(df: DataFrame, x: str) -> DataFrame:
    """(x, k, i, c): distinct finite values with their count, and the number and the sum of values up to and including them."""
    v = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).groupBy(F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("k"))
    v = v.withColumn("x", F.when(F.col("x") >= 0, F.col("x")).otherwise(F.raise_error(F.lit("values must not be negative")).cast("double")))
    return running_sums(v, "x", {"i": F.col("k"), "c": F.col("k") * F.col("x")})


def gini(df: DataFrame, x: str) -> DataFrame:
    """(n, gini): sum 2 i x / (n sum x) - (n + 1) / n over sorted values. A total of 0 gives 0, no values null; a negative value is an error.

    Equal values share their ranks' sum, so only distinct values are sorted.
    """
    r = _ranked(df, x)
    ranks = F.col("k") * (2 * F.col("i") - F.col("k") + 1) / 2.0  # the sum of the ranks of equal values
    s = r.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("x")).alias("t"), F.sum(2 * ranks * F.col("x")).alias("w"))
    return s.select("n", F.when(F.col("n").isNull(), F.lit(None)).when(F.col("t") == 0, 0.0).otherwise(F.col("w") / (F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def gini_trapezoid(df: DataFrame, x: str) -> DataFrame:
    """(gini): 1 - 2 * area under the cumulative shares by the trapezoid rule over the n points, with spacing 1 / n."""
    r = _ranked(df, x)
    k, t = F.col("k"), F.max("c")
    area = F.sum(k * (F.col("c") - k * F.col("x")) + F.col("x") * k * (k + 1) / 2)  # cumulative sums of equal values, added up
    ends = F.when(F.sum("k") > 1, (F.min("x") + t) / 2).otherwise(t / 2)
    return r.agg((1 - 2 * F.try_divide(area - ends, t) / F.sum("k")).alias("gini"))


def lorenz(df: DataFrame, x: str) -> DataFrame:
    """(population, share): a point for each distinct value, from the smallest."""
    r = _ranked(df, x)
    total = r.agg(F.max("i").alias("n"), F.max("c").alias("t"))
    return r.crossJoin(F.broadcast(total)).select((F.col("i") / F.col("n")).alias("population"), F.try_divide("c", "t").alias("share"))


def top_share(df: DataFrame, x: str, fraction: float) -> DataFrame:
    """(k, share): what the max(1, ceil(n * fraction)) largest values hold; null for no values or a total of 0."""
    r = _ranked(df, x)
    total = r.agg(F.max("i").alias("n"))
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * fraction))
    above = F.col("n") - F.col("i")  # how many values are larger
    taken = F.greatest(F.lit(0), F.least(F.col("k"), k - above))
    rows = r.crossJoin(F.broadcast(total)).select(k.alias("top"), (taken * F.col("x")).alias("part"), (F.col("k") * F.col("x")).alias("all"))
    return rows.agg(F.max("top").alias("k"), F.sum("part").alias("p"), F.sum("all").alias("a")).select("k", F.when(F.col("a") > 0, F.col("p") / F.col("a")).alias("share"))


def concentration(slots: DataFrame, item: str, top: int = 10) -> DataFrame:
    """(slots, uniques, unique_share, top_share, gini) of recommended items."""
    n = slots.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    best = n.orderBy(F.desc("n"), item).limit(top).agg(F.sum("n").alias("best"))
    s = n.agg(F.sum("n").alias("slots"), F.count(F.lit(1)).alias("uniques")).crossJoin(best).crossJoin(gini(n, "n").select("gini"))
    return s.select("slots", "uniques", (F.col("uniques") / F.col("slots")).alias("unique_share"), (F.col("best") / F.col("slots")).alias("top_share"), "gini")


def quartile_class(df: DataFrame, x: str, out: str = "quartile") -> DataFrame:
    """df with Q1 to Q4 by average-rank percentage, ties together; null values have no data."""
    p = percent_ranks(df, x, "_pct")
    return p.withColumn(out, F.when(F.col("_pct").isNull(), NO_DATA).when(F.col("_pct") <= 0.25, "Q1").when(F.col("_pct") <= 0.5, "Q2").when(F.col("_pct") <= 0.75, "Q3").otherwise("Q4")).drop("_pct")


def multiplicity(df: DataFrame, key: Column, out: str = "places") -> DataFrame:
    """df with single, few (2 to 4) or chain (5 or more), by how many rows share the key."""
    n = F.count(F.lit(1)).over(Window.partitionBy("_key"))
    return df.withColumn("_key", key).withColumn("_n", n).withColumn(out, F.when(F.col("_n") == 1, "single").when(F.col("_n") < 5, "few").otherwise("chain")).drop("_key", "_n")


def representation(df: DataFrame, scores: list[str], fractions: list[float], dimensions: list[str], id_col: str) -> DataFrame:
    """(score, fraction, dimension, grp, catalogue, selected, exposure, ratio): shares of each group in the catalogue and among the best of each score.

    Exposure discounts by log2(1 + place). Rows without the score are in the catalogue only; a null group is `no data`.
    """
    long = df.select(id_col, *dimensions, F.explode(F.create_map(*(x for s in scores for x in (F.lit(s), F.col(s).cast("double"))))).alias("score", "v"))
    by = Window.partitionBy("score")
    place = F.row_number().over(by.orderBy(F.desc_nulls_last("v"), id_col))
    long = long.withColumns({"place": F.when(F.col("v").isNotNull(), place), "n": F.count("v").over(by)})
    long = long.withColumn("fraction", F.explode(F.array(*(F.lit(f) for f in fractions)))).withColumn("take", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("fraction"))))
    groups = F.explode(F.create_map(*(x for d in dimensions for x in (F.lit(d), F.coalesce(F.col(d).cast("string"), F.lit(NO_DATA)))))).alias("dimension", "grp")
    cells = long.select("score", "fraction", "place", "take", groups)
    chosen = F.col("place") <= F.col("take")
    g = cells.groupBy("score", "fraction", "dimension", "grp").agg(F.count(F.lit(1)).alias("c"), F.count_if(chosen).alias("s"), F.sum(F.when(chosen, 1 / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("e"))
    whole = Window.partitionBy("score", "fraction", "dimension")
    shares = {n: F.col(c) / F.sum(c).over(whole) for n, c in (("catalogue", "c"), ("selected", "s"), ("exposure", "e"))}
    return g.withColumns(shares).withColumn("ratio", F.col("selected") / F.col("catalogue")).drop("c", "s", "e")


def exposure(slots: DataFrame, eligible: DataFrame, item: str, dimension: str) -> DataFrame:
    """(grp, catalogue, shown, ratio): shares of each group among shown slots and eligible items."""
    group = F.coalesce(F.col(dimension).cast("string"), F.lit(NO_DATA)).alias("grp")
    every = Window.partitionBy()
    c = eligible.groupBy(group).agg(F.count(F.lit(1)).alias("n")).select("grp", (F.col("n") / F.sum("n").over(every)).alias("catalogue"))
    s = slots.join(eligible, item).groupBy(group).agg(F.count(F.lit(1)).alias("n")).select("grp", (F.col("n") / F.sum("n").over(every)).alias("shown"))
    return c.join(s, "grp", "left").select("grp", "catalogue", F.coalesce("shown", F.lit(0.0)).alias("shown"), (F.coalesce("shown", F.lit(0.0)) / F.col("catalogue")).alias("ratio"))


def rating_attack(items: DataFrame, *, stars: tuple[int, ...] = (1, 5), sizes: tuple[int, ...] = (5, 20, 100), mark: float = 4.0) -> DataFrame:
    """items(…, n, mean) with attack, added, mean_after, delta, crosses: what some more ratings of one kind would do to each mean."""
    grid = items.withColumn("attack", F.explode(F.array(*(F.lit(s) for s in stars)))).withColumn("added", F.explode(F.array(*(F.lit(s) for s in sizes))))
    after = (F.col("n") * F.col("mean") + F.col("attack") * F.col("added")) / (F.col("n") + F.col("added"))
    return grid.withColumn("mean_after", after).withColumns({"delta": F.col("mean_after") - F.col("mean"), "crosses": (F.col("mean") >= mark) != (F.col("mean_after") >= mark)})


def attack_summary(attacked: DataFrame, group: str) -> DataFrame:
    return attacked.groupBy("attack", "added", group).agg(F.count(F.lit(1)).alias("n_items"), F.median("delta").alias("median_delta"), F.percentile(F.abs("delta"), 0.9).alias("p90_delta"), F.avg(F.col("crosses").cast("double")).alias("crossing"))


def voice_sensitivity(rows: DataFrame, *, q: float = 0.9, least_all: int = 20, least_rest: int = 5) -> DataFrame:
    """(i, n_all, n_rest, mean_all, mean_rest, delta): item means of rows(u, i, r) with and without the users above the q-quantile of activity."""
    activity = rows.groupBy("u").agg(F.count(F.lit(1)).alias("k"))
    limit = activity.agg(F.percentile("k", q).alias("limit"))
    loud = activity.crossJoin(F.broadcast(limit)).where("k > limit").select("u", F.lit(True).alias("loud"))
    g = rows.join(loud, "u", "left").groupBy("i").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("loud").isNull()).alias("n_rest"), F.avg("r").alias("mean_all"), F.avg(F.when(F.col("loud").isNull(), F.col("r"))).alias("mean_rest"))
    return g.where((F.col("n_all") >= least_all) & (F.col("n_rest") >= least_rest)).withColumn("delta", F.col("mean_rest") - F.col("mean_all"))


def missingness(df: DataFrame, columns: list[str], context: str) -> DataFrame:
    """(context, attribute, share): the share of missing values of each column in each context."""
    g = df.groupBy(F.coalesce(F.col(context).cast("string"), F.lit(NO_DATA)).alias(context)).agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return g.select(context, F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c))))).alias("attribute", "share"))


def context_ratio(df: DataFrame, cluster: str, context: str) -> DataFrame:
    """(cluster, context, share, ratio): a context's share in each cluster, and against its share overall."""
    n = df.groupBy(cluster, context).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(cluster))
    overall = F.sum("n").over(Window.partitionBy(context)) / F.sum("n").over(Window.partitionBy())
    return n.select(cluster, context, share.alias("share"), (share / overall).alias("ratio"))


def growth_factors(sizes: list[float], exponents: dict[str, float]) -> list[tuple[str, float, float]]:
    """(kernel, factor of the input, factor of the cost) for costs that grow as a power of the input."""
    return [(name, s, float(s**e)) for name, e in exponents.items() for s in sizes]
