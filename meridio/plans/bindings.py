"""How the operators' inputs bind to the tables at hand: interactions, items, markets, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, i, r, d): each customer's first purchase from each supplier, rated 1 to 5 by quantity."""
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("u"), F.col("l_suppkey").alias("i"), (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("r"), F.to_date("o_orderdate").alias("d")
    )
    # the first by date, the lower rating on a tie: a partial aggregate instead of a sort of all rows
    return rows.groupBy("u", "i").agg(F.min(F.struct("d", "r")).alias("x")).select("u", "i", "x.r", "x.d")


INTER = """inter AS (SELECT u, i, r, d FROM (
  SELECT o_custkey AS u, l_suppkey AS i, CAST(1 + floor((l_quantity - 1) / 10) AS DOUBLE) AS r, CAST(o_orderdate AS DATE) AS d,
    row_number() OVER (PARTITION BY o_custkey, l_suppkey ORDER BY CAST(o_orderdate AS DATE), 1 + floor((l_quantity - 1) / 10)) AS k
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE k = 1)"""


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, market, city): suppliers with their region and nation; the dimension tables have 25 and 5 rows at any size."""
    s, n, r = (t(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    dims = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("market"))
    return s.join(F.broadcast(dims), s.s_nationkey == dims.n_nationkey).select(F.col("s_suppkey").alias("i"), "market", "city", F.col("s_acctbal").alias("balance"))


SUPP = "supp AS (SELECT s_suppkey AS i, r_name AS market, n_name AS city, s_acctbal AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def train(inter: DataFrame) -> DataFrame:
    return inter.where(F.year("d") <= 1999)


def by(*cols):
    return Window.partitionBy(*cols)
