"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import new_path, remove


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): each vertex of an edge with the smallest vertex it is connected to.

    Every round is two window minima, so a vertex of any degree is handled by sorting and no neighbour list is held in memory;
    the number of rounds is logarithmic in the longest path in practice. Null endpoints are dropped, self-loops keep their
    vertex, direction and repetition don't matter, an empty input gives an empty result.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select("u", "v")
    path = new_path(spark, "components")
    pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().write.parquet(path)
    schema = spark.read.parquet(path).schema
    by_u = Window.partitionBy("u")
    before = None
    while True:
        e = spark.read.schema(schema).parquet(path)
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(by_u))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(by_u))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        step = small.select("x.u", "x.v").where("u <> v").distinct()
        after_path = new_path(spark, "components")
        step.write.parquet(after_path)
        remove(spark, path)
        path = after_path
        now = spark.read.schema(schema).parquet(path).agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    e = spark.read.schema(schema).parquet(path)
    roots = e.select(F.col("v").alias("u"), "v").distinct()
    found = e.unionAll(roots)
    lone = loops.distinct().join(found.select("u"), "u", "left_anti")
    return found.unionAll(lone.select("u", "v")).select(F.col("u").alias("id"), F.col("v").alias("component"))
