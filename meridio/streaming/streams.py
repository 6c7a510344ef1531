"""Structured Streaming forms of the event operators: sources, windows, deduplication and DGIM state."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sketch import Dgim, cms_cells
from ..sources.shared import new_path


def read_events(spark: SparkSession, sf_dir: str, name: str = "events", ts: str = "ts") -> DataFrame:
    """A Parquet table as a stream with its event time as a timestamp."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(path) if whole else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """All that the stream has now, run to its end, as a frame: the last table in complete mode, else what all batches gave.

    Batches are written under their number, so a repeated batch replaces itself.
    """
    spark = stream.sparkSession
    out, state = new_path(spark, "stream"), new_path(spark, "stream-state")
    last: list[int] = []

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        last.append(number)

    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    paths = [f"{out}/batch={n}" for n in (last[-1:] if mode == "complete" else sorted(set(last)))]
    return spark.read.schema(stream.schema).parquet(*paths)


def tumbling(events: DataFrame, key: str, width: str, delay: str = "2 hours") -> DataFrame:
    w = events.withWatermark("ts", delay).groupBy(key, F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(key, F.col("window.start").alias("start"), "n", "total")


def sliding(events: DataFrame, key: str, width: str, slide: str, delay: str = "2 hours") -> DataFrame:
    w = events.withWatermark("ts", delay).groupBy(key, F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, key: str, gap: str, delay: str = "2 hours") -> DataFrame:
    w = events.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], delay: str = "60 days") -> DataFrame:
    """Each combination of the keys once within the watermark's reach."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys).select(*keys)


def count_min(events: DataFrame, code: str, width: int, depth: int) -> DataFrame:
    """The Count-Min table as a running aggregate."""
    return events.select(F.explode(cms_cells(F.col(code), width, depth)).alias("x")).groupBy("x.row", "x.col").agg(F.count(F.lit(1)).alias("n"))


def dgim(events: DataFrame, key: str, bit: str, window: int) -> DataFrame:
    """(key, seen, estimate, buckets, valid): DGIM over each key's bits in event order; the state is the bucket list as JSON.

    A batch's rows are put in event order first; bits count by arrival after that, as in a stream of ticks.
    """
    def step(group, frames, state: GroupState):
        old = json.loads(state.get[0]) if state.exists else {"buckets": [], "last": 0}
        sketch = Dgim(window, old["buckets"], old["last"])
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for b in rows["bit"].tolist():
            sketch.update((sketch.last or 0) + 1, int(b))
        state.update((json.dumps({"buckets": sketch.buckets, "last": sketch.last}),))
        yield pd.DataFrame({key: [group[0]], "seen": [sketch.last], "estimate": [sketch.estimate()], "buckets": [len(sketch.buckets)], "valid": [sketch.valid()]})

    rows = events.select(key, "ts", "event_id", events[bit].cast("int").alias("bit"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} string, seen bigint, estimate double, buckets int, valid boolean", "state string", "update", GroupStateTimeout.NoTimeout)
