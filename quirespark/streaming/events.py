"""Event streams: windows behind a watermark, sessions, duplicates, and jobs as state machines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirespark.shared import new_path

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
MOST_RESTARTS = 6


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with ts as a timestamp."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(SCHEMA)
    rows = reader.parquet(f"{sf_dir}/events.parquet") if whole else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, and read what it wrote. A restart goes on from the checkpoint."""
    spark = stream.sparkSession
    out, marks = new_path(spark, name), new_path(spark, f"{name}-marks")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
    else:

        def put(batch: DataFrame, n: int) -> None:
            batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")  # a repeated batch replaces itself

        q = stream.writeStream.foreachBatch(put).option("checkpointLocation", marks).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{out}/*")


def windowed_counts(events: DataFrame, size: str, slide: str, delay: str) -> DataFrame:
    """Events of each type in sliding windows; a window is final once the watermark has passed its end."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Runs of a user's events without a pause of `gap`: a stall ends a session."""
    s = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_each(events: DataFrame, key: str, delay: str) -> DataFrame:
    """Messages of which repeats within the watermark are dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def job_states(events: DataFrame) -> DataFrame:
    """user_id (a job), restarts, status and seen after each batch: an error restarts a job, more than six fail it for
    good; otherwise its last event tells."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        restarts, status, seen = state.get if state.exists else (0, "queued", 0)
        every = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for kind in every["event_type"]:
            seen += 1
            if status == "failed":
                continue
            restarts += kind == "error"
            status = "failed" if restarts > MOST_RESTARTS else "queued" if kind == "error" else "done" if kind == "purchase" else "running"
        state.update((int(restarts), status, seen))
        yield pd.DataFrame({"user_id": [key[0]], "restarts": [int(restarts)], "status": [status], "seen": [seen]})

    kind = "user_id long, restarts int, status string, seen long"
    return events.select("user_id", "ts", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(step, kind, "restarts int, status string, seen long", "update", GroupStateTimeout.NoTimeout)
