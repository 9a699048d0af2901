"""Progress events as a stream: windows, sessions, repeats, and their batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """New files of a table in folder as a stream, times with the session's zone; the schema is that of the files there now."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Counts by window and type; a window is final when the watermark has passed it."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, minutes: int = 30, late: str = "2 hours") -> DataFrame:
    """user_id, session_start, session_end and n: events of a user less than `minutes` apart."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", f"{minutes} minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_of_each(events: DataFrame, key: list[str], late: str = "2 hours") -> DataFrame:
    """A repeated event (same key) is passed on once."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
    return events.dropDuplicates(key)


def state_changes(events: DataFrame) -> DataFrame:
    """event_id, user_id, event_type of events whose type isn't that of the user's event before."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("event_type").over(order)
    return events.withColumn("_before", before).where("not (event_type <=> _before)").select("event_id", "user_id", "event_type")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives until no new file is left, as a table (append mode, exactly once)."""
    spark = stream.sparkSession
    top = f"{spark.conf.get('spark.checkpoint.dir')}/palimpsest/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{top}-state").trigger(availableNow=True).start(f"{top}-rows")
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}-rows")
