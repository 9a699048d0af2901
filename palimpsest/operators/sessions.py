"""Conversation and progress operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_summary(turns: DataFrame) -> DataFrame:
    """conv_id, n_messages, n_user and the first user message as title (at most 30 characters)."""
    first = F.min(F.when(F.col("role") == "user", F.struct("turn", "text")))
    out = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_user"), first.alias("first"))
    return out.select("conv_id", "n_messages", "n_user", F.coalesce(F.left("first.text", F.lit(30)), F.lit("")).alias("title"))


def last_messages(turns: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation, oldest first: conv_id, turn, role."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("rank", rank).where(F.col("rank") <= n).select("conv_id", "turn", "role")


def progress_monotone(events: DataFrame) -> DataFrame:
    """Progress never falls back: the running maximum of value of each user in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("event_id", "user_id", F.max("value").over(order).alias("progress"))


def task_state_latest(events: DataFrame) -> DataFrame:
    """The last event of each user: user_id, event_id, event_type."""
    last = F.max(F.struct("ts", "event_id", "event_type"))
    return events.groupBy("user_id").agg(last.alias("s")).select("user_id", "s.event_id", "s.event_type")


def progress_tumbling(events: DataFrame, minutes: int = 60) -> DataFrame:
    """Events by window and type; on a stream, give `events` a watermark first."""
    window = F.window("ts", f"{minutes} minutes")
    return events.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
