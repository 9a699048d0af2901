"""Tasks that report their progress: a state machine on a stream, and the same rows from a table.

Events have task_id, ts, event_id, command (run, pause, resume, cancel, done), step and pct
(0 to 100).  A task runs until it is cancelled or done, which is final; while it is paused
its reports don't count.  Progress never falls; steps of several kinds may show as one.
A row is passed on only if what it shows (step, progress, status) differs from the row before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OUT = "task_id long, event_id long, step string, progress double, status string"
_STATE = "step string, progress double, status string"


def _after(state: tuple, command: str, step: str, pct: float) -> tuple:
    """(step, progress, status) after one event."""
    shown, progress, status = state
    if status in ("cancelled", "done"):
        return state
    if command in ("pause", "resume"):
        return shown, progress, "paused" if command == "pause" else "running"
    if command == "cancel":
        return shown, progress, "cancelled"
    if status == "paused":
        return state
    return step, 100.0 if command == "done" else max(progress, min(100.0, max(0.0, pct))), "done" if command == "done" else "running"


def _step(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
    state = held.get if held.exists else ("", 0.0, "waiting")
    for rows in [pd.concat(list(frames))]:
        out = []
        for e in rows.sort_values(["ts", "event_id"]).itertuples(index=False):
            now = _after(state, e.command, e.step, e.pct)
            if now != state:
                out.append((key[0], e.event_id, *now))
            state = now
        yield pd.DataFrame(out, columns=["task_id", "event_id", "step", "progress", "status"])
    held.update(state)


def _complete(events: DataFrame, visible: Column | None) -> DataFrame:
    """Null steps are empty, null percentages 0, and null commands reports; events without a task or time are left out."""
    step = F.col("step") if visible is None else visible
    rows = events.where("task_id is not null and ts is not null")
    return rows.select("task_id", "ts", "event_id", F.coalesce("command", F.lit("run")).alias("command"), F.coalesce(step, F.lit("")).alias("step"), F.coalesce("pct", F.lit(0.0)).cast("double").alias("pct"))


def task_states(events: DataFrame, visible: Column | None = None) -> DataFrame:
    """task_id, event_id, step, progress and status of every event that changes what its task shows.

    On a stream each task's state is kept in the state store; events of one task must come
    in order of time between batches (within one they are sorted).  On a table windows give
    the same rows: what counts is decided by the commands before an event, progress is a
    running maximum of what counts.  visible: the step to show, a column of the events.
    """
    rows = _complete(events, visible)
    if rows.isStreaming:
        return rows.groupBy("task_id").applyInPandasWithState(_step, _OUT, _STATE, "append", "NoTimeout")
    order = Window.partitionBy("task_id").orderBy("ts", "event_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    switch = F.when(F.col("command").isin("pause", "resume"), F.col("command"))
    rows = rows.withColumns({"paused": F.coalesce(F.last(switch, ignorenulls=True).over(before) == "pause", F.lit(False)), "cancelled": F.coalesce(F.max(F.col("command") == "cancel").over(before), F.lit(False))})
    counts = ~F.col("paused") & ~F.col("cancelled") & F.col("command").isin("run", "done")
    ended = F.coalesce(F.max(counts & (F.col("command") == "done")).over(before), F.lit(False))
    live = rows.withColumn("counts", counts).withColumn("ended", ended).where("not ended and not cancelled")
    pct = F.when(F.col("counts"), F.when(F.col("command") == "done", 100.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("pct")))))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    shown = live.withColumns(
        {
            "progress": F.coalesce(F.max(pct).over(upto), F.lit(0.0)),
            "shown": F.coalesce(F.last(F.when(F.col("counts"), F.col("step")), ignorenulls=True).over(upto), F.lit("")),
            "status": F.when(F.col("command") == "cancel", "cancelled").when(F.col("command") == "pause", "paused").when(F.col("command") == "resume", "running").when(F.col("counts"), F.when(F.col("command") == "done", "done").otherwise("running")).otherwise("paused"),
        }
    )
    last = F.lag(F.struct("shown", "progress", "status")).over(order)
    first = F.struct(F.lit("").alias("shown"), F.lit(0.0).alias("progress"), F.lit("waiting").alias("status"))
    changed = shown.withColumn("before", F.coalesce(last, first)).where(F.struct("shown", "progress", "status") != F.col("before"))
    return changed.select("task_id", "event_id", F.col("shown").alias("step"), "progress", "status")


def most_recent(events: DataFrame, most: int = 500) -> DataFrame:
    """task_id and last_used of the `most` tasks that were used last: the ones that are kept, the others go first."""
    used = events.where("task_id is not null").groupBy("task_id").agg(F.max(F.struct("ts", "event_id")).alias("u"))
    return used.orderBy(F.desc("u"), "task_id").limit(most).select("task_id", F.col("u.ts").alias("last_used"))
