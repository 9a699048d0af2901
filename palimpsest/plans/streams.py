"""Registered queries on streams with state and on the growing library, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest.plans import catalogue as base
from palimpsest.streaming import ingest, progress, tasks


def _task_events(rows):
    """Events of users as reports of tasks: some pause, go on, stop or end them."""
    n = F.col("event_id") % 40
    command = F.when(n == 7, "pause").when(n == 13, "resume").when(F.col("event_id") % 199 == 5, "cancel").when(F.col("event_id") % 173 == 9, "done").otherwise("run")
    return rows.select(F.col("user_id").alias("task_id"), "ts", "event_id", command.alias("command"), F.col("event_type").alias("step"), F.col("value").alias("pct"))


def _states(spark, sf_dir):
    return tasks.task_states(_task_events(base._events(spark, sf_dir)))


def _streamed(spark, sf_dir):
    return progress.drained(tasks.task_states(_task_events(progress.event_stream(spark, sf_dir))), "tasks")


def _ingested(spark, sf_dir):
    """Documents that land in three batches of files, one after the other, and are added to a library."""
    root = f"{spark.conf.get('spark.checkpoint.dir')}/palimpsest/library-{uuid.uuid4().hex}"
    docs = base._documents(spark, sf_dir).select("doc_id", F.coalesce("source", F.lit("")).alias("family"), "text").where("doc_id is not null")
    for part in range(3):
        docs.where(F.col("doc_id") % 3 == part).write.mode("append").parquet(f"{root}/landing")
        landing = spark.readStream.schema(docs.schema).parquet(f"{root}/landing")
        ingest.follow(landing, f"{root}/store")
    return ingest.documents(spark, f"{root}/store").select("doc_id", "family", "sha256", "n_paragraphs", "status")


QUERIES: dict = {
    "task_states": _states,
    "task_states_stream": _streamed,
    "library_ingest": _ingested,
    "recent_tasks": lambda s, d: tasks.most_recent(_task_events(base._events(s, d)), 50),
}

_STATES = """with e as (select user_id as task_id, ts, event_id, event_type as step, coalesce(value, 0) as pct, case when event_id % 40 = 7 then 'pause' when event_id % 40 = 13 then 'resume' when event_id % 199 = 5 then 'cancel' when event_id % 173 = 9 then 'done' else 'run' end as command from events),
a as (select *, coalesce(last_value(case when command in ('pause', 'resume') then command end ignore nulls) over p = 'pause', false) as paused, coalesce(bool_or(command = 'cancel') over p, false) as cancelled
  from e window p as (partition by task_id order by ts, event_id rows between unbounded preceding and 1 preceding)),
b as (select *, not paused and not cancelled and command in ('run', 'done') as counts from a),
c as (select *, coalesce(bool_or(counts and command = 'done') over (partition by task_id order by ts, event_id rows between unbounded preceding and 1 preceding), false) as ended from b),
d as (select task_id, ts, event_id, coalesce(max(case when counts then case command when 'done' then 100.0 else least(100.0, greatest(0.0, pct)) end end) over u, 0.0) as progress, coalesce(last_value(case when counts then coalesce(step, '') end ignore nulls) over u, '') as shown,
  case when command = 'cancel' then 'cancelled' when command = 'pause' then 'paused' when command = 'resume' then 'running' when counts then case command when 'done' then 'done' else 'running' end else 'paused' end as status
  from c where not ended and not cancelled window u as (partition by task_id order by ts, event_id)),
l as (select *, lag(shown) over o as ls, lag(progress) over o as lp, lag(status) over o as lt from d window o as (partition by task_id order by ts, event_id))
select task_id, event_id, shown as step, cast(progress as double) as progress, status from l where shown <> coalesce(ls, '') or progress <> coalesce(lp, 0.0) or status <> coalesce(lt, 'waiting')"""

ORACLES: dict[str, str] = {
    "task_states": _STATES,
    "task_states_stream": _STATES,
    "library_ingest": """with d as (select *, coalesce(source, '') as family, sha256(coalesce(text, '')) as sha256, doc_id % 3 as b from documents where doc_id is not null),
n as (select * from d qualify row_number() over (partition by sha256 order by b, doc_id) = 1)
select doc_id, family, sha256, cast(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) as int) as n_paragraphs,
case when row_number() over (partition by family order by b desc, doc_id desc) = 1 then 'active' else 'inactive' end as status from n""",
    "recent_tasks": "select user_id as task_id, max(ts) as last_used from events group by user_id order by max((ts, event_id)) desc, user_id limit 50",
}
