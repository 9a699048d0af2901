"""Task states on a stream that stops and goes on, and a library whose batches fail half-way."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.streaming import ingest, tasks

EVENTS = "task_id long, ts timestamp, event_id long, command string, step string, pct double"


def made(seed, n=400):
    rng, at = random.Random(seed), datetime.datetime(2026, 1, 1)
    rows = []
    for i in range(n):
        at += datetime.timedelta(seconds=rng.randrange(3))
        command = rng.choices(["run", "pause", "resume", "cancel", "done", None], [30, 3, 4, 0.3, 0.3, 1])[0]
        rows.append((rng.randrange(6), at, i, command, rng.choice(["parse", "compare", None]), rng.choice([None, -5.0, 150.0, *(float(x) for x in range(0, 100, 7))])))
    return [*rows, (None, at, n, "run", "x", 1.0), (1, None, n + 1, "run", "x", 1.0)]


def plain(rows):
    out, states = [], {}
    for task, ts, event, command, step, pct in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2])):
        state = states.get(task, ("", 0.0, "waiting"))
        now = tasks._after(state, command or "run", step or "", pct or 0.0)
        if now != state:
            out.append((task, event, *now))
        states[task] = now
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_states_of_a_table(spark, seed):
    rows = made(seed)
    got = sorted(tuple(r) for r in tasks.task_states(spark.createDataFrame(rows, EVENTS)).collect())
    assert got == plain(rows) and {"paused", "running", "cancelled"} <= {r[4] for r in got}


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = sorted(made(4), key=lambda r: (r[1] or datetime.datetime.max, r[2]))
    for lo, hi in ((0, 130), (130, 131), (131, 999)):
        spark.createDataFrame(rows[lo:hi], EVENTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = tasks.task_states(spark.readStream.schema(EVENTS).parquet(f"file://{tmp_path}/in"))
        run = stream.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(f"file://{tmp_path}/out")
        run.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == plain(rows)


def test_most_recent(spark):
    at = datetime.datetime(2026, 1, 1)
    rows = [(t, at + datetime.timedelta(seconds=s), i, "run", "", 0.0) for i, (t, s) in enumerate([(1, 0), (2, 1), (3, 2), (1, 3), (4, 3)])]
    got = tasks.most_recent(spark.createDataFrame(rows, EVENTS), 3).orderBy(F.desc("last_used"), "task_id").collect()
    assert {r.task_id for r in got} == {1, 3, 4}


DOCS = "doc_id long, family string, text string"
FIRST = [(1, "a", "one\n\ntwo"), (2, "a", "three"), (3, "b", "three"), (4, "c", None), (None, "c", "no id"), (4, "c", None)]
SECOND = [(5, "a", "four"), (6, "b", "one\n\ntwo"), (7, "d", ""), (1, "z", "other text")]


def library(spark, root):
    docs = sorted((r.doc_id, r.family, r.n_paragraphs, r.status) for r in ingest.documents(spark, root).collect())
    return docs, sorted((r.doc_id, r.no, r.text) for r in ingest.paragraphs(spark, root).collect())


WHOLE = (
    [(1, "a", 2, "inactive"), (2, "a", 1, "inactive"), (4, "c", 0, "active"), (5, "a", 1, "active")],
    [(1, 0, "one"), (1, 1, "two"), (2, 0, "three"), (5, 0, "four")],
)


def test_a_batch_that_fails_half_way_is_not_there(spark, tmp_path, monkeypatch):
    landing, root = f"file://{tmp_path}/landing", f"file://{tmp_path}/store"
    stream = lambda: spark.readStream.schema(DOCS).parquet(landing)
    spark.createDataFrame(FIRST, DOCS).coalesce(1).write.mode("append").parquet(landing)
    ingest.follow(stream(), root)
    before = library(spark, root)
    assert before == ([(1, "a", 2, "inactive"), (2, "a", 1, "active"), (4, "c", 0, "active")], WHOLE[1][:3])
    spark.createDataFrame(SECOND, DOCS).coalesce(1).write.mode("append").parquet(landing)
    calls = []

    def broken(*columns):
        calls.append(1)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ingest.F, "count_if", broken)  # everything but the ledger is written then
        with pytest.raises(Exception, match="lost"):
            ingest.follow(stream(), root)
    assert calls and library(spark, root) == before
    assert spark.read.parquet(f"{root}/documents").where("batch = 1").count() == 1
    ingest.follow(stream(), root)
    assert library(spark, root) == WHOLE
    ingest.add_batch(spark.createDataFrame(SECOND, DOCS), 1, root)  # a batch that comes again
    assert library(spark, root) == WHOLE
    assert sorted(tuple(r) for r in ingest.ledger(spark, root).collect()) == [(0, 3, 1), (1, 1, 3)]


def test_confirmation_and_deletion(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert ingest.documents(spark, root).count() == 0
    ingest.add_batch(spark.createDataFrame(FIRST, DOCS), 0, root, F.col("family") == "a")
    assert {r.doc_id for r in ingest.documents(spark, root).collect()} == {1, 2}
    ingest.delete(spark, root, spark.createDataFrame([(2,), (99,), (None,)], "doc_id long"))
    assert library(spark, root) == ([(1, "a", 2, "active")], [(1, 0, "one"), (1, 1, "two")])
    ingest.add_batch(spark.createDataFrame([], DOCS), 1, root)
    assert ingest.ledger(spark, root).count() == 2


def test_landing_is_written_by_several_tasks(spark, tmp_path):
    """Documents of four files land in files of four tasks, in three batches, and none is lost."""
    import glob

    from palimpsest.plans import streams

    rows = [(d, f"text {d % 50}", f"s{d % 3}", "en", 6) for d in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/palimpsest/library-*"
    before = set(glob.glob(f"{root}/landing/part-*"))
    got = streams._ingested(spark, str(tmp_path)).collect()
    assert len(set(glob.glob(f"{root}/landing/part-*")) - before) >= 9
    assert len(got) == 50 and sum(r.status == "active" for r in got) == 3
