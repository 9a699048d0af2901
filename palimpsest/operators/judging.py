"""Batches that are asked again in halves where an answer fails, and answers that are kept for the next time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.durable import written


def in_halves(items: DataFrame, ask: Callable[[DataFrame], DataFrame], least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(answers, calls) of items (batch, place from 1 without gaps, and what the question needs).

    `ask` gets items with lo and hi (the stretch of the batch that is asked together, and the
    item's place) and returns batch, lo, place and answer.  A stretch is answered if it
    has exactly one answer that isn't null for each of its items; otherwise its halves are
    asked in the next round, the first half the shorter one, down to stretches of `least`
    items.  answers: batch, place, answer; calls: batch, lo, hi, answered.  All stretches of a
    round are asked in one job, and rounds are the logarithm of the longest batch.
    """
    open_ = items.groupBy("batch").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    answers, calls = [], []
    while True:
        stretch = open_.select("batch", "lo", "hi")
        asked = items.join(stretch, "batch").where("place between lo and hi")
        got = written(ask(asked).select("batch", "lo", "place", "answer"), "answers")
        # an item has one answer: more, or null ones, spoil the stretch
        each = got.groupBy("batch", "lo", "place").agg(F.count(F.lit(1)).alias("n"), F.count("answer").alias("told"))
        counted = each.groupBy("batch", "lo").agg(F.sum("n").alias("n"), F.sum("told").alias("told"), F.count(F.lit(1)).alias("places"), F.min("place").alias("first"), F.max("place").alias("last"))
        size = F.col("hi") - F.col("lo") + 1
        whole = (F.col("n") == size) & (F.col("told") == size) & (F.col("places") == size) & (F.col("first") == F.col("lo")) & (F.col("last") == F.col("hi"))
        round_ = written(stretch.join(counted, ["batch", "lo"], "left").select("batch", "lo", "hi", F.coalesce(whole, F.lit(False)).alias("answered")), "calls")
        calls.append(round_)
        answers.append(got.join(round_.where("answered"), ["batch", "lo"], "left_semi").select("batch", "place", "answer"))
        again = round_.where(~F.col("answered") & (F.col("hi") - F.col("lo") + 1 > least))
        if again.isEmpty():
            break
        middle = F.col("lo") + F.floor((F.col("hi") - F.col("lo") + 1) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo").alias("lo"), (middle - 1).alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi"))))
        open_ = written(again.select("batch", halves.alias("h")).select("batch", "h.lo", "h.hi"), "open")
    for more in answers[1:]:
        answers[0] = answers[0].unionByName(more)
    for more in calls[1:]:
        calls[0] = calls[0].unionByName(more)
    return answers[0], calls[0]


def with_cache(items: DataFrame, cache: DataFrame, ask: Callable[[DataFrame], DataFrame], least: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, calls, cache): items (batch, place, key) answered from the cache (key, answer) first.

    What the cache lacks is numbered anew within its batch, asked in halves, and put back to
    its own place.  The new cache has the old answers and the new ones, one a key.
    """
    known = cache.groupBy("key").agg(F.min("answer").alias("answer"))
    marked = written(items.join(known, "key", "left"), "marked")
    hits = marked.where("answer is not null").select("batch", "place", "answer")
    misses = marked.where("answer is null").drop("answer")
    order = F.row_number().over(Window.partitionBy("batch").orderBy("own"))
    fresh = written(misses.withColumnRenamed("place", "own").withColumn("place", order), "misses")
    answers, calls = in_halves(fresh, ask, least)
    found = written(answers.join(fresh.select("batch", "place", "own", "key"), ["batch", "place"]).select("batch", F.col("own").alias("place"), "key", "answer"), "found")
    kept = known.unionByName(found.groupBy("key").agg(F.min("answer").alias("answer")))
    return hits.unionByName(found.drop("key")), calls, kept

