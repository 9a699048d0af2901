"""Answers on batches of items, their cache, context for questions, groups of conflicts, findings told once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.durable import written


def validated(items: DataFrame, answers: DataFrame) -> DataFrame:
    """batch, n_items, n_answers, valid: a batch is valid if each item (from 1) has one answer and none is null.

    items has a row (batch) for every item, answers has batch, index, inconsistent; answers of unknown
    batches are left out.
    """
    want = items.groupBy("batch").agg(F.count(F.lit(1)).alias("n_items"))
    each = answers.groupBy("batch", "index").agg(F.count(F.lit(1)).alias("n"), F.count("inconsistent").alias("told"))
    got = each.groupBy("batch").agg(F.sum("n").alias("n_answers"), F.sum("told").alias("told"), F.count("index").alias("places"), F.min("index").alias("lo"), F.max("index").alias("hi"))
    n = F.col("n_items")
    valid = (F.col("n_answers") == n) & (F.col("told") == n) & (F.col("places") == n) & (F.col("lo") >= 1) & (F.col("hi") <= n)
    out = want.join(got, "batch", "left")
    return out.select("batch", "n_items", F.coalesce("n_answers", F.lit(0)).alias("n_answers"), F.coalesce(valid, F.lit(False)).alias("valid"))


def answer_key(*parts: Column) -> Column:
    """The key of a cached answer; a null part is empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def cache_misses(items: DataFrame, cache: DataFrame) -> DataFrame:
    """items (with key) whose key the cache lacks: what is still to be asked."""
    return items.join(cache.select("key").distinct(), "key", "left_anti")


def sources(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, source, status of each hit; a hit without a document is 'unknown'."""
    named = docs.select(F.col("doc_id").alias("vec_id"), "source", "status")
    out = hits.join(named, "vec_id", "left")
    return out.select("query_id", "rank", "vec_id", F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("status", F.lit("unknown")).alias("status"))


def contexts(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id and context: the numbered texts of its hits in order of rank, with source and mark of the current version.

    Hits of a query are bounded by its top k.
    """
    named = hits.join(docs.select(F.col("doc_id").alias("vec_id"), "source", "status", "text"), "vec_id")
    mark = F.when(F.col("status") == "active", " [current]").otherwise("")
    block = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.coalesce("source", F.lit("unknown")), mark, F.lit("\n"), F.coalesce("text", F.lit("")))
    blocks = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return named.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda b: b.block), "\n\n").alias("context"))


def conflict_groups(pairs: DataFrame, docs: DataFrame, head: int = 50) -> DataFrame:
    """query_id, source, head, n_pairs, first_id: conflicts that share the source and first characters of side a."""
    told = docs.select(F.col("doc_id").alias("id_a"), "source", F.left(F.trim(F.coalesce("text", F.lit(""))), F.lit(head)).alias("head"))
    return pairs.join(told, "id_a").groupBy("query_id", "source", "head").agg(F.count(F.lit(1)).alias("n_pairs"), F.min("id_a").alias("first_id"))


def keep_first(items: DataFrame, edges: DataFrame) -> DataFrame:
    """items (id) without those that an edge (a, b) ties to an earlier one (smaller id) that is kept.

    In each round an item with no earlier undecided neighbour is kept and its later
    neighbours go; in the end these are the rows of the sequential rule.
    """
    pairs = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct()
    left, gone = written(pairs, "ties"), []
    while left.limit(1).count():
        free = left.select("lo").distinct().join(left.select(F.col("hi").alias("lo")).distinct(), "lo", "left_anti")
        out = written(left.join(free, "lo", "left_semi").select(F.col("hi").alias("id")).distinct(), "dropped")
        gone.append(out)
        hi, lo = out.withColumnRenamed("id", "hi"), out.withColumnRenamed("id", "lo")
        rest = left.join(free, "lo", "left_anti").join(hi, "hi", "left_anti").join(lo, "lo", "left_anti")
        left = written(rest.select("lo", "hi"), "ties")
    for part in gone:
        items = items.join(part, "id", "left_anti")
    return items
