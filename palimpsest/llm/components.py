"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step: edges (a, b) with a > b."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # a hub's edges are dealt by their other ends
    large = salted_join(both, least, ["a"], "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    large = stored(large, "large-star")
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = salted_join(large, low, ["a"], "b")
    return small.select("a", F.col("m").alias("b")).union(small.select(F.col("b"), F.col("m"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node that it is connected with) for the nodes that aren't roots.

    edges: a long, b long, in any order, with repeats.  The number of steps grows with
    the logarithm of the longest path; each is a few joins on one key.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        # sums of hashes are the same only for the same edges
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(got) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(got)
        if not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = stored(_star(now), "small-star")
