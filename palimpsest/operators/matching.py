"""One-to-one matching of scored pairs, and conflicts among the hits of a search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import bigrams, jaccard
from palimpsest.sources.durable import written


def greedy_match(edges: DataFrame, least: float) -> DataFrame:
    """a, b, score: pairs taken best first (score, a, b, all descending), each end used once.

    The order is total, so that taking in each round every pair that is the best at both
    of its ends gives the rows of the sequential rule.  Ends are compared by maxima,
    which tasks pre-aggregate, so that a frequent end is no large group.
    """
    left, taken = written(edges.where(F.col("score") >= least).select("a", "b", "score").distinct(), "edges"), []
    while left.limit(1).count():
        best_a = left.groupBy("a").agg(F.max(F.struct("score", "a", "b")).alias("m")).select("m.*")
        best_b = left.groupBy("b").agg(F.max(F.struct("score", "a", "b")).alias("m")).select("m.*")
        now = written(best_a.join(best_b, ["a", "b", "score"]).select("a", "b", "score"), "taken")
        taken.append(now)
        left = written(left.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti").select("a", "b", "score"), "edges")
    out = edges.select("a", "b", "score").limit(0)
    for part in taken:
        out = out.unionByName(part)
    return out


def conflict_pairs(hits: DataFrame, score: float = 0.7, low: float = 0.5, high: float = 0.95) -> DataFrame:
    """query_id, id_a, id_b, likeness: hits (query_id, vec_id, rank, score, source, text) of one query that may conflict.

    Both scores above `score`, other sources, other texts, and a likeness of character
    pairs between low and high (both excluded).  Hits of a query are bounded by its top k.
    """
    strong = hits.where(F.col("score") > score)
    a = strong.select("query_id", F.col("rank").alias("ra"), F.col("vec_id").alias("id_a"), F.col("source").alias("sa"), F.trim("text").alias("ta"))
    b = strong.select("query_id", F.col("rank").alias("rb"), F.col("vec_id").alias("id_b"), F.col("source").alias("sb"), F.trim("text").alias("tb"))
    met = a.join(b, "query_id").where("ra < rb and not (sa <=> sb) and ta <> tb")
    scored = met.select("query_id", "id_a", "id_b", jaccard(bigrams(F.col("ta")), bigrams(F.col("tb"))).alias("likeness"))
    return scored.where((F.col("likeness") > low) & (F.col("likeness") < high))
