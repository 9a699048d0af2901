"""Paragraphs of two versions that say the same, whatever their numbering, breaks and spelling of spaces."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.normal import BOUNDARIES, content_key
from palimpsest.operators import blocks
from palimpsest.sources.durable import written

#: Shorter contents are not paired by this rule.
SHORTEST = 12
#: Characters by which contents meet that may hold one another.
PROBE = 12

_BOUNDARY = re.compile(f"[{BOUNDARIES}]")


def in_turn(wishes: DataFrame, ends: list[str]) -> DataFrame:
    """The pairs that come about if the a's of each group, in order, take the best free b each.

    wishes: the columns `ends` (of the group), a, b and rank (struct, larger is better).
    All a's ask for their best b at once; each b keeps the least a; the others ask for
    their next best, until none is refused.  As every b prefers the least a, this gives
    the pairs of the sequential rule.  A round removes one wish of each refused a.
    """
    left = written(wishes.select(*ends, "a", "b", "rank"), "wishes")
    while True:
        best = left.groupBy(*ends, "a").agg(F.max(F.struct("rank", "b")).alias("m")).select(*ends, "a", "m.b")
        first = best.groupBy(*ends, "b").agg(F.min("a").alias("first"))
        refused = written(best.join(first, [*ends, "b"]).where(F.col("a") > F.col("first")).select(*ends, "a", "b"), "refused")
        if refused.isEmpty():
            return left.join(best, [*ends, "a", "b"])
        left = written(left.join(refused, [*ends, "a", "b"], "left_anti").select(*left.columns), "wishes")


def _holding(outer: list[str], inner: list[str]) -> set[tuple[int, int]]:
    """(place in outer, place in inner) of contents that hold another as whole sentences; inner ones have PROBE characters or more."""
    heads: dict[str, list[int]] = {}
    for j, t in enumerate(inner):
        if len(t) >= SHORTEST:
            heads.setdefault(t[:PROBE], []).append(j)
    out = set()
    for i, t in enumerate(outer):
        # a sentence begins where the text does, or after the end of one
        for k in (0, *(m.end() for m in _BOUNDARY.finditer(t))) if heads else ():
            for j in heads.get(t[k : k + PROBE], ()):
                s, end = inner[j], k + len(inner[j])
                if len(s) < len(t) and t.startswith(s, k) and (end == len(t) or t[end - 1] in BOUNDARIES or t[end] in BOUNDARIES):
                    out.add((i, j))
    return out


def wished(no_a: list[int], x: list[str], no_b: list[int], y: list[str], alone: bool) -> list[tuple[int, int, int]]:
    """(place in x, place in y, relation) of contents that are the same; if `alone`, those that come about if the a's choose in turn."""
    out: list[tuple[int, int, int]] = []
    equal: dict[str, list[int]] = {}
    for j, key in enumerate(y):
        if len(key) >= SHORTEST:
            equal.setdefault(key, []).append(j)
    holds: dict[int, set[int]] = {}
    for i, j in _holding(x, y):
        holds.setdefault(i, set()).add(j)
    for j, i in _holding(y, x):
        holds.setdefault(i, set()).add(j)
    used: set[int] = set()
    for i, key in enumerate(x):
        for kind, found in ((2, equal.get(key, ())), (1, holds.get(i, ()))):
            some = [j for j in found if j not in used]
            if alone and some:
                some = [min(some, key=lambda j: (abs(no_a[i] - no_b[j]), no_b[j]))]
                used.update(some)
            out += [(i, j, kind) for j in some]
            if alone and some:
                break
    return out


def _wishes(batches):
    """(a, b, relation) of the contents of each pair of blocks; of a chapter's only one those that come about if the a's choose in turn."""
    for batch in batches:
        at, a, b, relation = [], [], [], []
        pairs = zip(blocks.sides(batch.column("a"), ["key"]), blocks.sides(batch.column("b"), ["key"]), batch.column("alone").to_pylist(), strict=True)
        for row, ((no_a, x), (no_b, y), alone) in enumerate(pairs):
            no_a, no_b = no_a.tolist(), no_b.tolist()
            for i, j, kind in wished(no_a, x, no_b, y, alone):
                at.append(row)
                a.append(no_a[i])
                b.append(no_b[j])
                relation.append(kind)
        place = pa.array(at, pa.int64())
        ends = [batch.column(c).take(place) for c in ("doc_id", "chapter")]
        yield pa.RecordBatch.from_arrays([*ends, pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(relation, pa.int32()), batch.column("alone").take(place)], ["doc_id", "chapter", "a", "b", "relation", "alone"])


def same_content(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, chapter, a, b and score of paragraphs (doc_id, chapter, no, text) that pair by content.

    Within a chapter, contents are the same if their keys are equal (1.0), or if one
    holds the other as whole sentences (0.95).  Old paragraphs choose in order: equal
    before holding, the nearest place, then the earlier one.  Keys under SHORTEST characters are not
    paired.  A chapter's keys meet in pairs of blocks; one of several blocks chooses in rounds.
    """
    keyed = lambda d: d.select("doc_id", "chapter", "no", content_key(F.col("text"), False).alias("key"))
    # short keys are passed over where keys meet, as a filter here would make every key twice
    ends, no = ["doc_id", "chapter"], old.schema["no"].dataType
    kind = old.schema["doc_id"].dataType.simpleString()
    met = blocks.met(keyed(old), keyed(new), ends, ["key"])
    wishes = written(met.mapInArrow(_wishes, f"doc_id {kind}, chapter string, a long, b long, relation int, alone boolean"), "content")
    several = wishes.where("not alone").drop("alone")
    rank = F.struct("relation", (-F.abs(F.col("a") - F.col("b"))).alias("near"), (-F.col("b")).alias("early"))
    turned = in_turn(several.withColumn("rank", rank), ends).select(*ends, "a", "b", F.col("rank.relation").alias("relation"))
    pairs = wishes.where("alone").select(*ends, "a", "b", "relation").unionByName(turned)
    return pairs.select(*ends, F.col("a").cast(no).alias("a"), F.col("b").cast(no).alias("b"), F.when(F.col("relation") == 2, 1.0).otherwise(0.95).alias("score"))


def without_copies(pairs: DataFrame) -> DataFrame:
    """Each pair once, with its best score."""
    best = F.row_number().over(Window.partitionBy("doc_id", "a", "b").orderBy(F.desc("score")))
    return pairs.withColumn("place", best).where("place = 1").drop("place")
