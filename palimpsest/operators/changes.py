"""Version compare: changes between two versions of the same documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.normal import folded_key, plain_key
from palimpsest.functions.text import (
    TRACKING_HINTS,
    is_noise,
    quantities,
    strip_revision_noise,
    window_hashes,
)
from palimpsest.operators import blocks, pair_chain
from palimpsest.operators.overlap import alike_edges
from palimpsest.operators.pair_chain import NEAR, NEAREST, left_over, near_edges, paragraph_pairs, rewritten_pairs
from palimpsest.operators.pairing import wished
from palimpsest.sources.durable import written

#: Least likeness of a removed and an added line that makes them one rewritten line.
REWRITTEN = 0.45


def _lines(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "text"))
    return lines.where(F.trim("text") != "").withColumn("chapter", F.lit(""))


def _document_changes(old: str, new: str, least: float) -> list[tuple[str, int, int, str | None, str | None]]:
    """kind, old_no, new_no, old_line, new_line of the changes between two texts of few lines: all stages, one after the other."""
    texts = [{i: t for i, t in enumerate(side.split("\n")) if t.strip(" ")} for side in (old, new)]
    left: list[dict[int, str]] = [{}, {}]
    found: list[tuple[int, int]] = []
    copies: dict[str, list[int]] = {}
    for j in reversed(texts[1]):
        copies.setdefault(plain_key(texts[1][j]), []).append(j)
    met = set()
    for i, t in texts[0].items():
        places = copies.get(plain_key(t))
        if places:
            met.add(places.pop())
        else:
            left[0][i] = t
    left[1] = {j: t for j, t in texts[1].items() if j not in met}

    def take(pairs: list[tuple[int, int]]) -> None:
        found.extend(pairs)
        for i, j in pairs:
            del left[0][i], left[1][j]

    if left[0] and left[1]:
        a, b = (list(side) for side in left)
        x, y = ([folded_key(t) for t in side.values()] for side in left)
        take([(a[i], b[j]) for i, j, _ in wished(a, x, b, y, True)])
    for edges in (partial(near_edges, top=NEAREST, least=NEAR, matching=True), partial(alike_edges, least=least, matching=True)):
        a, b = ([i for i, t in side.items() if len(t) >= 2] for side in left)
        if a and b:
            i, j, _ = edges(np.array(a), [left[0][k] for k in a], np.array(b), [left[1][k] for k in b])
            take([(a[k], b[m]) for k, m in zip(i.tolist(), j.tolist(), strict=True)])
    out = [("modified", i, j, texts[0][i], texts[1][j]) for i, j in found]
    out += [("removed", i, -1, t, None) for i, t in left[0].items()]
    return out + [("added", -1, j, None, t) for j, t in left[1].items()]


def _compared(least: float):
    """The changes of documents (doc_id, old, new: texts) of one text and one block on either side; other texts come back, kind is old or new."""
    size = min(blocks.BLOCK, pair_chain.BLOCK)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            at: list[int] = []
            for k in range(batch.num_rows):
                old, new = batch.column("old")[k].as_py(), batch.column("new")[k].as_py()
                if len(old) > 1 or len(new) > 1 or any(t.count("\n") >= size for t in (*old, *new)):
                    made = [("old", -1, -1, t, None) for t in old] + [("new", -1, -1, t, None) for t in new]
                else:
                    made = _document_changes("".join(old), "".join(new), least)
                rows += made
                at += [k] * len(made)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "kind", "old_no", "new_no", "old_line", "new_line"])

    return run


def line_changes(old: DataFrame, new: DataFrame, least: float = REWRITTEN) -> DataFrame:
    """doc_id, kind (added, removed, modified), old_no, new_no, old_line, new_line of what differs.

    A missing line has number -1 and a null text.  Lines of a document pair in stages
    (`pair_chain.paragraph_pairs`); of what is left, removed and added lines whose
    character pairs are alike by `least` are one modified line, the most alike first.
    Both texts of a document meet in one row, and all stages of a document of one block of lines
    are one pass; those of more lines meet block by block.
    """
    text, none = F.coalesce("text", F.lit("")), F.array().cast("array<string>")
    sides = old.select("doc_id", text.alias("old"), F.lit(None).cast("string").alias("new")).unionByName(new.select("doc_id", F.lit(None).cast("string").alias("old"), text.alias("new")))
    known = sides.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list("old").alias("old"), F.collect_list("new").alias("new"))
    # a document without an id is like no other
    alone = sides.where("doc_id is null").select("doc_id", *(F.when(F.col(c).isNull(), none).otherwise(F.array(c)).alias(c) for c in ("old", "new")))
    kind = old.schema["doc_id"].dataType.simpleString()
    made = known.unionByName(alone).mapInArrow(_compared(least), f"doc_id {kind}, kind string, old_no int, new_no int, old_line string, new_line string")
    made = written(made, "changes")
    rest = lambda side: made.where(F.col("kind") == side).select("doc_id", F.col("old_line").alias("text"))
    found = made.where(~F.col("kind").isin("old", "new"))
    if made.where(F.col("kind").isin("old", "new")).isEmpty():
        return found
    return found.unionByName(_changes_by_blocks(rest("old"), rest("new"), least))


def _changes_by_blocks(old: DataFrame, new: DataFrame, least: float) -> DataFrame:
    """`line_changes` of documents of any number of lines: blocks of lines meet, one stage after the other."""
    a, b = written(_lines(old), "old-lines"), written(_lines(new), "new-lines")
    paired = written(paragraph_pairs(a, b), "pairs")
    gone, come = written(left_over(a, paired, "a"), "gone"), written(left_over(b, paired, "b"), "come")
    again = written(rewritten_pairs(gone, come, least), "rewritten")
    no, nothing = F.lit(-1), F.lit(None).cast("string")
    both = paired.where("stage <> 'equal'").select("doc_id", "a", "b").unionByName(again.select("doc_id", "a", "b"))
    one = both.join(a.select("doc_id", F.col("no").alias("a"), F.col("text").alias("old_line")), ["doc_id", "a"]).join(b.select("doc_id", F.col("no").alias("b"), F.col("text").alias("new_line")), ["doc_id", "b"])
    modified = one.select("doc_id", F.lit("modified").alias("kind"), F.col("a").cast("int").alias("old_no"), F.col("b").cast("int").alias("new_no"), "old_line", "new_line")
    removed = left_over(gone, again, "a").select("doc_id", F.lit("removed").alias("kind"), F.col("no").alias("old_no"), no.alias("new_no"), F.col("text").alias("old_line"), nothing.alias("new_line"))
    added = left_over(come, again, "b").select("doc_id", F.lit("added").alias("kind"), no.alias("old_no"), F.col("no").alias("new_no"), nothing.alias("old_line"), F.col("text").alias("new_line"))
    return modified.unionByName(removed).unionByName(added)


def change_counts(changes: DataFrame) -> DataFrame:
    """kind and n."""
    return changes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def summary_quota(changes: DataFrame, quota: dict[str, int]) -> DataFrame:
    """The first changes of each kind of a document in order of line, as many as its quota."""
    most = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in quota.items()], F.lit(0))
    rank = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy(F.when(F.col("kind") == "added", F.col("new_no")).otherwise(F.col("old_no"))))
    # the constant bound lets each task keep no more than the largest quota before the shuffle
    return changes.withColumn("rank", rank).where(F.col("rank") <= max(quota.values())).where(F.col("rank") <= most)


def absorbed_out(changes: DataFrame, least: int = 15) -> DataFrame:
    """changes without removed lines that a modified line of the same document contains.

    A removed line has `least` characters or more, so it meets a modified line by the hash
    of its first `least` ones, which that line must have at some place; texts are compared
    where hashes meet.
    """
    changes = written(changes, "changes")
    removed = changes.where(f"kind = 'removed' and length(old_line) >= {least}").select("doc_id", "old_no", "old_line")
    modified = changes.where("kind = 'modified'").select("doc_id", F.col("old_no").alias("host"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("old_line").alias("text")), F.struct(F.lit(1).alias("side"), F.col("new_line").alias("text")))).alias("v"))
    modified = modified.select("doc_id", "host", "v.side", "v.text")
    windows = modified.select("doc_id", "host", "side", F.explode(window_hashes(F.col("text"), least)).alias("start"))
    met = removed.select("doc_id", "old_no", F.xxhash64(F.left("old_line", F.lit(least))).alias("start")).join(windows, ["doc_id", "start"])
    both = met.select("doc_id", "old_no", "host", "side").join(removed, ["doc_id", "old_no"]).join(modified, ["doc_id", "host", "side"])
    gone = both.where(F.contains("text", "old_line")).select("doc_id", "old_no", F.lit("removed").alias("kind")).distinct()
    return changes.join(gone, ["doc_id", "old_no", "kind"], "left_anti").select(*changes.columns)


def change_noise(changes: DataFrame, patterns: Sequence[str] = ()) -> DataFrame:
    """changes with noise: what came (added), what went (removed), or both sides (modified) are layout noise."""
    old, new = is_noise(F.col("old_line"), patterns), is_noise(F.col("new_line"), patterns)
    return changes.withColumn("noise", F.when(F.col("kind") == "added", new).when(F.col("kind") == "removed", old).otherwise(old & new))


def substantive(changes: DataFrame) -> DataFrame:
    """changes with bucket: noise (tracking rows, revision stamps, white space, cut tails), keep (quantities differ) or open."""
    old, new = F.coalesce("old_line", F.lit("")), F.coalesce("new_line", F.lit(""))
    bare = lambda x: F.regexp_replace(x, r"\s+", "")
    cut = F.startswith(bare(old), bare(new)) & (F.length(bare(new)) < F.length(bare(old))) & (F.length(bare(old)) - F.length(bare(new)) < 50)
    bucket = (
        F.when(F.coalesce("new_line", "old_line").rlike(TRACKING_HINTS), "noise")
        .when(F.col("kind") != "modified", F.when(strip_revision_noise(F.coalesce("new_line", "old_line")) == "", "noise").otherwise("keep"))
        .when(strip_revision_noise(old) == strip_revision_noise(new), "noise")
        .when(bare(old) == bare(new), "noise")
        .when(cut, "noise")
        .when(quantities(F.col("old_line")) != quantities(F.col("new_line")), "keep")
        .otherwise("open")
    )
    return changes.withColumn("bucket", bucket)
