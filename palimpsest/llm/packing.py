"""Bulk-synchronous best-fit packing of documents into sequences of a fixed length.

Only documents longer than a sequence are cut, into whole sequences and a rest.
What is shorter than a sequence is packed in rounds over all rows at once:

1. unplaced pieces and gaps (free room of open sequences) are range-sorted by size,
   which gives every row its place in the order without any global window;
2. a successor sweep over the size classes finds, from the longest pieces of the
   round down, the smallest gaps that still hold them;
3. pieces of one length that want the same gaps are told apart by rank: the piece of
   rank r gets gap r // k, slot r % k, where k pieces fit into one such gap;
4. gaps shrink by what they took, pieces that found none open new sequences, and the
   next round begins.

Sizes are whole numbers up to the sequence length, so the class table that a sweep
reads has at most 2 * max_tokens rows plus two for each partition, however large the
corpus; rows themselves never leave the executors.  A round takes pieces down to two
thirds of the longest unplaced one (see `band`); the number of rounds depends on the
sequence length, not on the number of documents.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranged, stored, table
from .pieces import encoder

_PIECES = "row bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_documents(docs: DataFrame, tokenizer: str, max_tokens: int, end_id: int | None) -> DataFrame:
    """Pieces of at most max_tokens ids: row (of docs), doc_id, piece, start, length, ids_crc32."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")

    def run(parts):
        enc = encoder(tokenizer)
        try:
            for batch in parts:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    flat, n = enc.ids(part.column(2))
                    if end_id is not None:
                        flat = np.insert(flat, np.cumsum(n), end_id)
                        n = n + 1
                    pieces = np.maximum(1, -(-n // max_tokens))
                    of = np.repeat(np.arange(len(n)), pieces)
                    piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    start = piece * max_tokens
                    length = np.minimum(max_tokens, n[of] - start)
                    at = (np.cumsum(n) - n)[of] + start
                    view = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
                    crc = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["row", "doc_id", "piece", "start", "length", "ids_crc32"])
        finally:
            enc.table.release()

    return numbered.mapInArrow(run, _PIECES)


def band(longest: int, capacity: int) -> int:
    """The shortest length that takes part in a round: bands widen as lengths get small."""
    return max(1, longest * 2 // 3 + 1 if 16 * longest > capacity else longest // 4)


def sweep(items: dict[int, tuple[int, int]], gaps: dict[int, tuple[int, int]], low: int, capacity: int) -> tuple[list[tuple], list[tuple]]:
    """One successor sweep over size classes.

    items, gaps: size to [from, to) places in the sorted order.  Pieces of `low` and
    longer take part.  Returns matches (size, from, to, gap size, gap from, gap to, k) and
    openings (size, from, to: these open a sequence each).
    """
    sizes = sorted(gaps)
    left = {g: list(gaps[g]) for g in sizes}
    matches, openings, rest = [], [], {}
    for size in sorted((s for s in items if s >= low), reverse=True):
        lo, hi = items[size]
        for g in sizes[int(np.searchsorted(sizes, size)) :]:
            if lo == hi:
                break
            a, b = left[g]
            if a == b:
                continue
            k = g // size
            used = min(b - a, -(-(hi - lo) // k))
            n = min(hi - lo, used * k)
            matches.append((size, lo, lo + n, g, a, a + used, k))
            lo, left[g][0] = lo + n, a + used
        if lo < hi:
            rest[size] = (lo, hi)
    # what found no gap opens as many sequences as it needs at least, the longest first
    need = max(-(-sum(s * (b - a) for s, (a, b) in rest.items()) // capacity), sum((b - a) // (capacity // s) for s, (a, b) in rest.items()), 1)
    for size in sorted(rest, reverse=True):
        a, b = rest[size]
        n = b - a if 2 * size > capacity else min(b - a, need)
        if n > 0:
            openings.append((size, a, a + n))
            need -= n
    return matches, openings


def pack(pieces: DataFrame, max_tokens: int) -> DataFrame:
    """pieces (id long, unique; length long) with sequence_id and offset.

    A sequence is named after the id of the piece that opened it.
    """
    spark = pieces.sparkSession
    whole = pieces.where(F.col("length") == max_tokens).select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    seeds = (2 * F.col("length") > max_tokens) & (F.col("length") < max_tokens)
    placed = [whole, pieces.where(seeds).select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    # kind 0: a gap of this size in sequence id; kind 1: an unplaced piece of this size
    state = pieces.where(seeds).select(F.lit(0).alias("kind"), (max_tokens - F.col("length")).alias("size"), "id").union(
        pieces.where(2 * F.col("length") <= max_tokens).select(F.lit(1).alias("kind"), F.col("length").alias("size"), "id")
    )
    while True:
        rows, parts = ranged(state, ["size", "kind", F.xxhash64("id"), "id"], "gaps")
        before = {r["part"]: r["before"] for r in parts.collect()}
        # contiguous runs of a sorted order: two for each size and one more for each partition at most
        classes = rows.groupBy("kind", "size", "part").agg(F.min("idx").alias("a"), F.max("idx").alias("b")).collect()
        spans: list[dict[int, tuple[int, int]]] = [{}, {}]
        for r in classes:
            a, b = before[r["part"]] + r["a"], before[r["part"]] + r["b"] + 1
            old = spans[r["kind"]].get(r["size"], (a, b))
            spans[r["kind"]][r["size"]] = (min(a, old[0]), max(b, old[1]))
        gaps, items = spans
        if not items:
            break
        matches, openings = sweep(items, gaps, band(max(items), max_tokens), max_tokens)
        # kind, size, places [a, b), what happens (1: match, 2: open), place of the first gap, pieces a gap, their size, pieces in all
        plan = [(1, s, a, b, 1, ga, k, s, 0) for s, a, b, g, ga, gb, k in matches] + [(1, s, a, b, 2, a, 1, s, 0) for s, a, b in openings]
        plan += [(0, g, ga, gb, 1, ga, k, s, b - a) for s, a, b, g, ga, gb, k in matches]
        lines = spark.createDataFrame(plan, "kind int, size long, a long, b long, how int, gap_at long, k long, took long, n long").coalesce(1)
        met = rows.join(F.broadcast(parts.select("part", "before").coalesce(1)), "part").withColumn("pos", F.col("before") + F.col("idx")).alias("r")
        # lines of one kind and size have places of their own, so a row meets at most one
        met = met.join(F.broadcast(lines).alias("p"), (F.col("r.kind") == F.col("p.kind")) & (F.col("r.size") == F.col("p.size")) & F.col("pos").between(F.col("a"), F.col("b") - 1), "left")
        rank = F.col("pos") - F.col("a")
        met = met.select("r.kind", "r.size", "id", "how", F.when(F.col("r.kind") == 0, F.col("pos")).otherwise(F.col("gap_at") + F.floor(rank / F.col("k"))).alias("at"), (rank % F.col("k") * F.col("r.size")).alias("shift"), (F.least("k", F.col("n") - rank * F.col("k")) * F.col("took")).alias("filled"))
        met = stored(met, "met")
        open_ = met.where("kind = 0 and how = 1").select("at", F.col("id").alias("sequence_id"), F.col("size").alias("free"))
        matched = met.where("kind = 1 and how = 1").join(open_, "at").select("id", "sequence_id", (max_tokens - F.col("free") + F.col("shift")).alias("offset"))
        opened = met.where("how = 2").select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        placed.append(stored(matched.union(opened), "placed"))
        state = met.where("kind = 0 or how is null or how = 2").select(
            F.when((F.col("kind") == 1) & F.col("how").isNull(), 1).otherwise(0).alias("kind"),
            F.when(F.col("kind") == 0, F.col("size") - F.coalesce("filled", F.lit(0))).when(F.col("how") == 2, max_tokens - F.col("size")).otherwise(F.col("size")).alias("size"),
            "id",
        ).where(F.col("size") >= min(items))
    return reduce(DataFrame.union, placed)


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int | None = 0) -> DataFrame:
    """docs (doc_id, text) packed into sequences of at most max_tokens ids.

    Every row is a document of its own: repeated rows are packed once each (column
    `row` tells them apart), a null text is an empty one (the end id alone, or, without
    an end id, one piece of length 0), a null doc_id stays null, an empty table gives no
    rows.  Other columns of docs are left out, whatever their names.
    """
    cut = stored(cut_documents(docs, tokenizer, max_tokens, end_id), "pieces")
    cut = stored(cut.withColumn("id", F.monotonically_increasing_id()), "numbered")
    packed = pack(cut.where("length > 0").select("id", "length"), max_tokens)
    return cut.join(packed, "id", "left").select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "id").alias("sequence_id"), F.coalesce("offset", F.lit(0)).alias("offset"), "row")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 0)
