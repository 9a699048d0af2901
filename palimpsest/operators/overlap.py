"""Likeness of the paragraphs of two versions: best partner of each line, shared content."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import blocks
from palimpsest.sources.durable import written

#: Lines with fewer characters have no say.
SHORTEST = 6


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, no (first line with it), n (copies) and line of each different line of a document."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "line"))
    lines = lines.withColumn("line", F.trim("line")).where(F.length("line") >= SHORTEST)
    return lines.groupBy("doc_id", "line").agg(F.min("no").alias("no"), F.count(F.lit(1)).alias("n"))


def alike_edges(no_a: np.ndarray, x: list[str], no_b: np.ndarray, y: list[str], least: float, matching: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in x, place in y, likeness) of texts that are alike by `least`; if `matching`, those that are taken best first."""
    scores = blocks.jaccard_matrix(x, y)
    i, j = np.nonzero(scores >= least)
    score = scores[i, j]
    if matching:
        kept = blocks.best_first(no_a, no_b, i, j, score)
        i, j, score = i[kept], j[kept], score[kept]
    return i, j, score


def _alike(least: float, matching: bool):
    """Pairs of each pair of blocks that are alike by `least`; if `matching`, of a document's only one those that are taken best first."""

    def run(batches):
        for batch in batches:
            found = []
            pairs = zip(blocks.sides(batch.column("a"), ["text"]), blocks.sides(batch.column("b"), ["text"]), batch.column("alone").to_pylist(), strict=True)
            for at, ((no_a, x), (no_b, y), alone) in enumerate(pairs):
                i, j, score = alike_edges(no_a, x, no_b, y, least, matching and alone)
                found.append((np.full(len(i), at), no_a[i], no_b[j], score, np.full(len(i), alone)))
            at, *columns = (np.concatenate(c) for c in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 5
            docs = batch.column("doc_id").take(pa.array(at, pa.int64()))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([docs, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "old_no", "new_no", "likeness", "alone"])

    return run


def alike_pairs(old: DataFrame, new: DataFrame, least: float, matching: bool = False) -> DataFrame:
    """doc_id, old_no, new_no, likeness of paragraphs (doc_id, no, text) of one document whose character pairs have a Jaccard similarity of `least` or more (above 0).

    Also alone: the document has one block of paragraphs on either side.  If `matching`, of
    such a document only the pairs come that are taken best first, each end once.
    """
    rows = lambda d: d.where(F.length("text") >= 2)
    kind = old.schema["doc_id"].dataType.simpleString()
    return blocks.met(rows(old), rows(new), ["doc_id"], ["text"]).mapInArrow(_alike(least, matching), f"doc_id {kind}, old_no long, new_no long, likeness double, alone boolean")


def _best(least: float):
    """Each old line of a pair of blocks with its most alike new line, the earliest of equals; none below `least`."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("at", "no", "line", "n", "likeness", "new_no", "new_line")}
            pairs = zip(blocks.sides(batch.column("a"), ["line", "n"]), blocks.sides(batch.column("b"), ["line", "n"]), strict=True)
            for at, ((no_a, x, n), (no_b, y, _)) in enumerate(pairs):
                top = np.zeros(len(x), np.int64)
                score = np.zeros(len(x))
                if y:
                    scores = blocks.jaccard_matrix(x, y)
                    top = scores.argmax(axis=1)
                    score = scores[np.arange(len(x)), top]
                good = (score >= least) & (score > 0)
                out["at"] += [at] * len(x)
                out["no"] += no_a.tolist()
                out["line"] += x
                out["n"] += n
                out["likeness"] += np.where(good, score, 0.0).tolist()
                out["new_no"] += [int(no_b[k]) if g else None for k, g in zip(top.tolist(), good.tolist(), strict=True)]
                out["new_line"] += [y[k] if g else None for k, g in zip(top.tolist(), good.tolist(), strict=True)]
            at = pa.array(out.pop("at"), pa.int64())
            docs = batch.column("doc_id").take(at)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([docs, *columns, batch.column("alone").take(at)], ["doc_id", *out, "alone"])

    return run


def best_partners(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, line, n (copies), new_line, likeness of every different line of the old version.

    likeness is the Jaccard similarity of character pairs with the most alike line of the
    new version (the earliest of equals); 0 and a null new_line if none has `least`.
    Blocks of a document's lines meet, each pair of blocks in one product.
    """
    a, b = written(_texts(old), "old-lines"), written(_texts(new), "new-lines")
    kind = old.schema["doc_id"].dataType.simpleString()
    met = blocks.met(a, b, ["doc_id"], ["line", "n"], "left")
    best = met.mapInArrow(_best(least), f"doc_id {kind}, no long, line string, n long, likeness double, new_no long, new_line string, alone boolean")
    best = written(best, "best")
    # only lines of documents of several blocks have several partners to choose from
    order = F.struct("likeness", (-F.col("new_no")).alias("early"), "new_line")
    several = best.where("not alone").groupBy("doc_id", "no", "line", "n").agg(F.max(order).alias("m")).select("doc_id", "line", "n", "m.new_line", "m.likeness")
    return best.where("alone").select("doc_id", "line", "n", "new_line", "likeness").unionByName(several)


def content_overlap(old: DataFrame, new: DataFrame, least: float = 0.5, versions: float = 0.5) -> DataFrame:
    """doc_id, n_lines, n_found, overlap and kind of each old document with lines.

    overlap is the share of lines (copies counted) that the new version has in like form; kind is
    'versions' from `versions` on, else 'different'.
    """
    found = F.sum(F.when(F.col("likeness") >= least, F.col("n")).otherwise(0))
    out = best_partners(old, new, least).groupBy("doc_id").agg(F.sum("n").alias("n_lines"), found.alias("n_found"))
    out = out.withColumn("overlap", F.col("n_found") / F.col("n_lines"))
    return out.withColumn("kind", F.when(F.col("overlap") >= versions, "versions").otherwise("different"))


def reworded(old: DataFrame, new: DataFrame, low: float = 0.5, high: float = 0.95) -> DataFrame:
    """doc_id, line, new_line, likeness: lines whose best partner says the same in other words (low to high)."""
    best = best_partners(old, new, low)
    return best.where((F.col("likeness") >= low) & (F.col("likeness") <= high)).drop("n")
