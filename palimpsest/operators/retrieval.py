"""Vector search: exact cosine top-k of queries against a whole library, block against block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.durable import written

#: Library rows of a block, and queries of one.
BLOCK, QUERY_BLOCK = 1024, 256


def _blocks(rows: DataFrame, side: str, size: int) -> DataFrame:
    """Blocks of at most `size` unit vectors of one length: {side}_dim, {side}_ids and {side}_vectors; null vectors are left out."""

    def run(parts):
        for batch in parts:
            held: dict[int, list] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if v is not None and None not in v and i is not None:
                    held.setdefault(len(v), []).append((i, v))
            for dim, found in held.items():
                for lo in range(0, len(found), size):
                    part = found[lo : lo + size]
                    x = np.array([v for _, v in part], np.float64).reshape(len(part), dim)
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    ids = np.array([i for i, _ in part], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()]), pa.array([x.tobytes()])], [f"{side}_dim", f"{side}_ids", f"{side}_vectors"])

    return rows.select("vec_id", "embedding").mapInArrow(run, f"{side}_dim int, {side}_ids binary, {side}_vectors binary")


def top_k(library: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, rank (from 1) and score of the k nearest library rows of each query.

    Every block of queries meets every block of the library; both stay tables, and Spark
    sends the smaller one out only if it is small.  A pair of blocks keeps k rows for each
    query; the final ranking sees those alone.  Ties go to the smaller vec_id; vectors of
    length 0 have score 0; null vectors, and those of another dimension, meet nothing.
    """
    met = _blocks(library, "l", BLOCK).crossJoin(_blocks(queries, "q", QUERY_BLOCK)).where("l_dim = q_dim")

    def run(parts):
        for batch in parts:
            for dim, li, lv, qi, qv in zip(*(batch.column(c).to_pylist() for c in ("l_dim", "l_ids", "l_vectors", "q_ids", "q_vectors")), strict=True):
                ids, names = np.frombuffer(li, np.int64), np.frombuffer(qi, np.int64)
                scores = np.frombuffer(qv, np.float64).reshape(len(names), dim) @ np.frombuffer(lv, np.float64).reshape(len(ids), dim).T
                best = np.lexsort((np.broadcast_to(ids, scores.shape), -np.round(scores, 9)))[:, :k]
                q = np.repeat(np.arange(len(names)), best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(ids[best.ravel()]), pa.array(scores[q, best.ravel()])], ["query_id", "vec_id", "score"])

    near = met.select("l_dim", "l_ids", "l_vectors", "q_ids", "q_vectors").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


#: Most pivots of a self-made index, and rows of the library for each.
PIVOTS, PER_PIVOT = 64, 4096
#: Blocks of the library in one of pairs, rows of it in one product, and pairs that are multiplied again at once.
NEAR, STRIP, PAIRS = 4, 256, 1 << 16


def _unit(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of a batch (id, vector), for each length; rows without an id, or without a whole vector, are left out."""
    ids, lists = batch.column(0), batch.column(1)
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    good = pc.is_valid(ids).to_numpy(zero_copy_only=False) & (length > 0)
    flat = lists.flatten()
    if flat.null_count:
        good[np.unique(pc.list_parent_indices(lists).to_numpy()[pc.is_null(flat).to_numpy(zero_copy_only=False)])] = False
    for dim in np.unique(length[good]).tolist():
        at = pa.array(np.flatnonzero(good & (length == dim)))
        x = lists.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        yield ids.take(at).to_numpy(zero_copy_only=False).astype(np.int64), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _pivoted(rows: DataFrame, pivots: np.ndarray):
    """pivot, angle to it, id and unit vector of each row; rows of another length than the pivots' have pivot -length."""

    def run(parts):
        for batch in parts:
            for ids, x in _unit(batch):
                pivot, angle = np.full(len(x), -x.shape[1]), np.zeros(len(x))
                if x.shape[1] == pivots.shape[1]:
                    near = x @ pivots.T
                    pivot = near.argmax(axis=1)
                    angle = np.arccos(np.clip(near[np.arange(len(x)), pivot], -1.0, 1.0))
                vectors = pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(pivot, pa.int32()), pa.array(angle), pa.array(ids), vectors], ["pivot", "angle", "id", "vector"])

    return rows.select("vec_id", "embedding").mapInArrow(run, "pivot int, angle double, id long, vector binary")


def _packed(blocks: DataFrame) -> DataFrame:
    """pivot, block, radius, ids and vectors of blocks whose rows are structs: arrays as bytes."""

    def run(parts):
        for batch in parts:
            lists = batch.column("rows")
            for at in range(batch.num_rows):
                rows = lists[at].values
                ids, vectors = rows.field("id").to_numpy().astype(np.int64), b"".join(rows.field("vector").to_pylist())
                told = [batch.column(c).slice(at, 1) for c in ("pivot", "block", "radius")]
                yield pa.RecordBatch.from_arrays([*told, pa.array([ids.tobytes()], pa.binary()), pa.array([vectors], pa.binary())], ["pivot", "block", "radius", "ids", "vectors"])

    return blocks.mapInArrow(run, "pivot int, block int, radius double, ids binary, vectors binary")


def _products(least: float):
    """a, b, score of the pairs of vectors of two blocks with a cosine of `least` or more; of a block with itself (same), each pair once."""

    def run(parts):
        for batch in parts:
            for at in range(batch.num_rows):
                ia, u, jb, v, same = (batch.column(c)[at].as_py() for c in ("x_ids", "x_vectors", "y_ids", "y_vectors", "same"))
                ia, jb = np.frombuffer(ia, np.int64), np.frombuffer(jb, np.int64)
                u, v = (np.frombuffer(z, np.float64).reshape(len(i), -1) for z, i in ((u, ia), (v, jb)))
                # what single precision rules out, whatever its rounding, isn't multiplied again
                low = np.float32(least - (u.shape[1] + 8) * 2.0**-22)
                u32, v32 = u.astype(np.float32), v.T.astype(np.float32)
                for lo in range(0, len(u), STRIP):
                    first = lo if same else 0
                    found = np.flatnonzero(u32[lo : lo + STRIP] @ v32[:, first:] >= low)
                    for part in range(0, len(found), PAIRS):
                        i, j = np.divmod(found[part : part + PAIRS], len(v) - first)
                        i, j = i + lo, j + first
                        if same:
                            i, j = i[i < j], j[i < j]
                        score = np.einsum("ij,ij->i", u[i], v[j])
                        good = score >= least
                        yield pa.RecordBatch.from_arrays([pa.array(ia[i[good]]), pa.array(jb[j[good]]), pa.array(score[good])], ["a", "b", "score"])

    return run


def _clusters(rows: DataFrame):
    """pivots (unit vectors: a bounded sample of rows), or None if there is no vector."""
    n = min(PIVOTS, max(1, rows.count() // PER_PIVOT))
    found = [r["embedding"] for r in rows.orderBy("vec_id").limit(n).collect()]
    found = [np.array(v, np.float64) for v in found if len(v) == len(found[0]) and None not in v]
    return np.stack([v / max(float(np.linalg.norm(v)), 1e-12) for v in found]) if found else None


def _laid(rows: DataFrame, pivots: np.ndarray, side: str) -> DataFrame:
    """The blocks of rows, about NEAR vectors with one nearest pivot each, as a table."""
    placed = written(_pivoted(rows, pivots), side)
    sizes = {r["pivot"]: r["n"] for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.coalesce(*(F.when(F.col("pivot") == p, -(-k // (NEAR * BLOCK))) for p, k in sizes.items()), F.lit(1))
    named = placed.withColumn("block", F.pmod(F.xxhash64("id"), parts).cast("int"))
    full = named.groupBy("pivot", "block").agg(F.max("angle").alias("radius"), F.collect_list(F.struct("id", "vector")).alias("rows"))
    return written(_packed(full), f"{side}-blocks")


def _met(x: DataFrame, y: DataFrame, pivots: np.ndarray, least: float, once: bool) -> DataFrame:
    """Pairs (a, b, score) of the blocks x and y that can hold any; if `once`, x and y are one table and each pair of its rows comes once."""
    apart = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
    reach = float(np.arccos(np.clip(least, -1.0, 1.0))) + 1e-6
    x, y = (d.select(*(F.col(c).alias(f"{side}_{c}") for c in d.columns)) for d, side in ((x, "x"), (y, "y")))
    # tasks read the blocks of both tables where these lie: a block is shuffled once, however many it meets
    between = F.split(F.lit(",".join(map(repr, apart.ravel().tolist()))), ",").cast("array<double>")
    there = F.when((F.col("x_pivot") >= 0) & (F.col("y_pivot") >= 0), F.get(between, F.col("x_pivot") * len(pivots) + F.col("y_pivot")))
    near = (there <= F.col("x_radius") + F.col("y_radius") + reach) | ((F.col("x_pivot") < 0) & (F.col("x_pivot") == F.col("y_pivot")))
    same = F.lit(False)
    if once:
        one, other = (F.struct(F.col(f"{side}_pivot").alias("pivot"), F.col(f"{side}_block").alias("block")) for side in "xy")
        near, same = near & (one <= other), one == other
    met = x.crossJoin(y).where(near).select("x_ids", "x_vectors", "y_ids", "y_vectors", same.alias("same"))
    return met.mapInArrow(_products(least), "a long, b long, score double")


def pairs_above(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b, score of all pairs (vec_id, embedding) with a cosine of `least` or more; none is left out.

    Rows lie in blocks of about NEAR * BLOCK with one nearest pivot (a bounded sample of the right
    side).  Two blocks can hold such a pair only if the angle between their pivots is no
    more than both blocks' radii and the angle of `least`, so most pairs of blocks aren't
    compared where vectors cluster.  Null vectors meet nothing, nor do those of different
    lengths; vectors of length 0 have score 0.
    """
    right = right.where("embedding is not null and size(embedding) > 0")
    pivots = _clusters(right)
    if pivots is None:
        return right.sparkSession.createDataFrame([], "a long, b long, score double")
    return _met(_laid(left, pivots, "x"), _laid(right, pivots, "y"), pivots, least, False)


def pairs_within(rows: DataFrame, least: float) -> DataFrame:
    """`pairs_above` of rows and themselves with a < b, each pair of blocks compared once."""
    rows = rows.where("embedding is not null and size(embedding) > 0")
    pivots = _clusters(rows)
    if pivots is None:
        return rows.sparkSession.createDataFrame([], "a long, b long, score double")
    blocks = _laid(rows, pivots, "x")
    return _met(blocks, blocks, pivots, least, True).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").where("a < b")


def first_copies(rows: DataFrame) -> DataFrame:
    """rows (vec_id, embedding) without those that repeat the vector of a smaller vec_id; vec_id is unique.

    Whatever is tied to a vector is tied to all its copies, and they to each other, so a rule that
    leaves out what is tied to an earlier row that is kept leaves out every copy but the first.
    Vectors without a length (null, of nulls, zero, too short or too long to be measured) are
    tied to nothing, and stay.
    """
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    whole = F.coalesce((square > 1e-20) & (square < float("inf")), F.lit(False))
    first = rows.where(whole).groupBy("embedding").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "embedding")
    return first.unionByName(rows.where(~whole).select("vec_id", "embedding"))
