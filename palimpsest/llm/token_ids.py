"""Token-ID output: canonical length-limited Huffman coding in independent blocks.

`write_ids` turns texts into ids, counts every id over the whole corpus, builds one
canonical code whose words have at most `MAX_BITS` bits, and writes blocks of whole
documents in ascending doc_id order.  A block decodes by itself; every `STEP` ids it
keeps a bit offset, so a reader can enter inside it, and all of a block's checkpoints
decode side by side through one table.

The file format: Parquet files under `<path>/blocks`, one row a block:
shard int, block int, start long (ids of the shard before the block), docs
array<struct<doc_id long, n_tokens long>>, offsets binary (uint32 little-endian bit
offset of every STEP-th id), payload binary (big-endian bit stream).  `<path>/code`
has (id int, bits int) of every id in use; the code words follow from the lengths.

Null texts are empty and hold the end id alone; null doc_ids come first; repeated
rows stay, each with its own ids; an empty table gives an empty file set.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hidden, shared_dir, stored, table
from .pieces import encoder

MAX_BITS = 16
STEP = 256
#: Ids after which a block is closed; a longer document has a block of its own.
BLOCK = 1 << 16

_DOCS = "array<struct<doc_id:bigint,n_tokens:bigint>>"
_FILE = f"shard int, block int, start bigint, docs {_DOCS}, offsets binary, payload binary"
_DOCS_ARROW = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits (package-merge); 0 for ids without count."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int32)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError("too many ids for this code length")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    merged, levels = weight, []
    for _ in range(max_bits - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weight))
        merged = both[rank]
    take, lengths = 2 * len(used) - 2, np.zeros(len(used), np.int32)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[:take] += 1
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids in code order, code word of each id) from the code lengths."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    bits = lengths[order]
    step = np.left_shift(np.int64(1), int(MAX_BITS) - bits.astype(np.int64))
    first = np.cumsum(step) - step
    words = np.zeros(len(lengths), np.uint64)
    words[order] = (first >> (MAX_BITS - bits)).astype(np.uint64)
    return order, words


def pack(ids: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> tuple[bytes, bytes]:
    """(bit offsets of every STEP-th id, bit stream) of one block."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    at = ends - bits
    total = int(ends[-1]) if len(ids) else 0
    unit, room = at >> 5, 64 - (at & 31) - bits
    shifted = words[ids] << room.astype(np.uint64)
    n = (total >> 5) + 2
    # parts of different ids share no bit, so the sums below stay under 2**32 and are exact
    high = np.bincount(unit, (shifted >> np.uint64(32)).astype(np.float64), n)
    low = np.bincount(unit + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    stream = (high + low).astype(np.uint32).astype(">u4").tobytes()
    return at[::STEP].astype("<u4").tobytes(), stream[: (total + 7) // 8]


def unpack(n: int, offsets: bytes, payload: bytes, lengths: np.ndarray, table_ids: np.ndarray) -> np.ndarray:
    """The ids of one block: all checkpoints advance together, one table look-up an id."""
    if not n:
        return np.zeros(0, np.uint32)
    at = np.frombuffer(offsets, "<u4").astype(np.int64)
    data = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    wide = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    out = np.zeros((STEP, len(at)), np.uint32)
    last = n - STEP * (len(at) - 1)
    for i in range(min(STEP, n)):
        if i == last:
            at = at[:-1]
        got = table_ids[(wide[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF]
        out[i, : len(at)] = got
        at = at + lengths[got]
    return out.T.reshape(-1)[:n]


def _decode_table(lengths: np.ndarray) -> np.ndarray:
    order, _ = canonical(lengths)
    spread = np.repeat(order, np.left_shift(1, MAX_BITS - lengths[order]))
    return np.r_[spread, np.zeros((1 << MAX_BITS) - len(spread), np.int64)].astype(np.uint32)


def id_blocks(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """Blocks of plain ids in ascending doc_id order, and one row of counts a task.

    docs: doc_id long, text string.  Texts are range-partitioned by doc_id (ties by a
    hash of the text), so a task holds a run of the order and knows its place in it.
    """
    tie = hidden(docs, "tie")
    kept = docs.select("doc_id", "text").withColumn(tie, F.xxhash64("text"))
    order = [F.asc_nulls_first("doc_id"), F.col(tie)]
    placed = kept.repartitionByRange(*order).sortWithinPartitions(*order).drop(tie)

    def run(parts):
        enc = encoder(tokenizer)
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        counts = np.zeros(max(enc.vocab_size, (end_id or 0) + 1), np.int64)
        names, sizes, held, total = [], [], [], 0
        width = np.uint16 if len(counts) <= 1 << 16 else np.uint32

        def flush():
            nonlocal block, start, names, sizes, held, total
            if not names:
                return
            flat = np.concatenate(held)
            row = {"shard": [shard], "block": [block], "start": [start], "docs": pa.array([[{"doc_id": a, "n_tokens": b} for a, b in zip(names, sizes, strict=True)]], _DOCS_ARROW), "ids": pa.array([flat.astype(width).tobytes()], pa.large_binary()), "width": [np.dtype(width).itemsize], "counts": pa.array([None], pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())])))}
            block, start = block + 1, start + total
            names, sizes, held, total = [], [], [], 0
            yield from _batch(row)

        for batch in parts:
            ids_of = batch.column(0).to_pylist()
            for lo in range(0, batch.num_rows, 256):
                flat, n = enc.ids(batch.column(1).slice(lo, 256))
                if end_id is not None:
                    flat = np.insert(flat, np.cumsum(n), end_id)
                    n = n + 1
                counts += np.bincount(flat, minlength=len(counts))
                edge = np.r_[0, np.cumsum(n)]
                for i in range(len(n)):
                    names.append(ids_of[lo + i])
                    sizes.append(int(n[i]))
                    held.append(flat[edge[i] : edge[i + 1]])
                    total += int(n[i])
                    if total >= BLOCK:
                        yield from flush()
        yield from flush()
        used = np.flatnonzero(counts)
        yield from _batch({"shard": [shard], "block": [None], "start": [None], "docs": pa.array([None], _DOCS_ARROW), "ids": pa.array([None], pa.large_binary()), "width": [None], "counts": pa.array([[{"id": int(i), "n": int(counts[i])} for i in used]], pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())])))})

    return placed.mapInArrow(run, f"shard int, block int, start bigint, docs {_DOCS}, ids binary, width int, counts array<struct<id:int,n:bigint>>")


def _batch(row: dict):
    types = {"shard": pa.int32(), "block": pa.int32(), "start": pa.int64(), "width": pa.int32()}
    cols = {k: v if isinstance(v, pa.Array) else pa.array(v, types[k]) for k, v in row.items()}
    cols = {k: v.cast(pa.binary()) if v.type == pa.large_binary() else v for k, v in cols.items()}
    yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int | None) -> None:
    """Encode docs (doc_id, text) and write them to `path` in the format above."""
    spark = docs.sparkSession
    raw = stored(id_blocks(docs, tokenizer, end_id), "ids")
    # as many rows as the vocabulary has ids: bounded by the tokenizer, not the corpus
    counts = raw.where("counts is not null").select(F.explode("counts").alias("c")).groupBy("c.id").agg(F.sum("c.n").alias("n")).collect()
    full = np.zeros(max((r["id"] for r in counts), default=0) + 1, np.int64)
    for r in counts:
        full[r["id"]] = r["n"]
    lengths = code_lengths(full)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, bits int").coalesce(1).write.parquet(f"{path}/code")

    def run(parts):
        _, words = canonical(lengths)
        for batch in parts:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_py(), np.uint16 if batch.column("width")[i].as_py() == 2 else np.uint32)
                offsets, payload = pack(ids, lengths, words)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ("shard", "block", "start", "docs")), pa.array([offsets]), pa.array([payload])], ["shard", "block", "start", "docs", "offsets", "payload"])

    blocks = raw.where("ids is not null").select("shard", "block", "start", "docs", "ids", "width")
    blocks.mapInArrow(run, _FILE).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The documents of a file set: doc_id, start, n_tokens, and ids (array) or, with digest, ids_crc32."""
    code = spark.read.schema("id int, bits int").parquet(f"{path}/code").collect()
    lengths = np.zeros(max((r["id"] for r in code), default=0) + 1, np.int32)
    for r in code:
        lengths[r["id"]] = r["bits"]

    def run(parts):
        table_ids = _decode_table(lengths)
        for batch in parts:
            for i in range(batch.num_rows):
                docs = batch.column("docs")[i].values
                n = docs.field("n_tokens").to_numpy()
                ids = unpack(int(n.sum()), batch.column("offsets")[i].as_py(), batch.column("payload")[i].as_py(), lengths, table_ids)
                ends = np.cumsum(n)
                if digest:
                    view = memoryview(ids.astype("<u4")).cast("B")
                    out = pa.array([zlib.crc32(view[4 * (b - k) : 4 * b]) for k, b in zip(n.tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("shard")[i].as_py()] * len(n), pa.int32()), docs.field("doc_id"), pa.array(batch.column("start")[i].as_py() + ends - n, pa.int64()), docs.field("n_tokens"), out], ["shard", "doc_id", "start", "n_tokens", "out"])

    blocks = spark.read.schema(_FILE).parquet(f"{path}/blocks")
    rows = blocks.select("shard", "start", "docs", "offsets", "payload").mapInArrow(run, f"shard int, doc_id bigint, start bigint, n_tokens bigint, out {'bigint' if digest else 'array<int>'}")
    sizes = blocks.select("shard", F.aggregate("docs", F.lit(0).cast("long"), lambda a, d: a + d["n_tokens"]).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    # one row a file: bounded by the number of partitions written
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", F.col("out").alias("ids_crc32" if digest else "ids"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/palimpsest/token-ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_ids(spark, path, digest=True)
