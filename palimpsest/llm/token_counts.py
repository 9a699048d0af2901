"""Token counts from a tokenizer compiled to finite-state transducers.

A byte-level BPE tokenizer is compiled, lazily, into a deterministic transducer over
bytes.  After any prefix of a part the encoding of that prefix is unique, and its last
token decides what may follow; so a state holds the longest suffix that still begins
some token, with the last token and the relative token count at each place in that
suffix.  Both are bounded by the longest token, so the states are finite.  Every
transition is annotated with the number of tokens it emits (which is below zero where
a longer token replaces shorter ones); the count of a part is the sum along its path.

A text is read in chunks.  A chunk's state map sends any entry state to an exit state
and a count; as the automaton returns to its start state at every certain boundary,
the map is (bytes before the first boundary, count between the boundaries, bytes after
the last).  Boundaries are certain where letters, digits and other characters meet, in
any script.  Such maps compose associatively, so the chunks of one text are counted in
parallel and their maps are composed in a tree: each level composes `FAN` neighbours in
tasks of their own.  A stretch without any boundary (a run of letters alone) has no
shorter map than itself, and is counted by the task that composes its ends.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .pieces import PieceTable, byte_letters, runs, split

#: Characters of a chunk; texts beyond it are counted chunk by chunk.
CHUNK = 1 << 16
#: Maps of neighbours that one task composes.
FAN = 16
#: States kept by a worker; beyond them the compilation starts anew.
STATES = 150_000

#: How byte-level tokenizers split text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where parts of that pattern always end: between letters, digits and other characters, apostrophes aside.
BOUNDARY = regex.compile(r"(?<=\p{L})(?=[^\p{L}\s'])|(?<=\p{N})(?=[^\p{N}\s'])|(?<=[^\p{L}\p{N}\s'])(?=[\p{L}\p{N}])")


class Transducer:
    """The lazily compiled transducer of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or model["type"] != "BPE":
            raise ValueError("only byte-level BPE without normalizer can be compiled")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        #: Tokens by the rank of the merge that makes them; single bytes rank below all merges.
        self.rank: dict[bytes, int] = {bytes([b]): b - 256 for b in range(256)}
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        self.merge: dict[tuple[bytes, bytes], int] = {}
        for i, pair in enumerate(model["merges"]):
            a, b = (bytes(byte_of[c] for c in x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merge[a, b] = i
            if a + b not in self.rank:
                self.rank[a + b], self.halves[a + b] = i, (a, b)
        self.begins = {t[:i] for t in self.rank for i in range(1, len(t))}
        self.whole: dict[bytes, bool] = {}
        self.table = PieceTable(self._new)
        self._clear()

    def _clear(self) -> None:
        self.names: list[tuple] = [(b"", ((None, 0),))]
        self.number = {self.names[0]: 0}
        self.step: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[bytes, bytes], bool] = {}

    def _is_token(self, t: bytes) -> bool:
        """Whether t, alone, is encoded as one token."""
        if t not in self.whole:
            self.whole[t] = len(t) == 1 or t in self.halves and all(map(self._is_token, self.halves[t])) and self._side_by_side(*self.halves[t], self.rank[t])
        return self.whole[t]

    def _side_by_side(self, a: bytes, b: bytes, limit: int = 1 << 60) -> bool:
        """Whether no merge ranked below limit joins the end of a with the start of b.

        The tokens are taken apart again, the later merge first; at each point the two
        parts that touch were neighbours until the merge that undid them.
        """
        while True:
            m = self.merge.get((a, b))
            if m is not None and m < limit:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if len(a) == 1 and len(b) == 1:
                return True
            if len(b) == 1 or len(a) > 1 and ra > rb:
                limit, a = min(limit, ra), self.halves[a][1]
            else:
                limit, b = min(limit, rb + 1), self.halves[b][0]

    def _follows(self, a: bytes | None, b: bytes) -> bool:
        if not self._is_token(b):
            return False
        if a is None:
            return True
        if (a, b) not in self.pair:
            self.pair[a, b] = self._side_by_side(a, b)
        return self.pair[a, b]

    def _advance(self, state: int, byte: int) -> tuple[int, int]:
        """The transition: next state and emitted tokens, compiled when first met."""
        suffix, places = self.names[state]
        grown = suffix + bytes([byte])
        for i in range(len(grown)):  # the longest token first
            token = grown[i:]
            last, count = places[i]
            if token in self.rank and self._follows(last, token):
                emitted = count + 1
                break
        keep = 0
        while keep < len(grown) and grown[keep:] not in self.begins:
            keep += 1
        after = tuple((t, c - emitted) for t, c in places[keep:]) + ((token, 0),)
        name = (grown[keep:], after)
        if name not in self.number:
            self.number[name] = len(self.names)
            self.names.append(name)
        self.step[state << 8 | byte] = out = (self.number[name], emitted)
        return out

    def count_part(self, part: bytes) -> int:
        if len(self.names) > STATES:
            self._clear()
        state = total = 0
        get = self.step.get
        for byte in part:
            to = get(state << 8 | byte)
            state, emitted = to if to is not None else self._advance(state, byte)
            total += emitted
        return total

    def _new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = regex.compile(PATTERN).findall
        counts = [self.count_part(p) if p.isalpha() and p.isascii() else sum(self.count_part(x.encode()) for x in parts(p.decode())) for p in pieces]
        return np.zeros(0, np.int32), np.array(counts, np.int32)

    def _spans(self, raw: bytes, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece starts, token count of each piece)."""
        if not raw:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        starts, _, counts = self.table.lookup(raw, borders, False)
        return starts, counts

    def count(self, raw: bytes) -> int:
        """Tokens of one text; special strings are one token each and bound what is beside them."""
        total, at = 0, 0
        while True:
            found = min(((p, s) for s in self.special if s and (p := raw.find(s, at)) >= 0), default=None)
            end = found[0] if found else len(raw)
            total += int(self._spans(raw[at:end], np.zeros(1, np.int64))[1].sum())
            if not found:
                return total
            total, at = total + 1, end + len(found[1])

    def count_all(self, texts) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for lo, hi, raw, borders in runs(texts):
            if any(s in raw for s in self.special):
                ends = [*borders[1:].tolist(), len(raw)]
                out[lo:hi] = [self.count(raw[a:b]) for a, b in zip(borders.tolist(), ends, strict=True)]
            elif raw:
                starts, counts = self._spans(raw, borders)
                before = np.r_[0, np.cumsum(counts, dtype=np.int64)]
                out[lo:hi] = np.diff(before[np.searchsorted(starts, np.r_[borders, len(raw)])])
        return out

    def chunk_map(self, raw: bytes) -> tuple[bytes, int, bytes | None]:
        """(head, count, tail): head up to the first boundary, tail from the last; tail None without one."""
        cuts = split(np.frombuffer(raw, np.uint8), np.zeros(0, np.int64), raw) if raw else np.zeros(0, np.int64)
        if len(cuts):
            first, last = int(cuts[0]), int(cuts[-1])
            return raw[:first], int(self._spans(raw[first:last], np.zeros(1, np.int64))[1].sum()), raw[last:]
        text = raw.decode()
        at = [m.start() for m in BOUNDARY.finditer(text)]
        if not at:
            return raw, 0, None
        inner = sum(self.count_part(x.encode()) for x in regex.findall(PATTERN, text[at[0] : at[-1]]))
        return text[: at[0]].encode(), inner, text[at[-1] :].encode()

    def compose(self, left: tuple, right: tuple) -> tuple:
        """The map of two neighbouring chunks, from the maps of each."""
        if left[2] is None and right[2] is None:
            return left[0] + right[0], 0, None
        if left[2] is None:
            return left[0] + right[0], right[1], right[2]
        if right[2] is None:
            return left[0], left[1], left[2] + right[0]
        # bytes on both sides of the seam are one stretch: its own chunk, now without borders
        return left[0], left[1] + right[1] + self.count(left[2] + right[0]), right[2]

    def finish(self, chunk: tuple) -> int:
        head, inner, tail = chunk
        return self.count(head) + inner + (0 if tail is None else self.count(tail))


_transducers: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One transducer for each file and worker process."""
    if path not in _transducers:
        _transducers[path] = Transducer(path)
    return _transducers[path]


_MAP = "row long, seg int, k long, head binary, inner long, tail binary"


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs (doc_id long, text).

    Null texts count as empty, null doc_ids stay null, repeated rows give a row each, an
    empty table gives none; other columns are left out, whatever their names.  Texts over
    `chunk` characters are cut at special strings and into chunks; counts don't depend on it.
    """
    special = [t["content"] for t in json.load(open(tokenizer, encoding="utf-8"))["added_tokens"]]
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    long_ = F.length("text") > chunk
    plain = _count(base.where(~long_), tokenizer)
    numbered = stored(base.where(long_).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    # a special string is one token, and bounds what is beside it; the longer of two goes first
    marks = "|".join(f"\\Q{t}\\E" for t in sorted(special, key=len, reverse=True))
    parts = F.split("text", marks) if special else F.array("text")
    segments = numbered.select("row", F.posexplode(parts).alias("seg", "text"))
    at = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / chunk)))
    chunks = segments.select("row", "seg", F.explode(at).alias("k"), "text").select("row", "seg", "k", F.substr("text", (F.col("k") * chunk + 1).cast("int"), F.lit(chunk)).alias("text"))

    def maps(parts):
        machine = transducer(tokenizer)
        for batch in parts:
            got = [machine.chunk_map(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "seg", "k")), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary())], ["row", "seg", "k", "head", "inner", "tail"])

    def compose(neighbours):
        machine, rows = transducer(tokenizer), neighbours.sort_by("k").to_pylist()
        whole = (rows[0]["head"], rows[0]["inner"], rows[0]["tail"])
        for r in rows[1:]:
            whole = machine.compose(whole, (r["head"], r["inner"], r["tail"]))
        first = rows[0]
        return pa.table({"row": [first["row"]], "seg": pa.array([first["seg"]], pa.int32()), "k": [first["k"] // FAN], "head": pa.array([whole[0]], pa.binary()), "inner": [whole[1]], "tail": pa.array([whole[2]], pa.binary())})

    mapped = chunks.repartition("row", "seg", "k").mapInArrow(maps, _MAP)
    # as many levels as the longest text needs
    most = -(-(numbered.agg(F.max(F.length("text"))).first()[0] or 0) // chunk)
    while most > 1:
        mapped = stored(mapped, "maps").groupBy("row", "seg", F.floor(F.col("k") / FAN)).applyInArrow(compose, _MAP)
        most = -(-most // FAN)

    def finish(parts):
        machine = transducer(tokenizer)
        for batch in parts:
            n = [machine.finish((r["head"], r["inner"], r["tail"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64())], ["row", "n"])

    counted = mapped.mapInArrow(finish, "row long, n long").groupBy("row").agg((F.sum("n") + F.count(F.lit(1)) - 1).alias("n_tokens"))
    composed = numbered.join(counted, "row").select("doc_id", "n_bytes", "n_tokens")
    return plain.union(composed).withColumn("over_limit", F.col("n_tokens") > limit)


def _count(base: DataFrame, tokenizer: str) -> DataFrame:
    def run(parts):
        machine = transducer(tokenizer)
        for batch in parts:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n = machine.count_all(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return base.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents, and which have more than 512 tokens."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)
