"""Periodic runs of words, found with string synchronising sets.

A run is a stretch of consecutive words with smallest period q, at least `LEAST` words and
`TIMES` periods long, that no neighbouring word extends.  Periods below `DIRECT` are found
by comparing words so far apart.  For every t = 4, 8, 16, ... the runs of period t to
2 t - 1 are proposed by a synchronising set: of each t + 1 neighbouring windows of t words
the one with the least hash picks a position, windows that are themselves periodic with at
most t / 4 left out.  Whether a position is picked depends on the 2 t words from it alone,
so a run of period q >= t and four periods has a picked position among its first t words,
and the same context is picked again q words on, with no equal context between (two
overlapping contexts nearer than that would give the run a smaller period).  So
neighbouring positions of one context propose every period.  What was left out, highly
periodic regions, are runs of a smaller scale and already known.  Proposals are extended
word by word, so meeting hashes cost time and never a wrong run.

A text in which no context of eight words comes twice has no run of period four and more,
and is left out of all larger scales.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table
from .pieces import mix, runs

#: Least words and periods of a run.
LEAST, TIMES = 6, 4
#: Periods below this are found by comparing words so far apart; the first scale.
DIRECT = 4
#: Words of short texts that are searched together (a longer text stands alone).
TOGETHER = 1 << 18
#: Distinct words that a worker's table holds before it starts anew.
VOCABULARY = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of True."""
    edge = np.diff(np.r_[False, same, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _reach(words: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The stretch [l, r) around `at` in which each word equals the one d words on."""
    r, step, n = at, 32, len(words) - d
    while r < n:
        to = min(n, r + step)
        differ = np.flatnonzero(words[r:to] != words[r + d : to + d])
        if len(differ):
            r += int(differ[0])
            break
        r, step = to, 2 * step
    left, step = at, 32
    while left > 0:
        to = max(0, left - step)
        differ = np.flatnonzero(words[to:left] != words[to + d : left + d])
        if len(differ):
            left = to + int(differ[-1]) + 1
            break
        left, step = to, 2 * step
    return left, r


def _windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of 2 * size words from those of size."""
    return mix(hashes[: max(0, len(hashes) - size)] * _STEP + hashes[size:])


def synchronising(hashes: np.ndarray, t: int, periodic: np.ndarray) -> np.ndarray:
    """Positions whose t + 1 windows from there on have their least hash first or last; windows marked periodic don't count."""
    own = np.where(periodic, _NONE, hashes >> np.uint64(1))
    least, k = own, 1
    while k < t:
        least, k = np.minimum(least[:-k], least[k:]), 2 * k
    first, last = own[: len(own) - t], own[t:]
    least = np.minimum(least[: len(last)], last)
    return np.flatnonzero((least != _NONE) & ((first == least) | (last == least)))


def _again(words: np.ndarray, places: np.ndarray, hashes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next `span` words come again at a later place, and how far on the next one is."""

    def pairs(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(names, kind="stable")
        same = np.flatnonzero(names[order[1:]] == names[order[:-1]])
        return order[same], order[same + 1]

    a, b = pairs(hashes)
    rows = max(1, (1 << 20) // span)
    for lo in range(0, len(a), rows):
        step = np.arange(span)
        x, y = (places[p[lo : lo + rows], None] + step for p in (a, b))
        if (words[x] != words[y]).any():  # different words of one hash: told apart by all their words
            known: dict[bytes, int] = {}
            a, b = pairs(np.array([known.setdefault(words[p : p + span].tobytes(), len(known)) for p in places.tolist()], np.int64))
            break
    return places[a], places[b] - places[a]


def find_runs(words: np.ndarray, edges: np.ndarray) -> dict[tuple[int, int], int]:
    """{(start, length): period} of all runs; words of the texts one after the other, from edges[i] to edges[i + 1] - 1.

    The last word of every text must be one that comes nowhere else.
    """
    found: dict[tuple[int, int], int] = {}

    def add(left: int, right: int, d: int) -> None:
        size = right - left + d
        if size >= max(LEAST, TIMES * d):
            found[left, size] = min(d, found.get((left, size), d))

    for q in range(1, DIRECT):
        for left, right in zip(*map(np.ndarray.tolist, _stretches(words[:-q] == words[q:])), strict=True):
            add(left, right, q)
    hashes, t = mix(words.astype(np.uint64) * _STEP + _STEP), DIRECT
    at, n = edges[:-1], np.diff(edges)
    size = 1
    while size < t:
        hashes, size = _windows(hashes, size), 2 * size
    place = None  # places of the words of texts that are left
    while True:
        alive = n > TIMES * t
        if not alive.all():
            keep = np.repeat(alive, n)
            words = words[keep]
            place = np.flatnonzero(keep) if place is None else place[keep]
            hashes = np.concatenate([hashes, np.zeros(len(keep) - len(hashes), np.uint64)])[keep]
            n = n[alive]
            at = np.cumsum(n) - n
        if len(words) < TIMES * t:
            return found
        hashes = hashes[: len(words) - t + 1]
        periodic = np.zeros(len(hashes) + 1, np.int32)
        for (left, length), q in found.items():
            if 4 * q <= t <= length:
                at_place = left if place is None else int(np.searchsorted(place, left))
                # a run of a text that was left out has no place here
                if place is not None and (at_place == len(place) or place[at_place] != left):
                    continue
                left = at_place
                if left < len(words) and left + length - t < len(hashes):
                    periodic[left] += 1
                    periodic[left + length - t + 1] -= 1
        contexts = _windows(hashes, t)
        picked = synchronising(hashes, t, np.cumsum(periodic[:-1]) > 0)
        picked = picked[picked < len(contexts)]
        first, gap = _again(words, picked, contexts[picked], 2 * t)
        text = np.searchsorted(at, first, "right") - 1
        same_text = first + gap < at[text] + n[text]
        near = np.flatnonzero(same_text & (gap >= t) & (gap < 2 * t))
        near = near[np.lexsort((first[near], gap[near]))]
        last = (0, 0, 0)
        for s, d in zip(first[near].tolist(), gap[near].tolist(), strict=True):
            if d == last[2] and last[0] <= s < last[1]:
                continue
            left, right = _reach(words, s, d)
            last = left, right, d
            add(left if place is None else int(place[left]), right - left + (left if place is None else int(place[left])), d)
        repeated = np.zeros(len(n), bool)
        repeated[text[same_text]] = True
        n = np.where(repeated, n, -n)
        keep = np.repeat(n > 0, np.abs(n))
        if not keep.all():
            words, place = words[keep], np.flatnonzero(keep) if place is None else place[keep]
            contexts = np.concatenate([contexts, np.zeros(len(keep) - len(contexts), np.uint64)])[keep]
            n = n[n > 0]
            at = np.cumsum(n) - n
        hashes, t = contexts[: max(0, len(words) - 2 * t + 1)], 2 * t


class _Words:
    """Numbers for words, and the words of numbers."""

    def __init__(self):
        self.names: list[bytes] = []
        self.numbers: dict[bytes, int] = {}

    def of(self, raw: bytes) -> np.ndarray:
        """Numbers of the words of a text, which is split a slice at a time."""
        out, lo = [], 0
        while lo < len(raw):
            hi = lo + (1 << 20)
            while hi < len(raw) and raw[hi] not in b" \t\n\x0b\x0c\r":
                hi += 1
            part = raw[lo:hi].split()
            new = dict.fromkeys(w for w in part if w not in self.numbers)
            self.numbers.update(zip(new, range(len(self.names), len(self.names) + len(new)), strict=True))
            self.names.extend(new)
            out.append(np.fromiter(map(self.numbers.__getitem__, part), np.int64, len(part)))
            lo = hi
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def joined(self, numbers: np.ndarray) -> bytes:
        name = self.names.__getitem__
        return b" ".join(b" ".join(map(name, numbers[i : i + 65536].tolist())) for i in range(0, len(numbers), 65536))


def _search(texts: list[np.ndarray], words: _Words) -> tuple[list, list]:
    """(runs, words left) of some texts."""
    n = np.array([len(x) + 1 for x in texts])
    edges = np.r_[0, np.cumsum(n)]
    flat = np.empty(edges[-1], np.int64)
    for i, x in enumerate(texts):
        flat[edges[i] : edges[i + 1] - 1] = x
    flat[edges[1:] - 1] = len(words.names) + np.arange(len(texts))  # a word of its own ends each text
    mine: list[list] = [[] for _ in texts]
    drop = np.zeros(len(flat) + 1, np.int32)
    for (start, length), q in sorted(find_runs(flat, edges).items()):
        i = int(np.searchsorted(edges, start, "right")) - 1
        mine[i].append({"start": start - int(edges[i]), "length": length, "period": q})
        drop[start + q] += 1
        drop[start + length] -= 1
    kept = np.cumsum(drop[:-1]) == 0
    return mine, [words.joined(x[kept[edges[i] : edges[i + 1] - 1]]) for i, x in enumerate(texts)]


def _batches(batches):
    words = _Words()
    for batch in batches:
        texts, done, held, size = batch.column("text"), ([], [], []), [], 0

        def flush(done=done, held=held):
            if held:
                mine, left = _search(held, words)
                for column, values in zip(done, ([len(x) for x in held], mine, left), strict=True):
                    column.extend(values)
                held.clear()

        for _, _, raw, borders in runs(texts):
            ends = np.r_[borders[1:], len(raw)].tolist()
            for a, b in zip(borders.tolist(), ends, strict=True):
                numbers = words.of(raw[a:b])
                if size + len(numbers) > TOGETHER:
                    flush()
                    size = 0
                held.append(numbers)
                size += len(numbers)
        flush()
        if len(words.names) > VOCABULARY:
            words = _Words()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        out = [pa.array(done[0], pa.int64()), pa.array(done[1], kind), pa.array(done[2], pa.binary()).cast(pa.string())]
        rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
        yield pa.RecordBatch.from_arrays([c for _, c in rest] + out, [n for n, _ in rest] + ["n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the runs of each text (start, length and period in words), and the text without repetitions.

    `collapsed` has the words that no run contains after its first period, joined by one
    space.  Null and empty texts have no words, no run and an empty `collapsed`; repeated
    rows give a row each; runs come by start, then period; an empty table gives none; other
    columns are left out, whatever their names.  Long texts are split in slices; their
    words are held as numbers, some 40 bytes a word while they are searched.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_batches, f"doc_id {kind}, {_SCHEMA}")


def with_repetitions(doc_id: Column, text: Column) -> Column:
    """The text, for a tenth of the doc_ids with a tail that repeats a stretch of its words (a rule by crc32 of doc_id); null doc_ids: as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.when(n > 0, F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + F.pmod(i - a, p)).cast("int")))), " ")).otherwise(text)

    tail = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), repeated)[0]
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.isNotNull(), tail).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents after the stated repetitions: their number, the longest one, digests of all and of the collapsed text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", with_repetitions(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.withColumns({"best": longest, "lines": F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")})
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
