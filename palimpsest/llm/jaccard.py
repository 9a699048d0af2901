"""Exact n-gram Jaccard join by universe partitioning and the pigeonhole principle.

A document is the set of its distinct word n-grams.  Sets are dealt to groups by size
band; two sets at the threshold differ in at most H elements, H following from the
band.  Within a group the universe of n-grams is hashed into segments.  A segment is
indexed exactly (it accounts for no difference) or with its one-deletion neighbourhood
(it still matches with one difference); an allocation with m exact and x deletion
segments finds every pair if m + 2 x > H.  `allocate` takes the cheapest one: index rows
against segments so small that unrelated sets share them.

Sets that are equal are one class, found by a cryptographic digest of the sorted set.  Two sets
differ in at least as many n-grams as their parity sketches differ in bits (each n-gram
turns one of `BITS` bits), so most pairs that share an entry are ruled out by sketches
alone, without losing any.  Classes are compared with the least class of each of their
entries ("hub") first, in groups of a hub and some others; sketches as wide as the sets are
large leave few of these pairs to texts.  What still has unconnected
classes under one entry is sorted by entry into blocks; where two blocks meet, sketches say
which of their classes may be linked, and those are compared there.  A comparison is a matrix product over
the n-grams of its texts, told apart by their words' bytes; it returns a spanning forest
of its links, not the links.  Nothing is capped: many classes under one entry give more
blocks, not larger ones.

Lower thresholds make segments so small that chance and common n-grams fill many.  There
an allocation has SPARE segments to spare (m + 2 x > H + 2 SPARE), so alike sets agree on
more than SPARE segments, and a set with at most so many "weak" segments leaves their weak
entries out: entries of no n-gram, or only of n-grams that are common in a sample.  Two
sets agree by weak entries alone on no more segments than either has weak ones, so one of
the others still leads them to each other; which n-grams count as common tells nothing
about the links.  The entries of such an index are made and met in rounds, each over some of
the groups.

Sets can be indexed by prefixes too: of two sets at the threshold, the first
len - ceil(threshold * len) + 1 n-grams of each, in one order of all n-grams, share one.
The order has n-grams that are common in a sample last.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hidden, ranged, salted_join, stored, table
from .components import components
from .pieces import _CLASS, _WS, PieceTable, WordTable, mix, plain_table, runs, same_windows

#: Classes of a block.
BLOCK = 128
#: Bits of a parity sketch, and of one for classes that are still to be compared: so many at least, and WIDE_SHARE for each n-gram.
BITS, WIDE, WIDE_SHARE = 512, 4096, 2
#: Documents, about, whose n-grams are counted to order prefixes, and most n-grams that are told to be common.
SAMPLE, COMMON = 20_000, 1 << 16
#: Where deletion segments alone would have fewer n-grams than this, they get SPARE segments to spare and are indexed in so many rounds.
SMALL_SEGMENT, SPARE, ROUNDS = 8, 8, 3
_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
_SPACE = _CLASS == _WS


def word_entries(texts, words: PieceTable):
    """(entries of all words, edges of the texts in them) for runs of texts."""
    for _, hi, raw, borders in runs(texts):
        raw = raw.translate(_LOWER)
        data = np.frombuffer(raw, np.uint8)
        solid = ~_SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[borders] = True
        starts = np.flatnonzero(solid & (np.r_[True, ~solid[:-1]][: len(data)] | first[:-1]))
        stops = np.flatnonzero(solid & (np.r_[~solid[1:], True][: len(data)] | np.r_[first[1:-1], True][: len(data)])) + 1
        yield words.find(raw, starts, stops), np.searchsorted(starts, np.r_[borders, len(data)])


def shingle_sets(texts, n: int, words: WordTable):
    """(sorted distinct hashes, exact size, digest) of the n-gram set of each text; fewer words than n: their sequence.

    Hashes serve the index and may meet; the size counts n-grams by their words, and the
    digest (16 bytes) is that of all words of the sorted set.
    """
    for entry, edges in word_entries(texts, words):
        names = words.digests(entry)
        grams = mix(names[:, 0])
        for k in range(1, n):
            grams = mix(grams[: max(0, len(entry) - k)] + names[k:, 0])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a >= n:
                order = np.argsort(grams[a : b - n + 1], kind="stable") + a
                hashes = grams[order]
                new = np.r_[True, hashes[1:] != hashes[:-1]]
                met = np.flatnonzero(~new)
                rows = lambda at: np.stack([names[at + k] for k in range(n)], axis=1)
                if all((entry[order[met] + k] == entry[order[met - 1] + k]).all() for k in range(n)):
                    size, content = int(new.sum()), rows(order[new]).tobytes()
                else:  # different n-grams of one hash
                    distinct = sorted({r.tobytes() for r in rows(order)})
                    size, content = len(distinct), b"".join(distinct)
                yield hashes[new], size, hashlib.blake2b(content, digest_size=16).digest()
            elif b > a:
                made = hashlib.blake2b(names[a:b].tobytes(), digest_size=16, person=b"short").digest()
                yield np.frombuffer(made, np.uint64)[:1], 1, made
            else:
                yield np.zeros(0, np.uint64), 0, bytes(16)


def exact_sets(texts, n: int, words: PieceTable) -> list[np.ndarray]:
    """The n-gram set of each text as numbers that are equal for equal words, and only for them."""
    words.trim()
    got = list(word_entries(texts, words))
    entry = np.concatenate([e for e, _ in got]) if got else np.zeros(0, np.int64)
    spans, at = [], 0
    for e, edges in got:
        spans += [(at + a, at + b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        at += len(e)
    grams = same_windows(entry, n) if len(entry) >= n else entry[:0]
    short: dict[bytes, int] = {}
    out = []
    for a, b in spans:
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(np.array([-1 - short.setdefault(entry[a:b].tobytes(), len(short))][: b - a], np.int64))
    return out


class Bands:
    """Size bands for a threshold of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges, self.shapes = [1], {}

    def most(self, size: int) -> int:
        """The largest size that can still be alike."""
        return size * self.den // self.num

    def band(self, size: int) -> int:
        while self.edges[-1] <= size:
            self.edges.append(max(self.edges[-1] + 1, self.most(self.most(self.edges[-1]))))
        return int(np.searchsorted(self.edges, size, "right")) - 1

    def groups(self, size: int) -> list[int]:
        """Its own band, and the next one if a set there can be alike."""
        own = self.band(size)
        self.band(self.edges[own + 1])
        return [own, own + 1] if self.most(size) >= self.edges[own + 1] else [own]

    def shape(self, group: int, spare: int = 0) -> tuple[int, int]:
        """(exact segments, deletion segments) of a group, of which alike sets agree on more than `spare`."""
        if (group, spare) not in self.shapes:
            self.band(self.edges[group])
            low, high = self.edges[group], self.edges[group + 1] - 1
            differ = 2 * high * (self.den - self.num) // (self.den + self.num)
            self.shapes[group, spare] = allocate(differ + 2 * spare, low)
        return self.shapes[group, spare]

    def small(self) -> bool:
        """Whether deletion segments alone have fewer than SMALL_SEGMENT n-grams, so that chance fills many."""
        ratio = self.den / self.num
        return (self.den + self.num) < SMALL_SEGMENT * ratio * ratio * (self.den - self.num)


def allocate(differ: int, size: int) -> tuple[int, int]:
    """The cheapest (m, x) with m + 2 x = differ + 1 for sets of about so many elements.

    Cost: index rows of a set, and for each segment the chance that it is so small that
    chance alone fills a bucket, weighed as a thousand rows.
    """
    best = None
    for x in range((differ + 1) // 2 + 1):
        m = differ + 1 - 2 * x
        mean = size / (m + x)
        tiny = math.exp(-mean)
        cost = m * (1 + 1000 * tiny) + x * (1 + mean + 1000 * tiny * (1 + mean) / 2)
        if best is None or cost < best[0]:
            best = cost, m, x
    return best[1], best[2]


def signatures(items: np.ndarray, size: int, bands: Bands) -> np.ndarray:
    """Index entries (uint64) of one set of so many n-grams, given by their distinct hashes.

    Hashes that meet make differences smaller, never larger, so no pair is lost.
    """
    out = []
    for g in bands.groups(size):
        m, x = bands.shape(g)
        salt = mix(np.array([g + 1], np.uint64))[0]
        mixed = mix(items + salt)
        spot = ((mixed >> np.uint64(32)) % np.uint64(m + x)).astype(np.int64)
        order = np.argsort(spot, kind="stable")
        sums = np.r_[np.uint64(0), np.cumsum(mixed[order])]
        edge = np.searchsorted(spot[order], np.arange(m + x + 1))
        total = sums[edge[1:]] - sums[edge[:-1]]
        name = mix(np.arange(m + x, dtype=np.uint64) * np.uint64(2) + salt)
        out.append(mix(total + name))
        if x:  # the segments after the exact ones, each without one of its elements
            tail = order[edge[m] :]
            out.append(mix(total[spot[tail]] - mixed[tail] + name[spot[tail]]))
    return np.concatenate(out)


def spare_signatures(items: np.ndarray, size: int, bands: Bands, common: np.ndarray, rounds: int = 1, turn: int = 0) -> np.ndarray:
    """Index entries (uint64) of one set as `signatures` has them, with SPARE segments to spare.

    Weak entries are left out where no more than SPARE segments have any (common: sorted
    hashes).  Only groups with a number of `turn`, modulo `rounds`, are told.  n-grams whose
    hashes meet count once.
    """
    rare = np.ones(len(items), np.int64)
    if len(common):
        rare[common[np.minimum(np.searchsorted(common, items), len(common) - 1)] == items] = 0
    out = []
    for g in bands.groups(size):
        if g % rounds != turn:
            continue
        m, x = bands.shape(g, SPARE)
        salt = mix(np.array([g + 1], np.uint64))[0]
        mixed = mix(items + salt)
        spot = ((mixed >> np.uint64(32)) % np.uint64(m + x)).astype(np.int64)
        order = np.argsort(spot, kind="stable")
        sums = np.r_[np.uint64(0), np.cumsum(mixed[order])]
        edge = np.searchsorted(spot[order], np.arange(m + x + 1))
        total = sums[edge[1:]] - sums[edge[:-1]]
        known = np.bincount(spot, rare, m + x).astype(np.int64)
        loose = np.arange(m + x) >= m
        keep_weak = np.count_nonzero(known <= loose) > SPARE
        name = mix(np.arange(m + x, dtype=np.uint64) * np.uint64(2) + salt)
        out.append(mix(total + name)[keep_weak | (known > 0)])
        tail = order[edge[m] :]
        left = known[spot[tail]] - rare[tail]
        tail = tail[keep_weak | (left > 0)]
        out.append(mix(total[spot[tail]] - mixed[tail] + name[spot[tail]]))
    return np.concatenate(out)


def parity(items: np.ndarray, bits: int = BITS) -> bytes:
    """The parity sketch of a set: sets that differ in d elements have sketches that differ in d bits at most."""
    odd = np.bincount((mix(items ^ np.uint64(0x3C6EF372FE94F82B)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_be_alike(n: np.ndarray, bits: np.ndarray, m: np.ndarray, others: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sets of sizes n and sketches bits (one a row) can be alike to which others: a matrix."""
    differ = np.bitwise_count(bits[:, None, :] ^ others[None, :, :]).sum(axis=2, dtype=np.int64)
    n, m = n[:, None], m[None, :]
    return (differ * (den + num) <= (n + m) * (den - num)) & (num * n <= den * m) & (num * m <= den * n)


def _sketches(column, bits: int = BITS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, bits // 64)


def wide_bits(size: int) -> int:
    """Bits of the wide sketch of a set of so many n-grams: a narrow one of a large set has about half its bits set, whatever it holds."""
    return max(WIDE, 1 << (WIDE_SHARE * size - 1).bit_length())


def fold(bits: bytes, length: int) -> bytes:
    """A sketch as the same set has it in `length` bytes (both powers of two)."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, length), axis=0).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """In how many bits two sketches differ, at the narrower of their widths."""
    length = min(len(a), len(b))
    a, b = (x if len(x) == length else fold(x, length) for x in (a, b))
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def may_be_alike_wide(n: np.ndarray, bits: list[bytes], m: np.ndarray, others: list[bytes], num: int, den: int) -> np.ndarray:
    """`may_be_alike` for sketches of several widths; two of them meet at the narrower width."""
    out = np.zeros((len(n), len(m)), bool)
    wide, other_wide = np.array([len(b) for b in bits], np.int64), np.array([len(b) for b in others], np.int64)
    for w in np.unique(wide):
        for v in np.unique(other_wide):
            i, j = np.flatnonzero(wide == w), np.flatnonzero(other_wide == v)
            length = int(min(w, v))
            a, b = (np.frombuffer(b"".join(fold(s[k], length) for k in at), np.uint64).reshape(-1, length // 8) for s, at in ((bits, i), (others, j)))
            for k in range(0, len(i), 16):
                out[np.ix_(i[k : k + 16], j)] = may_be_alike(n[i[k : k + 16]], a[k : k + 16], m[j], b, num, den)
    return out


def _wide_sketches(texts: DataFrame, n: int) -> DataFrame:
    """c, n and wide (a sketch of `wide_bits`) of the n-gram sets of texts (c, text)."""

    def run(parts):
        words = WordTable()
        for batch in parts:
            for lo in range(0, batch.num_rows, 512):
                words.trim()
                part = batch.slice(lo, 512)
                made = [(size, parity(s, wide_bits(size))) for s, size, _ in shingle_sets(part.column(1), n, words)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.binary())], ["c", "n", "wide"])

    return texts.select("c", "text").mapInArrow(run, "c bigint, n bigint, wide binary")


def common_grams(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and places by count, of n-grams that several documents of a sample have (docs: row, text)."""
    rows = max(1, docs.count())
    some = docs.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < min(1 << 30, (SAMPLE << 30) // rows))

    def run(parts):
        words = WordTable()
        for batch in parts:
            words.trim()
            for s, _, _ in shingle_sets(batch.column(0), n, words):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64), pa.int64())], ["gram"])

    counts = some.select("text").mapInArrow(run, "gram bigint").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    found = counts.orderBy(F.desc("n"), "gram").limit(COMMON).collect()
    grams = np.array([r["gram"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], len(grams) - order


def prefixes(items: np.ndarray, size: int, bands: Bands, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Index entries (uint64) of one set: its prefix in each of its groups.

    items has the distinct hashes of its `size` n-grams; n-grams whose hashes meet count once.
    """
    grams, places = common
    kept = size + (-bands.num * size // bands.den) + 1
    late = np.zeros(len(items), np.int64)
    if len(grams):
        at = np.minimum(np.searchsorted(grams, items), len(grams) - 1)
        late = np.where(grams[at] == items, places[at], 0)
    first = items[np.lexsort((items, late))[:kept]]
    return np.concatenate([mix(first + mix(np.array([g + 1], np.uint64))[0]) for g in bands.groups(size)])


def indexed(docs: DataFrame, n: int, num: int, den: int, common: tuple[np.ndarray, np.ndarray] | None = None, bare: bool = False) -> DataFrame:
    """row, doc_id, n_shingles, k1, k2 (digest of the set), bits (its sketch) and sigs of every row of docs; sigs are prefixes if common is given, none if bare."""

    def run(parts):
        words, bands = WordTable(), Bands(num, den)
        for batch in parts:
            for lo in range(0, batch.num_rows, 512):
                words.trim()
                part = batch.slice(lo, 512)
                sizes, keys, bits, sigs = [], [], [], []
                for s, size, key in shingle_sets(part.column(2), n, words):
                    sizes.append(size)
                    keys.append(key)
                    bits.append(parity(s))
                    sigs.append(s[:0] if bare or not size else signatures(s, size, bands) if common is None else prefixes(s, size, bands, common))
                ends = np.r_[0, np.cumsum([len(x) for x in sigs])]
                flat = np.concatenate(sigs).view(np.int64) if sigs else np.zeros(0, np.int64)
                k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["row", "doc_id", "n_shingles", "k1", "k2", "bits", "sigs"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row bigint, doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bits binary, sigs array<bigint>")


def _met(entries: DataFrame) -> DataFrame:
    """c, sig and hub (the least class) of the entries (c, sig) that several classes have; entries of one class alone say nothing."""
    hubs = entries.groupBy("sig").agg(F.min("c").alias("hub"), F.max("c").alias("far")).where("hub < far").select("sig", "hub")
    return entries.join(stored(hubs, "hubs"), "sig")


def _met_in_rounds(texts: DataFrame, n: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """`_met` of the entries of texts (c, text, n_shingles) with segments to spare; a round makes and joins those of a part of the groups."""
    found = []
    for turn in range(ROUNDS):

        def run(parts, turn=turn):
            words, bands = WordTable(), Bands(num, den)
            for batch in parts:
                here = [any(g % ROUNDS == turn for g in bands.groups(size)) for size in batch.column(2).to_pylist()]
                batch = batch.filter(pa.array(here, pa.bool_()))
                for lo in range(0, batch.num_rows, 512):
                    words.trim()
                    part = batch.slice(lo, 512)
                    sigs = [np.unique(spare_signatures(s, size, bands, common, ROUNDS, turn)) for s, size, _ in shingle_sets(part.column(1), n, words)]
                    c = np.repeat(part.column(0).to_numpy(), [len(x) for x in sigs])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(np.concatenate(sigs).view(np.int64))], ["c", "sig"])

        # one shuffle, and none for the least class of an entry
        own = Window.partitionBy("sig")
        entries = texts.select("c", "text", "n_shingles").mapInArrow(run, "c bigint, sig bigint")
        met = entries.withColumns({"hub": F.min("c").over(own), "far": F.max("c").over(own)}).where("hub < far")
        found.append(stored(met.select("sig", "c", "hub"), "shared"))
    return reduce(DataFrame.union, found)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between n nodes."""
    up, forest = list(range(n)), []

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(i), top(j)
        if x != y:
            up[max(x, y)] = min(x, y)
            forest.append((i, j))
    return forest


def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int, width: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of left and right, index lists) that are alike: sparse counts by slices of the shared universe."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([sets[i] for i in np.unique(np.r_[left, right])])
    used = np.unique(np.r_[left, right])
    of = np.repeat(used, sizes[used])
    universe, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[inverse] > 1
    column, of = shared[inverse[keep]], of[keep]
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    order = np.argsort(column, kind="stable")
    column, of = column[order], place[of[order]]
    both = np.zeros((len(left), len(right)), np.float32)
    pl, pr = place[left], place[right]
    total = int(count.size and (count > 1).sum())
    for lo in range(0, total, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        dense = np.zeros((len(used), min(width, total - lo)), np.float32)
        dense[of[a:b], column[a:b] - lo] = 1
        both += dense[pl] @ dense[pr].T
    inter = both.astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - inter
    i, j = np.nonzero(den * inter >= num * union)
    return left[i], right[j]


_words: list[PieceTable] = []


def _forest(table: pa.Table, left: np.ndarray, right: np.ndarray, n: int, num: int, den: int) -> pa.Table:
    """A spanning forest (a, b) of the links between the rows left and right of table (c, text)."""
    forest = []
    if len(left) and len(right):
        if not _words:  # one table for each worker process, kept over groups
            _words.append(plain_table())
        texts = table.column("text").cast(pa.large_string()).combine_chunks()
        forest = _roots(len(texts), *links(exact_sets(texts, n, _words[0]), left, right, num, den))
    c = table.column("c").to_numpy()
    return pa.table({"a": pa.array([int(c[x]) for x, _ in forest], pa.int64()), "b": pa.array([int(c[y]) for _, y in forest], pa.int64())})


def _with_hubs(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among pairs (c, hub): groups of a hub and at most about BLOCK of its classes."""
    sizes = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("members"))
    cuts = stored(sizes.where(F.col("members") > BLOCK).select("hub", F.ceil(F.col("members") / BLOCK).alias("cuts")), "cuts")
    dealt = pairs.join(cuts, "hub", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1).cast("long")))
    dealt = dealt.select("c", "hub", F.pmod(F.xxhash64("c"), F.col("cuts")).alias("cut"), F.lit(False).alias("is_hub"))
    hubs = dealt.select(F.col("hub").alias("c"), "hub", "cut", F.lit(True).alias("is_hub")).distinct()
    groups = dealt.union(hubs).join(texts, "c")

    def compare(group):
        is_hub = group.column("is_hub").to_numpy(zero_copy_only=False)
        every = np.arange(len(is_hub))
        return _forest(group, every[is_hub], every[~is_hub], n, num, den)

    return groups.groupBy("hub", "cut").applyInArrow(compare, "a bigint, b bigint")


def similar_groups(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, by_prefix: bool = False) -> DataFrame:
    """row, doc_id, n_shingles and component of every row of docs (row long unique, doc_id long, text).

    component is the least row that a row is linked with, over any number of links; rows
    without words are linked with nothing.  Null texts have no words; a null doc_id is
    carried along; repeated rows are equal sets and so one component; an empty table has
    no rows; other columns are left out.  A long text is held whole by the tasks that
    index and compare it.  by_prefix indexes prefixes in place of segments; the links are
    the same.
    """
    in_rounds = not by_prefix and Bands(num, den).small()
    common = common_grams(docs, n) if by_prefix or in_rounds else None
    sets = stored(indexed(docs, n, num, den, common if by_prefix else None, in_rounds), "sets")
    some = sets.where("n_shingles > 0")
    classes = stored(some.groupBy("n_shingles", "k1", "k2").agg(F.min("row").alias("c"), F.count(F.lit(1)).alias("rows")), "classes")
    texts = docs.select(F.col("row").alias("c"), "text")
    if in_rounds:
        shared = _met_in_rounds(stored(texts.join(classes.select("c", "n_shingles"), "c"), "reps"), n, num, den, common[0])
    else:
        reps = some.join(classes.select(F.col("c").alias("row")), "row", "left_semi")
        shared = stored(_met(reps.select(F.col("row").alias("c"), F.explode("sigs").alias("sig"))), "shared")
    sketch = sets.select(F.col("row").alias("c"), F.col("n_shingles").alias("n"), "bits")
    pairs = shared.where("c <> hub").groupBy("c", "hub").agg(F.count(F.lit(1)).alias("common"))
    pairs = stored(_not_ruled_out(pairs, sketch, num, den), "pairs")
    concerned = pairs.select("c").union(pairs.select(F.col("hub").alias("c"))).distinct()
    wide = stored(_wide_sketches(texts.join(concerned, "c", "left_semi"), n), "wide")
    pairs = stored(_not_ruled_out(pairs, wide.withColumnRenamed("wide", "bits"), num, den), "pairs")
    best = pairs.groupBy("c").agg(F.max_by("hub", F.struct("common", -F.col("hub"))).alias("hub"))
    found = stored(_with_hubs(best, texts, n, num, den), "links")
    roots = stored(components(found), "roots")

    rooted = lambda d, c, r: d.join(roots.select(F.col("node").alias(c), F.col("root").alias(r)), c, "left").withColumn(r, F.coalesce(r, c))
    apart = rooted(rooted(pairs.select("c", "hub"), "c", "c_root"), "hub", "hub_root").where("c_root <> hub_root").select("c", "hub")
    more = stored(_with_hubs(apart.join(best, ["c", "hub"], "left_anti"), texts, n, num, den), "links")
    found = found.union(more)
    roots = stored(components(found), "roots")

    # every class has met its hubs; what isn't connected under one entry meets block by block
    rest = rooted(shared.where("c <> hub"), "c", "root")
    marks = [F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("mark")]
    mixed = rest.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *marks).where("lo < hi")
    # of entries that the same classes share, one is enough
    mixed = mixed.groupBy("members", "total", "mark").agg(F.min("sig").alias("sig")).select("sig")
    rest = stored(rest.join(stored(mixed, "mixed"), "sig").select("c", "root", "sig"), "rest")
    if not rest.isEmpty():
        found = found.union(_by_blocks(rest, sketch, texts, n, num, den))
        roots = stored(components(found), "roots")

    named = classes.where("rows > 1").join(roots, F.col("c") == F.col("node"), "left").select("n_shingles", "k1", "k2", F.coalesce("root", "c").alias("component"))
    out = salted_join(sets.select("row", "doc_id", "n_shingles", "k1", "k2"), named, ["n_shingles", "k1", "k2"], "row")
    # a class of one row has no name there
    out = out.join(roots, F.col("row") == F.col("node"), "left")
    return out.select("row", "doc_id", "n_shingles", F.coalesce("component", "root", "row").alias("component"))


def _not_ruled_out(pairs: DataFrame, sketch: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (c, hub, common) that sketches (c, n, bits) don't rule out."""
    hubs = sketch.select(F.col("c").alias("hub"), F.col("n").alias("hub_n"), F.col("bits").alias("hub_bits"))
    both = pairs.join(sketch, "c").join(hubs, "hub")

    def run(parts):
        for batch in parts:
            table = pa.table(batch)
            n, m = table.column("n").to_numpy(), table.column("hub_n").to_numpy()
            differ = np.array([differing(x, y) for x, y in zip(table.column("bits").to_pylist(), table.column("hub_bits").to_pylist(), strict=True)], np.int64)
            alike = (differ * (den + num) <= (n + m) * (den - num)) & (num * n <= den * m) & (num * m <= den * n)
            yield from table.select(["c", "hub", "common"]).filter(pa.array(alike)).to_batches()

    return both.select("c", "hub", "common", "n", "bits", "hub_n", "hub_bits").mapInArrow(run, "c bigint, hub bigint, common bigint")


def _by_blocks(rest: DataFrame, sketch: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among the classes of rest (c, root, sig) that share a sig.

    Rows stand in the order of sig, root and size and are cut into blocks, so that a block
    has many small sigs, or a part of a large one.  Blocks meet as far as a sig lies in
    both, with sizes that can be alike and more than one root.  Where sketches leave any
    pair of different roots open, wide sketches of the classes concerned meet, and the
    texts of what these leave are compared where the blocks meet; a spanning forest of
    their links comes out.  No pair is a row.
    """
    rows, parts = ranged(rest.join(sketch, "c"), ["sig", "root", "n", "c"], "members")
    rows = rows.join(F.broadcast(parts.select("part", "before").coalesce(1)), "part")
    rows = stored(rows.select("c", "n", "bits", "root", "sig", F.floor((F.col("before") + F.col("idx")) / BLOCK).alias("block")), "blocks")
    met = rows.groupBy("sig", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    places = stored(met, "places")
    other = places.select("sig", *(F.col(x).alias(f"j_{x}") for x in ("block", "least", "most", "lo", "hi")))
    near = (num * F.col("least") <= den * F.col("j_most")) & (num * F.col("j_least") <= den * F.col("most"))
    apart = F.least("lo", "j_lo") < F.greatest("hi", "j_hi")
    tasks = stored(places.join(other, "sig").where((F.col("block") <= F.col("j_block")) & near & apart).select(F.col("block").alias("i"), F.col("j_block").alias("j")).distinct(), "tasks")
    place = tasks.select(F.col("i").alias("block"), "i", "j").union(tasks.where("i <> j").select("j", "i", "j"))
    dealt = rows.join(place, "block")

    def candidates(task):
        c, size, root, sig, block = (task.column(k).to_numpy() for k in ("c", "n", "root", "sig", "block"))
        i, j = task.column("i")[0].as_py(), task.column("j")[0].as_py()
        left, right, bits = np.flatnonzero(block == i), np.flatnonzero(block == j), _sketches(task.column("bits"))
        alike = may_be_alike(size[left], bits[left], size[right], bits[right], num, den)
        alike &= (sig[left][:, None] == sig[right][None, :]) & (root[left][:, None] != root[right][None, :])
        a, b = np.unique(c[left[alike.any(axis=1)]]), np.unique(c[right[alike.any(axis=0)]])
        kind = pa.list_(pa.int64())
        some = [(i, j, a, b)] if len(a) else []
        return pa.table({"i": pa.array([x[0] for x in some], pa.int64()), "j": pa.array([x[1] for x in some], pa.int64()), "a": pa.array([x[2] for x in some], kind), "b": pa.array([x[3] for x in some], kind)})

    # a row for each pair of blocks with open pairs: their classes, at most a block a side
    open_ = stored(dealt.groupBy("i", "j").applyInArrow(candidates, "i bigint, j bigint, a array<bigint>, b array<bigint>"), "open")
    members = F.array_distinct(F.concat("a", "b"))
    asked = open_.select("i", "j", "a", "b", F.explode(members).alias("c")).select("i", "j", "c", F.array_contains("a", F.col("c")).alias("left"), F.array_contains("b", F.col("c")).alias("right"))

    # wide sketches, made once a class, leave few of them to be compared by their words
    concerned = asked.select("c").distinct()
    wide = stored(_wide_sketches(texts.join(concerned, "c", "left_semi"), n).join(rest.select("c", "root").distinct(), "c"), "wide")

    def narrowed(group):
        c, size, root = (group.column(k).to_numpy() for k in ("c", "n", "root"))
        bits = group.column("wide").to_pylist()
        left, right = (np.flatnonzero(group.column(k).to_numpy(zero_copy_only=False)) for k in ("left", "right"))
        alike = may_be_alike_wide(size[left], [bits[k] for k in left], size[right], [bits[k] for k in right], num, den) & (root[left][:, None] != root[right][None, :])
        keep_left, keep_right = np.zeros(len(c), bool), np.zeros(len(c), bool)
        keep_left[left[alike.any(axis=1)]] = True
        keep_right[right[alike.any(axis=0)]] = True
        kept = group.select(["i", "j", "c"]).append_column("left", pa.array(keep_left)).append_column("right", pa.array(keep_right))
        return kept.filter(pa.array(keep_left | keep_right))

    asked = stored(asked.join(wide, "c").groupBy("i", "j").applyInArrow(narrowed, "i bigint, j bigint, c bigint, left boolean, right boolean"), "asked")

    def compare(group):
        side = lambda name: np.flatnonzero(group.column(name).to_numpy(zero_copy_only=False))
        return _forest(group, side("left"), side("right"), n, num, den)

    return stored(asked.join(texts, "c").groupBy("i", "j").applyInArrow(compare, "a bigint, b bigint"), "links")


def _numbered(docs: DataFrame, name: str = "row") -> DataFrame:
    """docs with a number a row: unique, and the same whenever this table is read."""
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "documents")


def keep_one(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, by_prefix: bool = False) -> DataFrame:
    """Of each component the row with the least doc_id, with all columns of docs; rows without words stay.

    A null doc_id comes after all others; of rows with one doc_id the first of the scan stays.
    """
    row = hidden(docs, "row_of_join")
    kept = _numbered(docs, row)
    groups = similar_groups(kept.select(F.col(row).alias("row"), "doc_id", "text"), n, num, den, by_prefix)
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select(F.col("first.row").alias(row))
    return kept.join(first, row, "left_semi").select(*docs.columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of all documents: three words, 90 of 100."""
    docs = _numbered(table(spark, sf_dir, "documents").select("doc_id", "text"))
    groups = stored(similar_groups(docs), "similar")
    least = groups.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    named = salted_join(groups, least.where("rows > 1").select("component", "component_id"), ["component"], "row")
    return named.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
