"""Whole texts to token ids, each distinct piece of text encoded once per worker.

Both tokenizers used here (byte-level BPE, and BPE with word ends) first split a
text by a fixed pattern and then merge inside each part, so the ids of a text are
the ids of its parts in order.  `split` cuts a batch of texts only at places where
that pattern always has a boundary; `PieceTable` asks the tokenizer library for
the ids of the pieces it has not met yet and finds the others by a hash and their bytes.
The table is a cache with a bound: once over it, it starts anew, so memory does not grow
with the corpus and every piece still gets its ids from the library.  A long text is a
run of its own; hashes and comparisons go over it in slices.
"""

from __future__ import annotations

import gc
import hashlib
import re

import numpy as np

_WS, _LETTER, _PUNCT, _APOS, _HIGH = 1, 2, 4, 8, 16

#: White space outside ASCII (UTF-8); fixed values of the Unicode standard.
_WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]

#: Bytes that are hashed and compared at a time (a longer piece stands alone).
SLICE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _classes() -> np.ndarray:
    table = np.full(256, _PUNCT, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = _WS
    table[65:91] = table[97:123] = _LETTER
    table[39] = _APOS
    table[128:] = _HIGH
    table[[28, 29, 30, 31]] = _HIGH  # white space to some pattern engines: never cut beside them
    return table


_CLASS = _classes()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64 = _BASE):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << int(n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.base)])
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.inverse)])
        return self.up[:n], self.down[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hashes of the byte spans [starts, ends) of data: equal for equal bytes, not only for them."""
    up, down = powers.upto(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def split(data: np.ndarray, borders: np.ndarray, raw: bytes) -> np.ndarray:
    """Starts of the pieces of the concatenated texts; every border (text start) is one.

    Cut between a character and white space after it, between a letter and an ASCII
    non-letter after it, and between ASCII punctuation or digits (the apostrophe
    excepted, it opens contractions) and a letter after it.
    """
    cls = _CLASS[data]
    two = np.flatnonzero(data[:-1] == 0xC3)  # Latin-1 letters, but for the two signs
    two = two[(data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]
    letter = cls == _LETTER
    letter[two] = letter[two + 1] = True
    inside = np.zeros(len(data), bool)
    inside[two + 1] = True
    ws = cls == _WS
    solid = (cls != _WS) & ((cls != _HIGH) | letter)
    if not any(s in raw for s in _WIDE_SPACES):
        solid |= data >= 128
    cut = np.zeros(len(data), bool)
    cut[1:] = (solid[:-1] & ws[1:]) | (letter[:-1] & ((cls[1:] & (_PUNCT | _APOS)) > 0)) | ((cls[:-1] == _PUNCT) & letter[1:] & ~inside[1:])
    cut[borders[borders < len(data)]] = True
    return np.flatnonzero(cut)


class PieceTable:
    """Open-addressing map from the bytes of a piece to its run of values (ids, counts, digests).

    A 64-bit hash finds the slot; the bytes of every hit are compared with those kept, so
    no two pieces are ever taken for each other.  A piece whose hash belongs to another
    one gets an entry without a slot, and is encoded again when it is met again.
    Entries stay valid until `trim`, which starts the table anew once it is over its bound.
    """

    def __init__(self, encode_new, bound: int = 1 << 20, most_bytes: int = 1 << 26):
        self.encode_new, self.bound, self.most_bytes = encode_new, bound, most_bytes
        self.powers = Powers()
        self._clear()

    def _clear(self) -> None:
        self.n = self.used = self.held = 0
        self.starts, self.lens = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.first, self.sizes, self.names = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint64)
        self.values, self.bytes = np.zeros(1 << 18, np.int32), np.zeros(1 << 20, np.uint8)
        self._slots(4 * self.bound)

    def _slots(self, slots: int) -> None:
        slots = 1 << (slots - 1).bit_length()
        self.mask = np.uint64(slots - 1)
        self.keys, self.at = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)

    def trim(self) -> None:
        """Forget all pieces if there are more than the bound; entries given out so far are void then."""
        if self.n > self.bound or self.held > self.most_bytes:
            self.release()

    def release(self) -> None:
        """Forget all pieces and give their memory back: a worker goes on to tasks that have no use for them."""
        self.powers = Powers()
        self._clear()

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash (-1: absent)."""
        slot = (hashes & self.mask).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == hashes, self.at[slot], -1)
        left = np.flatnonzero((key != hashes) & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & int(self.mask)
            key = self.keys[slot[left]]
            hit = key == hashes[left]
            out[left[hit]] = self.at[slot[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def _place(self, hashes: np.ndarray, entry: np.ndarray) -> None:
        """Slots for hashes that have none yet, all distinct."""
        slot, todo = (hashes & self.mask).astype(np.int64), np.arange(len(hashes))
        while len(todo):
            free = self.keys[slot[todo]] == 0
            first = todo[free]
            self.keys[slot[first]] = hashes[first]  # of several on one slot the last stays
            won = first[self.keys[slot[first]] == hashes[first]]
            self.at[slot[won]] = entry[won]
            stay = np.ones(len(hashes), bool)
            stay[won] = False
            todo = todo[stay[todo]]
            slot[todo] = (slot[todo] + 1) & int(self.mask)

    def _append(self, pieces: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """New entries (hash 0: without a slot)."""
        values, lens = self.encode_new(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        blob = np.frombuffer(b"".join(pieces), np.uint8)
        n, m, k = len(pieces), len(values), len(blob)

        def room(a: np.ndarray, need: int) -> np.ndarray:
            return a if need <= len(a) else np.r_[a, np.zeros(max(need, 2 * len(a)) - len(a), a.dtype)]

        for name in ("starts", "lens", "first", "sizes", "names"):
            setattr(self, name, room(getattr(self, name), self.n + n))
        self.values, self.bytes = room(self.values, self.used + m), room(self.bytes, self.held + k)
        here = slice(self.n, self.n + n)
        self.values[self.used : self.used + m], self.bytes[self.held : self.held + k] = values, blob
        self.starts[here], self.lens[here] = self.used + np.cumsum(lens) - lens, lens
        self.first[here], self.sizes[here], self.names[here] = self.held + np.cumsum(sizes) - sizes, sizes, hashes
        entry = np.arange(self.n, self.n + n)
        self.n, self.used, self.held = self.n + n, self.used + m, self.held + k
        if 2 * self.n > len(self.keys):
            self._slots(4 * self.n)
            slotted = np.flatnonzero(self.names[: self.n])
            self._place(self.names[slotted], slotted)
        else:
            slotted = np.flatnonzero(hashes)
            self._place(hashes[slotted], entry[slotted])
        return entry

    def _unlike(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Which spans differ from the bytes of their entries."""
        sizes = ends - begins
        wrong = self.sizes[entry] != sizes
        same = np.flatnonzero(~wrong) if wrong.any() else slice(None)
        sizes, kept, seen = sizes[same], self.first[entry[same]], begins[same]
        to = np.cumsum(sizes) - sizes
        step = np.arange(int(sizes.sum()))
        bad = np.flatnonzero(self.bytes[np.repeat(kept - to, sizes) + step] != data[np.repeat(seen - to, sizes) + step])
        if len(bad):
            at = np.unique(np.searchsorted(to + sizes, bad, "right"))
            wrong[np.arange(len(wrong))[same][at]] = True
        return np.flatnonzero(wrong)

    def find(self, raw: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each byte span [begin, end) of raw, in slices of about a megabyte."""
        out, lo = np.zeros(len(begins), np.int64), 0
        data = np.frombuffer(raw, np.uint8)
        while lo < len(begins):
            hi = max(lo + 1, int(np.searchsorted(ends, begins[lo] + SLICE, "right")))
            a = int(begins[lo])
            out[lo:hi] = self._slice(raw, data[a : int(ends[hi - 1])], a, begins[lo:hi] - a, ends[lo:hi] - a)
            lo = hi
        return out

    def _slice(self, raw: bytes, data: np.ndarray, base: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        of = lambda where: [raw[a:b] for a, b in zip((begins[where] + base).tolist(), (ends[where] + base).tolist(), strict=True)]
        hashes = span_hashes(data, begins, ends, self.powers)
        hashes[hashes == 0] = 1
        entry = self._find(hashes)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            fresh, first = np.unique(hashes[miss], return_index=True)
            self._append(of(miss[first]), fresh)
            entry[miss] = self._find(hashes[miss])
        wrong = self._unlike(data, begins, ends, entry)
        if len(wrong):
            own: dict[bytes, list[int]] = {}
            for i, piece in zip(wrong.tolist(), of(wrong), strict=True):
                own.setdefault(piece, []).append(i)
            for e, places in zip(self._append(list(own), np.zeros(len(own), np.uint64)), own.values(), strict=True):
                entry[places] = e
        return entry

    def lookup(self, raw: bytes, borders: np.ndarray, trim: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece starts, entry of each piece, lens of entries) for concatenated texts.

        A run with more distinct pieces than the bound makes the table larger; the next
        run starts with an empty one.
        """
        self.trim()
        data = np.frombuffer(raw, np.uint8)
        starts = split(data, borders, raw)
        ends = np.r_[starts[1:], len(data)]
        begins = starts
        if trim:  # leading white space has no ids
            solid = np.flatnonzero(_CLASS[data] != _WS)
            begins = np.minimum(np.r_[solid, len(data)][np.searchsorted(solid, starts)], ends)
        entry = self.find(raw, begins, ends)
        return starts, entry, self.lens[entry]

    def gather(self, entry: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The values of the entries, one run after the other."""
        total = int(lens.sum())
        if not total:
            return np.zeros(0, np.int32)
        to = np.cumsum(lens, dtype=np.int64) - lens
        return self.values[np.repeat(self.starts[entry] - to, lens) + np.arange(total)]


class WordTable(PieceTable):
    """Words to 128-bit digests (blake2b); entries tell words apart by their bytes."""

    def __init__(self, bound: int = 1 << 17):
        super().__init__(self._digests, bound, 1 << 23)

    @staticmethod
    def _digests(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        made = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in words)
        return np.frombuffer(made, np.int32), np.full(len(words), 4, np.int32)

    def digests(self, entry: np.ndarray) -> np.ndarray:
        """Two uint64 for each entry."""
        return self.values[: 4 * self.n].view(np.uint64).reshape(-1, 2)[entry]


def plain_table(bound: int = 1 << 17) -> PieceTable:
    """Entries of spans, without values."""
    return PieceTable(lambda pieces: (np.zeros(0, np.int32), np.zeros(len(pieces), np.int32)), bound, 1 << 23)


def same_windows(entry: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the windows of n neighbours: equal for equal entries, and only for them."""
    out = entry[: len(entry) - n + 1]
    for k in range(1, n):
        out = np.unique(out * (int(entry.max()) + 1) + entry[k : len(out) + k], return_inverse=True)[1]
    return out


_ONE_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte (fixed values)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them without added special tokens."""

    def __init__(self, path: str, bound: int = 1 << 20):
        import json

        import tokenizers

        self.tok = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.sep = "<|endoftext|>" if b"<|endoftext|>" in self.special else None
        self.trim = self.tok.normalizer is not None
        spec = json.loads(self.tok.to_str())
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        byte_level = (spec["pre_tokenizer"] or {}) if not kinds else (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[-1]
        #: A run of letters is one part before merging, so the model alone gives its ids.
        self.direct = byte_level.get("type") == "ByteLevel" and not byte_level.get("add_prefix_space") and (kinds == ["NFC", "Replace", "Lowercase"] or not kinds and bool(byte_level.get("use_regex")))
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.vocab_size = self.tok.get_vocab_size()
        self.table = PieceTable(self._new, bound)

    def _batch(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def _new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not self.direct:
            got = self._joined(pieces)
        else:
            model, got, others = self.tok.model, [], []
            gc.disable()  # many small lists, none of them cyclic
            for i, p in enumerate(pieces):
                if _ONE_WORD.fullmatch(p):
                    if self.trim:
                        p = p.strip().decode().lower().encode()
                    got.append([t.id for t in model.tokenize(p.decode("latin-1").translate(self.letters))])
                else:
                    got.append(None)
                    others.append(i)
            for i, ids in zip(others, self._joined([pieces[i] for i in others]), strict=True):
                got[i] = ids
            gc.enable()
        return np.fromiter((i for x in got for i in x), np.int32), np.fromiter(map(len, got), np.int32, len(got))

    def _joined(self, pieces: list[bytes]) -> list[list[int]]:
        """Many pieces in one string, between separators that the library keeps apart."""
        texts = [p.decode() for p in pieces]
        if self.sep is None:
            return self._batch(texts)
        sep, out = self.tok.token_to_id(self.sep), []
        for ids in self._batch([self.sep.join(texts[i : i + 512]) + self.sep for i in range(0, len(texts), 512)]):
            run: list[int] = []
            for t in ids:
                if t == sep:
                    out.append(run)
                    run = []
                else:
                    run.append(t)
        return out

    def ids(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each); texts: an Arrow string array or a list."""
        counts, parts = np.zeros(len(texts), np.int64), []
        for lo, hi, raw, borders in runs(texts):
            marked = set()
            for s in self.special:
                at = raw.find(s)
                while at >= 0:
                    marked.add(int(np.searchsorted(borders, at, "right")) - 1)
                    at = raw.find(s, at + 1)
            if not marked:
                flat, counts[lo:hi] = self._plain(raw, borders)
                parts.append(flat)
                continue
            ends = np.r_[borders[1:], len(raw)]
            for i, (a, b) in enumerate(zip(borders.tolist(), ends.tolist(), strict=True)):
                flat = np.array(self._batch([raw[a:b].decode()])[0], np.int32) if i in marked else self._plain(raw[a:b], np.zeros(1, np.int64))[0]
                counts[lo + i] = len(flat)
                parts.append(flat)
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), counts

    def _plain(self, raw: bytes, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not raw:
            return np.zeros(0, np.int32), np.zeros(len(borders), np.int64)
        starts, entry, lens = self.table.lookup(raw, borders, self.trim)
        before = np.r_[0, np.cumsum(lens, dtype=np.int64)]
        return self.table.gather(entry, lens), np.diff(before[np.searchsorted(starts, np.r_[borders, len(raw)])])


def runs(texts, size: int = 1 << 20):
    """(from, to, bytes, starts of texts in them) for runs of texts of about so many bytes; a longer text stands alone."""
    import pyarrow as pa

    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.large_string())
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = memoryview(data) if data is not None else memoryview(b"")
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, hi, bytes(whole[at[lo] : at[hi]]), at[lo:hi] - at[lo]
        lo = hi


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
