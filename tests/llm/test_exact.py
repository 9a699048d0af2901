"""Pieces, words and lines are told apart by their bytes, whatever their hashes."""

import re
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import tokenizers  # noqa: E402

from palimpsest.llm import jaccard, packing, pieces, quality, token_counts, token_ids  # noqa: E402

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def thue_morse(n, flip=0):
    """Words of two letters whose polynomial hashes modulo 2**64 are those of their complements."""
    return "".join("ab"[(bin(i).count("1") + flip) & 1] for i in range(n))


TEXTS = []
for size in (1024, 2048):
    one, two = thue_morse(size), thue_morse(size, 1)
    TEXTS += [one, two, f"x y {one}", f"x y {two}", f"{one}\n{two}\n{one}", f"{one} {one} {one} {two} {two}", f"{two} p q r", f"{one} p q r"]


def test_these_hashes_meet():
    raw = (thue_morse(1024) + thue_morse(1024, 1)).encode()
    a, b = pieces.span_hashes(np.frombuffer(raw, np.uint8), np.array([0, 1024]), np.array([1024, 2048]), pieces.Powers())
    assert a == b


@pytest.mark.parametrize("bound", [1 << 20, 4])
def test_encoder(bound, monkeypatch):
    for path in (BYTES, WORDS):
        tok = tokenizers.Tokenizer.from_file(path)
        want = [tok.encode(t, add_special_tokens=False).ids for t in TEXTS]
        for every_hash_meets in (False, True):
            if every_hash_meets:
                monkeypatch.setattr(pieces, "span_hashes", lambda data, a, b, powers: np.ones(len(a), np.uint64))
            got = pieces.Encoder(path, bound)
            for _ in range(2):
                ids, n = got.ids(TEXTS)
                assert ids.tolist() == [i for t in want for i in t] and n.tolist() == list(map(len, want))
        monkeypatch.undo()


def test_counts_in_slices(monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 64)
    tok = tokenizers.Tokenizer.from_file(BYTES)
    texts = [*TEXTS, " ".join(f"w{i}" for i in range(500)), ""]
    assert token_counts.Transducer(BYTES).count_all(texts).tolist() == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def word_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, windows = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")], Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), sum(x in lines[:i] for i, x in enumerate(lines)), len(again)


def test_quality_statistics(monkeypatch):
    texts = [*TEXTS, "", "\n \n a\n a\na\n", "é è é è é è\n#$%\n#$%"]
    for _ in range(2):
        got = quality.statistics(texts)
        assert list(zip(*(got[k].tolist() for k in quality.STATS), strict=True)) == [word_statistics(t) for t in texts]
        monkeypatch.setattr(pieces, "span_hashes", lambda data, a, b, powers: np.ones(len(a), np.uint64))


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute_groups(texts, n, num, den):
    """(size, least member of the component) of each text."""
    sets, up = [shingles(t, n) for t in texts], list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            inter = len(a & b)
            if a and b and den * inter >= num * (len(a) + len(b) - inter):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return [(len(s), top(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("n,num,by_prefix,block", [(3, 90, False, 128), (3, 90, False, 4), (5, 80, True, 8)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, n, num, by_prefix, block):
    import random

    from pyspark.sql import functions as F

    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng, words = random.Random(1), [f"w{i}" for i in range(300)]
    texts = [*TEXTS, None, "", " \n"]
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 6, 15, 40, 120]))
        texts += [" ".join(base), " ".join(base)] + [" ".join(rng.choice(words) if rng.random() < p else w for w in base) for p in (0.01, 0.04)]
    base = rng.choices(words, k=50)
    texts += [" ".join(rng.choice(words) if rng.random() < 0.012 else w for w in base) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").withColumn("doc_id", F.col("row"))
    got = {r.row: (r.n_shingles, r.component) for r in jaccard.similar_groups(docs, n, num, 100, by_prefix).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts, n, num, 100)


def test_packing_and_ids_of_meeting_words(spark, tmp_path):
    import zlib

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    tok = tokenizers.Tokenizer.from_file(WORDS)
    want = {i: tok.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(TEXTS)}
    got = packing.pack_documents(docs, WORDS, 1 << 13, 0).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in got} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}
    tok = tokenizers.Tokenizer.from_file(BYTES)
    token_ids.write_ids(docs, f"file://{tmp_path}/ids", BYTES, 2)
    at = 0
    for r in token_ids.read_ids(spark, f"file://{tmp_path}/ids", digest=True).orderBy("doc_id").collect():
        ids = tok.encode(TEXTS[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("spare", [0, 2])
def test_components_at_low_thresholds_by_segments(spark, monkeypatch, spare):
    import random

    import corpus_pipeline

    monkeypatch.setattr(jaccard, "SPARE", spare)
    monkeypatch.setattr(jaccard, "prefixes", None)  # the stage's index has segments, as its method says
    rng, words = random.Random(5), [f"w{i}" for i in range(400)]
    texts, line = [*TEXTS, None, ""], " ".join(rng.choices(words, k=9))
    for _ in range(15):
        base = rng.choices(words, k=rng.choice([7, 12, 30, 90, 260]))
        texts += [" ".join(base), " ".join(base) + " " + line, line + " " + " ".join(base)]
        texts += [" ".join(rng.choice(words) if rng.random() < p else w for w in base) for p in (0.01, 0.02, 0.03)]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    docs = docs.select(docs.row.alias("doc_id"), "text")
    want = brute_groups(texts, 5, 80, 100)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i, (_, top) in enumerate(want) if top == i}


def test_segments_to_spare_lose_no_pair():
    rng = np.random.default_rng(3)
    bands = jaccard.Bands(80, 100)
    assert bands.small() and not jaccard.Bands(90, 100).small()
    for _ in range(300):
        size = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        gone = int(rng.integers(0, len(a) // 5 + 1))
        b = np.unique(np.r_[a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, len(a) // 8 + 1)), dtype=np.uint64)])
        inter = len(np.intersect1d(a, b))
        common = np.sort(rng.permutation(a)[: int(rng.integers(0, len(a) + 1))])
        if 100 * inter >= 80 * (len(a) + len(b) - inter):
            one, other = (jaccard.spare_signatures(x, len(x), bands, common) for x in (a, b))
            assert len(np.intersect1d(one, other))
