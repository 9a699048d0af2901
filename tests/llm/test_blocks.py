"""Many texts of one template, about and just under the threshold: every link found, no row for a pair."""

import random

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import jaccard


def texts(n, changed, seed):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(400)]
    out = []
    for k in range(n):
        words = list(base)
        for at in rng.sample(range(400), changed if k % 5 else changed - 3):
            words[at] = f"x{k}-{at}"
        out.append((k, k, " ".join(words)))
    return out


def plain(rows):
    sets = {k: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for k, _, t in rows}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in sets}


def test_blocks_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    made = []
    kept = jaccard.stored

    def counted(df, name="t", codec="zstd"):
        out = kept(df, name, codec)
        if name in ("open", "links"):
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stored", counted)
    for by_prefix in (False, True):
        rows = texts(120, 6, by_prefix)
        made.clear()
        got = jaccard.similar_groups(spark.createDataFrame(rows, "row long, doc_id long, text string"), by_prefix=by_prefix).select("row", "component").collect()
        want = plain(rows)
        assert {r.row: r.component for r in got} == want
        assert 1 < len(set(want.values())) < 120
        # 7,140 pairs; 36 pairs of blocks, each with a row and a forest
        assert max(made) < 1200


def test_wide_sketches_meet_at_the_narrower_width():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 9000).astype(np.uint64)
    for size, other in ((9000, 8000), (2100, 2000), (300, 290), (4096, 4097)):
        a, b = base[:size], base[:other]
        bits = [jaccard.parity(x, jaccard.wide_bits(len(x))) for x in (a, b)]
        width = min(len(x) for x in bits)
        assert jaccard.fold(bits[0], width) == jaccard.parity(a, 8 * width)
        assert jaccard.differing(*bits) <= abs(size - other)
        assert jaccard.may_be_alike_wide(np.array([size]), bits[:1], np.array([other]), bits[1:], 80, 100).all()


def test_long_unlike_texts_are_not_moved(spark, monkeypatch):
    """Texts of 2,000 words that are alike at 0.5 meet in entries; sketches of 512 bits say nothing about sets of that size."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(2000)]
    rows = []
    for k in range(12):
        words = list(base)
        for lo in rng.sample(range(0, 2000, 20), 30):
            words[lo : lo + 20] = [f"x{k}-{lo}-{i}" for i in range(20)]
        rows.append((k, k, " ".join(words)))
    rows.append((12, 12, rows[0][2] + " one more"))
    moved = []
    real = jaccard._with_hubs

    def counted(pairs, *rest):
        moved.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(jaccard, "_with_hubs", counted)
    got = jaccard.similar_groups(spark.createDataFrame(rows, "row long, doc_id long, text string"), 5, 80, 100).select("row", "component").collect()
    assert {r.row: r.component for r in got} == {k: 0 if k == 12 else k for k in range(13)}
    assert moved[0] <= 2, moved
