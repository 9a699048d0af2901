"""Stages of pairing, and the changes of two versions, against the sequential rules."""

import math
import random
import re
from collections import Counter

import pytest

from palimpsest.operators import changes, pair_chain

BOUNDS = "。；;！？!?．"


def key(text, fold):
    bare = re.sub(r"\s+", "", text)
    return re.sub(r"(^|[。；;])\d+(?:\.\d+)+[、.]?", r"\1", bare, flags=re.M).lower() if fold else bare


def holds(longer, shorter):
    at = longer.find(shorter)
    while shorter and len(shorter) < len(longer) and at >= 0:
        end = at + len(shorter)
        if (at == 0 or longer[at - 1] in BOUNDS) and (end == len(longer) or longer[end - 1] in BOUNDS or longer[end] in BOUNDS):
            return True
        at = longer.find(shorter, at + 1)
    return False


def cosine(x, y):
    a, b = (Counter((ord(p) * 31 + ord(q)) % 256 for p, q in zip(t, t[1:])) for t in (x, y))
    if not a or not b:
        return 0.0
    return sum(n * b[k] for k, n in a.items()) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def alike(x, y):
    a, b = ({p + q for p, q in zip(t, t[1:])} for t in (x, y))
    return len(a & b) / len(a | b) if a and b else 0.0


def greedy(edges):
    pairs, left, right = [], set(), set()
    for s, i, j in sorted(edges, reverse=True):
        if i not in left and j not in right:
            pairs.append((i, j, s))
            left.add(i)
            right.add(j)
    return pairs


def stages(old, new):
    """(a, b, score, stage) by plain loops; old and new: {no: (chapter, text)}."""
    out, a, b = [], dict(old), dict(new)

    def take(i, j, score, stage):
        out.append((i, j, round(score, 9), stage))
        del a[i], b[j]

    for i in sorted(old):
        j = next((j for j in sorted(b) if key(b[j][1], False) == key(old[i][1], False)), None)
        if j is not None:
            take(i, j, 1.0, "equal")
    for i in sorted(a):
        x, best = key(a[i][1], True), None
        for j in b:
            y = key(b[j][1], True)
            if a[i][0] != b[j][0] or len(x) < 12 or len(y) < 12:
                continue
            relation = 2 if x == y else 1 if holds(x, y) or holds(y, x) else 0
            if relation:
                best = max(best or (0,), (relation, -abs(i - j), -j))
        if best:
            take(i, -best[2], 1.0 if best[0] == 2 else 0.95, "content")
    edges = []
    for i in a:
        near = sorted(((-cosine(a[i][1], b[j][1]), j) for j in b))[:3]
        edges += [(-s, i, j) for s, j in near if -s >= 0.8]
    for i, j, s in greedy(edges):
        take(i, j, s, "near")
    return out, a, b


def versions(seed):
    rng = random.Random(seed)
    words = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu".split()
    sentence = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 8))) + rng.choice(["!", ";", ".", "", "？"])
    old, new = {}, {}
    for doc in range(12):
        lines = [(rng.choice(["", "1", "2"]), rng.choice([sentence(), sentence() + sentence(), f"{rng.randrange(9)}.{rng.randrange(9)} " + sentence()])) for _ in range(rng.randrange(0, 15))]
        later = []
        for chapter, text in lines:
            kind = rng.randrange(9)
            if kind == 0:
                continue
            later.append((chapter, text + sentence() if kind == 1 else text.replace("a", "o") if kind == 2 else text.upper() if kind == 3 else re.sub(r"^\d\.\d", "7.7", text) if kind == 4 else text.replace(" ", "  ") if kind == 5 else text))
        rng.shuffle(later)
        later += [("", sentence()) for _ in range(rng.randrange(3))]
        old[doc], new[doc] = dict(enumerate(lines)), dict(enumerate(later))
    return old, new


@pytest.mark.parametrize("seed", range(2))
def test_pairs_equal_plain_loops(spark, seed, monkeypatch):
    monkeypatch.setattr(pair_chain, "BLOCK", 4)
    old, new = versions(seed)
    frame = lambda side: spark.createDataFrame([(d, c, n, t) for d, rows in side.items() for n, (c, t) in rows.items()], "doc_id long, chapter string, no int, text string")
    got = pair_chain.paragraph_pairs(frame(old), frame(new)).collect()
    want = {(d, *p) for d in old for p in stages(old[d], new[d])[0]}
    assert {(r.doc_id, r.a, r.b, round(r.score, 9), r.stage) for r in got} == want and len(got) == len(want)
    assert {w[4] for w in want} == {"equal", "content", "near"}


def test_changes_equal_plain_loops(spark):
    old, new = versions(7)
    text = lambda side: [(d, "\n".join(t for _, t in rows.values()) if rows else None) for d, rows in side.items()]
    frames = [spark.createDataFrame(text(s), "doc_id long, text string") for s in (old, new)]
    got = {(r.doc_id, r.kind, r.old_no, r.new_no, r.old_line, r.new_line) for r in changes.line_changes(*frames).collect()}
    want = set()
    for d in old:
        a, b = ({i: ("", t) for i, (_, t) in s[d].items() if t.strip()} for s in (old, new))
        pairs, left, right = stages(a, b)
        met = [(i, j) for i, j, _, stage in pairs if stage != "equal"]
        edges = [(alike(x[1], y[1]), i, j) for i, x in left.items() for j, y in right.items()]
        met += [(i, j) for i, j, _ in greedy([e for e in edges if e[0] >= 0.45])]
        want |= {(d, "modified", i, j, a[i][1], b[j][1]) for i, j in met}
        want |= {(d, "removed", i, -1, left[i][1], None) for i in left if i not in {m[0] for m in met}}
        want |= {(d, "added", -1, j, None, right[j][1]) for j in right if j not in {m[1] for m in met}}
    assert got == want
    assert {w[1] for w in want} == {"added", "removed", "modified"}


def test_empty_sides(spark):
    none = spark.createDataFrame([], "doc_id long, chapter string, no int, text string")
    one = spark.createDataFrame([(1, None, 0, None), (1, "", 1, "x")], none.schema)
    assert pair_chain.paragraph_pairs(none, one).count() == 0
    assert {(r.a, r.b, r.stage) for r in pair_chain.paragraph_pairs(one, one).collect()} == {(0, 0, "equal"), (1, 1, "equal")}


def test_absorbed_lines(spark):
    rows = [(1, "removed", 0, -1, "a passage of some length", None), (1, "removed", 1, -1, "another passage that stays", None), (1, "modified", 2, 2, "x", "here is a passage of some length, moved"), (2, "removed", 0, -1, "a passage of some length", None), (1, "removed", 5, -1, "short", None)]
    frame = spark.createDataFrame(rows, "doc_id long, kind string, old_no int, new_no int, old_line string, new_line string")
    assert {(r.doc_id, r.old_no) for r in changes.absorbed_out(frame).collect()} == {(1, 1), (1, 2), (2, 0), (1, 5)}
