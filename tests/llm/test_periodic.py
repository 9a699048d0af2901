"""Periodic runs against all periods and places, one by one."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from palimpsest.llm import periodic

DATA = "/root/testdata/sf0.001"


def brute(words):
    """Runs by comparing every pair of words."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, size, q) for (s, size), q in out.items())


def expected(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    found = brute(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    return len(words), found, " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        words = []
        while len(words) < rng.randrange(1, 400):
            part = [rng.choice("abcdefgh"[: rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 40))]
            words += part * rng.choice([1, 1, 2, 3, 4, 5, 9]) + part[: rng.randrange(len(part))]
        yield words


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    many = list(texts(seed))
    table = periodic._Words()
    mine, left = periodic._search([table.of(" ".join(w).encode()) for w in many], table)
    for words, found, rest in zip(many, mine, left, strict=True):
        n, want, text = expected(" ".join(words))
        assert [(r["start"], r["length"], r["period"]) for r in found] == want
        assert rest.decode() == text


def test_long_periods_and_nested_runs():
    inner = [f"w{i}" for i in range(37)] + ["x"] * 30 + ["y", "z"] * 20
    words = ["head"] + inner * 9 + inner[:50] + ["tail"] + [f"v{i}" for i in range(300)] * 4
    fib = ["a"], ["a", "b"]
    for _ in range(11):
        fib = fib[1], fib[1] + fib[0]
    table = periodic._Words()
    for case in (words, fib[1], ["t"] * 5000, [f"u{i % 1000}" for i in range(4000)]):
        mine, _ = periodic._search([table.of(" ".join(case).encode())], table)
        assert [(r["start"], r["length"], r["period"]) for r in mine[0]] == brute(case)


def test_meeting_hashes_cost_no_run(monkeypatch):
    monkeypatch.setattr(periodic, "mix", lambda x: x & np.uint64(7))
    test_runs_equal_brute_force(3)


def test_runs_of_texts_left_out_hide_none_of_the_next():
    rng = random.Random(5)
    for q in range(8, 40):
        part = [rng.choice("abcdefgh") for _ in range(q)]
        for n in (8, 12, 20, 31, 60):
            many = [["a"] * n, (part * 5)[: 4 * q + n % 3], ["x", "y"] * n, part * 4 + ["end"]]
            table = periodic._Words()
            mine, _ = periodic._search([table.of(" ".join(w).encode()) for w in many], table)
            assert [[(r["start"], r["length"], r["period"]) for r in m] for m in mine] == [brute(w) for w in many]


def damaged(doc_id, text):
    h = zlib.crc32(str(doc_id).encode())
    g, words = h // 10, re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if h % 10 == 0 and words:
        n = len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return " ".join(words)


def test_query_equals_brute_force(spark):
    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        _, found, rest = expected(damaged(r.doc_id, r.text))
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want[r.doc_id] = (len(found), *best, best[1] and 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, rest)))
    got = {r.doc_id: tuple(r[1:]) for r in periodic.op12_periodic_runs(spark, DATA).collect()}
    assert got == want
    assert sum(v[0] > 0 for v in want.values()) > 10


def test_awkward_rows(spark):
    schema = "doc_id long, text string, runs string, n_words int, collapsed string"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 6), (4, "a " * 6), (None, "b c " * 8), (7, "é x y\n" * 5 + "z"), (8, "w " * 300_000 + "end"), (9, " ".join(f"q{i % 70000}" for i in range(290_000)))]
    docs = spark.createDataFrame([(*r, "r", 1, "c") for r in rows], schema)
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect()), key=str)
    want = sorted(((i or 0, *expected(t)) for i, t in rows[:7]), key=str)
    long = {r[0]: r[1:] for r in got if r[0] > 7}
    assert [r for r in got if r[0] <= 7] == want
    assert long[8] == (300_001, [(0, 300_000, 1)], "w end")
    assert long[9][:2] == (290_000, [(0, 290_000, 70_000)]) and len(long[9][2].split()) == 70_000
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
