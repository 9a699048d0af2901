"""Words to lines, prefixes, Markdown, likeness, evidence, halved batches and pairs above a cosine, against plain loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import evidence, judging, likeness, markdown, page_lines, pair_chain, retrieval


def plain_lines(words, tolerance):
    """The rule word by word: (top of the first word, text)."""
    out = []
    for top, x0, text in sorted(words):
        if out and abs(top - out[-1][0]) <= tolerance:
            out[-1][1].append((x0, top, text))
        else:
            out.append((top, [(x0, top, text)]))
    return [(top, " ".join(t for _, _, t in sorted(ws))) for top, ws in out]


@pytest.mark.parametrize("seed", range(2))
def test_words_to_lines(spark, seed):
    rng = random.Random(seed)
    pages = {(d, p): [(rng.randrange(rng.choice([3, 60, 400])) / 2, rng.randrange(9) * 10.0, rng.choice("abcdef")) for _ in range(rng.randrange(1, 90))] for d in range(6) for p in range(2)}
    rows = [(d, p, *w) for (d, p), words in pages.items() for w in words]
    frame = spark.createDataFrame([*rows, (0, 0, None, 1.0, "no place")], "doc_id long, page int, top double, x0 double, text string")
    got = page_lines.words_to_lines(frame).orderBy("doc_id", "page", "line_no").collect()
    want = [(d, p, i, *line) for (d, p), words in sorted(pages.items()) for i, line in enumerate(plain_lines(words, 3.0), 1)]
    assert [(r.doc_id, r.page, r.line_no, r.top, r.text) for r in got] == want


def test_numbers_in_the_margin(spark):
    rows = [("a", 10.0, 60.0, "策"), ("a", 10.5, 70.0, "略"), ("a", 12.0, 5.0, "1.2"), ("a", 12.0, 90.0, "plan"), ("a", 30.0, 5.0, "text"), ("a", 30.0, 60.0, "3"), ("b", 1.0, 1.0, None)]
    got = page_lines.words_to_lines(spark.createDataFrame(rows, "page string, top double, x0 double, text string"), margin=50, numbers=r"\d+\.\d+").collect()
    assert {(r.page, r.line_no, r.text) for r in got} == {("a", 1, "1.2 策略 plan"), ("a", 2, "text 3"), ("b", 1, "")}
    inside = spark.createDataFrame([(5.0,), (10.0,), (20.0,), (20.5,)], "top double").select(page_lines.inside(F.col("top"), F.lit(10.0), F.lit(20.0)).alias("x"))
    assert [r.x for r in inside.collect()] == [False, True, True, False]


def plain_prefix(page, wanted):
    page, mark = (re.sub(r"\s+", "", x or "") for x in (page, wanted))
    if not mark:
        return None
    if mark in page:
        return page.find(mark), len(mark)
    for n in range(min(len(mark), 80), 11, -1):
        if mark[:n] in page:
            return page.find(mark[:n]), n
    return None


def test_longest_prefix(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    rows = [(None, "x"), ("x", None), ("", ""), ("abc", "abc")]
    for _ in range(300):
        page = text(rng.randrange(400))
        at = rng.randrange(len(page) + 1)
        rows.append((page, page[at : at + rng.randrange(150)] + text(rng.randrange(30))))
    got = spark.createDataFrame(rows, "page string, wanted string").select("page", "wanted", page_lines.longest_prefix(F.col("page"), F.col("wanted")).alias("f")).collect()
    assert [r.f and tuple(r.f) for r in got] == [plain_prefix(r.page, r.wanted) for r in got]


def test_evidence(spark):
    cases = [
        ("设备，每月检查一次", "设备，每季度检查一次", "frequency"),
        ("设备每月检查一次", "设备每季度检查一次", None),
        ("设备每月检查一次", "每季度看", None),
        ("设备每月检查", "设备，每月 检查", None),
        ("禁止使用外部网络", "可以使用外部网络", "prohibition"),
        ("禁止外部网络", "可以使用外部网络", "prohibition"),
        ("不得访问VPN", "允许访问VPN服务", "prohibition"),
        ("不得访问VPN", "说明访问VPN服务", None),
        ("禁止任何", "可以任何", None),
        ("班组长负责审核", "值班员负责审核", "duty"),
        ("班组长负责审核", "值班员负责培训", None),
        (None, "x", None),
        (None, None, None),
    ]
    got = spark.createDataFrame([c[:2] for c in cases], "a string, b string").select(evidence.kind_of_evidence(F.col("a"), F.col("b")).alias("e")).collect()
    assert [r.e for r in got] == [c[2] for c in cases]
    back = spark.createDataFrame([c[1::-1] for c in cases], "a string, b string").select(evidence.kind_of_evidence(F.col("a"), F.col("b")).alias("e")).collect()
    assert [r.e for r in back] == [c[2] for c in cases]


def test_markdown(spark):
    # (kind, page, order, text, chapter, title)
    items = [
        ("paragraph", 1, 1, "1 Scope 1.3-12", "1", "Scope"),
        ("paragraph", 1, 2, "1.1 Terms 35 页", "1.1", "Terms 35 页"),
        ("paragraph", 2, 3, "First words.", "1.1", "Terms 35 页"),
        ("table", 2, 5, "| a | b |", "1.1", "Terms"),
        ("paragraph", 2, 4, "Scope", "1", "Scope"),
        ("paragraph", 3, 6, "1.2、Use：Then text", "1.2", "Use"),
        ("paragraph", 3, 7, "2.1.1 Deep and on", "2.1.1", "Deep"),
        ("paragraph", 3, 8, " no chapter ", None, None),
        ("table", 3, 9, "", "", ""),
    ]
    rows = [(1, k, i + 1, p, 0, o, t, c, n) for i, (k, p, o, t, c, n) in enumerate(items)] + [(2, "paragraph", 1, 1, 2, 0, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, kind string, index int, page int, page_end int, order_no int, text string, chapter string, chapter_title string")
    got = {r.doc_id: r.markdown for r in markdown.documents(markdown.blocks(frame)).collect()}
    assert got[1] == "# 1 Scope\n\n\n\n## 1.1 Terms\n\nFirst words.\n\n\n# 1 Scope\n\n\n| a | b |\n\n\n## 1.2 Use\n\nThen text\n\n\n### 2.1.1 Deep\n\nand on\n\nno chapter\n"
    assert got[2] == "\n"
    told = {(r.doc_id, r["at"]["order"]): r.text for r in markdown.checked_blocks(frame).collect()}
    assert told[1, 5] == "<!-- parse_qa type='table' index=4 page=2 page_end=2 chapter='1.1' -->\n| a | b |\n"
    assert told[2, 1] == "<!-- parse_qa type='paragraph' index=1 page=1 page_end=2 chapter='' -->"


def plain_halves(known, places, least):
    """Answers and calls of one batch by recursion."""
    calls = []

    def go(lo, hi):
        ok = all(known.get(p) is not None for p in range(lo, hi + 1))
        calls.append((lo, hi, ok))
        if ok:
            return {p: known[p] for p in range(lo, hi + 1)}
        if hi - lo + 1 <= least:
            return {}
        mid = lo + (hi - lo + 1) // 2
        return go(lo, mid - 1) | go(mid, hi)

    return go(1, places), sorted(calls)


@pytest.mark.parametrize("least", [1, 3])
def test_halves(spark, least):
    rng = random.Random(least)
    batches = {b: {p: rng.choice([0, 1, 1, 1, 1, None]) for p in range(1, n + 1)} for b, n in enumerate([1, 2, 3, 8, 13, 5])}
    items = spark.createDataFrame([(b, p, f"k{b}-{p}") for b, known in batches.items() for p in known], "batch long, place int, key string")
    table = spark.createDataFrame([(b, p, a) for b, known in batches.items() for p, a in known.items() if a is not None or p % 2], "batch long, place int, answer int")
    ask = lambda asked: asked.join(table, ["batch", "place"])
    answers, calls = judging.in_halves(items, ask, least)
    got = {}
    for r in answers.collect():
        assert got.setdefault(r.batch, {}).setdefault(r.place, r.answer) == r.answer
    made = {}
    for r in calls.collect():
        made.setdefault(r.batch, []).append((r.lo, r.hi, r.answered))
    for b, known in batches.items():
        want, asked = plain_halves(known, len(known), least)
        assert got.get(b, {}) == want and sorted(made[b]) == asked


def test_cached_answers_keep_their_places(spark):
    items = spark.createDataFrame([(1, p, f"k{p}") for p in range(1, 7)] + [(2, 1, "k9")], "batch long, place int, key string")
    cache = spark.createDataFrame([("k2", 20), ("k5", 50), ("k2", 20), ("other", 7)], "key string, answer int")
    ask = lambda asked: asked.select("batch", "lo", "place", F.when(F.col("key") != "k4", F.lit(1)).alias("answer"))
    answers, calls, kept = judging.with_cache(items, cache, ask)
    assert {(r.batch, r.place, r.answer) for r in answers.collect()} == {(1, 1, 1), (1, 2, 20), (1, 3, 1), (1, 5, 50), (1, 6, 1), (2, 1, 1)}
    assert {(r.lo, r.hi) for r in calls.where("batch = 1").collect()} == {(1, 4), (1, 2), (3, 4), (3, 3), (4, 4)}
    assert {(r.key, r.answer) for r in kept.collect()} == {("k1", 1), ("k2", 20), ("k3", 1), ("k5", 50), ("k6", 1), ("k9", 1), ("other", 7)}
    none = judging.with_cache(items.limit(0), cache, ask)
    assert none[0].count() == none[1].count() == 0


@pytest.mark.parametrize("least", [0.6, 0.9])
def test_pairs_above(spark, monkeypatch, least):
    monkeypatch.setattr(retrieval, "PER_PIVOT", 40)
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 6))
    vectors = [(i, (centres[i % 9] + 0.4 * rng.normal(size=6)).tolist()) for i in range(300)] + [(300, [0.0] * 6), (301, None), (302, [1.0, 2.0]), (303, [2.0, 4.0]), (304, [])]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {(r.a, r.b): r.score for r in retrieval.pairs_above(rows, rows, least).collect()}
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-12) for i, v in vectors if v}
    want = {(i, j): float(u @ v) for i, u in unit.items() for j, v in unit.items() if len(u) == len(v) and u @ v >= least}
    assert set(got) == set(want) and all(math.isclose(got[p], want[p], abs_tol=1e-9) for p in got)
    assert (302, 303) in got and retrieval.pairs_above(rows, rows.limit(0), least).count() == 0


def test_likeness_of_documents(spark):
    rng = random.Random(5)
    docs = {d: ["".join(rng.choices("abcde ", k=rng.randrange(0, 12))) for _ in range(rng.choice([0, 1, 3, 7]))] for d in range(8)}

    def vector(t):
        return Counter((ord(p) * 31 + ord(q)) % 256 for p, q in zip(t, t[1:]))

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return sum(x * b[k] for k, x in a.items()) / n if n else 0.0

    def plain(a, b):
        a, b = (list(map(vector, x[:3])) for x in (a, b))
        if not a or not b:
            return 0.0
        return (sum(max(cosine(x, y) for y in b) for x in a) / len(a) + sum(max(cosine(x, y) for x in a) for y in b) / len(b)) / 2

    rows = spark.createDataFrame([(d, n, t) for d, ts in docs.items() for n, t in enumerate(ts)], "doc_id long, no int, text string")
    pairs = spark.createDataFrame([(a, b) for a in docs for b in docs], "doc_a long, doc_b long")
    got = likeness.document_likeness(rows.select("doc_id", "no", pair_chain.pair_buckets(F.col("text")).alias("buckets")), pairs, 3).collect()
    assert len(got) == 64 and all(math.isclose(r.likeness, plain(docs[r.doc_a], docs[r.doc_b]), abs_tol=1e-9) for r in got)
    ranked = likeness.most_alike_first(spark.createDataFrame([(1, 5, 0.5), (1, 2, 0.5), (1, 9, 0.7)], "doc_a long, doc_b long, likeness double")).orderBy("place").collect()
    assert [r.doc_b for r in ranked] == [9, 2, 5]


def test_pairs_of_a_likeness_carry_no_texts(spark, monkeypatch):
    """Pairs are rows of two ids: groups of any size give the same, ids that aren't there are like nothing, a line that all have is dealt out."""
    import inspect

    rng = random.Random(2)
    rows = spark.createDataFrame([(d, n, "".join(rng.choices("abcd ", k=9))) for d in range(30) for n in range(d % 4)], "doc_id long, no int, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(0, 30, 3) for b in range(32)] + [(1, 1), (1, 1)], "doc_a long, doc_b long")
    want = sorted((r.doc_a, r.doc_b, round(r.likeness, 12)) for r in likeness.document_likeness(rows, pairs).collect())
    for name, n in (("GROUP_A", 2), ("GROUP_B", 3), ("ROWS", 2), ("HELD", 10)):
        monkeypatch.setattr(likeness, name, n)
    assert sorted((r.doc_a, r.doc_b, round(r.likeness, 12)) for r in likeness.document_likeness(rows, pairs).collect()) == want
    assert len(want) == 322 and all(v == 0 for a, b, v in want if b > 29 or a % 4 == 0 or b % 4 == 0)
    assert "cogroup" in inspect.getsource(likeness.document_likeness)
    lines = spark.createDataFrame([(d, t) for d in range(40) for t in ("all have it", "all have it", f"own {d % 9}")], "doc_id long, line string")
    met = likeness.sharing(lines.where("doc_id < 3"), lines)
    assert sorted((r.doc_a, r.doc_b) for r in met.collect()) == [(a, b) for a in range(3) for b in range(40) if a != b]


def test_blocks_of_vectors_are_not_shuffled_for_each_pair(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = retrieval.pairs_above(rows, rows, 0.9)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_pages_of_many_words_and_few_shuffles(spark, monkeypatch):
    rng = random.Random(9)
    pages = {d: [(rng.randrange(300) / 2, rng.randrange(9) * 10.0, rng.choice("abcdef")) for _ in range(n)] for d, n in enumerate((1, 30, 400, 500))}
    frame = spark.createDataFrame([(d, *w) for d, words in pages.items() for w in words], "doc_id long, top double, x0 double, text string")
    want = [(d, i, *line) for d, words in sorted(pages.items()) for i, line in enumerate(plain_lines(words, 3.0), 1)]
    few = page_lines.words_to_lines(frame)
    # words are shuffled once, to their page
    assert few._jdf.queryExecution().sparkPlan().toString().count("ObjectHashAggregate(") <= 2 and "Join" not in few._jdf.queryExecution().sparkPlan().toString()
    for most in (50_000, 100):
        monkeypatch.setattr(page_lines, "PAGE_WORDS", most)
        got = page_lines.words_to_lines(frame).orderBy("doc_id", "line_no").collect()
        assert [(r.doc_id, r.line_no, r.top, r.text) for r in got] == want
