"""Operators against brute force, SQL, other partitionings, and very long texts."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from palimpsest.llm import fingerprints, language_id, mixing, pieces, pii, quality, registry, token_counts, url_reputation  # noqa: E402

DATA = "/root/testdata/sf0.001"


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert plain(registry.QUERIES[name](spark, DATA).toPandas()) == plain(db.execute(registry.ORACLES[name]).fetchdf())


def test_mix_does_not_depend_on_the_scan(spark, tmp_path):
    rows = [(i % 150, f"{'w ' * (i % 7)}{i % 5}", f"s{i % 3}" if i % 11 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [sorted((r.doc_id, r.size, r.copies, r.target) for r in mixing.mix(d).collect()) for d in (docs, docs.orderBy(F.rand(1)).repartition(7), docs.coalesce(1))]
    assert got[0] == got[1] == got[2]


def refill(sizes, weights=(5, 2, 1)):
    """Targets by filling again and again what the cut sources leave."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    cut, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in cut)
        share = {s: 3 * sizes[s] if s in cut else left * w[s] / sum(w[x] for x in names if x not in cut) for s in names}
        more = {s for s in names if s not in cut and share[s] > 3 * sizes[s]}
        if not more:
            return share
        cut |= more


def test_targets_are_those_of_refilling(spark):
    for seed in range(4):
        rng = random.Random(seed)
        sizes = {s: rng.choice([0, 3, 40, 700, 9000]) for s in ["a", "b", "c", "d", "e", None]}
        sizes["f"] = 50
        table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(table).collect()}
        assert got == pytest.approx(refill(sizes))


def test_likeness_is_that_of_paragraph_sets(spark):
    rng = random.Random(6)
    rows = [(i, None if i == 5 else "\n".join(f"line number {rng.randrange(60)}" for _ in range(rng.choice([0, 1, 3, 30, 200])))) for i in range(40)]
    rows += [(50, "\n".join(f"line number {i}" for i in range(4000))), (51, "\n".join(f"line number {i}" for i in range(0, 8000, 2)))]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rows.sort(key=lambda r: -r[0])
    lines = lambda t: set(re.findall("[^\n]+", t))
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after = t or "", after or ""
        k = len(t) // 2
        # all lines are shorter than what is cut further; edges of the edit may make parts of lines
        assert got[i].near_next == pytest.approx(alike(lines(t), lines(after))), i
        assert got[i].near_edited == pytest.approx(alike(lines(t), {x.strip() for x in lines(t[: len(t) - k] + after[:k])} - {""})), i
    same = {}
    for i, t in rows:
        assert same.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint


def test_determinant_is_the_least_of_all_subsets(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=(9, 5)) * [0.5, 0.1, 0.1, 0.4, 0.3], rng.normal(size=(3, 5)) * 0.1 + [6, -4, 5, 3, -5]]
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, " + ", ".join(f"{c} double" for c in quality._X))
    got = quality.robust_estimates(rows).first()
    best = min(
        np.linalg.det(quality._CONSISTENT * np.cov(x[list(s)].T, bias=True) + np.diag(np.square(quality.FLOOR)))
        for s in itertools.combinations(range(12), 9)
    )
    assert got.n == 9 and got.det == pytest.approx(best)


def test_small_sources_lean_on_their_language(spark):
    words = [f"w{i}" for i in range(4000)]
    rng = random.Random(1)
    text = lambda: " ".join(rng.sample(words, 80))
    rows = [(i, text(), "en", "big") for i in range(300)] + [(300, text(), "en", "one"), (301, text() + " #$%" * 60, "en", "two"), (302, "", "en", "one"), (303, None, None, None)]
    stats = quality.text_statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ("doc_id", "lang", "source"))
    got = {r.doc_id: r.kept for r in quality.robust_verdicts(stats).collect()}
    assert got[300] and not got[301] and not got[302] and not got[303] and sum(got.values()) >= 299


def test_posterior_bound(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 4}.d{i % 2}.com/p") for i in range(40)] + [(99, "http://new.co.uk/"), (98, "http://u@x.co.uk:80/")], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i % 4 == 3)) for i in range(40)] + [(98, None), (None, 1)], "page_id long, bad int")
    got = {r.page_id: r for r in url_reputation.judge_urls(pages, outcomes, []).collect()}
    assert all(got[i].verdict == ("block" if i % 4 == 3 else "allow") and got[i].rule is None for i in range(40))
    assert got[3].bad_rate > 0.7 > got[1].bad_rate and got[99].bound < got[99].bad_rate
    d, s = url_reputation.domain_and_suffix(F.col("h"))
    hosts = ["a.b.co.uk", "co.uk", "x.com", "com", "", "u@p.q.de:8080", "10.0.0.1", "a.org."]
    found = [tuple(r) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(d, s).collect()]
    assert found == [("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("x.com", "com"), ("com", "com"), ("", ""), ("q.de", "de"), ("10.0.0.1", ""), ("a.org", "org")]


def test_rules_of_any_number(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/x/y"), (2, "http://zz.q9.net/"), (3, "http://c/x")], "page_id long, url string")
    rules = [("c", "/x", "allow"), ("b.c", "/x/y", "block"), *((f"q{i}.net", "/", "block") for i in range(3000))]
    got = {r.page_id: (r.rule, r.verdict) for r in url_reputation.judge_urls(pages, spark.createDataFrame([], "page_id long, bad int"), rules).collect()}
    assert got == {1: ("b.c/x/y", "block"), 2: ("q9.net/", "block"), 3: ("c/x", "allow")}


def test_pseudonyms_can_be_undone_and_stay_linked():
    assert len({pii._mixed(f"{a}{b}", b"k", "t") for a in "abcdefghij" for b in "0123456789"}) == 100
    value = "aB3" * 100
    one, two = (pii.pseudonymise(f"{p} token={value} end")[0] for p in ("x", "other"))
    assert one.split("token=")[1] == two.split("token=")[1] != f"{value} end" and len(one) == len(f"x token={value} end")
    assert pii.pseudonymise("mail Bob@Ex.org")[0].split()[1] == pii.pseudonymise("to bob@ex.org;")[0].split()[1][:-1]
    years = {pii._day(y, 1, 1, b"k") for y in range(1, 9999, 13)}
    assert len(years) == len(range(1, 9999, 13))
    assert all((1800 <= pii._day(y, 6, 1, b"k").year < 2200) == (1800 <= y < 2200) for y in range(1700, 2300, 7))


def test_languages_have_no_bound(spark):
    letters = [chr(c) for c in range(0x3B1, 0x3C9)] + [chr(c) for c in range(0x430, 0x450)] + [chr(c) for c in range(0x561, 0x587)]
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices(letters[i % 70 : i % 70 + 3], k=60)), f"x{i % 70}") for i in range(70 * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.classify(docs, language_id.train(docs), ("doc_id", "lang")).where("lang = lang_pred").count()
    assert got > 400


def test_long_texts():
    one = "abc def " * 400_000 + "\n" + " ".join(f"w{i}" for i in range(300_000))
    got = quality.statistics([one, "x"])
    assert got["n_words"].tolist() == [1_100_000, 1] and got["n_dup_lines"].tolist() == [0, 0]
    assert pii.pseudonymise("a" * 5_000_000 + " @ x@y.org")[1] == {"email": 1}
    machine = token_counts.transducer(public_tokenizers.path("byte_bpe_50k.json"))
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = len(tok.encode(one, add_special_tokens=False).ids)
    assert machine.count_all([one]).tolist() == [want]
    ids, n = pieces.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 1 << 10).ids([one])
    assert n.tolist() == [want] and len(ids) == want
    assert np.allclose(language_id.features([one[:1000]]), language_id.features([one[:1000], "other"])[:1])


def test_pipeline_stages_and_whole(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, DATA)
        rows[name] = docs = docs.cache()
        if name != "sequence_packing":
            assert docs.columns == before.columns
        if name == "quality_rules":
            kept = {r.doc_id for r in docs.collect()}
            stats = quality.op10_robust_quality(spark, DATA)
            assert kept == {r.doc_id for r in stats.where("kept").collect()}
        if name == "personal_data":
            old = {r.doc_id: r.text for r in before.collect()}
            assert all(r.text == pii.pseudonymise(old[r.doc_id])[0] and r.n_chars == len(r.text) for r in docs.collect())
        if name == "source_mixture":
            copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
            taken = {r.doc_id: r.n for r in docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
            assert taken == {i: n for i, n in copies.items() if n}
    tokens = rows["sequence_packing"].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert tokens.where("n <> end or n > 2048").count() == 0
    assert {r.doc_id for r in rows["sequence_packing"].select("doc_id").collect()} == {r.doc_id for r in rows["source_mixture"].select("doc_id").collect()}
    want = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows["sequence_packing"].collect())
    got = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == want


def test_second_sketches_count_what_differs_or_say_that_they_are_stuck(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(30):
        a, b, c = ({rng.randrange(1 << 62) for _ in range(rng.choice([0, 1, 20, 150]))} for _ in range(3))
        b |= set(list(a)[::2])
        wide = 1 if i == 29 else 1 << 16
        if i == 29:
            a, b = {1, 2, 3, 4}, {5, 6, 7}
        rows += [(i, list(a), wide, 1 << 16), (i, list(b), wide, None), (i, list(c), None, 1 << 16)]
        want[i] = (None if i == 29 else len(a ^ b), len(a ^ c))
    moved = spark.createDataFrame(rows, "id long, digests array<long>, w0 long, w1 long").repartition(3, "id")
    got = {r.id: (r.d0, r.d1) for r in fingerprints._second(moved).collect()}
    for i, (d0, d1) in want.items():
        # pairs without a difference have no cells
        assert got.get(i, (0, 0)) == (d0, d1), i
