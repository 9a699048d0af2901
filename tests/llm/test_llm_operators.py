"""Awkward rows for every operator, and brute force or round trips where SQL can't say it."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import tokenizers  # noqa: E402

from palimpsest.llm import fingerprints, jaccard, language_id, mixing, packing, pii, quality, token_counts, token_ids, url_reputation  # noqa: E402

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, part int, size int, _key int, idx string"


def awkward():
    rng = random.Random(5)
    base = " ".join(rng.choices("the of and ther inor ation west blue hat".split(), k=200)) + ".\nNext line. And more."
    texts = [base, base, base + " x", None, "", " \n\t", "a", "One two", "mail bob@example.com or 4111 1111 1111 1111", "<|endoftext|> tail " + base, "É" * 30 + " ça va", "line\n" * 80, "w " * 40_000, "#$% " * 60, base.upper()]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", None, "s2"][i % 3], None if t is None else len(t), "r", 1, 2, 3, "i") for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, "no id here", "en", "s1", 10, "r", 1, 2, 3, "i"), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, none):
    assert packing.pack_documents(none, WORDS, 64).count() == 0
    tok, got = tokenizers.Tokenizer.from_file(WORDS), packing.pack_documents(docs, WORDS, 64).collect()
    want = Counter()
    for r in awkward():
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for i, s in enumerate(range(0, len(ids), 64)):
            part = ids[s : s + 64]
            want[r[0], i, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    short = [r.length for r in got]
    assert len(places) <= 1.15 * -(-sum(short) // 64) + 1


def test_token_counts(docs, none):
    assert token_counts.count_tokens(none, BYTES, 512).count() == 0
    tok = tokenizers.Tokenizer.from_file(BYTES)
    want = Counter((r[0], len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in awkward())
    for chunk in (1 << 16, 50):
        got = token_counts.count_tokens(docs, BYTES, 512, chunk).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want


def test_token_ids_round_trip(spark, docs, none, tmp_path):
    token_ids.write_ids(none, f"file://{tmp_path}/none", BYTES, 2)
    assert token_ids.read_ids(spark, f"file://{tmp_path}/none").count() == 0
    token_ids.write_ids(docs, f"file://{tmp_path}/ids", BYTES, 2)
    got = token_ids.read_ids(spark, f"file://{tmp_path}/ids").orderBy("start").collect()
    tok = tokenizers.Tokenizer.from_file(BYTES)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((r[0], (*tok.encode(r[1] or "", add_special_tokens=False).ids, 2)) for r in awkward())
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_code_lengths():
    counts = np.array([2**i for i in range(40)] + [0, 5])
    lengths = token_ids.code_lengths(counts)
    assert lengths.max() <= 16 and lengths[40] == 0
    assert sum(2.0 ** -int(n) for n in lengths if n) <= 1


def test_jaccard(docs, none):
    from pyspark.sql import functions as F

    named = lambda d: d.withColumn("row", F.monotonically_increasing_id())
    assert jaccard.similar_groups(named(none)).count() == 0
    rows = jaccard._numbered(docs.select("doc_id", "text"))
    got = jaccard.similar_groups(rows).join(rows.select("row", "text"), "row").collect()
    sets = {}
    for r in got:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "").replace("\n", " ").replace("\t", " ").split(" ")
        w = [x for x in w if x]
        sets[r.row] = set(zip(w, w[1:], w[2:])) if len(w) > 2 else ({tuple(w)} if w else set())
        assert r.n_shingles == len(sets[r.row])
    by = {r.row: r.component for r in got}
    for a in sets:
        for b in sets:
            inter = len(sets[a] & sets[b])
            if sets[a] and 100 * inter >= 90 * (len(sets[a]) + len(sets[b]) - inter):
                assert by[a] == by[b]
    assert jaccard.keep_one(docs).count() < docs.count() and jaccard.keep_one(docs).columns == docs.columns


def test_allocation_finds_every_pair():
    rng = np.random.default_rng(3)
    bands = jaccard.Bands(90, 100)
    for size in (*range(1, 60), 300, 1500):
        base = rng.integers(1, 1 << 63, size).astype(np.uint64)
        drop = size // 10
        other = np.unique(base[drop // 2 :])
        other = np.unique(np.r_[other, rng.integers(1, 1 << 63, (drop - drop // 2) // 2).astype(np.uint64)])
        base = np.unique(base)
        inter = len(np.intersect1d(base, other))
        if 100 * inter >= 90 * (len(base) + len(other) - inter):
            assert np.intersect1d(jaccard.signatures(base, len(base), bands), jaccard.signatures(other, len(other), bands)).size


def test_quality(docs, none):
    assert quality.filter_quality(none).count() == 0
    stats = quality.text_statistics(docs, ("doc_id", "lang", "source"))
    got = quality.robust_verdicts(stats).collect()
    assert len(got) == len(awkward())
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.filter_quality(docs).columns == docs.columns


def test_pii(docs, none):
    assert pii.pseudonyms(none).count() == 0
    got = pii.pseudonyms(docs).collect()
    assert len(got) == len(awkward())
    text = next(r.text for r in got if r.doc_id == 8)
    assert "bob@" not in text and "4111 1111" not in text
    card = "".join(c for c in text.split(" or ")[1] if c.isdigit())
    assert card[-1] == pii._luhn(card[:-1])
    for size in (2, 7, 100, 366):
        assert sorted(pii.permute(i, size, b"k", "t") for i in range(size)) == list(range(size))
    one, two = pii.pseudonymise("on 2001-02-03")[0], pii.pseudonymise("am 03.02.2001")[0]
    y, m, d = one[3:].split("-")
    assert two == f"am {d}.{m}.{y}"
    assert pii.pseudonymise("order 1234567890123456, version 1.2.3")[1] == {}


def test_mixing(docs, none):
    assert mixing.emit(none).count() == 0
    got = mixing.mix(docs).collect()
    assert len(got) == len(awkward()) and all(0 <= r.copies <= 3 for r in got)
    targets = {r.source: (r.target, r.source_size) for r in got}
    assert abs(sum(t for t, _ in targets.values()) - sum(s for _, s in targets.values())) < 1e-6
    assert all(t <= 3 * s + 1e-9 for t, s in targets.values())
    assert mixing.emit(docs).columns == docs.columns


def test_language(docs, none):
    assert language_id.classify(docs, language_id.train(none)).where("lang_pred <> 'und'").count() == 0
    got = language_id.classify(docs, language_id.train(docs)).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (3, 4, 5, 13))


def test_held_out_accuracy(spark):
    rows = language_id.op3_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    assert rows.join(truth, "doc_id").where("held_out").selectExpr("avg(int(lang = lang_pred)) a").first().a > 0.95


def test_fingerprints(docs, none):
    assert fingerprints.fingerprints(none).count() == 0
    got = fingerprints.fingerprints(docs).collect()
    rows = sorted(((r[0], r[1] or "") for r in awkward() if r[0] is not None and r[0] != 0), key=lambda r: -r[0])
    want = {}
    for (i, t), (_, nxt) in zip(rows, rows[1:], strict=False):
        k = len(t) // 2
        want[i] = hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
    assert len(got) == len(awkward())
    assert all(r.edited_sha256 == want[r.doc_id] for r in got if r.doc_id in want)
    assert len({r.fingerprint for r in got if r.doc_id == 0}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_urls(spark):
    urls = ["http://A.example.org/es/x?y", "https://b.org/en", "no scheme", None, "http://c.com/de/1#f", "http://bad.net/x", "http://bad.net", "ftp://h?q"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(5, 1)] * 30 + [(6, 1)] * 30 + [(1, 0)] * 60 + [(4, 0)] * 60, "page_id long, bad int")
    got = {r.page_id: r for r in url_reputation.judge_urls(pages, outcomes, url_reputation.RULES).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1].rule == "org/" and got[4].verdict == "block"
    assert got[5].verdict == "block" and got[5].rule is None
    assert (got[2].host, got[2].path, got[3].host, got[7].host, got[7].path) == ("", "", "", "h", "")
    assert url_reputation.judge_urls(pages.limit(0), outcomes, url_reputation.RULES).count() == 0


def test_pipeline_near_duplicates(spark):
    import corpus_pipeline

    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for i in range(40):
        base = rng.choices(words, k=rng.choice([3, 8, 30, 100, 250]))
        texts.append(base)
        texts.append(base + rng.choices(words, k=len(base) // 5))
        for part in (0.01, 0.03, 0.06):
            texts.append([rng.choice(words) if rng.random() < part else w for w in base])
    base = rng.choices(words, k=100)
    texts += [base, base + rng.choices(words, k=20)]  # 96 of 116 five-word shingles, 98 of 118 of three words
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} or {tuple(t)} for t in texts]
    up = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            inter = len(a & sets[j])
            if 100 * inter >= 80 * (len(a) + len(sets[j]) - inter):
                low, high = sorted((up[i], up[j]))
                up = [low if x == high else x for x in up]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == set(up) and len(texts) - 1 not in got
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_half_shared_texts_share_paragraphs(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(500)]
    cjk, cyrillic = (["".join(map(chr, rng.choices(range(lo, hi), k=8))) for _ in range(500)] for lo, hi in ((0x4E00, 0x9000), (0x430, 0x450)))
    make = {
        "lower": lambda: " ".join(rng.choices(words, k=7)) + ". ",
        "late initial": lambda: "The " + " ".join(rng.choices(words, k=7)) + ". ",
        "chinese": lambda: "".join(rng.choices(cjk, k=2)) + "\u3002",
        "cyrillic": lambda: " ".join(rng.choices(cyrillic, k=7)) + "! ",
        "no sentence": lambda: " ".join(rng.choices(words, k=20)) + " ",
        "chinese, no sentence": lambda: "".join(rng.choices(cjk, k=20)),
        "one character": lambda: "x" * 300,
    }
    rows = []
    for name, one in make.items():
        head = "".join(one() for _ in range(10))
        rows.append((name, head + "".join(one() for _ in range(10)), head + "other" + "".join(one() for _ in range(10))))
    docs = spark.createDataFrame(rows, "name string, a string, b string")
    p = {c: fingerprints.paragraphs(F.col(c)) for c in "ab"}
    got = docs.select("name", F.size(F.array_intersect(p["a"], p["b"])).alias("n")).collect()
    assert all(r.n > 0 for r in got) and len(got) == len(make), got


def test_more_pieces_than_the_table_holds():
    from palimpsest.llm.pieces import Encoder

    texts = ["a b", " ".join(f"w{i} {i}" for i in range(400)), "a b c", "", " ".join(f"x{i}" for i in range(20))]
    for path in (BYTES, WORDS):
        tok, small = tokenizers.Tokenizer.from_file(path), Encoder(path, 16)
        for text in (texts, texts[1:2], texts):
            ids, counts = small.ids(text)
            want = [tok.encode(t, add_special_tokens=False).ids for t in text]
            assert ids.tolist() == [i for t in want for i in t] and counts.tolist() == list(map(len, want))
