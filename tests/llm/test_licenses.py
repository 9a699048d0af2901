"""License scans against plain loops over all words, templates and offsets."""

import math
import random
import re
from collections import Counter

from palimpsest.llm import licenses

DATA = "/root/testdata/sf0.001"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    w, at, labels = tokens(text), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), sorted(labels)


def scan(text):
    """Spans by every offset of every template."""
    w, found = tokens(text), []
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    for t, (_, template) in enumerate(licenses.TEMPLATES):
        p = template.split()
        votes = Counter(i - j for j in range(len(p) - 2) for i in places.get(tuple(p[j : j + 3]), ()))
        groups, last = [], None
        for d in sorted(votes):
            if last is None or d - last > licenses.NEAR:
                groups.append([])
            groups[-1].append(d)
            last = d
        for g in groups:
            if sum(votes[d] for d in g) < max(1, math.ceil(licenses.VOTES * (len(p) - 2))):
                continue
            met = {(j, j + d) for d in range(g[0], g[-1] + 1) for j in range(len(p)) if 0 <= j + d < len(w) and w[j + d] == p[j]}
            first, end = min(i for _, i in met), max(i for _, i in met)
            n = len({j for j, _ in met})
            like = n / max(len(p), end - first + 1)
            if like >= licenses.LIKE:
                found.append((first, end - first + 1, n, like, t))
    return [(licenses.TEMPLATES[t][0], t, a, n, x) for a, n, _, x, t in licenses.apart(found)]


def rows(result):
    return Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, tuple(r.base), tuple(tuple(s) for s in r.licenses)) for r in result.collect())


def expected(pairs):
    return Counter((i, *base(t)[:4], tuple(base(t)[4]), tuple(scan(t))) for i, t in pairs)


def changed(words, rng, rate):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < rate / 3 else [w, "extra"] if x < 2 * rate / 3 else ["other"] if x < rate else [w]
    return out


def test_licenses_equal_plain_loops(spark):
    rng = random.Random(4)
    pairs = []
    for i in range(150):
        words = rng.choices("the of and a software license this with under terms".split(), k=rng.randrange(120))
        for _ in range(rng.randrange(3)):
            _, template = rng.choice(licenses.TEMPLATES)
            words += changed(template.split(), rng, rng.choice([0, 0.05, 0.15, 0.3, 0.5])) + rng.choices("an other text".split(), k=rng.randrange(9))
        pairs.append((i, rng.choice([" ", "\n", ", "]).join(words).title()))
    pairs += [(None, pairs[3][1]), (None, None), pairs[5], pairs[5], (7, ""), (8, "--- !!"), (9, "MIT\nLicense mit-license. Mit  licensé"), (10, "GNU General\tPublic (License)"), (11, "the the " * 40_000 + "Released under the MIT License. " + "x " * 70_000)]
    docs = spark.createDataFrame([(i, t, 1, "s", "b") for i, t in pairs], "doc_id long, text string, n_words int, h string, base string")
    got = rows(licenses.licenses(docs))
    assert got == expected(pairs)
    assert len({s[0] for r in got for s in r[6]}) > 10
    assert rows(licenses.licenses(docs.repartition(7))) == got
    assert licenses.licenses(docs.limit(0)).count() == 0


def test_large_tables_are_joined_without_broadcast(spark, monkeypatch):
    pairs = [(i % 3, "Released under the MIT License." if i % 2 else "nothing here") for i in range(40)] + [(None, "Licensed under CC BY-SA 4.0")]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    monkeypatch.setattr(licenses, "SMALL", 0)
    assert rows(licenses.licenses(docs)) == expected(pairs)


def test_query(spark):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = {}
    for i, t in pairs:
        n, places, first, last, labels = base(t)
        spans = scan(t)
        score = 1.0 if labels else max((s[4] for s in spans), default=0.0)
        want[i] = (n, places, first, last, ",".join(labels), ",".join(sorted({*labels, *(s[0] for s in spans)})), score)
    got = {r.doc_id: tuple(r[1:]) for r in licenses.op13_license_scan(spark, DATA).collect()}
    assert got == want


def test_statements_are_told_apart():
    cases = {
        "Licensed under CC BY-NC 4.0.": ["cc-by-nc"],
        "Released under the MIT License.": ["mit"],
        "Licensed under the Apache License, Version 2.0.": ["apache"],
        "This work is licensed under the GNU General Public License, version 3.": ["gpl"],
        "Licensed under the GNU Lesser General Public License, version 3": ["lgpl"],
        "We licensed the work to them under the terms of a contract.": [],
    }
    assert {t: sorted({s[0] for s in scan(t)}) for t in cases} == cases
