"""Which n-grams count as common steers what the index of near duplicates costs, never what it finds."""

import random

import corpus_pipeline
from palimpsest.llm import jaccard


def test_rows_do_not_depend_on_the_sample(spark, monkeypatch):
    rng, words = random.Random(8), [f"w{i}" for i in range(300)]
    line, texts = " ".join(rng.choices(words, k=12)), []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([6, 14, 40, 150]))
        texts += [" ".join(base), line + " " + " ".join(base), " ".join(base) + " " + line]
        texts += [" ".join(rng.choice(words) if rng.random() < p else w for w in base) for p in (0.005, 0.02)]

    def grams(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    top, sets = list(range(len(texts))), list(map(grams, texts))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and top[i] != top[j]:
                lo, hi = sorted((top[i], top[j]))
                top = [lo if t == hi else t for t in top]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = []
    kept = jaccard.common_grams
    monkeypatch.setattr(jaccard, "common_grams", lambda *a: told.append(kept(*a)) or told[-1])
    for sample, common in ((0, 1 << 16), (20_000, 1 << 16), (20_000, 3)):
        monkeypatch.setattr(jaccard, "SAMPLE", sample)
        monkeypatch.setattr(jaccard, "COMMON", common)
        assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(top)
    assert [len(g) for g, _ in told][0] == 0 and len(told[1][0]) > len(told[2][0]) == 3 and len(set(top)) < len(texts)
