"""Changes between two versions: one pass a document gives what blocks of lines give; directions are told as the matcher tells them."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import normal
from palimpsest.operators import changes, fragments, pair_chain, pairing


def _versions(rng):
    words = ["alpha", "beta", "Γάμμα", "delta。", "1.2.3", "漢字", "12.5", "ﬁne", "End;", "​zero", "\t"]
    line = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 9)))
    for doc in range(40):
        old = [rng.choice([line(), line(), "", " ", "\t", "x", "same line again and again"]) for _ in range(rng.randrange(0, 25))]
        new = [rng.choice([t, t, t.upper(), t + " 30 GB", line(), t.replace(" ", "")]) for t in old if rng.random() < 0.8] + [line()]
        rng.shuffle(new) if doc % 5 == 0 else None
        yield doc, "\n".join(old), "\n".join(new)


@pytest.mark.parametrize("seed", [1, 2])
def test_one_pass_gives_what_blocks_give(spark, monkeypatch, seed):
    rows = list(_versions(random.Random(seed)))
    old = spark.createDataFrame([(d, a) for d, a, _ in rows if d != 7] + [(None, "of nobody\nand more"), (90, None)], "doc_id long, text string")
    new = spark.createDataFrame([(d, b) for d, _, b in rows if d != 8] + [(None, "of nobody"), (90, "came later")], "doc_id long, text string")
    want = sorted(map(str, changes._changes_by_blocks(old, new, changes.REWRITTEN).collect()))
    made = []
    kept = changes.written
    monkeypatch.setattr(changes, "written", lambda df, name: made.append(name) or kept(df, name))
    assert sorted(map(str, changes.line_changes(old, new).collect())) == want and made == ["changes"] and len(want) > 250
    # documents of many lines go by blocks, the others don't
    monkeypatch.setattr(pair_chain, "BLOCK", 12)
    assert len({len(b.split("\n")) > 12 for _, _, b in rows}) == 2
    assert sorted(map(str, changes.line_changes(old, new).collect())) == want and "gone" in made


def test_repeated_rows_of_a_document_go_by_blocks(spark):
    twice = spark.createDataFrame([(1, "a line of it"), (2, "another line"), (2, "a second text")], "doc_id long, text string")
    got = changes.line_changes(twice, spark.createDataFrame([(1, "a line of it"), (2, "new text 77")], "doc_id long, text string"))
    want = changes._changes_by_blocks(twice, spark.createDataFrame([(1, "a line of it"), (2, "new text 77")], "doc_id long, text string"), changes.REWRITTEN)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_keys_and_contents_as_they_were():
    import re
    import unicodedata

    rng = random.Random(3)
    pieces = ["a", " ", "\t", "​", "　", "1.2", "。", "1.2.3、", "; ", "；4.5.", "ﬁ", "É", "\x85", "Sentence one two three", "."]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(0, 12))) for _ in range(3000)]
    for t in texts:
        bare = t.translate(dict.fromkeys(map(ord, " \t\n\v\f\r"))) if t.isascii() else normal._GONE.sub("", unicodedata.normalize("NFKC", t))
        assert normal._bare(t) == bare and normal._numberless(t) == normal._ITEM.sub(r"\1", bare)

    def plain(outer, inner):
        ends = lambda c: re.match(f"[{normal.BOUNDARIES}]", c)
        return {
            (i, j)
            for i, t in enumerate(outer)
            for j, s in enumerate(inner)
            if pairing.SHORTEST <= len(s) < len(t)
            and any(t.startswith(s, k) and (k == 0 or ends(t[k - 1])) and (k + len(s) == len(t) or ends(s[-1]) or ends(t[k + len(s)])) for k in range(len(t) - len(s) + 1))
        }

    some = [normal._numberless(t) for t in texts[:250]] + ["Sentenceonetwothree", "a。Sentenceonetwothree", "aSentenceonetwothree", "Sentenceonetwothree。b"]
    assert pairing._holding(some, some) == plain(some, some) and len(plain(some, some)) > 5


def test_directions_are_those_of_the_matcher_and_the_matcher_is_asked_seldom(spark, monkeypatch):
    rng = random.Random(4)
    sentence = lambda: "".join(rng.choices("abcdef", k=rng.randrange(2, 20))) + rng.choice([".", "。", "", ";"])
    pairs = [(None, "A whole sentence."), ("", "shrt."), ("A whole sentence.", ""), ("ab", "ab 12345678"), ("x" * 30_000, "y" * 40_000)]
    for _ in range(400):
        parts = [sentence() for _ in range(rng.randrange(1, 6))]
        fewer = [p for p in parts if rng.random() < 0.6]
        pairs += [("".join(parts), "".join(fewer)), ("".join(fewer), "".join(parts)), ("".join(parts), "".join(fewer) + rng.choice("xyz"))]

    def plain(a, b):
        a, b = a or "", b or ""
        steps = [s for s in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if s[0] != "equal"]
        tags = {s[0] for s in steps}
        if len(tags) != 1 or "replace" in tags:
            return None
        text = "".join(a[i:j] + b[k:m] for _, i, j, k, m in steps).strip()
        found = len(text) >= fragments.LEAST_ONE_WAY and any(c in fragments.SENTENCE_END for c in text)
        return ("deleted" if "delete" in tags else "inserted", text) if found else None

    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.w for r in rows.select("i", fragments.one_way(F.col("a"), F.col("b")).alias("w")).collect()}
    want = [plain(a, b) for a, b in pairs]
    assert [(got[i].direction, got[i].text) if got[i].direction else None for i in range(len(pairs))] == want
    assert sum(w is not None for w in want) > 100 and not fragments.may_be_one_way("ab", "ab 12345678") and not fragments.may_be_one_way("x." * 20_000, "y" * 30_000)
