"""Canonical text, pairing by content and tables over pages, on small cases with known results."""

import random
import unicodedata

from pyspark.sql import functions as F

from palimpsest.functions.normal import BOUNDARIES, canonical, content_key, has_sentences
from palimpsest.operators import continued, pairing


def test_forms(spark):
    rows = ["ａｂ\u3000ｃ\u200bd", "soft\u00adhyphen", " x \u2003 y ", None, "plain", "①Ａ"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", canonical(F.col("t")).alias("c"), content_key(F.col("t")).alias("k")).orderBy("i").collect()
    assert [r.c for r in got] == ["ab cd", "softhyphen", "x y", "", "plain", "1A"]
    assert [r.k for r in got][4:] == ["plain", "1a"]
    one = spark.createDataFrame([("3.2.1、备份。3.2.2 保存",)], "t string")
    assert one.select(content_key(F.col("t"), False)).first()[0] == "备份。保存"


def whole(longer, shorter):
    if not shorter or len(shorter) >= len(longer):
        return False
    for i in range(len(longer) - len(shorter) + 1):
        e = i + len(shorter)
        if longer[i:e] == shorter and (i == 0 or longer[i - 1] in BOUNDARIES) and (e == len(longer) or longer[e - 1] in BOUNDARIES or longer[e] in BOUNDARIES):
            return True
    return False


def test_whole_sentences(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choices("ab。；", k=rng.randrange(0, 12))), "".join(rng.choices("ab。；", k=rng.randrange(0, 4)))) for _ in range(400)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", has_sentences(F.col("a"), F.col("b")).alias("w")).collect()
    assert all(r.w == whole(r.a, r.b) for r in got) and any(r.w for r in got)


def serial(old, new):
    """Old paragraphs take the best free new one in turn."""
    key = lambda t: "".join(unicodedata.normalize("NFKC", t).split()).lower()
    used, out = set(), []
    for chapter, a, text in old:
        best = None
        for other, b, t in new:
            if other != chapter or b in used or min(len(key(text)), len(key(t))) < pairing.SHORTEST:
                continue
            x, y = key(text), key(t)
            relation = 2 if x == y else 1 if whole(x, y) or whole(y, x) else 0
            if relation:
                best = max(best or (0,), (relation, -abs(a - b), -b, b))
        if best:
            used.add(best[3])
            out.append((chapter, a, best[3], 1.0 if best[0] == 2 else 0.95))
    return sorted(out)


def test_pairs_are_those_of_the_sequential_rule(spark):
    rng = random.Random(4)
    say = ["一二三四五六七八九十百千。", "备份频率为每天一次保存三十天；", "Operators check the log daily.。", "网络设备由信息部门负责管理。"]
    for _ in range(3):
        old = [(rng.choice(["1", "2"]), i, "".join(rng.choices(say, k=rng.choice([1, 1, 2])))) for i in range(14)]
        new = [(rng.choice(["1", "2"]), i, " ".join(rng.choices(say, k=rng.choice([1, 1, 2, 3])))) for i in range(14)]
        table = lambda rows: spark.createDataFrame([(7, *r) for r in rows], "doc_id long, chapter string, no int, text string")
        got = sorted((r.chapter, r.a, r.b, r.score) for r in pairing.same_content(table(old), table(new)).collect())
        assert got == serial(old, new)


def test_chapters_of_several_blocks_pair_by_the_same_rule(spark, monkeypatch):
    monkeypatch.setattr(pairing.blocks, "BLOCK", 4)
    test_pairs_are_those_of_the_sequential_rule(spark)


def test_contents_meet_without_a_row_for_a_window_or_a_round_for_a_copy(spark, monkeypatch):
    made, kept = [], pairing.written
    monkeypatch.setattr(pairing, "written", lambda df, name: made.append(kept(df, name)) or made[-1])
    old = [(1, "1", i, "设备，每月检查一次并且记录结果。" * 40) for i in range(12)]
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, chapter string, no int, text string")
    got = sorted((r.a, r.b, r.score) for r in pairing.same_content(table(old), table(old)).collect())
    assert got == [(i, i, 1.0) for i in range(12)]
    assert sum(t.count() for t in made) <= 12 and len(made) <= 3


PARTS = "doc_id long, page long, pos long, chapter string, top double, bottom double, rows array<array<string>>"


def test_tables_over_pages(spark):
    head = ["序号", "名称", "要求"]
    parts = [
        (1, 1, 0, "3.1", 0.5, 0.9, [head, ["1", "a", "b"]]),
        (1, 2, 0, "", 0.1, 0.5, [head, ["2", "c"]]),  # header again, a short row
        (1, 3, 0, "", 0.1, 0.9, [["", "", "d"], ["3", "e", "f"]]),  # first row with gaps
        (1, 4, 0, "", 0.3, 0.9, [["x", "y", "z"]]),  # nothing ties it
        (1, 5, 0, "9", 0.1, 0.9, [["x2", "y2", "z2", "w"]]),  # other width
        (1, 7, 0, "9", 0.1, 0.9, [["q", "r", "s", "t"]]),  # a page between
        (2, 1, 0, "", 0.1, 0.95, [["k", "l"]]),
        (2, 2, 0, "4", 0.05, 0.4, [["m", "n"]]),  # foot and head of the pages
    ]
    got = {(r.doc_id, r.table_no): (r.page, r.page_end, r.chapter, r.rows) for r in continued.joined(spark.createDataFrame(parts, PARTS)).collect()}
    assert got == {
        (1, 1): (1, 3, "3.1", [head, ["1", "a", "b"], ["2", "c", ""], ["", "", "d"], ["3", "e", "f"]]),
        (1, 2): (4, 4, "", [["x", "y", "z"]]),
        (1, 3): (5, 5, "9", [["x2", "y2", "z2", "w"]]),
        (1, 4): (7, 7, "9", [["q", "r", "s", "t"]]),
        (2, 1): (1, 2, "4", [["k", "l"], ["m", "n"]]),
    }
    assert continued.joined(spark.createDataFrame([], PARTS)).count() == 0


def test_cleaned_tables(spark):
    rows = [[[" a ", None, ""], ["", " ", None], ["b", "", "c", "d"]], [["", None]], []]
    table = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, rows array<array<string>>")
    got = [r.c for r in table.select("i", continued.cleaned(F.col("rows")).alias("c")).orderBy("i").collect()]
    assert got == [[["a", ""], ["b", "c"]], [], []]


def test_content_keys_in_one_pass(spark):
    """Keys are those of the Spark expressions, made in one pass over a text."""
    import random

    from pyspark.sql import functions as F

    from palimpsest.functions import normal

    def plain(text, items):
        bare = F.regexp_replace(F.regexp_replace(normal.nfkc(F.coalesce(text, F.lit(""))), normal.ZERO_WIDTH, ""), normal.SPACES, "")
        return F.lower(bare if items else F.regexp_replace(bare, normal.NUMBERED_ITEM, "$1"))

    rng = random.Random(6)
    texts = ["".join(rng.choices("aB1.2；;。、 \t\n\x0b\x1c\x85  　​Ａ①İΣ٣.１", k=rng.randrange(14))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for items in (True, False):
        made = rows.select(normal.content_key(F.col("t"), items).alias("k"))
        assert "regexp_replace" not in made._jdf.queryExecution().executedPlan().toString()
        assert rows.where(~plain(F.col("t"), items).eqNullSafe(normal.content_key(F.col("t"), items))).count() == 0


def test_tables_over_pages_start_no_group_in_python(spark):
    parts = [(d, p, 0, "", 0.1, 0.9, [["k", "v"], [str(d), str(p)]]) for d in range(30) for p in range(1, 4)]
    out = continued.joined(spark.createDataFrame(parts, PARTS))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # a document is one row in Python, and met again by no join
    assert "FlatMapGroups" not in plan and "Join" not in plan and plan.count("Exchange") <= 2
    assert {(r.doc_id, r.page, r.page_end, len(r.rows)) for r in out.collect()} == {(d, 1, 3, 4) for d in range(30)}
