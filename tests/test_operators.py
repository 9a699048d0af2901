"""Operators whose rows SQL can't give, against brute force on small fixtures."""

import random

from pyspark.sql import functions as F

from palimpsest.functions import chapters, text
from palimpsest.operators import answers, changes, fragments, matching, overlap, ranks, retrieval, rules, segments, store
from palimpsest.plans import catalogue, review
from palimpsest.sources import html
from palimpsest.streaming import progress

DATA = "/root/testdata/sf0.001"


def test_greedy_match(spark):
    pick = random.Random(5)
    edges = {(a, b): pick.choice([0.2, 0.5, 0.9]) for a in range(12) for b in range(9) if pick.random() < 0.5}
    used_a, used_b, want = set(), set(), set()
    for s, a, b in sorted(((s, a, b) for (a, b), s in edges.items() if s >= 0.4), reverse=True):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), want.add((a, b, s))
    rows = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "a long, b long, score double")
    assert {tuple(r) for r in matching.greedy_match(rows, 0.4).collect()} == want
    assert matching.greedy_match(rows.limit(0), 0.4).count() == 0


def test_rank_within_a_hot_key(spark):
    keys = ["hot"] * 500 + ["a", "b", "b", "z"] * 5
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, i long")
    got = ranks.rank_within(rows, "key", ["i"]).collect()
    seen, want = {}, set()
    for i, k in enumerate(keys):
        seen[k] = seen.get(k, 0) + 1
        want.add((k, i, seen[k]))
    assert {(r.key, r.i, r.k) for r in got} == want


def test_search_in_blocks(spark, monkeypatch):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    asked = rows.where("vec_id % 20 = 0")
    whole = {tuple(r) for r in retrieval.top_k(rows, asked, 3).select("query_id", "vec_id", "rank").collect()}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert {tuple(r) for r in retrieval.top_k(rows, asked, 3).select("query_id", "vec_id", "rank").collect()} == whole


def test_rules(spark):
    pairs = [
        ("1.2 总则", "3 总则", "structural"),
        ("所有员工不得外传", "全体员工不得外传", "wording"),
        ("企业邮箱每年检查", "VPN每年检查", "scope"),
        ("版次 手册编号 打印", "x", "metadata"),
        ("有效页 状态符号", "x", "structural"),
        ("plain", "text", None),
        (None, "text", None),
        ("see 1.2 for more words", "see 1.3 for more words", "numbering"),
        ("a 5 b 6 c text that stays", "a 7 b 8 c text that stays", "numbering"),
        ("批准 2023-01-02", "批准 2024-01-02", "metadata"),
        ("禁止外传", "外传要登记", "scope"),
        ("负责培训", "负责保管", "scope"),
        ("本规定定义了系统范围", "本规定定义了系统范围以及别的", "scope"),
        ("1.2xx 目录", "正文", "structural"),
        ("《甲》、《乙》", "《丙》", "reference"),
        ("hello, world", "hello world", "wording"),
        ("由分管领导签字", "由总经理签字", "wording"),
    ]
    rows = spark.createDataFrame(pairs, "a string, b string, want string")
    for r in rules.classified(rows, "a", "b").collect():
        assert r.category == r.want, r


def test_change_buckets(spark):
    cases = [
        ("modified", "限30分钟", "限15分钟", "keep"),
        ("modified", "a b", "ab", "noise"),
        ("modified", "one two three", "one two", "noise"),
        ("modified", "old R3-21", "old R4-22", "noise"),
        ("modified", "red", "blue", "open"),
        ("added", None, "修订记录表 1", "noise"),
        ("added", None, "R3-21", "noise"),
        ("removed", "text", None, "keep"),
    ]
    rows = spark.createDataFrame(cases, "kind string, old_line string, new_line string, want string")
    for r in changes.substantive(rows).collect():
        assert r.bucket == r.want, r


def test_text_functions(spark):
    rows = spark.createDataFrame([("限 30分钟，75 % 版次：R3",), ("a",), (None,)], "t string")
    got = rows.select(text.quantities(F.col("t")).alias("q"), F.size(text.bigrams(F.col("t"))).alias("n"), text.citations(F.lit("见［ 3 ］")).alias("c")).collect()
    assert got[0].q == ["30分钟", "75%"] and got[1].q == [] and got[2].q == [] and got[1].n == 0
    assert got[0].c == "见[3]"


def test_pages(spark):
    page = "<html><title> A\nb </title><script>if (a<b) x</script><table><TR><th>n</th><td>1 &amp; 2</td></tr><tr></tr></table></html>"
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in html.title_text(pages).orderBy("page_id").collect()] == [(1, "A b", "n 1 & 2"), (2, None, None)]
    assert [tuple(r) for r in html.table_rows(pages).orderBy("row_no").collect()] == [(1, 0, ["n", "1 & 2"]), (1, 1, [])]


def test_stream_gives_the_closed_windows(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {tuple(r) for r in catalogue.QUERIES["progress_stream_windows"](spark, DATA).collect()}
    late = events.agg(F.max("ts") - F.expr("interval 2 hours")).first()[0]
    want = {tuple(r) for r in progress.windowed(events).where(F.col("window_start") + F.expr("interval 60 minutes") <= F.lit(late)).collect()}
    assert want and got == want


def test_store(spark):
    docs = spark.createDataFrame([(1, "f", "x"), (2, "f", "y"), (3, None, "z"), (4, None, None)], "doc_id long, fam string, text string")
    now = store.latest_active(docs, "fam")
    assert {r.doc_id for r in now.where("status = 'active'").collect()} == {2, 4}
    back = store.promote(now, spark.createDataFrame([(1,)], "doc_id long"), "fam")
    assert {r.doc_id for r in back.where("status = 'active'").collect()} == {1, 4}
    assert store.remove(docs, docs.where("doc_id < 3")).count() == 2
    assert store.append(docs, docs.drop("text")).count() == 8


def test_chapters(spark):
    cases = [
        ("1.2.3 Scope of work", ("1.2.3", "Scope of work")),
        (" 3 总则 ", ("3", "总则")),
        ("第六章 信息安全管理", ("六", "信息安全管理")),
        ("（一）运行风险． 7-8 月有雨", ("一", "运行风险")),
        ("2026 year of plans", None),
        ("6 月份，管理局", None),
        ("1.1 负责信息系统建设和维护工作的部门", None),
        ("1.1 设备；", None),
        ("1.1 a、b、c、d", None),
        ("1.1 2025-12-03 R", None),
        ("4 x", None),
        ("3 a title of more than fifteen", None),
        ("plain", None),
        ("", None),
        (None, None),
    ]
    rows = spark.createDataFrame([(t, w and list(w)) for t, w in cases], "t string, want array<string>")
    for r in rows.withColumn("got", chapters.chapter(F.col("t"))).collect():
        assert (r.got and [r.got.chapter, r.got.title]) == r.want, r
    got = rows.select(chapters.unfinished(F.lit("he said")).alias("a"), chapters.unfinished(F.lit("done.”")).alias("b"), chapters.unfinished(F.lit("as:")).alias("c"), chapters.starts_block(F.lit("2. x")).alias("d")).first()
    assert tuple(got) == (True, False, False, True)


def test_segments(spark):
    text = "1 Start\n这是第一\n段话\n\nR12\nshort.\n" + "word " * 9 + "end.\nafter the end of it\nall is well here. 2.1 Next part\n尾"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = segments.segments(docs).orderBy("doc_id", "seg_no").collect()
    assert [(r.doc_id, r.seg_no, r.chapter) for r in got] == [(1, 1, "1"), (1, 2, "1"), (1, 3, "1"), (1, 4, "2.1")]
    assert [r.text for r in got] == ["1 Start", "short. " + "word " * 9 + "end.", "after the end of it all is well here.", "2.1 Next part"]
    assert text[got[1].start : got[1].stop].strip() == "short.\n" + "word " * 9 + "end."
    assert (got[2].start, got[2].stop) == (text.index("after"), text.index("尾")) and got[3].start == text.index("all is")


def test_merge_over_pages(spark):
    rows = [
        (1, 1, "it goes on", 1, 1, "", ""),
        (1, 2, "over the page", 2, 2, "", ""),
        (1, 3, "and again.", 3, 3, "2", "b"),
        (1, 4, "new", 4, 4, "2", "b"),
        (1, 5, "3 Title", 5, 5, "3", "Title"),
        (1, 6, "中文", 6, 6, "3", "Title"),
        (1, 7, "接着", 7, 7, "3", "Title"),
        (1, 8, "same page", 7, 7, "3", "Title"),
        (1, 9, "same page", 7, 7, "3", "Title"),
    ]
    segs = spark.createDataFrame(rows, "doc_id long, seg_no int, text string, page int, page_end int, chapter string, title string")
    got = [tuple(r)[1:] for r in segments.merge_pages(segs).orderBy("paragraph_no").collect()]
    assert got == [
        (1, "it goes on over the page and again.", 1, 3, "2", 3),
        (2, "new", 4, 4, "2", 1),
        (3, "3 Title", 5, 5, "3", 1),
        (4, "中文接着 same page same page", 6, 7, "3", 4),
    ]
    assert segments.merge_pages(segs.limit(0)).count() == 0


def test_best_partners(spark):
    pick = random.Random(3)
    line = lambda: "".join(pick.choice("abc") for _ in range(pick.randint(6, 14)))
    old, new = [line() for _ in range(40)] + ["aaaaaa"] * 3, [line() for _ in range(40)] + ["aaaaaa"]
    pairs = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    like = lambda a, b: len(pairs(a) & pairs(b)) / len(pairs(a) | pairs(b))
    frame = lambda x: spark.createDataFrame([(1, "\n".join(x)), (2, None)], "doc_id long, text string")
    got = {r.line: r for r in overlap.best_partners(frame(old), frame(new), 0.6).collect()}
    assert set(got) == set(old) and got["aaaaaa"].n == 3
    for a in set(old):
        best = max(like(a, b) for b in new)
        assert abs(got[a].likeness - (best if best >= 0.6 else 0)) < 1e-9
        assert best < 0.6 or got[a].new_line == next(b for b in new if like(a, b) == best)


def test_fragments(spark):
    pairs = [
        ("keep 30天 now", "keep 60天 now", [("replace", "numeric_value")], "numbers: 60"),
        ("see 1.2", "see 1.2 2024年1月", [("insert", "date")], None),
        ("R3-1 stays", "R3-2 stays", [("replace", "version")], None),
        ("same", "same", [], "none"),
        (None, "x", [("insert", "text_content")], None),
    ]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(pairs)], "i int, a string, b string")
    rows = rows.withColumn("f", fragments.token_diff(F.col("a"), F.col("b")))
    rows = rows.withColumn("told", fragments.description(F.col("f"), F.col("a"), F.col("b"))).withColumn("f", fragments.annotated(F.col("f"), F.col("a"), F.col("b")))
    for r in rows.collect():
        assert [(x.tag, x.kind) for x in r.f] == pairs[r.i][2] and pairs[r.i][3] in (None, r.told), r
    way = rows.select(fragments.one_way(F.lit("One. "), F.lit("One. Two is more. ")).alias("w"), fragments.one_way(F.lit("abc"), F.lit("abd")).alias("v")).first()
    assert way.w.direction == "inserted" and way.w.text == "Two is more." and way.v.direction is None


def test_keep_first(spark):
    pick = random.Random(8)
    edges = [(pick.randrange(40), pick.randrange(40)) for _ in range(60)]
    kept = []
    for i in range(40):
        if not any((i, k) in edges or (k, i) in edges for k in kept):
            kept.append(i)
    items = spark.range(40)
    assert sorted(r.id for r in answers.keep_first(items, spark.createDataFrame(edges, "a long, b long")).collect()) == kept


def test_validated(spark):
    items = spark.createDataFrame([(1,), (1,), (2,), (3,), (3,)], "batch long")
    told = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 2, True), (3, 1, True), (3, 1, True), (9, 1, True)], "batch long, index long, inconsistent boolean")
    got = {r.batch: (r.n_answers, r.valid) for r in answers.validated(items, told).collect()}
    assert got == {1: (2, True), 2: (1, False), 3: (2, False)}
    assert not any(r.valid for r in answers.validated(items, told.limit(0)).collect())


def test_review_queries_run(spark):
    for name in ("segment_stream", "cross_page_merge", "token_diff", "dedup_findings", "quantity_changes"):
        assert review.QUERIES[name](spark, DATA).count() > 0, name


def test_exact_pairs_of_lines_with_many_copies(spark, monkeypatch):
    from palimpsest.operators import paragraphs

    rng, want = random.Random(2), set()
    sides = [[(d, "\n".join(rng.choice(["a", "a", "a", "b", f"c{rng.randrange(9)}", " "]) for _ in range(12))) for d in range(20)] for _ in range(2)]
    places = [{}, {}]
    for side, docs in enumerate(sides):
        for d, text in docs:
            for i, line in enumerate(text.split("\n")):
                if line.strip():
                    places[side].setdefault(line, []).append((d, i))
    for line in places[0]:
        want |= {(line, *a, *b) for a, b in zip(places[0][line], places[1].get(line, []))}
    old, new = (spark.createDataFrame(docs, "doc_id long, text string") for docs in sides)
    for most in (20_000, 60):
        monkeypatch.setattr(paragraphs, "COPIES", most)
        pairs = paragraphs.exact_pairs(old, new)
        if most > 60:  # a line's copies meet without a join
            assert "Join" not in pairs._jdf.queryExecution().sparkPlan().toString()
        assert sorted(map(tuple, pairs.collect())) == sorted(want)
