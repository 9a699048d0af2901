"""Rules and conditions that follow the survey's sentences, case by case; anchors against the plain walk."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import anchors, continued, layout, rules


def told(spark, rows, schema, column):
    return [r.x for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def test_one_sided_prohibition(spark):
    cases = [
        ("禁止外接设备", "说明外接设备", True),
        ("禁止外接设备", "可以外接设备", False),
        ("采用固定地址，禁止外接", "配置为固定地址，可以外接", True),
        ("采用固定地址，禁止外接", "配置为其他地址，可以外接", False),
        ("自动获取，禁止填写", "自动获取，可以填写", True),
        ("禁止外接", "不得外接", False),
        ("外接", "外接", False),
    ]
    got = rules._missing_requirement(F.col("a"), F.col("b"))
    assert told(spark, [c[:2] for c in cases], "a string, b string", got) == [c[2] for c in cases]
    assert told(spark, [c[1::-1] for c in cases], "a string, b string", got) == [c[2] for c in cases]


def test_swapped_levels(spark):
    cases = [("管理手册", "工作手册", True), ("总经理签发的文件", "分管领导签发的文件", True), ("管理手册的内容", "总经理的内容", False), ("部门", "手册", True), ("其他内容改了", "完全不同的话", False), ("管理手册的内容", "管理的内容很多", False)]
    f = F.struct(F.col("a").alias("old"), F.col("b").alias("new"))
    for flip in (1, -1):
        rows = [c[:2][::flip] for c in cases]
        assert told(spark, rows, "a string, b string", F.transform(F.array(f), rules._level_swap)[0]) == [c[2] for c in cases]


def test_hints_of_tables_without_lines(spark):
    cases = [("序\n号 名称", True), ("序号 其他", False), ("名称 描述\na   b   c", True), ("名称 描述\na b c\nd e f", True), ("名称 描述\na b c", False), ("名称\na   b   c", False), ("名称 描述\n" + "x " * 50 + "\n" + "y " * 50, False), ("", False)]
    assert told(spark, [(c[0],) for c in cases], "t string", layout.borderless_hint(F.col("t"))) == [c[1] for c in cases]


def test_tables_that_go_on():
    table = {"page_end": 1, "rows": [["a", "b", "c"]], "chapter": "1", "title": "T", "bottom": 0.5}
    part = {"page": 2, "rows": [["x", "y", "z"]], "chapter": "", "title": "", "top": 0.5}
    yes = lambda t=None, p=None: continued.continues({**table, **(t or {})}, {**part, **(p or {})})
    assert not yes()
    assert yes(p={"chapter": "1"}) and yes(p={"chapter": "1", "title": "T"}) and not yes(p={"chapter": "1", "title": "U"})
    assert yes(p={"rows": [["a", "b", "c"]]}) and yes(t={"rows": [["a", "b", "c", "", ""]]}, p={"rows": [["a", "b", "c", ""]]}) and not yes(p={"chapter": "1", "rows": [["x", "y"]]})
    assert yes(p={"rows": [["", "", "z"]]}) and not yes(p={"rows": [["", "", ""]]})
    assert yes(t={"bottom": 0.9}, p={"top": 0.1}) and not yes(t={"bottom": 0.9}) and not yes(t={"bottom": None}, p={"top": 0.1})
    assert not yes(p={"page": 3, "chapter": "1"}) and not yes(p={"rows": []}) and not yes(t={"rows": []})


def plain_anchor(pages, paragraphs):
    norm = lambda t: "".join(unicodedata.normalize("NFKC", t or "").split())
    stream, bounds = "", {}
    for page, text in sorted(pages):
        bounds[page] = (len(stream), len(stream) + len(norm(text)))
        stream += norm(text)
    cursor, out = 0, []
    for no, page, end, text in sorted(paragraphs, key=lambda p: p[0]):
        target = norm(text)
        first = max(1, page or 1)
        last = max(first, end or first)
        lo, hi = bounds.get(first, (0, len(stream)))[0], bounds.get(last, (0, len(stream)))[1]
        at = stream.find(target, max(cursor, lo), max(lo, hi)) if target else -1
        if at < 0 and target:
            at = stream.find(target, max(cursor, lo))
        if at >= 0:
            out.append((no, at, len(target)))
            cursor = at + len(target)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_anchors_equal_the_plain_walk(spark, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abＡ ①\n") for _ in range(n))
    pages = {d: [(p, text(rng.randrange(60))) for p in range(1, rng.randrange(2, 5))] for d in range(20)}
    paragraphs = {}
    for d, ps in pages.items():
        whole, rows = "".join(t for _, t in ps), []
        for no in range(rng.randrange(8)):
            at = rng.randrange(len(whole) + 1)
            rows.append((no, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice([None, 0, 2, 4]), rng.choice([whole[at : at + rng.randrange(20)], text(5), None])))
        paragraphs[d] = rows
    a = spark.createDataFrame([(d, *r) for d, rs in paragraphs.items() for r in rs], "doc_id long, no int, page int, page_end int, text string")
    b = spark.createDataFrame([(d, *p) for d, ps in pages.items() for p in ps], "doc_id long, page int, text string")
    got = {(r.doc_id, r.no, r["at"], r.length) for r in anchors.anchored(a, b).collect()}
    assert got == {(d, *x) for d in pages for x in plain_anchor(pages[d], paragraphs[d])}


def test_boxes_of_lines():
    box = lambda x, y: {"x0": x, "y0": y, "x1": x + 5, "y1": y + 8}
    assert anchors.merge_boxes([box(10, 0), box(0, 2), box(20, 20), box(5, 3.5), box(30, 21)]) == [[0, 0, 15, 11.5], [20, 20, 35, 29]]
    assert anchors.merge_boxes([]) == []


def test_paragraphs_of_documents(spark):
    from palimpsest.operators import store

    rows = [("a#1", 0, "p1", "x"), ("a#1", 1, "p2", "y"), ("a#2", 0, "p1", "z"), ("a", 0, "p1", "w"), ("b#1#2", 0, "p1", "v"), ("b#12", 0, "p1", "u")]
    lines = spark.createDataFrame(rows, "stored_id string, no int, location string, line string")

    def found(names, most=None):
        wanted = spark.createDataFrame(names, "name string, location string")
        return {(r.name, r.line) for r in store.paragraphs_of(lines, wanted, most).collect()}

    assert found([("a", None), ("b#1", ""), ("b", None), ("c", None), (None, None)]) == {("a", "w"), ("b#1", "v"), ("b", "v"), ("b", "u")}
    assert found([("a#1", "p2"), ("b", None)], 1) == {("a#1", "y"), ("b", "v")}


def test_noise_of_changes(spark):
    from palimpsest.operators import changes

    rows = [("added", "", "1.2 Scope"), ("added", "", "a real sentence that stays"), ("removed", "short", "a real sentence that stays"), ("modified", "short", "a real sentence that stays"), ("modified", None, "x")]
    got = changes.change_noise(spark.createDataFrame(rows, "kind string, old_line string, new_line string")).collect()
    assert [r.noise for r in got] == [True, False, True, False, True]


def test_boxes_of_pages_by_columns(spark):
    """No row for a character: the rectangles of paragraphs over two pages equal those of their characters one by one."""
    import inspect

    import numpy as np

    rng = random.Random(3)
    for _ in range(50):
        boxes = [{"x0": rng.randrange(50), "y0": y, "x1": rng.randrange(50, 60), "y1": y + 8} for y in (rng.choice([0, 2.5, 3, 7, 20, 21.5, 26]) for _ in range(rng.randrange(12)))]
        columns = [np.array([b[c] for b in boxes], np.float64) for c in ("x0", "y0", "x1", "y1")]
        assert anchors._lines(*columns) == anchors.merge_boxes(boxes)
    assert "explode" not in inspect.getsource(anchors.page_rectangles)
    chars = lambda n: [(5.0 * (i % 4), 10.0 * (i // 4), 5.0 * (i % 4) + 5, 10.0 * (i // 4) + 8) for i in range(n)]
    pages = spark.createDataFrame([(1, 1, 0, 10, chars(10)), (1, 2, 10, 16, chars(6)), (2, 1, 0, 3, chars(3))], "doc_id long, page int, start int, end int, chars array<struct<x0:double,y0:double,x1:double,y1:double>>")
    places = spark.createDataFrame([(1, 0, 2, 5), (1, 1, 8, 4), (1, 2, 12, 0), (2, 0, 0, 3)], "doc_id long, no long, at int, length int")
    got = {(r.doc_id, r.no, r.page): r.rects for r in anchors.page_rectangles(places, pages, F.col("chars")).collect()}

    def plain(page, at, length, start):
        return anchors.merge_boxes([dict(zip(("x0", "y0", "x1", "y1"), b, strict=True)) for b in chars(page)[max(0, at - start) : at + length - start]])

    assert got == {(1, 0, 1): plain(10, 2, 5, 0), (1, 1, 1): plain(10, 8, 4, 0), (1, 1, 2): plain(6, 8, 4, 10), (2, 0, 1): plain(3, 0, 3, 0)}


def test_no_row_for_a_window_of_a_page():
    """Windows of a page are hashed beside its text; a target whose first characters aren't there costs no search."""
    stream = "".join(random.Random(1).choices("abc", k=500))
    targets = [{"no": n, "page": 1, "page_end": 0, "target": t} for n, t in enumerate([stream[5:30], "ab", "x" * 8, stream[100:108], stream[200:207] + "x", stream[490:]])]
    probes = set(anchors._probes([stream]).tolist())
    assert set(anchors._probes([stream[3:11], stream[-8:]]).tolist()) <= probes and not set(anchors._probes(["x" * 8]).tolist()) & probes
    assert [f["no"] for f in anchors._walk(stream, {}, targets)] == [0, 1, 3, 5]
    assert anchors._walk("short", {}, targets) == []


def test_segments_move_no_lines(spark):
    from palimpsest.operators import segments

    text = "\n".join(["1.1 Scope", "words " * 9 + "go on", "and end here, after the line before.", "", *["x y z without an end"] * 45, "1.2 Rest", "the last one of them."])
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    out = segments.segments(docs)
    # lines are not shuffled; segments are, to their document's window
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
    rows = [(r.seg_no, r.start, r.stop, r.page, r.page_end, r.chapter) for r in out.orderBy("seg_no").collect()]
    assert rows[0] == (1, 0, 10, 1, 1, "1.1") and rows[1][:2] == (2, 10) and rows[1][3:] == (1, 1, "1.1")
    assert (rows[2][3], rows[-3][4]) == (1, 3) and rows[-2][5] == "1.2" and rows[-1][2] == len(text) + 1
