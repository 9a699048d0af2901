"""Tables of two versions: pairs, aligned columns, rows and cells."""

import random
from difflib import SequenceMatcher

import pytest

from palimpsest.operators import table_compare

HEADS, ROWS = "doc_id long, table_no int, location string, headers array<string>", "doc_id long, table_no int, row_no int, cells array<string>"


def frames(spark, tables):
    """tables: (doc_id, table_no, location, headers or None, rows)."""
    heads = spark.createDataFrame([t[:4] for t in tables], HEADS)
    return heads, spark.createDataFrame([(t[0], t[1], i, r) for t in tables for i, r in enumerate(t[4])], ROWS)


def compare(spark, old, new):
    found = table_compare.compare_tables(*frames(spark, old), *frames(spark, new)).collect()
    return sorted(((r.doc_id, r.part, r.kind, r.row_key or "", r.row_index, r.old_text, r.new_text, tuple(tuple(c) for c in r.cells)) for r in found), key=str)


def test_rows_columns_and_cells(spark):
    old = [
        (1, 0, "p. 53", None, [["Device", "Model"], ["fire wall", "PA-850"]]),
        (2, 0, "", ["No", "Date"], [["21", "2025-01-01"]]),
        (3, 0, "", None, [["Device"], ["wall"]]),
        (4, 0, "", None, [["Item", "Old name", "Count"], ["a", "x", "1"], ["b", "y", "2"], ["a", "last", "3"], ["", "no key", "9"], [None, None, None]]),
        (5, 0, "", ["Only"], []),
    ]
    new = [
        (1, 0, "p. 50", None, [["Device", "Model"], ["firewall", "PA-3260"]]),
        (2, 0, "", ["No", "Date"], [["21", "2025-01-01"], ["22", "2026-05-08"]]),
        (3, 0, "", None, [["Device", "Status"], ["wall", "in use"]]),
        (4, 0, "", None, [["Count", "Item", "Old names"], ["3", "a", "la st"], ["7", "c"]]),
        (5, 0, "", ["Only"], [["z"]]),
    ]
    assert compare(spark, old, new) == sorted(
        [
            (1, "row", "modified", "firewall", 1, "fire wall | PA-850", "firewall | PA-3260", (("Model", "PA-850", "PA-3260"),)),
            (2, "row", "added", "22", 2, None, "22 | 2026-05-08", (("No", "", "22"), ("Date", "", "2026-05-08"))),
            (3, "column", "added", "", None, None, "Status", ()),
            (4, "row", "removed", "b", 2, "b | y | 2", None, (("Item", "b", ""), ("Old name", "y", ""), ("Count", "2", ""))),
            (4, "row", "added", "c", 2, None, "7 | c", (("Count", "", "7"), ("Item", "", "c"))),
        ],
        key=str,
    )


def test_unnamed_columns_and_similarity(spark):
    old = [(1, 7, None, ["", ""], [["k", "abcd"]])]
    new = [(1, 3, None, ["", ""], [["k", "abxd"]])]
    found = table_compare.compare_tables(*frames(spark, old), *frames(spark, new)).collect()
    assert [(r.old_table, r.new_table, r.table_name, r.cells[0].column) for r in found] == [(7, 3, "未命名表格", "第2列")]
    assert found[0].similarity == pytest.approx(SequenceMatcher(None, "k | abcd", "k | abxd").ratio())


def plain_pairs(old, new):
    """Every old table against every new one, in order."""
    taken, pairs = set(), []
    for i, (header, _, _) in enumerate(old):
        best = (0.0, -1)
        for j, (other, _, _) in enumerate(new):
            r = SequenceMatcher(None, header, other).ratio()
            if j not in taken and r >= 0.5 and r > best[0]:
                best = (r, j)
        if best[1] >= 0:
            pairs.append((i, best[1]))
            taken.add(best[1])
    for i, (_, width, rows) in enumerate(old):
        if rows >= 5 and i not in {p[0] for p in pairs}:
            for j, (_, w, n) in enumerate(new):
                if j not in taken and n >= 5 and w == width and min(n, rows) / max(n, rows) >= 0.7:
                    pairs.append((i, j))
                    taken.add(j)
                    break
    return pairs


@pytest.mark.parametrize("seed", range(20))
def test_pairs_are_those_of_the_sequential_rule(seed):
    rng = random.Random(seed)
    side = lambda: [(rng.choice(["No Date", "No Date Name", "Item Count", "qq", "zz", "", "Name Date No", "Item Counts"]), rng.randrange(1, 3), rng.choice([1, 5, 6, 9, 20])) for _ in range(rng.randrange(12))]
    old, new = side(), side()
    assert sorted(table_compare.pair_tables(old, new)) == sorted(plain_pairs(old, new))


def test_columns_by_name_or_place():
    assert table_compare.align_columns(["Item", "Count"], ["Counts", "Item", "New"]) == [1, 0]
    assert table_compare.align_columns(["a", "b", "c"], ["", "x"]) == [-1, -1, -1]
    assert table_compare.align_columns(["a", "b", "c"], ["", "", "x"]) == [0, 1, 2]
    assert table_compare.align_columns(["a", "b", "c"], ["", ""]) == [0, 1, -1]


def test_no_tables(spark):
    assert compare(spark, [(1, 0, "", None, [["a"], ["b"]])], []) == []
