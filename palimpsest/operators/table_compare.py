"""Tables of two versions of a document: paired by their headers, columns aligned, rows and cells compared.

Tables come as two frames: `heads` (doc_id, table_no, location, headers) and `rows` (doc_id,
table_no, row_no from 0 without gaps, cells).  Rows stay rows: only headers and the numbers
of rows of one document's tables meet in one place.
"""

from __future__ import annotations

from collections import defaultdict, deque
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

#: Least likeness of headers of two tables, and of two columns, that belong together.
ALIKE = 0.5
#: Tables without a partner pair by size: least rows, and least ratio of their numbers of rows.
LEAST_ROWS, SIZE_RATIO = 5, 0.7
#: Name of a table without a location, and of the n-th column without a name.
UNNAMED_TABLE, UNNAMED_COLUMN = "未命名表格", "第%d列"


def _bare(cell: Column) -> Column:
    return F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", "")


def _shown(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))


def likeness(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio of two short texts."""
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def _text_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def pair_tables(old: list[tuple[str, int, int]], new: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Places of tables (header, columns, rows) that belong together.

    Old tables choose in order the new one with the most alike header (the earlier of
    equals).  New tables with one header are a queue, so that copies cost nothing.  Large
    tables that found none take the first with as many columns and about as many rows.
    """
    queues: dict[str, deque] = defaultdict(deque)
    for j, (header, _, _) in enumerate(new):
        queues[header].append(j)
    seen: dict[tuple[str, str], float] = {}
    partner: dict[int, int] = {}
    for i, (header, _, _) in enumerate(old):
        best = None
        for other, queue in queues.items():
            if (header, other) not in seen:
                seen[header, other] = likeness(header, other)
            rank = seen[header, other], -queue[0]
            if rank[0] >= ALIKE and (best is None or rank > best[0]):
                best = rank, other
        if best:
            partner[i] = queues[best[1]].popleft()
            if not queues[best[1]]:
                del queues[best[1]]
    free = [j for j in sorted(j for q in queues.values() for j in q) if new[j][2] >= LEAST_ROWS]
    for i, (_, width, rows) in enumerate(old):
        if i in partner or rows < LEAST_ROWS:
            continue
        fits = (j for j in free if new[j][1] == width and min(rows, new[j][2]) / max(rows, new[j][2]) >= SIZE_RATIO)
        j = next(fits, None)
        if j is not None:
            partner[i] = j
            free.remove(j)
    return list(partner.items())


def align_columns(old: list[str], new: list[str]) -> list[int]:
    """For each old column the new one, or -1: by name, each new one once; by place if most new names are missing."""
    if not old or 2 * sum(map(bool, new)) < len(new):
        return [i if i < len(new) else -1 for i in range(len(old))]
    out, free = [], list(range(len(new)))
    for name in old:
        best = max(((likeness(name, new[j]), -j) for j in free), default=(0.0, 0))
        out.append(-best[1] if best[0] >= ALIKE else -1)
        if out[-1] >= 0:
            free.remove(out[-1])
    return out


@F.pandas_udf(ArrayType(StructType([StructField("old", IntegerType()), StructField("new", IntegerType())])))
def _paired(old: pd.Series, new: pd.Series) -> pd.Series:
    as_rows = lambda tables: [(t["header"], t["width"], t["n"]) for t in tables]
    return pd.Series([[{"old": i, "new": j} for i, j in pair_tables(as_rows(a), as_rows(b))] for a, b in zip(old, new, strict=True)])


@F.pandas_udf(ArrayType(IntegerType()))
def _aligned(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([align_columns(list(a), list(b)) for a, b in zip(old, new, strict=True)])


def _with_headers(heads: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads with header, width, n and filled; rows without header rows, numbered from 1).

    A table without headers of its own has its first row as header.
    """
    own = F.coalesce(F.size("headers"), F.lit(0)) > 0
    counts = rows.groupBy("doc_id", "table_no").agg(F.count(F.lit(1)).alias("n_all"), F.max(F.when(F.col("row_no") == 0, F.col("cells"))).alias("first"))
    found = heads.join(counts, ["doc_id", "table_no"], "left")
    header = F.transform(F.when(own, F.col("headers")).otherwise(F.coalesce("first", F.array().cast("array<string>"))), lambda c: F.trim(F.coalesce(c, F.lit(""))))
    n = F.coalesce("n_all", F.lit(0))
    found = found.select("doc_id", "table_no", "location", own.alias("own"), header.alias("header"), F.when(own, n).otherwise(F.greatest(n - 1, F.lit(0))).alias("n"), (n > 0).alias("filled"))
    body = rows.join(found.select("doc_id", "table_no", "own"), ["doc_id", "table_no"]).where(F.col("own") | (F.col("row_no") > 0))
    return found.drop("own"), body.select("doc_id", "table_no", (F.col("row_no") + F.col("own").cast("int")).alias("row_index"), "cells")


def table_pairs(old_heads: DataFrame, new_heads: DataFrame) -> DataFrame:
    """doc_id, old_table, new_table, both headers and locations, and columns (new place of each old column) of tables that belong together."""
    text = F.array_join(F.transform("header", _bare), " ")

    def gathered(heads: DataFrame, side: str) -> DataFrame:
        one = F.struct("table_no", text.alias("header"), F.size("header").alias("width"), F.col("n").cast("int").alias("n"))
        return heads.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias(side))

    met = gathered(old_heads, "o").join(gathered(new_heads, "n"), "doc_id")
    pairs = met.select("doc_id", "o", "n", F.explode(_paired("o", "n")).alias("p")).select("doc_id", F.col("o")[F.col("p.old")]["table_no"].alias("old_table"), F.col("n")[F.col("p.new")]["table_no"].alias("new_table"))
    # tables without rows take part in the pairing, and have nothing to compare
    named = lambda heads, side: heads.where("filled").select("doc_id", F.col("table_no").alias(f"{side}_table"), F.col("header").alias(f"{side}_header"), F.col("location").alias(f"{side}_location"))
    out = pairs.join(named(old_heads, "old"), ["doc_id", "old_table"]).join(named(new_heads, "new"), ["doc_id", "new_table"])
    return out.withColumn("columns", _aligned(F.transform("old_header", _bare), F.transform("new_header", _bare)))


def _column_name(header: Column, i: Column) -> Column:
    name = _shown(F.get(header, i))
    return F.when(name == "", F.format_string(UNNAMED_COLUMN, i + 1)).otherwise(name)


def compare_tables(old_heads: DataFrame, old_rows: DataFrame, new_heads: DataFrame, new_rows: DataFrame) -> DataFrame:
    """What differs between the tables of two versions of each document.

    doc_id, old_table, new_table, table_name, part (column or row), kind (added, removed,
    modified), row_key, row_index (from 1, in the new table unless removed), old_text,
    new_text, similarity (modified rows) and cells (column, old_value, new_value).

    Rows meet by their first cell without white space (in the column that the first old
    one is aligned with); of rows with one key the last counts, and rows without key are left out.
    Only aligned columns are compared, as text without white space; added and removed
    columns are rows of their own.  Tables without any row, and tables without a partner,
    are not compared; null cells are empty.  A table's rows meet its header in a join that
    Spark may split; a key has one row a side.
    """
    old_heads, old_body = _with_headers(old_heads, old_rows)
    new_heads, new_body = _with_headers(new_heads, new_rows)
    pairs = table_pairs(old_heads, new_heads)
    name = F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in ("old_location", "new_location")), F.lit(UNNAMED_TABLE))
    pairs = pairs.withColumn("table_name", name)
    ends = ["doc_id", "old_table", "new_table"]
    none = lambda kind: F.lit(None).cast(kind)
    cell = "array<struct<column:string,old_value:string,new_value:string>>"

    # columns
    places = lambda header: F.transform(header, lambda _, i: i)
    gone = F.filter(places(F.col("old_header")), lambda i: F.get("columns", i) < 0)
    come = F.filter(places(F.col("new_header")), lambda i: ~F.array_contains("columns", i))
    listed = lambda header, at: F.array_join(F.transform(at, lambda i: F.get(header, i)), ", ")
    change = lambda kind, old, new: F.struct(F.lit(kind).alias("kind"), old.alias("old_text"), new.alias("new_text"))
    both = F.array(F.when(F.size(come) > 0, change("added", none("string"), listed(F.col("new_header"), come))), F.when(F.size(gone) > 0, change("removed", listed(F.col("old_header"), gone), none("string"))))
    columns = pairs.select(*ends, "table_name", F.explode(F.array_compact(both)).alias("c"))
    columns = columns.select(*ends, "table_name", F.lit("column").alias("part"), "c.kind", none("string").alias("row_key"), none("int").alias("row_index"), "c.old_text", "c.new_text", none("double").alias("similarity"), F.array().cast(cell).alias("cells"))

    # rows
    def keyed(body: DataFrame, side: str) -> DataFrame:
        there = pairs.select(*ends, F.col(f"{side}_table").alias("table_no"), F.when(F.lit(side == "old"), F.lit(0)).otherwise(F.greatest(F.coalesce(F.get("columns", F.lit(0)), F.lit(0)), F.lit(0))).alias("at"))
        met = body.join(there, ["doc_id", "table_no"]).withColumn("row_key", _bare(F.get("cells", F.col("at")))).where("row_key <> ''")
        return met.groupBy(*ends, "row_key").agg(F.max(F.struct("row_index", "cells")).alias(side))

    met = keyed(old_body, "old").join(keyed(new_body, "new"), [*ends, "row_key"], "full_outer")
    met = met.join(pairs.select(*ends, "table_name", "old_header", "new_header", "columns"), ends)
    aligned = F.filter(F.transform("columns", lambda to, i: F.struct(i.alias("a"), to.alias("b"))), lambda p: p["b"] >= 0)
    text = lambda cells, at: F.array_join(F.transform(F.filter(aligned, lambda p: p[at] < F.size(cells)), lambda p: _bare(F.get(cells, p[at]))), " | ")
    met = met.withColumns({"a": F.col("old.cells"), "b": F.col("new.cells")}).withColumns({"old_aligned": text(F.col("a"), "a"), "new_aligned": text(F.col("b"), "b")})
    one = lambda i, header, old, new: F.struct(_column_name(header, i).alias("column"), _shown(old).alias("old_value"), _shown(new).alias("new_value"))
    differ = F.filter(aligned, lambda p: _bare(F.get("a", p["a"])) != _bare(F.get("b", p["b"])))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old_aligned") != F.col("new_aligned"), "modified")
    met = met.withColumn("kind", kind).where("kind is not null")
    cells = (
        F.when(F.col("kind") == "added", F.transform("b", lambda v, i: one(i, F.col("new_header"), F.lit(""), v)))
        .when(F.col("kind") == "removed", F.transform("a", lambda v, i: one(i, F.col("old_header"), v, F.lit(""))))
        .otherwise(F.transform(differ, lambda p: one(p["a"], F.col("old_header"), F.get("a", p["a"]), F.get("b", p["b"]))))
    )
    line = lambda cells: F.array_join(F.transform(cells, _shown), " | ")
    index = F.when(F.col("kind") == "removed", F.col("old.row_index")).otherwise(F.col("new.row_index"))
    same = F.when(F.col("kind") == "modified", _text_likeness("old_aligned", "new_aligned"))
    rows = met.select(*ends, "table_name", F.lit("row").alias("part"), "kind", "row_key", index.alias("row_index"), line(F.col("a")).alias("old_text"), line(F.col("b")).alias("new_text"), same.alias("similarity"), cells.cast(cell).alias("cells"))
    return columns.unionByName(rows)
