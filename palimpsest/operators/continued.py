"""Tables that go on over pages: cleaned, judged and joined."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Likeness of two header rows from which on they are the same.
SAME_HEADER = 0.85
EDGE = 0.2


def cleaned(rows: Column) -> Column:
    """A table (array of rows) with trimmed cells, without rows and columns that are empty throughout.

    The first kept row tells how many columns there are.
    """
    trimmed = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    kept = F.filter(trimmed, lambda r: F.exists(r, lambda c: c != ""))
    width = F.coalesce(F.size(F.get(kept, F.lit(0))), F.lit(0))
    used = F.filter(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), lambda i: F.exists(kept, lambda r: F.coalesce(F.get(r, i), F.lit("")) != ""))
    return F.when(width > 0, F.transform(kept, lambda r: F.transform(used, lambda i: F.coalesce(F.get(r, i), F.lit(""))))).otherwise(F.array().cast("array<array<string>>"))


def likeness(a, b) -> float:
    """Jaccard similarity of the cells of two rows; 0 if either has none."""
    x, y = ({str(c).strip() for c in row if c and str(c).strip()} for row in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


def _ties(table: dict, part: dict) -> set[str]:
    """What ties a part to the table before it: header, chapter, gaps (in its first row) and edges (of the pages)."""
    first = part["rows"][0]
    gaps = sum(not str(c or "").strip() for c in first) / max(len(first), 1)
    titles = {t for t in (table.get("title"), part.get("title")) if t}
    found = {
        "header": likeness(table["rows"][0], first) >= SAME_HEADER,
        "chapter": bool(table["chapter"]) and table["chapter"] == part["chapter"] and len(titles) < 2,
        "gaps": 0.4 <= gaps < 1,
        "edges": None not in (table["bottom"], part["top"]) and table["bottom"] >= 1 - EDGE and part["top"] <= EDGE,
    }
    return {name for name, there in found.items() if there}


def continues(table: dict, part: dict) -> bool:
    """Whether part stands on the next page and anything ties it to the table.

    Only under a repeated header may widths differ, by one column.
    """
    if not (len(table["rows"]) and len(part["rows"])) or part["page"] - table["page_end"] != 1:
        return False
    ties = _ties(table, part)
    slack = 1 if "header" in ties else 0
    return bool(ties) and abs(len(table["rows"][0]) - len(part["rows"][0])) <= slack


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("table_no", T.IntegerType()), T.StructField("repeated", T.BooleanType()), T.StructField("width", T.IntegerType())])))
def _numbers(docs: pa.Array) -> pa.Array:
    """For each part of a document (in order of place; rows: its first one) its table, whether its header is a repeated one, and the table's width."""

    def number(parts: list[dict]) -> list[dict]:
        out, now, n = [], None, 0
        for r in parts:
            r["page_end"] = r["page"]
            goes_on = now is not None and continues(now, r)
            repeated = goes_on and likeness(now["rows"][0], r["rows"][0]) >= SAME_HEADER
            if goes_on:
                now = {**now, "page_end": r["page"], "bottom": r["bottom"], "chapter": now["chapter"] or r["chapter"]}
            else:
                now, n = r, n + 1
            out.append({"table_no": n, "repeated": repeated, "width": len(now["rows"][0]) if now["rows"] else 0})
        return out

    return pa.array([number(x) for x in docs.to_pylist()], pa.list_(pa.struct([("table_no", pa.int32()), ("repeated", pa.bool_()), ("width", pa.int32())])))


def joined(parts: DataFrame) -> DataFrame:
    """doc_id, table_no (from 1), page, page_end, chapter and rows of logical tables.

    parts: doc_id, page, pos, chapter, top and bottom (shares of the page's height), rows
    (array of rows) and, if known, title (of the chapter).  The decision looks at the table as it is so far, so the parts
    of one document are read in order; a repeated header is dropped, rows are padded or
    cut to the header's width.
    """

    title = F.col("title") if "title" in parts.columns else F.lit(None).cast("string")
    part = F.struct(F.col("page").cast("long").alias("page"), F.col("pos").cast("long").alias("pos"), "chapter", "top", "bottom", title.alias("title"), "rows")
    docs = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    # what decides goes through Python: places, chapters and first rows; rows stay in Spark
    first = lambda x: F.coalesce(F.slice(x["rows"], 1, 1), F.array().cast("array<array<string>>"))
    slim = F.transform("p", lambda x: F.struct(x["page"].alias("page"), x["chapter"].alias("chapter"), x["top"].alias("top"), x["bottom"].alias("bottom"), x["title"].alias("title"), first(x).alias("rows")))
    marked = docs.withColumn("m", _numbers(slim)).select("doc_id", F.explode(F.arrays_zip("p", "m")).alias("x")).select("doc_id", "x.p.*", "x.m.*")
    own = F.when(F.col("repeated"), F.slice("rows", F.lit(2), F.greatest(F.lit(0), F.size("rows") - 1))).otherwise(F.col("rows"))
    shaped = lambda r, w: F.slice(F.concat(r, F.array_repeat(F.lit(""), w)), 1, w)
    rows = marked.withColumn("own", F.transform(own, lambda r: shaped(r, F.col("width"))))
    named = F.min(F.when(F.coalesce("chapter", F.lit("")) != "", F.struct("page", "pos", "chapter")))
    out = rows.groupBy("doc_id", "table_no").agg(F.min("page").alias("page"), F.max("page").alias("page_end"), named.alias("c"), F.sort_array(F.collect_list(F.struct("page", "pos", "own"))).alias("all"))
    return out.select("doc_id", "table_no", "page", "page_end", F.coalesce("c.chapter", F.lit("")).alias("chapter"), F.flatten(F.transform("all", lambda x: x["own"])).alias("rows"))
