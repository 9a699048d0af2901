"""Paragraphs of running text: cut by headings, blank lines and sentence ends, merged over pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.chapters import CJK, chapter, is_heading, joined, let, starts_block, stripped, unfinished
from palimpsest.operators.paragraphs import PAGE_LINES

# Fixed values that the results depend on.
NOISE_LINES = (
    r"^修订日期\s*[：:]\s*\S+$",
    r"^发布日期\s*[：:]\s*\S+$",
    r"^修订时间\s*[：:]\s*\S+$",
    r"^\d{4}[-./]\s*\d{1,2}[-./]\s*\d{1,2}$",
    r"^版\s*次\s*[：:]\s*\S+$",
    r"^版本号\s*[：:]\s*\S+$",
    r"^(?:R\d{2,}|版本\s*\S+)\s*$",
    r"^修订次数\s*[：:]\s*\d+\s+\S+\s+页码",
    r"^修订日期\s*[：:]\s*\d{4}-\d{1,2}-\d{1,2}\s*$",
    r"^-\d+-\s*$",
)
SHORTEST, SENTENCE_BREAK, LONGEST, LONGEST_MERGED = 10, 40, 600, 1200
SHORTEST_BODY, SHORTEST_INLINE = 10, 4
#: Characters at the end of a line in which a heading stuck to a sentence is looked for:
#: a heading has at most 80, the rest is room for white space before it.
TAIL = 120

# Bits of a line's code; 0 is a blank line.
NOISE, HEADING, TEXT, ENDS, SOFT, CJK_FIRST, CJK_LAST, HELD = 1, 2, 4, 8, 16, 32, 64, 128


def _bit(test: Column, value: int) -> Column:
    return F.when(test, F.lit(value)).otherwise(F.lit(0))


def _entry(text: Column, code: Column, line: Column) -> Column:
    clean = F.regexp_replace(text, f"(?U)(?<={CJK})\\s+(?={CJK})", "")
    return F.struct(text.alias("text"), code.cast("int").alias("code"), F.length(clean).alias("size"), F.length(line).alias("raw"))


def _words(text: Column, code: int) -> Column:
    """The code of running text."""
    flags = _bit(text.rlike("[。！？.!]\\z"), ENDS) + _bit(text.rlike("[。.;；，,]\\z"), SOFT)
    return F.lit(code) + flags + _bit(text.rlike(f"^{CJK}"), CJK_FIRST) + _bit(text.rlike(f"{CJK}\\z"), CJK_LAST)


def _stuck(bare: Column) -> Column:
    """The heading at the end of a line of text, after a sentence; null if there is none."""

    def fitting(pieces: Column) -> Column:
        rests = F.transform(F.sequence(F.lit(2), F.size(pieces)), lambda k: stripped(F.array_join(F.slice(pieces, k, F.size(pieces)), "")))
        fits = F.filter(rests, lambda r: (F.length(r) >= SHORTEST_INLINE) & (F.length(bare) - F.length(r) >= SHORTEST_BODY) & is_heading(r))
        return F.when(F.size(pieces) > 1, F.get(fits, F.lit(0)))

    tail = F.split(F.right(bare, F.lit(TAIL)), "(?<=[。！？.!；;])")
    return F.when(bare.rlike(r"(?U)[。！？.!；;]\s*(?:\d|第|（|[一二三四五六七八九十])"), let(tail, fitting))


def _entries(line: Column) -> Column:
    """One entry a line, or two if a heading is stuck to its last sentence."""

    def text(bare: Column, stuck: Column) -> Column:
        body = stripped(F.substring(bare, F.lit(1), F.length(bare) - F.length(stuck)))
        two = let(body, lambda b: F.array(_entry(b, _words(b, TEXT + HELD), line), _entry(stuck, F.lit(HEADING), line)))
        return F.when(stuck.isNotNull(), two).otherwise(F.array(_entry(bare, _words(bare, TEXT), line)))

    def any_line(bare: Column) -> Column:
        return (
            F.when(bare == "", F.array(_entry(bare, F.lit(0), line)))
            .when(bare.rlike("(?U)" + "|".join(NOISE_LINES)), F.array(_entry(bare, F.lit(NOISE), line)))
            .when(is_heading(bare), F.array(_entry(bare, F.lit(HEADING), line)))
            .otherwise(let(_stuck(bare), lambda s: text(bare, s)))
        )

    return let(stripped(line), any_line)


def _cut(codes, sizes, raws) -> list[dict]:
    """The segments of a document's entries: start and end offset, first and last page, and the places of their entries."""
    length, at, open_, last, held = 0, 0, False, 0, 0
    out = []
    for pos, (code, size, raw) in enumerate(zip(codes, sizes, raws)):
        after = at + raw + 1
        if open_ and (code == 0 or code & HEADING):
            out[-1]["stop"], open_ = at, False
        # pages go by lines: the two entries of one line count once
        page = (pos - held) // PAGE_LINES + 1
        if code & HEADING or code & TEXT and not open_:
            length = 0
            out.append({"start": at, "stop": after, "page": page, "page_end": page, "at": []})
        if code & TEXT:
            glue = 1 if open_ and not (last & CJK_LAST and code & CJK_FIRST) else 0
            length, last, open_ = length + size + glue, code, True
            if code & HELD or code & ENDS and length >= SENTENCE_BREAK or code & SOFT and length > LONGEST:
                out[-1]["stop"], open_ = after, False
        if code & (HEADING | TEXT):
            out[-1]["at"].append(pos)
            out[-1]["page_end"] = page
        held += bool(code & HELD)
        at = at if code & HELD else after
    if open_:
        out[-1]["stop"] = at
    return out


_SPAN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "stop")] + [T.StructField(c, T.IntegerType()) for c in ("page", "page_end")] + [T.StructField("at", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(T.ArrayType(_SPAN))
def _cuts(codes: pd.Series, sizes: pd.Series, raws: pd.Series) -> pd.Series:
    return pd.Series([_cut(c.tolist(), s.tolist(), r.tolist()) for c, s, r in zip(codes, sizes, raws)])


def segments(docs: DataFrame) -> DataFrame:
    """doc_id, seg_no (from 1), text, start, stop, page, page_end, chapter and title.

    Lines are joined to segments until a blank line, a heading, a full stop after
    SENTENCE_BREAK characters or a soft stop after LONGEST; headings stand alone, noise
    lines are passed over.  Segments under SHORTEST characters go unless they are
    headings; chapter is that of the last heading.  stop is the offset after the
    segment.  Null or empty texts have no segments.
    """
    lines = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    entries = lines.select("doc_id", F.flatten(F.transform("lines", _entries)).alias("e"))
    marked = entries.withColumn("cut", _cuts(F.col("e.code"), F.col("e.size"), F.col("e.raw")))
    # a segment's lines stand in its document's row: nothing is shuffled for them
    rows = marked.select("doc_id", F.col("e.text").alias("texts"), F.posexplode_outer("cut").alias("seg", "s")).where("s is not null")
    segs = rows.select("doc_id", "seg", joined(F.transform("s.at", lambda i: F.get("texts", i))).alias("text"), "s.start", "s.stop", "s.page", "s.page_end")
    segs = segs.withColumn("ch", chapter(F.col("text"))).where((F.length("text") >= SHORTEST) | F.col("ch").isNotNull())
    by = Window.partitionBy("doc_id").orderBy("seg")
    filled = segs.withColumn("ch", F.last("ch", ignorenulls=True).over(by)).withColumn("seg_no", F.row_number().over(by))
    return filled.select("doc_id", "seg_no", "text", "start", "stop", "page", "page_end", F.coalesce("ch.chapter", F.lit("")).alias("chapter"), F.coalesce("ch.title", F.lit("")).alias("title"))


def _runs(sizes, pages, ends, chapters, flags) -> list[int]:
    """The merged paragraph (from 1) of each segment; what has been merged so far decides on the next."""
    out, run = [], 0
    for size, page, end, ch, flag in zip(sizes, pages, ends, chapters, flags):
        near = run and page <= run_end + 1 and not page == run_page == run_end
        same = run and not (run_ch and ch and run_ch != ch)
        if near and same and not last & 1 and last & 4 and not flag & 3 and length + size + 1 <= LONGEST_MERGED:
            length += size + (0 if last & 16 and flag & 8 else 1)
            run_end, run_ch, last = max(run_end, end), run_ch or ch, flag
        else:
            run, length, run_page, run_end, run_ch, last = run + 1, size, page, end, ch, flag
        out.append(run)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _merged(sizes: pd.Series, pages: pd.Series, ends: pd.Series, chapters: pd.Series, flags: pd.Series) -> pd.Series:
    return pd.Series([_runs(*x) for x in zip(sizes, pages, ends, chapters, flags)])


def merge_pages(segs: DataFrame) -> DataFrame:
    """segs, with a segment that breaks off at the end of a page joined to its other part.

    Both parts are on adjoining pages, in one chapter, no headings, the second no new
    block, and together at most LONGEST_MERGED characters.  Gives doc_id, paragraph_no
    (from 1), text, page, page_end, chapter, n_parts.
    """
    bare = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    heading = (F.col("title") != "") & (bare(F.col("text")) == bare(F.concat("chapter", "title")))
    tests = [(heading, 1), (starts_block(F.col("text")), 2), (unfinished(F.col("text")), 4), (F.col("text").rlike(f"^{CJK}"), 8), (F.col("text").rlike(f"{CJK}\\z"), 16)]
    flags = sum((F.when(t, F.lit(v)).otherwise(F.lit(0)) for t, v in tests), F.lit(0))
    row = F.struct("seg_no", "page", "page_end", "chapter", flags.alias("flag"), F.length("text").alias("size"), "text")
    docs = segs.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("s"))
    runs = docs.withColumn("run", _merged(F.col("s.size"), F.col("s.page"), F.col("s.page_end"), F.col("s.chapter"), F.col("s.flag")))
    rows = runs.select("doc_id", F.explode(F.arrays_zip("s", "run")).alias("r")).select("doc_id", F.col("r.run").alias("paragraph_no"), "r.s.*")
    parts = F.array_sort(F.collect_list(F.struct("seg_no", "text", "chapter")))
    out = rows.groupBy("doc_id", "paragraph_no").agg(parts.alias("p"), F.min("page").alias("page"), F.max("page_end").alias("page_end"))
    named = F.filter(F.transform("p", lambda x: x.chapter), lambda c: c != "")
    return out.select("doc_id", "paragraph_no", joined(F.transform("p", lambda x: x.text)).alias("text"), "page", "page_end", F.coalesce(F.get(named, F.lit(0)), F.lit("")).alias("chapter"), F.size("p").alias("n_parts"))
