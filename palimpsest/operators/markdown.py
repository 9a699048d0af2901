"""Documents as Markdown: blocks in reading order, each chapter's heading at its first use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A contents entry, and the page references that are cut off titles.
TOC_LINE = r"\d+\.\d+-\d+\s*\z|\s+\d+\s*页\s*\z"
PAGE_SUFFIX, TOC_SUFFIX = r"\s+\d+\s*页\s*\z", r"\s+\d+\.\d+-\d+\s*\z"
TITLE_MARKS = r"[\s、（）()]+"
TERMINATORS = "．。：:"
#: Levels of headings.
DEEPEST = 6


def clean_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(title, PAGE_SUFFIX, ""), TOC_SUFFIX, ""))


def _heading(chapter: Column, title: Column) -> Column:
    level = F.least(F.size(F.split(chapter, r"\.")), F.lit(DEEPEST))
    return F.concat(F.lit("\n"), F.repeat(F.lit("#"), level), F.lit(" "), title, F.lit("\n"))


def _places(items: DataFrame) -> DataFrame:
    fields = [F.coalesce(c, F.lit("")).alias(c) for c in ("chapter", "chapter_title")]
    at = F.struct("page", F.when(F.coalesce("order_no", F.lit(0)) != 0, F.col("order_no")).otherwise(F.col("index")).alias("order"), F.when(F.col("kind") == "table", 1).otherwise(0).alias("kind"), "index")
    return items.select("doc_id", "kind", "index", "page", F.trim(F.coalesce("text", F.lit(""))).alias("text"), *fields, at.alias("at"))


def blocks(items: DataFrame) -> DataFrame:
    """doc_id, at (the order) and lines of every block of documents that isn't a contents entry.

    items: doc_id, kind (paragraph or table), index, page, order_no (0 or null: by index),
    text (a table's Markdown), chapter and chapter_title.

    A paragraph that is its chapter's title is a heading; one that begins with it is a
    heading and text.  A chapter that shows up in text first gets its heading there, and
    so do the chapters above it that have a title, the nearest first.  Where a chapter is
    used first follows from the least place of all paragraphs of it and of the chapters
    below it, so no document is walked through in order; a chapter's places are minima,
    which tasks pre-aggregate.  Null chapters and titles are empty.
    """
    rows = _places(items)
    named = rows.where("kind <> 'table' and chapter <> '' and chapter_title <> ''")
    title = lambda: clean_title(F.trim(F.concat_ws(" ", "chapter", "chapter_title")))
    titles = named.groupBy("doc_id", "chapter").agg(F.min_by(title(), "at").alias("title"))
    used = named.where(~F.col("text").rlike(TOC_LINE))
    parts = F.split("chapter", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    first = used.select("doc_id", "at", F.explode(above).alias("chapter")).groupBy("doc_id", "chapter").agg(F.min("at").alias("at"))
    opened = first.join(titles, ["doc_id", "chapter"]).select("doc_id", "at", F.struct(F.size(F.split("chapter", r"\.")).alias("depth"), "chapter", "title").alias("opened"))
    # at most one chapter for each level of a dotted number
    opened = opened.groupBy("doc_id", "at").agg(F.reverse(F.sort_array(F.collect_list("opened"))).alias("opened"))
    shown = rows.where(~((F.col("kind") != "table") & (F.col("chapter") != "") & (F.col("chapter_title") != "") & F.col("text").rlike(TOC_LINE)))
    shown = shown.join(opened, ["doc_id", "at"], "left")
    text, whole, own = F.col("text"), F.trim(F.concat_ws(" ", "chapter", "chapter_title")), title()
    bare = lambda x: F.regexp_replace(x, TITLE_MARKS, "")
    is_named = (F.col("kind") != "table") & (F.col("chapter") != "") & (F.col("chapter_title") != "")
    is_title = is_named & ((bare(text) == bare(whole)) | (bare(text) == bare(F.col("chapter_title"))) | (bare(text) == bare(own)))
    begins = is_named & ~is_title & (F.startswith(bare(text), bare(whole)) | F.startswith(bare(text), bare(own)))
    after = lambda p: F.trim(F.substr(text, F.length(p) + 1))
    found = F.instr(text, F.col("chapter_title"))
    behind = F.trim(F.substr(text, found + F.length("chapter_title")))
    behind = F.when(F.contains(F.lit(TERMINATORS), F.left(behind, F.lit(1))) & (behind != ""), F.trim(F.substr(behind, F.lit(2)))).otherwise(behind)
    rest = F.when(F.startswith(text, whole), after(whole)).when(F.startswith(text, own), after(own)).when(found > 0, behind).otherwise(after(whole))
    none = F.array().cast("array<string>")
    all_opened = F.coalesce(F.col("opened"), F.array().cast("array<struct<depth:int,chapter:string,title:string>>"))
    higher = F.filter(all_opened, lambda o: o["chapter"] != F.col("chapter"))
    parents = F.flatten(F.transform(higher, lambda o: F.array(_heading(o["chapter"], o["title"]), F.lit(""))))
    mine = F.array(_heading(F.col("chapter"), own))
    newly = F.exists(all_opened, lambda o: o["chapter"] == F.col("chapter"))
    lines = (
        F.when(is_title, F.concat(parents, mine, F.array(F.lit(""))))
        .when(begins, F.concat(parents, mine, F.when(rest != "", F.array(rest)).otherwise(none), F.array(F.lit(""))))
        .when(is_named & newly, F.concat(parents, mine, F.array(text, F.lit(""))))
        .when((F.col("kind") == "table") & (text == ""), F.array(F.lit("")))
        .otherwise(F.array(text, F.lit("")))
    )
    return shown.select("doc_id", "at", lines.alias("lines"))


def documents(blocks: DataFrame) -> DataFrame:
    """doc_id and markdown: the blocks of each document as one text, for documents that fit a value."""
    gathered = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "lines"))), lambda b: b["lines"]))
    text = F.btrim(F.array_join(gathered, "\n"), F.lit(" \n\t\r"))
    return blocks.groupBy("doc_id").agg(F.concat(text, F.lit("\n")).alias("markdown"))


def checked_blocks(items: DataFrame) -> DataFrame:
    """doc_id, at and text of every item for a check of the parser: a comment with what is known of it, then the item.

    A paragraph in a chapter is a heading of its level; page_end 0 or null is the page.
    """
    rows = _places(items).join(items.select("doc_id", "kind", "index", F.col("page_end").alias("end")), ["doc_id", "kind", "index"])
    end = F.when(F.coalesce("end", F.lit(0)) != 0, F.col("end")).otherwise(F.col("page"))
    told = F.concat(F.lit("<!-- parse_qa type='"), "kind", F.lit("' index="), "index", F.lit(" page="), "page", F.lit(" page_end="), end, F.lit(" chapter='"), "chapter", F.lit("' -->"))
    return rows.select("doc_id", "at", F.concat(told, F.when(F.col("text") != "", F.concat(F.lit("\n"), "text", F.lit("\n"))).otherwise("")).alias("text"))
