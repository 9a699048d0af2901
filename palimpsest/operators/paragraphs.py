"""Paragraph operators: lines with offsets and pages, exact pairs, repeats, chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import match_key
from palimpsest.operators.ranks import rank_within
from palimpsest.sources.durable import written

#: Lines of a page where a text has no pages of its own.
PAGE_LINES = 20
#: Copies of a line, in both versions, that are paired as one row.
COPIES = 20_000


def paragraph_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line, start (characters before it) and page of every line."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(order), F.lit(0))
    return lines.select("doc_id", "line_no", "line", start.alias("start"), (F.floor(F.col("line_no") / PAGE_LINES) + 1).alias("page"))


def repeated_lines(docs: DataFrame, least: int = 3, share: float = 0.3, longest: int = 100) -> DataFrame:
    """Lines of a document that occur often enough to be page furniture: doc_id, line, n."""
    lines = paragraph_lines(docs).where((F.trim("line") != "") & (F.length("line") < longest))
    pages = paragraph_lines(docs).groupBy("doc_id").agg(F.max("page").alias("pages"))
    counts = lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).join(pages, "doc_id")
    return counts.where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("pages") * share))).select("doc_id", "line", "n")


def strip_repeated_lines(docs: DataFrame) -> DataFrame:
    """The lines that are left without `repeated_lines`, numbered anew from 1."""
    return renumbered(paragraph_lines(docs).join(repeated_lines(docs).select("doc_id", "line"), ["doc_id", "line"], "left_anti"))


def renumbered(lines: DataFrame) -> DataFrame:
    """doc_id, paragraph_no (from 1 in each document) and line of the lines that a filter left."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return lines.select("doc_id", number.alias("paragraph_no"), "line")


def exact_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Multiset pairs of equal paragraphs: the k-th copy in old meets the k-th in new.

    Lines of at most COPIES copies meet in one shuffle, each line with the places of its
    copies; of the others every copy is ranked, over as many tasks as it takes.
    """
    lines = lambda docs: paragraph_lines(docs).where(F.trim("line") != "").select("line", "doc_id", "line_no")
    a, b = lines(old), lines(new)
    counts = a.select("line").union(b.select("line")).groupBy(F.xxhash64("line").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    # at most one in COPIES rows; equal hashes only send a line the other way
    many = written(counts.where(F.col("n") > COPIES).select("h"), "many")
    crowded = not many.isEmpty()
    few = lambda df: df.join(many, F.xxhash64("line") == F.col("h"), "left_anti") if crowded else df
    places = lambda side: F.sort_array(F.collect_list(F.when(F.col("new") == side, F.struct("doc_id", "line_no"))))
    both = few(a).withColumn("new", F.lit(False)).union(few(b).withColumn("new", F.lit(True)))
    met = both.groupBy("line").agg(places(False).alias("a"), places(True).alias("b"))
    k = F.least(F.size("a"), F.size("b"))
    met = met.select("line", F.explode(F.arrays_zip(F.slice("a", F.lit(1), k).alias("a"), F.slice("b", F.lit(1), k).alias("b"))).alias("p"))
    out = met.select("line", F.col("p.a.doc_id").alias("old_doc"), F.col("p.a.line_no").alias("old_line"), F.col("p.b.doc_id").alias("new_doc"), F.col("p.b.line_no").alias("new_line"))
    if not crowded:
        return out

    def ranked(df: DataFrame, side: str) -> DataFrame:
        df = df.join(many, F.xxhash64("line") == F.col("h"), "left_semi")
        return rank_within(df, "line", ["doc_id", "line_no"]).select("line", "k", F.col("doc_id").alias(f"{side}_doc"), F.col("line_no").alias(f"{side}_line"))

    hot = ranked(a, "old").join(ranked(b, "new"), ["line", "k"]).select("line", "old_doc", "old_line", "new_doc", "new_line")
    return out.unionByName(hot)


def chapter_forward_fill(docs: DataFrame, longest: int = 20) -> DataFrame:
    """Every line with the last heading at or before it; a heading is a short line that ends in a full stop."""
    lines = paragraph_lines(docs)
    heading = F.when((F.length("line") <= longest) & F.endswith("line", F.lit(".")), F.col("line"))
    chapter = F.last(heading, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no"))
    return lines.select("doc_id", "line_no", F.coalesce(chapter, F.lit("")).alias("chapter"))


def latest_versions(docs: DataFrame, family: str) -> DataFrame:
    """The newest row of each family of versions (largest doc_id), and how many there are."""
    return docs.groupBy(family).agg(F.max("doc_id").alias("latest"), F.count(F.lit(1)).alias("versions"))


def duplicate_uploads(docs: DataFrame) -> DataFrame:
    """Contents stored more than once: first id, copies, and the short id from the content hash."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    groups = docs.select("doc_id", digest.alias("sha")).groupBy("sha").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))
    return groups.where("copies > 1").select("first_doc", "copies", F.left("sha", F.lit(8)).alias("short_id"))


def unmatched_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """line, kind and n: copies of a paragraph that only the old (removed) or the new side (added) has."""

    def counted(docs: DataFrame, n: str) -> DataFrame:
        lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).where(F.trim("line") != "")
        return lines.groupBy("line").agg(F.count(F.lit(1)).alias(n))

    both = counted(old, "a").join(counted(new, "b"), "line", "full_outer").select("line", (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("d"))
    return both.where("d <> 0").select("line", F.when(F.col("d") > 0, "added").otherwise("removed").alias("kind"), F.abs("d").alias("n"))


def repeated_neighbours(docs: DataFrame, least: int = 20) -> DataFrame:
    """doc_id, line_no of lines equal to the line before (white space and case aside) of `least` characters or more."""
    lines = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    pairs = F.arrays_zip(F.slice("lines", F.lit(1), F.size("lines") - 1).alias("a"), F.slice("lines", F.lit(2), F.size("lines") - 1).alias("b"))
    rows = lines.select("doc_id", F.posexplode(pairs).alias("i", "p"))
    same = (F.length(F.trim("p.a")) >= least) & (match_key(F.col("p.a")) == match_key(F.col("p.b")))
    return rows.where(same).select("doc_id", (F.col("i") + 1).alias("line_no"))


def line_context(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, line_no, context: each line with the `radius` lines on either side, joined by line feeds."""
    lines = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    low = F.greatest(F.col("line_no") - radius, F.lit(0))
    around = F.slice("lines", low + 1, F.col("line_no") + radius - low + 1)
    rows = lines.select("doc_id", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - 1)).alias("line_no"))
    return rows.select("doc_id", "line_no", F.array_join(around, "\n").alias("context"))


def parse_issues(docs: DataFrame, shortest: int = 10, longest: int = 600) -> DataFrame:
    """doc_id, line_no, kind and risk of lines that look badly parsed.

    short_fragment: under `shortest` characters and no heading; long_paragraph: over
    twice `longest`; duplicate_paragraph: equal to the line before.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    n = F.length(F.trim("line"))
    kind = F.when((n < shortest) & ~F.col("line").endswith("."), "short_fragment").when(n > 2 * longest, "long_paragraph")
    odd = lines.select("doc_id", "line_no", kind.alias("kind"), F.lit("low").alias("risk")).where("kind is not null")
    again = repeated_neighbours(docs).select("doc_id", "line_no", F.lit("duplicate_paragraph").alias("kind"), F.lit("high").alias("risk"))
    return odd.unionByName(again)


def parse_status(docs: DataFrame) -> DataFrame:
    """doc_id, n_issues, n_high and status (ok, review or failed) of every document."""
    found = parse_issues(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_issues"), F.count_if(F.col("risk") == "high").alias("n_high"))
    out = docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), F.coalesce("n_high", F.lit(0)).alias("n_high"))
    return out.withColumn("status", F.when(F.col("n_high") > 0, "failed").when(F.col("n_issues") > 0, "review").otherwise("ok"))


def ranked_issues(docs: DataFrame, most: int = 20) -> DataFrame:
    """The `most` issues of each document to look at first: high risk before low, then by line and kind."""
    high = F.when(F.col("risk") == "high", 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(high, "line_no", "kind"))
    return parse_issues(docs).withColumn("place", place).where(F.col("place") <= most).drop("place")
