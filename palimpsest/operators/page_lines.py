"""Words on a page put together to lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.chapters import joined
from palimpsest.sources.durable import written

#: Points that tops of words of one line may lie below that of its first word.
TOLERANCE = 3.0
#: Words of a page that are put together as one row.
PAGE_WORDS = 50_000


def line_starts(tops: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """page, top of the words that begin a line; tops has different tops of each page (any columns but top name the page).

    A line begins at the first top that is more than `tolerance` below the one that
    began the line before.  Every top knows its successor, the first top too far below it;
    lines begin at the tops that successors lead to from the first one.  Reached tops and
    successors double their reach every round, so rounds are the logarithm of the number
    of lines of the longest page.
    """
    page = [c for c in tops.columns if c != "top"]
    window = Window.partitionBy(*page).orderBy("top")
    names = ", ".join(f"`{c}`" for c in page)
    n = F.expr(f"count(1) over (partition by {names} order by top range between unbounded preceding and {tolerance}D following)")
    rows = tops.select(*page, "top", F.row_number().over(window).alias("i"), (n + 1).alias("to"))
    rows = written(rows.withColumn("last", F.max("i").over(Window.partitionBy(*page))), "tops")
    steps = written(rows.where(F.col("to") <= F.col("last")).select(*page, "i", "to"), "steps")
    reached = written(rows.where("i = 1").select(*page, "i"), "reached")
    while not steps.isEmpty():
        more = reached.join(steps, [*page, "i"]).select(*page, F.col("to").alias("i"))
        reached = written(reached.unionByName(more).distinct(), "reached")
        on = steps.select(*page, F.col("i").alias("to"), F.col("to").alias("beyond"))
        steps = written(steps.join(on, [*page, "to"]).select(*page, "i", F.col("beyond").alias("to")), "steps")
    return rows.join(reached, [*page, "i"]).select(*page, "top")


def _line_tops(tolerance: float):
    """A function of the ascending tops of a page's words: for each the top that its line begins with."""

    @F.pandas_udf("array<double>")
    def starts(tops: pd.Series) -> pd.Series:
        def page(values: list[float]) -> list[float]:
            out, start = [], None
            for top in values:
                # differences with NaN, which sorts last, are never small
                if start is None or not (top - start <= tolerance or top == start):
                    start = top
                out.append(start)
            return out

        return tops.map(lambda x: page(x.tolist()))

    return starts


def _whole_pages(words: DataFrame, page: list[str], tolerance: float) -> DataFrame:
    """The page's columns, start and words (x0, top, text, in order) of each line, by one shuffle of whole pages."""
    row = F.sort_array(F.collect_list(F.struct("top", "x0", "text")))
    pages = words.groupBy(*page).agg(row.alias("w")).withColumn("s", _line_tops(tolerance)(F.col("w.top").cast("array<double>")))
    # a line's words stand next to each other
    heads = F.filter(F.sequence(F.lit(1), F.size("s")), lambda i: (i == 1) | ~F.get("s", i - 1).eqNullSafe(F.get("s", i - 2)))
    ends = F.concat(F.slice("heads", F.lit(2), F.size("heads")), F.array(F.size("s") + 1))
    cut = pages.withColumn("heads", heads).select(*page, "w", F.posexplode(F.arrays_zip("heads", ends.alias("ends"))).alias("line", "at"))
    own = F.transform(F.slice("w", F.col("at.heads"), F.col("at.ends") - F.col("at.heads")), lambda x: F.struct(x["x0"].alias("x0"), x["top"].alias("top"), x["text"].alias("text")))
    return cut.select(*page, (F.col("line") + 1).alias("line_no"), F.get("w", F.col("at.heads") - 1)["top"].alias("start"), F.sort_array(own).alias("words"))


def _dealt_pages(words: DataFrame, page: list[str], tolerance: float) -> DataFrame:
    """The same for pages of any number of words: their words are dealt over tasks, lines found by successors."""
    words = written(words, "words")
    starts = line_starts(words.select(*page, "top").distinct(), tolerance).withColumn("start", F.col("top"))
    by_page = Window.partitionBy(*page).orderBy("top")
    tops = words.select(*page, "top").distinct().join(starts, [*page, "top"], "left").withColumn("start", F.last("start", ignorenulls=True).over(by_page))
    placed = words.join(tops, [*page, "top"])
    lines = placed.groupBy(*page, "start").agg(F.sort_array(F.collect_list(F.struct("x0", "top", "text"))).alias("words"))
    return lines.select(*page, F.row_number().over(Window.partitionBy(*page).orderBy("start")).alias("line_no"), "start", "words")


def words_to_lines(words: DataFrame, tolerance: float = TOLERANCE, margin: float = 0.0, numbers: str | None = None) -> DataFrame:
    """The page's columns, line_no (from 1), top and text of the lines of words (top, x0, text and columns that name the page).

    Words of a line are joined by spaces from left to right (of equals the higher first,
    then by text).  With a margin, words left of it that match `numbers` from their start go
    to the front, joined by dots, and the others are joined without spaces between Chinese
    characters.  Null texts are empty words; words without a place are left out.  A page of
    at most PAGE_WORDS words is one row on the way; larger ones are dealt over tasks.
    """
    page = [c for c in words.columns if c not in ("top", "x0", "text")]
    words = words.where("top is not null and x0 is not null").withColumn("text", F.coalesce("text", F.lit("")))
    for c in page:
        words = words.where(F.col(c).isNotNull())
    large = written(words.groupBy(*page).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PAGE_WORDS).drop("n"), "large")
    if large.isEmpty():
        lines = _whole_pages(words, page, tolerance)
    else:
        lines = _whole_pages(words.join(large, page, "left_anti"), page, tolerance).unionByName(_dealt_pages(words.join(large, page, "left_semi"), page, tolerance))
    if margin > 0 and numbers is not None:
        number = lambda w: (w["x0"] < margin) & F.trim(w["text"]).rlike(f"^(?:{numbers})")
        front = F.array_join(F.transform(F.filter("words", number), lambda w: F.trim(w["text"])), ".")
        text = F.trim(F.concat_ws(" ", front, joined(F.transform(F.filter("words", lambda w: ~number(w)), lambda w: w["text"]))))
    else:
        text = F.array_join(F.transform("words", lambda w: w["text"]), " ")
    return lines.select(*page, "line_no", F.col("start").alias("top"), text.alias("text"))


def inside(top: Column, table_top: Column, table_bottom: Column) -> Column:
    """Whether a line lies in a table's vertical extent, ends included."""
    return (top >= table_top) & (top <= table_bottom)


def longest_prefix(page: Column, wanted: Column, least: int = 12, most: int = 80) -> Column:
    """struct(at, length) of `wanted` on a page, white space aside: all of it, else its longest prefix of `least` to `most` characters; null if neither is there.

    at counts the page's characters without white space, from 0.  If a prefix is there, the
    shorter ones are too, so halving finds the longest one.
    """
    bare = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", "")
    text, mark = bare(page), bare(wanted)

    def search(x: Column) -> Column:
        text, mark = x["text"], x["mark"]
        top = F.least(F.length(mark), F.lit(most))
        middle = lambda s: F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        there = lambda n: F.contains(text, F.left(mark, n))
        # lo is there, hi + 1 isn't
        step = lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(F.when(there(middle(s)), F.struct(middle(s).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (middle(s) - 1).alias("hi"))))
        rounds = F.sequence(F.lit(1), F.lit(max(1, (most - least + 1).bit_length())))
        n = F.aggregate(rounds, F.struct(F.lit(least).alias("lo"), top.alias("hi")), step, lambda s: s["lo"])
        size = F.when(F.contains(text, mark), F.length(mark)).when((top >= least) & there(F.lit(least)), n)
        return F.when((mark != "") & size.isNotNull(), F.struct((F.instr(text, F.left(mark, size)) - 1).alias("at"), size.alias("length")))

    return F.transform(F.array(F.struct(text.alias("text"), mark.alias("mark"))), search)[0]
