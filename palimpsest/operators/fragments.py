"""What differs between two texts: fragments, their kinds, direction and description."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import any_of

# Fixed values that the results depend on.
SECTION = r"^\d+(?:[.\-]\d+){0,3}\z"
VALUE = r"\d+\.?\d*\s*(?:天|日|月|年|分钟|小时|秒|次|%|元|万|人|台|个|项|条|页|周)"
DATE = r"\d{4}[.\-/]\d{1,2}[.\-/]?\d{0,2}|\d{4}\s*年\s*\d{1,2}\s*月|[零〇一二三四五六七八九十百千万两]+\s*年\s*[零〇一二三四五六七八九十百千万两]+\s*月(?:\s*[零〇一二三四五六七八九十百千万两]+\s*[日号])?"
VERSION = r"^[RVv]?\d+[.\-]\d+\z|^第?\d+版\z"
MANAGEMENT = ("修订", "版次", "版本", "生效", "批准", "发布", "页码", "页号", "受控", "编号", "手册编号", "文件编号", "下载时间", "打印")
SENTENCE_END = "。；！？.;!？"
CHINESE_SHARE, SHORT_FRAGMENTS, LEAST_ONE_WAY = 0.3, 30, 8


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("tag", "old", "new")])))
def token_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Replaced, deleted and inserted runs of tokens: characters where old is over 30 % Chinese, else words."""

    def one(a, b):
        a, b = a or "", b or ""
        chars = sum("一" <= c <= "鿿" for c in a) > len(a) * CHINESE_SHARE
        x, y, sep = (list(a), list(b), "") if chars else (a.split(), b.split(), " ")
        steps = difflib.SequenceMatcher(None, x, y).get_opcodes()
        return [{"tag": t, "old": sep.join(x[i:j]), "new": sep.join(y[k:m])} for t, i, j, k, m in steps if t != "equal"]

    return pd.Series([one(a, b) for a, b in zip(old, new)])


@F.pandas_udf(T.DoubleType())
def likeness(old: pd.Series, new: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters; null if a text is null."""
    both = [None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(old, new)]
    return pd.Series(both, dtype="float64")


def may_be_one_way(a: str, b: str) -> bool:
    """Whether all of the shorter text can stand in the longer one, with LEAST_ONE_WAY characters and a sentence's end more."""
    a, b = (a, b) if len(a) > len(b) else (b, a)
    if len(a) - len(b) < LEAST_ONE_WAY or not any(a.count(c) > b.count(c) for c in SENTENCE_END):
        return False
    at = 0
    for c in b:
        at = a.find(c, at) + 1
        if not at:
            return False
    return True


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("direction", "text")]))
def one_way(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """deleted or inserted, and the text, if the change only does one of the two and has a sentence's end; else nulls."""

    def one(a, b):
        a, b = a or "", b or ""
        # the matcher takes time with the square of a text's length at worst
        if not may_be_one_way(a, b):
            return None, None
        steps = [s for s in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if s[0] != "equal"]
        tags = {s[0] for s in steps}
        if len(tags) != 1 or "replace" in tags:
            return None, None
        text = "".join(a[i:j] + b[k:m] for _, i, j, k, m in steps).strip()
        if len(text) < LEAST_ONE_WAY or not any(c in SENTENCE_END for c in text):
            return None, None
        return "deleted" if "delete" in tags else "inserted", text

    return pd.DataFrame([one(a, b) for a, b in zip(old, new)], columns=["direction", "text"])


def fragment_kind(old: Column, new: Column, context: Column) -> Column:
    """section_ref, version, date, numeric_value, mgmt_info, ambiguous_number or text_content."""
    a, b = F.trim(old), F.trim(new)
    section = lambda x: x.rlike(SECTION)
    number = lambda x: F.regexp_replace(x, r"[.\-]", "").rlike(r"^\d+\z")
    either = lambda p: a.rlike(p) | b.rlike(p)
    both = F.concat(a, b)
    managed = (any_of(context, MANAGEMENT) > 0) & (F.length(both) < SHORT_FRAGMENTS) & (both.rlike(DATE) | both.rlike(VERSION))
    return (
        F.when((section(a) & (section(b) | (b == ""))) | (section(b) & (a == "")), "section_ref")
        .when(either(VERSION), "version")
        .when(either(DATE), "date")
        .when(either(VALUE), "numeric_value")
        .when(managed, "mgmt_info")
        .when(number(a) & number(b), "ambiguous_number")
        .otherwise("text_content")
    )


def annotated(fragments: Column, old: Column, new: Column) -> Column:
    """fragments with their kind."""
    context = F.concat(F.coalesce(old, F.lit("")), F.lit(" "), F.coalesce(new, F.lit("")))
    return F.transform(fragments, lambda f: F.struct(f.tag.alias("tag"), f.old.alias("old"), f.new.alias("new"), fragment_kind(f.old, f.new, context).alias("kind")))


def changed_chars(fragments: Column) -> Column:
    return F.aggregate(fragments, F.lit(0), lambda n, f: n + F.length(f.old) + F.length(f.new))


def description(fragments: Column, old: Column, new: Column) -> Column:
    """numbers (with the first three new ones), minor, partial or major; none without fragments."""
    found = lambda x: F.array_distinct(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\d+\.?\d*"), F.lit(0)))
    fresh = F.array_sort(F.array_except(found(new), found(old)))
    share = changed_chars(fragments) / F.greatest(F.length(old), F.length(new), F.lit(1))
    return (
        F.when(F.size(fragments) == 0, "none")
        .when(F.size(fresh) > 0, F.concat(F.lit("numbers: "), F.array_join(F.slice(fresh, 1, 3), ", ")))
        .when(share < 0.1, "minor")
        .when(share < 0.3, "partial")
        .otherwise("major")
    )
