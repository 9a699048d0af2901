"""Column functions on text: normal forms, grams, quantities, noise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that the results depend on.
QUANTITY = r"(?i)(?<![\d.])\d+(?:\.\d+)?\s*(?:%|％|秒|分钟|小时|天|人|个|次|项|台|年|月|日|[KMGT]B)(?![A-Za-z0-9_])"
VERSION_STAMPS = (r"R\d+-\d{2,}", r"BK-J-\d+", r"版次[：:]\s*\S+")
REVISION_DATE = r"修订日期[：:]\s*\d{4}[-年./]\s*\d{1,2}[-月./]\s*\d{1,2}[日]?"
STANDALONE_DATE = r"(?:^\s*|\b)\d{4}[-./]\s*\d{1,2}[-./]\s*\d{1,2}\s*(?:$|\b)"
TRACKING_HINTS = r"有效页清单|修订记录表|发放清单|修改记录"
CITATION = r"［\s*(\d+)\s*］"
HEADING_PREFIX = r"^\s*(?:(?:第\s*)?\d+(?:\.\d+){0,4}\s*)"
TOC_ENTRY = r"^\d+(?:\.\d+)*\s+\S"


def strip_patterns(text: Column, patterns: Sequence[str]) -> Column:
    """text without what the patterns match, trimmed."""
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return F.trim(text)


def strip_revision_noise(text: Column, stamps: Sequence[str] = VERSION_STAMPS) -> Column:
    return strip_patterns(text, (REVISION_DATE, STANDALONE_DATE, *stamps))


def match_key(text: Column) -> Column:
    """text in lower case without white space: what makes two paragraphs the same."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def citations(text: Column) -> Column:
    """Full-width citation brackets as [n]; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), CITATION, "[$1]")


def bigrams(text: Column) -> Column:
    """Distinct character pairs; none for shorter texts."""
    # characters are taken apart once, as a substring counts its way from the start
    chars = F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    pairs = F.transform(chars, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda x, y: F.concat(x, y)))
    return F.when(F.length(text) >= 2, F.array_distinct(pairs[0])).otherwise(F.array().cast("array<string>"))


def window_hashes(text: Column, size: int) -> Column:
    """Distinct hashes of all windows of `size` characters, in time linear in the text."""
    windows = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
    return F.array_distinct(F.transform(windows, lambda w: F.xxhash64(w)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays taken as sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def repair_decimals(text: Column) -> Column:
    """Decimals that extraction tore apart: `28. 55` and, before a unit, `57 10. 万`."""
    joined = F.regexp_replace(text, r"(\d)\.\s+(\d)", "$1.$2")
    return F.regexp_replace(joined, r"(\d+)\s+(\d+)\.(\s*(?:万|亿|％|%|吨|米|公里))", "$1.$2$3")


def quantities(text: Column) -> Column:
    """Numbers with a unit, in order, white space removed first."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    return F.regexp_extract_all(bare, F.lit(QUANTITY), F.lit(0))


def heading_core(text: Column) -> Column:
    """A heading without its number, white space and outer punctuation."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), HEADING_PREFIX, ""), r"\s+", "")
    return F.regexp_replace(F.btrim(bare, F.lit(" ：:、．.")), "^(?:相关|支持性)", "")


def is_noise(text: Column, patterns: Sequence[str] = (), least: int = 6, toc: int = 40) -> Column:
    """Layout noise: empty, short, matched by a pattern, or a short entry of a contents list."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    found = (F.length(bare) < least) | ((F.length(bare) <= toc) & bare.rlike(TOC_ENTRY))
    for p in patterns:
        found = found | bare.rlike(p)
    return found


def any_of(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur in text."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
