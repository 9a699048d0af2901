"""Canonical forms of text. Spark has no Unicode normal forms, so NFKC runs in Arrow batches, for rows beyond ASCII."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values that the results depend on.
ZERO_WIDTH = r"[\u200b\u200c\u200d\ufeff\u2060]"
INVISIBLE = r"[\u200b\u200c\u200d\ufeff\u00ad\u2060\ufe0f\ufe0e]"
SPACES = r"[\s\u00a0\u2000-\u200a\u202f\u205f\u3000]+"
NUMBERED_ITEM = r"(?m)(^|[。；;])\d+(?:\.\d+)+[、.]?"
BOUNDARIES = "。；;！？!?．"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC form; ASCII rows have it already."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), _nfkc(text)).otherwise(text)


def canonical(text: Column) -> Column:
    """Compatibility form, invisible characters gone, white space of any kind as single spaces; null is empty."""
    shown = F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), INVISIBLE, "")
    return F.trim(F.regexp_replace(shown, SPACES, " "))


# ZERO_WIDTH, SPACES and NUMBERED_ITEM as Spark's expressions read them
_GONE = re.compile("[\u200b\u200c\u200d\ufeff\u2060 \t\n\v\f\r\u00a0\u2000-\u200a\u202f\u205f\u3000]+")
_ITEM = re.compile("(\\A|(?<=[\x85\u2028\u2029])|[。；;])[0-9]+(?:\\.[0-9]+)+[、.]?")
# what the first has besides the space, and what any item has
_RARE = re.compile("[\u200b\u200c\u200d\ufeff\u2060\t\n\v\f\r\u00a0\u2000-\u200a\u202f\u205f\u3000]")
_DOTTED = re.compile("[0-9]\\.[0-9]")


def _bare(text: str | None) -> str:
    if text is None:
        return ""
    text = (text if text.isascii() else unicodedata.normalize("NFKC", text)).replace(" ", "")
    return _GONE.sub("", text) if _RARE.search(text) else text


@F.pandas_udf(StringType())
def _key(texts: pd.Series) -> pd.Series:
    return texts.map(_bare)


def _numberless(text: str | None) -> str:
    bare = _bare(text)
    return _ITEM.sub(r"\1", bare) if _DOTTED.search(bare) else bare


@F.pandas_udf(StringType())
def _numberless_key(texts: pd.Series) -> pd.Series:
    return texts.map(_numberless)


def plain_key(text: str) -> str:
    """`content_key` with the case and numbers of items, of one text."""
    return _bare(text)


def folded_key(text: str) -> str:
    """`content_key` without them."""
    return _numberless(text).lower()


def content_key(text: Column, item_numbers: bool = True, fold: bool = True) -> Column:
    """What two paragraphs of the same content share: no white space and, if asked, no case or numbers of items; null is empty."""
    key = _key(text) if item_numbers else _numberless_key(text)
    return F.lower(key) if fold else key


def has_sentences(longer: Column, shorter: Column) -> Column:
    """Whether `shorter` stands in `longer` as whole sentences: bounded by ends of text or of sentences at some place."""
    n, m = F.length(shorter), F.length(longer)
    at = lambda i: F.contains(F.lit(BOUNDARIES), F.substring(longer, i, F.lit(1)))

    def here(i: Column) -> Column:
        before = (i == 1) | at(i - 1)
        after = (i + n - 1 == m) | at(i + n - 1) | at(i + n)
        return (F.substring(longer, i, n) == shorter) & before & after

    found = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), m - n + 1)), here)
    return F.when((n > 0) & (n < m) & F.contains(longer, shorter), found).otherwise(F.lit(False))
