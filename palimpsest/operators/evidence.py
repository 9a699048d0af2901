"""Evidence for a contradiction of two texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that the results depend on.
SEPARATORS = r"[\s，。；：、,.;:（）()]+"
FREQUENCY = r"每(?:[一二三四五六七八九十\d]+)?(?:天|日|周|月|季度|年)|\d+(?:天|日|周|月|季度|年|小时|分钟|次)"
CHUNK = r"[一-鿿]{2,6}"
PROHIBITIONS = ("禁止", "不得", "严禁", "不允许")
PERMISSIONS = ("允许", "可以", "可使用", "可访问", "必须", "应当")
TARGET = r"(?:禁止|不得|严禁|不允许)([^，。；;]*)"
TERM = r"[一-鿿]{2,6}|VPN|IP地址"
NO_TERMS = ("任何", "不得")
DUTY = "负责"
ACTIONS = ("审批", "审核", "维护", "维修", "安装", "培训", "考核", "监督", "保管", "解释", "运行", "管理")


def _all(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _has(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _same(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def kind_of_evidence(a: Column, b: Column) -> Column:
    """frequency, prohibition or duty, the first that the texts show; null if none. Null texts are empty.

    frequency: both name times or numbers, not the same ones, and share a chunk of two to
    six Chinese characters; prohibition: one forbids something that the other, which
    forbids nothing, names along with a permission or demand; duty: both assign the same
    action.  Texts that differ in white space and punctuation alone show none.
    """
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    bare = lambda x: F.regexp_replace(x, SEPARATORS, "")
    fa, fb = _all(a, FREQUENCY), _all(b, FREQUENCY)
    frequency = (F.size(fa) > 0) & (F.size(fb) > 0) & ~_same(fa, fb) & F.arrays_overlap(_all(a, CHUNK), _all(b, CHUNK))

    def forbids(one: Column, other: Column) -> Column:
        terms = F.filter(_all(F.regexp_extract(one, TARGET, 1), TERM), lambda t: ~t.isin(*NO_TERMS))
        return _has(one, PROHIBITIONS) & ~_has(other, PROHIBITIONS) & _has(other, PERMISSIONS) & F.exists(terms, lambda t: F.contains(other, t))

    duty = F.lit(False)
    for w in ACTIONS:
        duty = duty | (F.contains(a, F.lit(w)) & F.contains(b, F.lit(w)))
    duty = duty & F.contains(a, F.lit(DUTY)) & F.contains(b, F.lit(DUTY))
    found = F.when(frequency, "frequency").when(forbids(a, b) | forbids(b, a), "prohibition").when(duty, "duty")
    return F.when(bare(a) != bare(b), found)
