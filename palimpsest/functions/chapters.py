"""Column functions on lines of documents: numbered headings, new blocks, unfinished sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that the results depend on.
CHAPTER_PATTERNS = (
    r"^(\d+\.\d+\.\d+)\s+(.+)",
    r"^(\d+\.\d+)\s+(.+)",
    r"^(\d+)\s+(.+)",
    r"^第\s*(\d+)\s*[章节]\s*(.+)",
    r"^第\s*([一二三四五六七八九十百千]+)\s*[章节]\s*(.+)",
    r"^([一二三四五六七八九十]+)、\s*(.+)",
    r"^（([一二三四五六七八九十]+)）\s*(.+)",
)
CHINESE_NUMBER = r"^（?[一二三四五六七八九十]+[、）)]"
SINGLE_NUMBER = r"^\d+\s+.+"
TITLE_DATE = r"\d{4}[-./]\d{1,2}[-./]\d{1,2}"
TERMINATORS = ("．", "。", "：", ":")
LIST_END = "；，。、;,."
LIST_VERBS = ("负责", "建立", "整合", "加强", "完成", "管理与", "参与", "组织", "规划", "做好", "开展", "制定", "依据", "按照", "定期", "管理维护", "采集", "编制", "审批", "评估")
UNITS = (
    "万人次", "人月", "人年", "万小时", "小时", "万架次", "架次", "万公里", "公里", "万米", "万吨", "吨", "亿元", "万元", "千元", "元", "万方", "立方米", "平米", "平方米", "平方公里",
    "个月", "月份", "月", "年度", "季度", "天", "日", "号", "人次", "次", "个", "名", "家", "岁", "分", "秒", "‰", "%", "％",
)
LONGEST_HEADING, LONGEST_PLAIN_TITLE, LONGEST_VERB_TITLE, MOST_SEPARATORS = 80, 15, 12, 2
LIST_ITEM = r"^(?:\d+[.)、]\s|[a-zA-Z][.)]\s|[①②③④⑤⑥⑦⑧⑨⑩]|[•●]\s|[（(][一二三四五六七八九十]+[）)]|[一二三四五六七八九十]+[、．.]\s)"
BLOCK_HEADING = r"^(?:\d+(?:\.\d+)+\s|第\s*[\d一二三四五六七八九十百千]+\s*[章节条款]\s|[（(][一二三四五六七八九十]+[）)]\s)"
CJK = "[一-鿿　-〿＀-￯]"
SENTENCE_END = "。！？.!?；;"
CLOSING = "」』”’）)》】"

#: What every heading begins with; lines without it need no closer look.
_NUMBERED = r"^(?:\d|第|（|[一二三四五六七八九十])"


def stripped(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _split(bare: Column) -> Column:
    """struct<number, title> by the first pattern that fits, or null."""
    parts = [F.when(bare.rlike("(?U)" + p), F.struct(*[F.regexp_extract(bare, "(?U)" + p, n).alias(name) for n, name in ((1, "number"), (2, "title"))])) for p in CHAPTER_PATTERNS]
    return F.coalesce(*parts)


def _cut(bare: Column, whole: Column) -> Column:
    """The title; that of a Chinese number ends before the first terminator inside it."""
    inside = [F.when((F.instr(whole, t) > 1) & (F.instr(whole, t) < F.length(whole)), stripped(F.substring_index(whole, t, 1))) for t in TERMINATORS]
    return F.when(bare.rlike(CHINESE_NUMBER), F.coalesce(*inside, whole)).otherwise(whole)


def _refused(bare: Column, number: Column, title: Column) -> Column:
    plain = ~number.rlike(r"(?U)^0*\d{1,3}\z") | (F.length(title) > LONGEST_PLAIN_TITLE) | title.rlike("^(?:" + "|".join(UNITS) + ")")
    return (
        (F.length(title) < 2)
        | title.rlike(TITLE_DATE)
        | (F.length(F.regexp_replace(title, "[^、，]", "")) > MOST_SEPARATORS)
        | title.rlike(f"[{LIST_END}]\\z")
        | ((F.length(title) > LONGEST_VERB_TITLE) & title.rlike("^(?:" + "|".join(LIST_VERBS) + ")"))
        | (bare.rlike("(?U)" + SINGLE_NUMBER) & plain)
    )


def chapter(text: Column) -> Column:
    """struct<chapter, title> of a numbered heading, null for any other text.

    The first pattern that fits decides; its title may then be refused: too short, with a
    date, a list, the end or the verb of a list item, or (plain numbers) too long, a unit
    or a year.
    """

    def titled(bare: Column, s: Column) -> Column:
        return let(_cut(bare, stripped(s.title)), lambda t: F.when(~_refused(bare, s.number, t), F.struct(s.number.alias("chapter"), t.alias("title"))))

    def found(bare: Column) -> Column:
        return let(_split(bare), lambda s: F.when(s.isNotNull(), titled(bare, s)))

    return let(stripped(text), lambda bare: F.when(bare.rlike(_NUMBERED) & (F.length(bare) <= LONGEST_HEADING), found(bare)))


def is_heading(text: Column) -> Column:
    return F.coalesce(chapter(text).isNotNull(), F.lit(False))


def unfinished(text: Column) -> Column:
    """text stops within a sentence; a colon at the end is no such stop."""
    bare = stripped(text)
    return (bare != "") & ~bare.rlike(f"[{SENTENCE_END}：:]\\z") & ~bare.rlike(f"[{SENTENCE_END}][{CLOSING}]\\z")


def starts_block(text: Column) -> Column:
    """text begins like a heading or a list item."""
    bare = stripped(text)
    return bare.rlike("(?U)" + BLOCK_HEADING) | bare.rlike("(?U)" + LIST_ITEM)


def joined(parts: Column) -> Column:
    """The parts with spaces between them; none between two Chinese or full-width characters."""
    return F.regexp_replace(F.array_join(parts, " "), f"(?U)(?<={CJK})\\s+(?={CJK})", "")
