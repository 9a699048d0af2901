"""Registered queries on layout and life cycle, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.text import repair_decimals
from palimpsest.operators import continued, evidence, layout, lifecycle, pairing, paragraphs
from palimpsest.plans import catalogue as base


def _docs(spark, sf_dir):
    return base._documents(spark, sf_dir)


def _lines(spark, sf_dir):
    return paragraphs.paragraph_lines(_docs(spark, sf_dir))


def _markdown(spark, sf_dir):
    # lines as Markdown: every ninth is a heading, three after it a table
    n = F.col("line_no") % 9
    line = F.when(n == 0, F.concat(F.lit("## "), "line")).when(n == 4, F.concat(F.lit("| "), F.left("line", F.lit(9)), F.lit(" | x |"))).when(n == 5, "|---|---|").when(n == 6, "| y | z |").otherwise(F.col("line"))
    return layout.markdown_blocks(_lines(spark, sf_dir).withColumn("line", line))


def _pages(spark, sf_dir):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    pages = _lines(spark, sf_dir).groupBy("doc_id", "page").agg(text.alias("text"))
    tables = F.when((F.col("doc_id") + F.col("page")) % 4 == 0, 1).otherwise(0)
    return pages.select("doc_id", "page", "text", tables.alias("n_tables"), (F.col("doc_id") % 3 == 0).alias("large_image"), (F.col("doc_id") % 5 == 0).alias("drawings"))


def _order(spark, sf_dir):
    lines = _lines(spark, sf_dir).where("trim(line) <> ''").select("doc_id", "page", (2 * F.col("line_no")).alias("pos"))
    return layout.reading_order(lines, lines.where("pos % 14 = 6").withColumn("pos", F.col("pos") + 1))


def _places(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    page = F.when(F.col("line_no") % 3 > 0, F.col("page"))
    chapter = F.when(F.col("line_no") % 2 == 1, F.concat_ws(".", "page", "line_no"))
    first, last = layout.padded_pages(F.col("page"), F.col("page"), 1)
    return lines.select("doc_id", "line_no", layout.location(page, chapter, F.when(F.col("line_no") % 3 == 2, F.left("line", F.lit(20))), F.col("line_no")).alias("location"), first.alias("first_page"), last.alias("last_page"), layout.heading_markdown(F.concat_ws(".", "page", "line_no"), F.left("line", F.lit(12))).alias("heading"))


def _store(spark, sf_dir):
    status = F.when(F.col("doc_id") % 4 == 1, "inactive").otherwise("active")
    return _docs(spark, sf_dir).select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), (-F.col("doc_id")).alias("added_at"), status.alias("status"))


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _hash_hits(spark, sf_dir):
    rows = _store(spark, sf_dir)
    return lifecycle.active_with_hash(rows, rows.where("doc_id % 100 = 0")).select("doc_id", "sha256")


def _migrated(spark, sf_dir):
    name = F.concat(F.lit("/Data/ "), F.coalesce("source", F.lit("none")), F.lit("  File.PDF"))
    return lifecycle.migrated(_store(spark, sf_dir).select("doc_id", name.alias("name"), F.when(F.col("doc_id") % 2 == 0, lifecycle.family_id(name)).alias("family"), "added_at", "status"))


def _headers(spark, sf_dir):
    head = F.when(F.col("doc_id") % 3 == 0, "信息技术管理手册").when(F.col("doc_id") % 3 == 1, "运行安全手册：").otherwise("")
    text = F.concat(head, F.coalesce("text", F.lit("")))
    return _docs(spark, sf_dir).select("doc_id", layout.suspect_prefix(text).alias("prefix"))


def _decimals(spark, sf_dir):
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" 28. 55, "), F.col("doc_id").cast("string"), F.lit(" 10. %"))
    return _docs(spark, sf_dir).select("doc_id", repair_decimals(text).alias("text"))


def _summaries(spark, sf_dir):
    return base._changes(spark, sf_dir).select("doc_id", "kind", "old_no", "new_no", lifecycle.change_summary(F.col("kind"), F.col("old_line"), F.col("new_line")).alias("summary"))


#: Clauses put after texts in turn, so that pairs of them contradict each other in every way, or not at all.
CLAUSES = ("设备，每月检查一次", "设备，每季度检查一次", "禁止使用外部网络", "可以使用外部网络", "班组长负责审核", "值班员负责审核", "")


def _clause(shift):
    return F.element_at(F.array(*map(F.lit, CLAUSES)), F.pmod(F.col("doc_id") + shift, F.lit(len(CLAUSES))).cast("int") + 1)


def _judged(spark, sf_dir):
    items = _labels(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    text = F.coalesce("text", F.lit(""))
    shown = evidence.kind_of_evidence(F.concat(text, _clause(0)), F.concat(text, _clause(1)))
    items = items.select("doc_id", (F.coalesce("toxic", F.lit(0)) == 1).alias("inconsistent"), F.when(F.col("quality") == 1, "high").otherwise("low").alias("confidence"), shown.isNotNull().alias("evidence"), "text")
    return lifecycle.judged(items).select("doc_id", "verdict", "excerpt")


def _evidence(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    rows = _docs(spark, sf_dir).select("doc_id", evidence.kind_of_evidence(F.concat(text, _clause(0)), F.concat(text, _clause(1))).alias("evidence"))
    return rows.withColumn("evidence", F.coalesce("evidence", F.lit("none")))


def _cells(spark, sf_dir):
    rows = base._customers(spark, sf_dir)
    columns = [F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")), F.lit(float("nan")), F.concat(F.col("c_mktsegment"), F.lit("|x\ny")), F.col("c_nationkey")]
    return rows.select("c_custkey", layout.row_markdown(columns).alias("line"), layout.is_sparse(F.array(*map(layout.cell, columns))).alias("sparse"))


#: Letters that the second version writes as capitals.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _same_content(spark, sf_dir):
    # the second version numbers its lines and breaks some of them apart
    lines = _lines(spark, sf_dir).select("doc_id", F.lit("1").alias("chapter"), F.col("line_no").alias("no"), F.col("line").alias("text"))
    new = lines.withColumn("text", F.when(F.col("no") % 3 == 0, F.concat(F.lit("3.1、"), "text")).when(F.col("no") % 3 == 1, F.concat(F.lit("。"), F.translate("text", LETTERS, LETTERS.upper()), F.lit("。 more"))).otherwise(F.reverse("text")))
    return pairing.same_content(lines, new).drop("chapter")


def _joined_tables(spark, sf_dir):
    # orders of a customer as parts of tables, some with a repeated header and some on a page far off
    parts = base._orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 11).alias("page")).agg(F.array_sort(F.collect_list(F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"))).alias("body"))
    head = F.array(F.lit("key"), F.lit("status"), F.lit("priority"))
    rows = F.when((F.col("doc_id") + F.col("page")) % 2 == 0, F.concat(F.array(head), "body")).otherwise(F.col("body"))
    # a column and a row without anything, as extraction leaves them, are cleaned off
    rows = continued.cleaned(F.concat(F.transform(rows, lambda r: F.concat(r, F.array(F.lit(" ")))), F.array(F.array(F.lit("")))))
    share = lambda k: (F.col("page") % k / k).cast("double")
    parts = parts.select("doc_id", "page", F.lit(0).cast("long").alias("pos"), F.when(F.col("page") % 4 == 0, "3.1").otherwise("").alias("chapter"), share(5).alias("top"), share(3).alias("bottom"), rows.alias("rows"))
    out = continued.joined(parts)
    return out.select("doc_id", "table_no", "page", "page_end", "chapter", F.size("rows").alias("n_rows"), F.array_join(F.flatten("rows"), "|").alias("cells"))


QUERIES: dict = {
    "same_content_pairs": _same_content,
    "tables_over_pages": _joined_tables,
    "markdown_blocks": _markdown,
    "parser_routes": lambda s, d: layout.routes(_pages(s, d)).withColumns({c: F.round(c, 6) for c in ("avg_text", "avg_tables")}),
    "reading_order": _order,
    "item_locations": _places,
    "band_filter": lambda s, d: _lines(s, d).select("doc_id", "line_no", layout.in_bands(F.col("line_no") % 20 * 42.0, F.lit(842.0)).alias("in_band")),
    "strip_header_prefixes": lambda s, d: layout.strip_prefixes(_lines(s, d)),
    "suspect_header_prefixes": _headers,
    "repair_decimals": _decimals,
    "table_markdown_rows": _cells,
    "list_documents": lambda s, d: lifecycle.listed(_store(s, d), True).select("doc_id", "status"),
    "delete_documents": lambda s, d: lifecycle.removed(_store(s, d), _labels(s, d).where("toxic = 1")).select("doc_id", "status"),
    "active_by_hash": _hash_hits,
    "migrate_store": _migrated,
    "recent_sessions": lambda s, d: lifecycle.recent_sessions(base._turns(s, d)),
    "chapter_first_lines": lambda s, d: lifecycle.first_chapters(paragraphs.chapter_forward_fill(_docs(s, d))),
    "search_pairs_once": lambda s, d: lifecycle.unordered_pairs(base._hits(s, d, 10), "query_id", "vec_id"),
    "issue_ids": lambda s, d: lifecycle.issue_ids(paragraphs.parse_issues(_docs(s, d))).select("doc_id", "line_no", "kind", "issue_id"),
    "high_risk_issues": lambda s, d: paragraphs.parse_issues(_docs(s, d)).where("risk = 'high'"),
    "change_summaries": _summaries,
    "judge_results": _judged,
    "conflict_evidence": _evidence,
}

_STORE = "st as (select doc_id, source, sha256(coalesce(text, '')) as sha256, -doc_id as added_at, case when doc_id % 4 = 1 then 'inactive' else 'active' end as status from documents)"
_WORDS = " + ".join(f"contains({{0}}, '{w}')::int" for w in layout.TABLE_WORDS)
_WITH = " + ".join(f"contains({{0}}, '{w}')::int" for w in layout.SERIAL_WITH)

_FREQUENCY = r"每(?:[一二三四五六七八九十\d]+)?(?:天|日|周|月|季度|年)|\d+(?:天|日|周|月|季度|年|小时|分钟|次)"
_FORBIDS = "regexp_matches({0}, '禁止|不得|严禁|不允许') and not regexp_matches({1}, '禁止|不得|严禁|不允许') and regexp_matches({1}, '允许|可以|可使用|可访问|必须|应当') and len(list_filter(regexp_extract_all(regexp_extract({0}, '(?:禁止|不得|严禁|不允许)([^，。；;]*)', 1), '[一-鿿]{{2,6}}|VPN|IP地址'), lambda t: t not in ('任何', '不得') and contains({1}, t))) > 0"
_DUTIES = " or ".join(f"(contains(a, '{w}') and contains(b, '{w}'))" for w in evidence.ACTIONS)
_EVIDENCE = f"""ab as (select doc_id, coalesce(text, '') || {list(CLAUSES)}[doc_id % {len(CLAUSES)} + 1] as a, coalesce(text, '') || {list(CLAUSES)}[(doc_id + 1) % {len(CLAUSES)} + 1] as b from documents),
sets as (select *, list_sort(list_distinct(regexp_extract_all(a, '{_FREQUENCY}'))) as fa, list_sort(list_distinct(regexp_extract_all(b, '{_FREQUENCY}'))) as fb, regexp_extract_all(a, '[一-鿿]{{2,6}}') as ca, regexp_extract_all(b, '[一-鿿]{{2,6}}') as cb from ab),
shown as (select doc_id, case when regexp_replace(a, '[\\s，。；：、,.;:（）()]+', '', 'g') = regexp_replace(b, '[\\s，。；：、,.;:（）()]+', '', 'g') then 'none'
  when len(fa) > 0 and len(fb) > 0 and fa <> fb and len(list_intersect(ca, cb)) > 0 then 'frequency'
  when ({_FORBIDS.format("a", "b")}) or ({_FORBIDS.format("b", "a")}) then 'prohibition'
  when contains(a, '负责') and contains(b, '负责') and ({_DUTIES}) then 'duty' else 'none' end as evidence from sets)"""

ORACLES: dict[str, str] = {
    "markdown_blocks": f"""with {base._LINES}, m as (select doc_id, line_no, trim(case line_no % 9 when 0 then '## ' || line when 4 then '| ' || left(line, 9) || ' | x |' when 5 then '|---|---|' when 6 then '| y | z |' else line end) as bare from lines),
k as (select *, case when regexp_matches(bare, '^#{{1,6}}\\s') then 'heading' when regexp_matches(bare, '^\\|?[ :|-]*-[ :|-]*\\|?$') then 'separator' when bare[1] = '|' then 'row' when bare = '' then 'empty' else 'paragraph' end as kind from m),
b as (select *, kind in ('row', 'separator') and not coalesce(lag(kind) over (partition by doc_id order by line_no) in ('row', 'separator'), false) as begins from k),
t as (select *, case when kind in ('row', 'separator') then sum(begins::int) over (partition by doc_id order by line_no) end as table_no from b)
select doc_id, line_no, kind, case when kind = 'heading' then length(regexp_extract(bare, '^#+'))::int else 0 end as level, coalesce(table_no, 0)::int as table_no, case when kind = 'heading' then regexp_replace(bare, '^#+\\s+', '') else bare end as text
from t where kind not in ('separator', 'empty')""",
    "parser_routes": f"""with {base._LINES}, p as (select doc_id, page, string_agg(line, chr(10) order by line_no) as text from placed group by all),
n as (select doc_id, max(page)::int as n_pages from p group by doc_id),
c as (select doc_id, n_pages, unnest(case when n_pages <= 5 then range(n_pages) else list_distinct([round_even(i * (n_pages - 1) / 4, 0)::bigint for i in range(5)]) end) as place from n),
s as (select p.doc_id, n_pages, text, case when (p.doc_id + page) % 4 = 0 then 1 else 0 end as tables, p.doc_id % 3 = 0 as image, p.doc_id % 5 = 0 as drawings, regexp_replace(text, '\\s+', ' ', 'g') as flat, regexp_replace(text, '\\s+', '', 'g') as compact from p join c on p.doc_id = c.doc_id and p.page = c.place + 1),
h as (select *, regexp_matches(text, '\\S+\\s{{3,}}\\S+\\s{{3,}}\\S+') as aligned, ({_WORDS.format('text')}) > 0 as worded, {_WORDS.format('flat')} as hits, contains(compact, '{layout.SERIAL}') and ({_WITH.format('flat')}) > 0 as pair, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) <= 80 and regexp_matches(trim(x), '\\S+\\s+\\S+\\s+\\S'))) as short from s),
a as (select doc_id, n_pages, avg(length(text)) as avg_text, avg(tables) as avg_tables, avg(image::int) as images, bool_or(drawings) and sum(tables) = 0 as bare, bool_or(pair or (hits >= 2 and (aligned or short >= 2))) or (avg(worded::int) >= 0.5 and avg(aligned::int) >= 0.3) as hinted from h group by all)
select doc_id, n_pages, round(avg_text, 6) as avg_text, round(avg_tables, 6) as avg_tables, case when avg_text < 50 or (images > 0.5 and avg_text < 300) then 'scan' when (bare or hinted) and avg_tables < 0.3 then 'layout' else 'text' end as route from a""",
    "reading_order": f"""with {base._LINES}, p as (select doc_id, page, 2 * line_no as pos from placed where trim(line) <> ''),
u as (select doc_id, page, pos, 'paragraph' as kind from p union all select doc_id, page, pos + 1, 'table' from p where pos % 14 = 6)
select doc_id, row_number() over (partition by doc_id order by page, pos, kind)::int as item_no, kind, page, pos from u""",
    "item_locations": f"""with {base._LINES}, x as (select *, concat_ws(' / ', case when line_no % 3 > 0 then 'p.' || page end, case when line_no % 2 = 1 then '§' || page || '.' || line_no end, case when line_no % 3 = 2 and line <> '' then left(line, 20) end) as parts from placed)
select doc_id, line_no, case when parts <> '' then parts else '#' || line_no end as location, greatest(1, page - 1) as first_page, page + 1 as last_page, '## ' || trim(page || '.' || line_no || ' ' || left(line, 12)) as heading from x""",
    "band_filter": f"with {base._LINES} select doc_id, line_no, (line_no % 20 * 42.0 < 842.0 * 0.08 + 3 or line_no % 20 * 42.0 > 842.0 * 0.92 - 3) as in_band from lines",
    "strip_header_prefixes": f"""with {base._LINES}, l as (select doc_id, line_no, line from lines where trim(line) <> ''), n as (select doc_id, count(*) as total from l group by doc_id),
s as (select doc_id, line_no, left(line, k) as prefix, k from l, lateral (select unnest(range(8, 21)) as k) where k <= length(line)),
f as (select doc_id, prefix from s join n using (doc_id) where total >= 8 group by doc_id, prefix, total having count(*) >= greatest(3, floor(total * 0.08))),
c as (select doc_id, line_no, max(k) as cut from s join f using (doc_id, prefix) group by all),
o as (select doc_id, line_no, trim(substr(line, (coalesce(cut, 0) + 1)::int)) as line from l left join c using (doc_id, line_no))
select * from o where line <> ''""",
    "suspect_header_prefixes": f"""with t as (select doc_id, case doc_id % 3 when 0 then '信息技术管理手册' when 1 then '运行安全手册：' else '' end || coalesce(text, '') as t from documents),
p as (select *, regexp_extract(t, '{layout.HEADER_HINTS}') as found from t), r as (select *, substr(t, length(found) + 1) as rest from p)
select doc_id, case when found <> '' and length(rest) >= 6 and left(rest, 1) not in ('：', ':', '。') then found end as prefix from r""",
    "repair_decimals": r"""with t as (select doc_id, coalesce(text, '') || ' 28. 55, ' || doc_id || ' 10. %' as t from documents)
select doc_id, regexp_replace(regexp_replace(t, '(\d)\.\s+(\d)', '\1.\2', 'g'), '(\d+)\s+(\d+)\.(\s*(?:万|亿|％|%|吨|米|公里))', '\1.\2\3', 'g') as text from t""",
    "table_markdown_rows": """with r as (select c_custkey, case when c_custkey % 3 = 0 then trim(c_name) else '' end as a, trim(c_mktsegment || '|x' || chr(10) || 'y') as b, trim(c_nationkey::varchar) as c from customer)
select c_custkey, '| ' || concat_ws(' | ', replace(a, '|', '\\|'), '', replace(replace(b, chr(10), ' '), '|', '\\|'), c) || ' |' as line, (a = '')::int + 1 >= 0.4 * 4 as sparse from r""",
    "list_documents": f"with {_STORE} select doc_id, status from st",
    "delete_documents": f"with {_STORE} select doc_id, case when doc_id in (select doc_id from labels where toxic = 1) then 'removed' else status end as status from st",
    "active_by_hash": f"with {_STORE} select doc_id, sha256 from st where status = 'active' and sha256 in (select sha256 from st where doc_id % 100 = 0)",
    "migrate_store": f"""with {_STORE}, f as (select *, left(sha256(lower(coalesce(source, 'none') || ' file.pdf')), 16) as family from st),
n as (select family, max(added_at) filter (where status = 'active') as newest from f group by family)
select doc_id, family, case when status = 'active' and added_at <> newest then 'inactive' else status end as status from f join n using (family)""",
    "recent_sessions": "select conv_id, max(turn) as last_turn from conversations group by conv_id order by last_turn desc, conv_id limit 50",
    "chapter_first_lines": f"with f as ({base.ORACLES['chapter_forward_fill']}) select doc_id, chapter, min(line_no) as line_no from f where chapter <> '' group by all",
    "search_pairs_once": f"with f as materialized ({base.ORACLES['semantic_search_topk']}) select distinct least(query_id, vec_id) as a, greatest(query_id, vec_id) as b from f where query_id <> vec_id",
    "issue_ids": f"""with {base._ODD}, r as (select *, row_number() over (partition by doc_id, kind, line_no order by risk) as k from issues)
select doc_id, line_no, kind, kind || '-' || line_no || case when k > 1 then '-' || k else '' end as issue_id from r""",
    "high_risk_issues": f"with {base._ODD} select doc_id, line_no, kind, risk from issues where risk = 'high'",
    "change_summaries": f"""with recursive {base._CHANGED}, t as (select *, trim(replace(coalesce(old_line, ''), chr(10), ' ')) as o, trim(replace(coalesce(new_line, ''), chr(10), ' ')) as n from changes)
select doc_id, kind, old_no, new_no, case kind when 'added' then '[新增] ' || left(n, 160) when 'removed' then '[删除] ' || left(o, 160) else case when o <> '' and n <> '' then '[修改] ' || left(o, 80) || ' → ' || left(n, 80) else '[修改] 内容发生变化' end end as summary from t""",
    "same_content_pairs": f"""with recursive {base._LINES}, t as (select doc_id, line_no as no, line, case line_no % 3 when 0 then '3.1、' || line when 1 then '。' || translate(line, '{LETTERS}', '{LETTERS.upper()}') || '。 more' else reverse(line) end as later from lines),
keys as (select doc_id, no, lower(regexp_replace(regexp_replace(line, '\\s+', '', 'g'), '(^|[。；;])\\d+(?:\\.\\d+)+[、.]?', '\\1', 'g')) as a, lower(regexp_replace(regexp_replace(later, '\\s+', '', 'g'), '(^|[。；;])\\d+(?:\\.\\d+)+[、.]?', '\\1', 'g')) as b from t),
c as (select o.doc_id, o.no as a, n.no as b, o.a = n.b as same, case when length(o.a) > length(n.b) then o.a else n.b end as l, case when length(o.a) > length(n.b) then n.b else o.a end as s
  from keys o join keys n on o.doc_id = n.doc_id and length(o.a) >= 12 and length(n.b) >= 12 and (o.a = n.b or contains(o.a, n.b) or contains(n.b, o.a))),
w as (select *, case when same then 2 else 1 end as rel from c where same or len(list_filter(range(1, length(l) - length(s) + 2), lambda i: substring(l, i, length(s)) = s
  and (i = 1 or contains('。；;！？!?．', substring(l, i - 1, 1))) and (i + length(s) - 1 = length(l) or contains('。；;！？!?．', right(s, 1)) or contains('。；;！？!?．', substring(l, i + length(s), 1))))) > 0),
g as (select doc_id, list({{'a': a, 'b': b, 'rel': rel}} order by a, rel desc, abs(a - b), b) as rest, null::struct(a int, b int, rel int) as take from w group by doc_id
  union all select doc_id, list_filter(rest, lambda x: x.a <> rest[1].a and x.b <> rest[1].b), rest[1] from g where len(rest) > 0)
select doc_id, take.a as a, take.b as b, case when take.rel = 2 then 1.0 else 0.95 end as score from g where take is not null""",
    "conflict_evidence": f"with {_EVIDENCE} select doc_id, evidence from shown",
    "judge_results": f"""with {_EVIDENCE} select doc_id, case when coalesce(toxic, 0) <> 1 then 'consistent' when quality = 1 and evidence <> 'none' then 'inconsistent' else 'suspect' end as verdict, left(coalesce(text, ''), 80) as excerpt
from labels join documents using (doc_id) join shown using (doc_id)""",
}
