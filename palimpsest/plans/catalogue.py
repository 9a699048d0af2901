"""Registered queries on paragraphs, searches, changes, tables, stores, pages and streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.text import citations
from palimpsest.operators import changes, matching, paragraphs, retrieval, sessions, store, tables
from palimpsest.sources import html
from palimpsest.streaming import progress

#: Cosine from which two vectors may be partners.
PARTNER = 0.3


def _read(name):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


_documents, _embeddings, _turns, _events, _pages = map(_read, ("documents", "embeddings", "conversations", "events", "pages"))
_orders, _customers, _parts = map(_read, ("orders", "customer", "part"))


def _search(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    found = retrieval.top_k(rows, rows.where("vec_id % 100 = 0"), 10)
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def _pairs(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return paragraphs.exact_pairs(docs, _second(docs))


def _hits(spark, sf_dir, k):
    rows = _embeddings(spark, sf_dir)
    return retrieval.top_k(rows, rows.where("vec_id % 100 = 0"), k)


def _candidates(spark, sf_dir):
    found = _hits(spark, sf_dir, 4).where("query_id <> vec_id and score >= 0.3")
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"))


def _greedy(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    edges = retrieval.pairs_above(rows.where("vec_id % 100 = 0"), rows.where("vec_id % 100 <> 0"), PARTNER)
    return matching.greedy_match(edges.withColumn("score", F.round("score", 6)), PARTNER)


def _active_hits(spark, sf_dir):
    rows, labels = _embeddings(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    active = rows.join(labels.where("toxic = 1").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")
    found = retrieval.top_k(active, rows.where("vec_id % 100 = 0"), 5)
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def _conflicts(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "source", "text")
    pairs = matching.conflict_pairs(_hits(spark, sf_dir, 10).join(docs, "vec_id"), score=0.1, low=0.2)
    return pairs.withColumn("likeness", F.round("likeness", 6))


def _second(docs):
    """A later version of each document, derived from its lines: some go, some are rewritten, one comes."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when(i % 7 == 3, None).when(i % 5 == 2, F.concat(x, F.lit(" 30 GB"))).otherwise(x))
    kept = F.filter(lines, lambda x: x.isNotNull())
    return docs.withColumn("text", F.array_join(F.concat(kept, F.array(F.concat(F.lit("Added to "), F.col("doc_id").cast("string")))), "\n"))


def _changes(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return changes.line_changes(docs, _second(docs))


def _buckets(spark, sf_dir):
    return changes.substantive(_changes(spark, sf_dir)).groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _order_versions(spark, sf_dir):
    old = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = old.where("o_orderkey % 17 <> 0").withColumn("o_orderstatus", F.expr("case when o_orderkey % 10 = 3 then 'X' else o_orderstatus end"))
    return old.where("o_orderkey % 19 <> 5"), new, "o_orderkey", ["o_orderstatus", "o_orderpriority"]


def _headings(spark, sf_dir):
    lines = paragraphs.paragraph_lines(_documents(spark, sf_dir))
    found = lines.where((F.length("line") <= 20) & F.endswith("line", F.lit(".")))
    pages = lines.select("doc_id", "page", F.col("page").alias("table_no")).distinct()
    return tables.chapters_asof(pages, found.select("doc_id", "page", F.col("line_no").alias("pos"), F.col("line").alias("chapter")))


def _promoted(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "source")
    oldest = docs.groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    return store.promote(store.latest_active(docs, "source"), oldest.where("source <> 'src1'"), "source")


def _removed(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return store.remove(_documents(spark, sf_dir).select("doc_id", "source"), labels.where("toxic = 1"))


def _table_rows(spark, sf_dir):
    """Rows of tables that are put into two of three pages: the page's title, its number, and cells with tags and signs."""
    head, number = F.lit("<table class='t'><TR><th>Title</th><th scope=col>No &amp; mark</th></TR>"), F.col("page_id").cast("string")
    body = F.concat(F.lit("<tr>\n<td>"), F.coalesce(F.regexp_extract("html", html.TITLE, 1), F.lit("")), F.lit("</td><td><b>"), number, F.lit("</b> &lt;x&gt;</td></tr>"))
    pages = _pages(spark, sf_dir).withColumn("html", F.when(F.col("page_id") % 3 > 0, F.concat("html", head, F.when(F.col("page_id") % 3 == 2, body).otherwise(""), F.lit("<tr><td>end</td></tr></table>"))).otherwise(F.col("html")))
    return html.table_rows(pages).withColumn("cells", F.array_join("cells", "|"))


QUERIES: dict = {
    "semantic_search_topk": _search,
    "paragraph_lines": lambda s, d: paragraphs.paragraph_lines(_documents(s, d)),
    "repeated_lines": lambda s, d: paragraphs.repeated_lines(_documents(s, d)),
    "strip_repeated_lines": lambda s, d: paragraphs.strip_repeated_lines(_documents(s, d)),
    "exact_pairs_multiset": _pairs,
    "chapter_forward_fill": lambda s, d: paragraphs.chapter_forward_fill(_documents(s, d)),
    "latest_version_per_family": lambda s, d: paragraphs.latest_versions(_documents(s, d), "source"),
    "duplicate_uploads": lambda s, d: paragraphs.duplicate_uploads(_documents(s, d)),
    "session_summary": lambda s, d: sessions.session_summary(_turns(s, d)),
    "last_n_messages": lambda s, d: sessions.last_messages(_turns(s, d), 3),
    "progress_monotone": lambda s, d: sessions.progress_monotone(_events(s, d)),
    "task_state_latest": lambda s, d: sessions.task_state_latest(_events(s, d)),
    "progress_tumbling": lambda s, d: sessions.progress_tumbling(_events(s, d)),
    "library_candidates": _candidates,
    "search_active_only": _active_hits,
    "greedy_match_vectors": _greedy,
    "conflict_pairs_scored": _conflicts,
    "added_removed_paragraphs": lambda s, d: paragraphs.unmatched_lines(_documents(s, d), _second(_documents(s, d))),
    "duplicate_adjacent_lines": lambda s, d: paragraphs.repeated_neighbours(_documents(s, d)),
    "neighbor_context": lambda s, d: paragraphs.line_context(_documents(s, d)),
    "parse_qa_issues": lambda s, d: paragraphs.parse_issues(_documents(s, d)),
    "parse_qa_status": lambda s, d: paragraphs.parse_status(_documents(s, d)),
    "llm_candidate_ranking": lambda s, d: paragraphs.ranked_issues(_documents(s, d)),
    "version_compare": _changes,
    "change_kind_counts": lambda s, d: changes.change_counts(_changes(s, d)),
    "summary_quota": lambda s, d: changes.summary_quota(_changes(s, d), {"modified": 20, "added": 5, "removed": 5}).select("doc_id", "kind", "old_no", "new_no", "rank"),
    "absorbed_passages": lambda s, d: changes.absorbed_out(_changes(s, d)),
    "substantive_changes": _buckets,
    "table_row_diff": lambda s, d: tables.row_diff(*_order_versions(s, d)),
    "table_cell_diff": lambda s, d: tables.cell_diff(*_order_versions(s, d)),
    "table_to_rows_text": lambda s, d: tables.rows_text(_customers(s, d), "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"]),
    "template_table_filter": lambda s, d: tables.template_filter(_documents(s, d), "source", ["lang", "text"]),
    "row_token_jaccard": lambda s, d: tables.neighbour_likeness(_orders(s, d), "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"]).withColumn("likeness", F.round("likeness", 6)),
    "assign_chapter_asof": _headings,
    "promote_version": _promoted,
    "remove_documents": _removed,
    "doc_ids": lambda s, d: store.document_ids(_documents(s, d), "source"),
    "store_counters": lambda s, d: store.counters(store.latest_active(_documents(s, d), "source")),
    "normalize_citations": lambda s, d: _turns(s, d).select("conv_id", "turn", citations(F.concat("text", F.lit("［ "), "turn", F.lit("］"))).alias("text")),
    "html_title_text": lambda s, d: html.title_text(_pages(s, d)),
    "html_table_rows": _table_rows,
    "progress_sessions": lambda s, d: progress.sessions(_events(s, d)),
    "progress_state_changes": lambda s, d: progress.state_changes(_events(s, d)),
    "progress_stream_windows": lambda s, d: progress.drained(progress.windowed(progress.event_stream(s, d)), "windows"),
}

_LINES = """lines as (
  select doc_id, cast(i as int) as line_no, parts[i + 1] as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
       lateral (select unnest(range(len(parts))) as i)
), placed as (
  select doc_id, line_no, line, line_no // 20 + 1 as page,
         cast(coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from lines
)"""
_REPEATED = _LINES + """, repeated as (
  select l.doc_id, l.line, count(*) as n, max(p.pages) as pages
  from placed l join (select doc_id, max(page) as pages from placed group by doc_id) p using (doc_id)
  where trim(l.line) <> '' and length(l.line) < 100 group by l.doc_id, l.line
  having count(*) >= greatest(3, floor(max(p.pages) * 0.3))
)"""

ORACLES: dict[str, str] = {
    "semantic_search_topk": """with n as (select vec_id, cast(embedding as double[]) as e from embeddings),
s as (select q.vec_id as query_id, v.vec_id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) as score
      from n q, n v where q.vec_id % 100 = 0)
select query_id, vec_id, cast(rank as int) as rank, round(score, 6) as score
from (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from s) where rank <= 10""",
    "paragraph_lines": f"with {_LINES} select doc_id, line_no, line, start, page from placed",
    "repeated_lines": f"with {_REPEATED} select doc_id, line, n from repeated",
    "strip_repeated_lines": f"""with {_REPEATED}
select doc_id, cast(row_number() over (partition by doc_id order by line_no) as int) as paragraph_no, line
from placed p where not exists (select 1 from repeated r where r.doc_id = p.doc_id and r.line = p.line)""",
    "chapter_forward_fill": f"""with {_LINES}
select doc_id, line_no, coalesce(last_value(case when length(line) <= 20 and line like '%.' then line end ignore nulls)
  over (partition by doc_id order by line_no rows between unbounded preceding and current row), '') as chapter from lines""",
    "latest_version_per_family": "select source, max(doc_id) as latest, count(*) as versions from documents group by source",
    "duplicate_uploads": """select min(doc_id) as first_doc, count(*) as copies, left(sha256(coalesce(text, '')), 8) as short_id
from documents group by sha256(coalesce(text, '')) having count(*) > 1""",
    "session_summary": """select conv_id, count(*) as n_messages, count(*) filter (where role = 'user') as n_user,
coalesce(left(arg_min(text, turn) filter (where role = 'user'), 30), '') as title from conversations group by conv_id""",
    "last_n_messages": """select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 3""",
    "progress_monotone": """select event_id, user_id, max(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as progress from events""",
    "task_state_latest": "select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by user_id",
    "progress_tumbling": "select time_bucket(interval '60 minutes', ts) as window_start, event_type, count(*) as n from events group by all",
}

_SCORES = """n as (select vec_id, cast(embedding as double[]) as e from embeddings),
s as (select q.vec_id as query_id, v.vec_id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) as score
      from n q, n v where q.vec_id % 100 = 0)"""
_ODD = _LINES + """, two as (select *, lag(line) over (partition by doc_id order by line_no) as prev from lines),
key as (select *, lower(regexp_replace(line, '\\s+', '', 'g')) as a, lower(regexp_replace(prev, '\\s+', '', 'g')) as b from two),
again as (select doc_id, line_no from key where length(trim(prev)) >= 20 and a = b),
issues as (select doc_id, line_no, case when length(trim(line)) < 10 and line not like '%.' then 'short_fragment' else 'long_paragraph' end as kind, 'low' as risk from lines
  where (length(trim(line)) < 10 and line not like '%.') or length(trim(line)) > 1200
  union all select doc_id, line_no, 'duplicate_paragraph', 'high' from again)"""
_CHANGED = """l2 as (select doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: case when (i - 1) % 7 = 3 then null when (i - 1) % 5 = 2 then x || ' 30 GB' else x end) as parts from documents),
versions as (select doc_id, 'old' as side, string_split(coalesce(text, ''), chr(10)) as parts from documents
  union all select doc_id, 'new', list_append(list_filter(parts, lambda x: x is not null), 'Added to ' || doc_id) from l2),
vlines as (select doc_id, side, cast(i as int) as no, parts[i + 1] as line, regexp_replace(parts[i + 1], '\\s+', '', 'g') as key
  from versions, lateral (select unnest(range(len(parts))) as i) where trim(parts[i + 1]) <> ''),
vk as (select *, row_number() over (partition by doc_id, side, key order by no) as k from vlines),
m1 as (select a.doc_id, a.no as a, b.no as b from (select * from vk where side = 'old') a join (select * from vk where side = 'new') b on a.doc_id = b.doc_id and a.key = b.key and a.k = b.k),
l1 as (select doc_id, side, no, line, lower(regexp_replace(key, '(^|[。；;])\\d+(?:\\.\\d+)+[、.]?', '\\1', 'g')) as key from vlines
  where not ((side = 'old' and (doc_id, no) in (select (doc_id, a) from m1)) or (side = 'new' and (doc_id, no) in (select (doc_id, b) from m1)))),
c2 as (select o.doc_id, o.no as a, n.no as b, o.key = n.key as same, case when length(o.key) > length(n.key) then o.key else n.key end as l, case when length(o.key) > length(n.key) then n.key else o.key end as s
  from l1 o join l1 n on o.side = 'old' and n.side = 'new' and o.doc_id = n.doc_id and length(o.key) >= 12 and length(n.key) >= 12 and (o.key = n.key or contains(o.key, n.key) or contains(n.key, o.key))),
w2 as (select *, case when same then 2 else 1 end as rel from c2 where same or len(list_filter(range(1, length(l) - length(s) + 2), lambda i: substring(l, i, length(s)) = s
  and (i = 1 or contains('。；;！？!?．', substring(l, i - 1, 1)))
  and (i + length(s) - 1 = length(l) or contains('。；;！？!?．', right(s, 1)) or contains('。；;！？!?．', substring(l, i + length(s), 1))))) > 0),
g2 as (select doc_id, list({'a': a, 'b': b} order by a, rel desc, abs(a - b), b) as rest, null::struct(a int, b int) as take from w2 group by doc_id
  union all select doc_id, list_filter(rest, lambda x: x.a <> rest[1].a and x.b <> rest[1].b), rest[1] from g2 where len(rest) > 0),
m2 as (select doc_id, take.a as a, take.b as b from g2 where take is not null),
l2r as (select * from l1 where not ((side = 'old' and (doc_id, no) in (select (doc_id, a) from m2)) or (side = 'new' and (doc_id, no) in (select (doc_id, b) from m2)))),
v3 as (select doc_id, side, no, (unicode(substring(line, j, 1)) * 31 + unicode(substring(line, j + 1, 1))) % 256 as d, count(*) as c from l2r, lateral (select unnest(range(1, length(line))) as j) group by all),
q3 as (select doc_id, side, no, cast(sum(c * c) as double) as q from v3 group by all),
d3 as (select o.doc_id, o.no as a, n.no as b, cast(sum(o.c * n.c) as double) as dot from v3 o join v3 n on o.side = 'old' and n.side = 'new' and o.doc_id = n.doc_id and o.d = n.d group by all),
s3 as (select d.doc_id, a, b, dot / sqrt(x.q * y.q) as score from d3 d join q3 x on x.doc_id = d.doc_id and x.side = 'old' and x.no = a join q3 y on y.doc_id = d.doc_id and y.side = 'new' and y.no = b),
t3 as (select * from s3 qualify row_number() over (partition by doc_id, a order by score desc, b) <= 3),
g3 as (select doc_id, list({'a': a, 'b': b, 'score': score} order by score desc, a desc, b desc) as rest, null::struct(a int, b int, score double) as take from t3 where score >= 0.8 group by doc_id
  union all select doc_id, list_filter(rest, lambda x: x.a <> rest[1].a and x.b <> rest[1].b), rest[1] from g3 where len(rest) > 0),
m3 as (select doc_id, take.a as a, take.b as b, take.score as score from g3 where take is not null),
l3 as (select *, list_distinct(list_transform(range(1, length(line)), lambda j: substring(line, j, 2))) as g from l2r where not ((side = 'old' and (doc_id, no) in (select (doc_id, a) from m3)) or (side = 'new' and (doc_id, no) in (select (doc_id, b) from m3)))),
s4 as (select o.doc_id, o.no as a, n.no as b, len(list_intersect(o.g, n.g)) / greatest(len(list_distinct(list_concat(o.g, n.g))), 1) as score from l3 o join l3 n on o.side = 'old' and n.side = 'new' and o.doc_id = n.doc_id and len(o.g) > 0 and len(n.g) > 0),
g4 as (select doc_id, list({'a': a, 'b': b} order by score desc, a desc, b desc) as rest, null::struct(a int, b int) as take from s4 where score >= 0.45 group by doc_id
  union all select doc_id, list_filter(rest, lambda x: x.a <> rest[1].a and x.b <> rest[1].b), rest[1] from g4 where len(rest) > 0),
m4 as (select doc_id, take.a as a, take.b as b from g4 where take is not null),
met as (select doc_id, a, b from m2 union all select doc_id, a, b from m3 union all select doc_id, a, b from m4),
changes as (select m.doc_id, 'modified' as kind, a as old_no, b as new_no, o.line as old_line, n.line as new_line from met m join vlines o on o.side = 'old' and o.doc_id = m.doc_id and o.no = a join vlines n on n.side = 'new' and n.doc_id = m.doc_id and n.no = b
  union all select doc_id, 'removed', no, -1, line, null from l3 where side = 'old' and (doc_id, no) not in (select (doc_id, a) from m4)
  union all select doc_id, 'added', -1, no, null, line from l3 where side = 'new' and (doc_id, no) not in (select (doc_id, b) from m4))"""
_ORDERS = """o as (select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderkey % 19 <> 5),
n as (select o_orderkey, case when o_orderkey % 10 = 3 then 'X' else o_orderstatus end as o_orderstatus, o_orderpriority from orders where o_orderkey % 17 <> 0)"""
_LATEST = "l as (select d.*, case when doc_id = max(doc_id) over (partition by source) then 'active' else 'inactive' end as status from documents d)"

ORACLES |= {
    "greedy_match_vectors": f"""with recursive {_SCORES}, g as (select list({{'a': query_id, 'b': vec_id, 'score': round(score, 6)}} order by round(score, 6) desc, query_id desc, vec_id desc) as rest, null::struct(a bigint, b bigint, score double) as take from s where vec_id % 100 <> 0 and score >= 0.3 and round(score, 6) >= 0.3
  union all select list_filter(rest, lambda x: x.a <> rest[1].a and x.b <> rest[1].b), rest[1] from g where len(rest) > 0)
select take.a as a, take.b as b, take.score as score from g where take is not null""",
    "library_candidates": f"""with {_SCORES}
select query_id, vec_id, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as r from s) where r <= 4 and query_id <> vec_id and score >= 0.3""",
    "search_active_only": f"""with {_SCORES}, a as (select * from s where vec_id not in (select doc_id from labels where toxic = 1 and doc_id is not null))
select query_id, vec_id, cast(r as int) as rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as r from a) where r <= 5""",
    "conflict_pairs_scored": f"""with {_SCORES}, h as (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as r from s),
t as (select query_id, vec_id, r, source, trim(text) as t, list_distinct(list_transform(range(1, length(trim(text))), lambda j: substring(trim(text), j, 2))) as g from h join documents d on d.doc_id = h.vec_id where r <= 10 and score > 0.1),
p as (select a.query_id, a.vec_id as id_a, b.vec_id as id_b, len(list_intersect(a.g, b.g)) / greatest(len(list_distinct(list_concat(a.g, b.g))), 1) as likeness
from t a join t b on a.query_id = b.query_id and a.r < b.r and a.source is distinct from b.source and a.t <> b.t)
select query_id, id_a, id_b, round(likeness, 6) as likeness from p where likeness > 0.2 and likeness < 0.95""",
    "exact_pairs_multiset": f"""with recursive {_CHANGED}, r as (select *, row_number() over (partition by side, line order by doc_id, no) as c from vlines)
select o.line, o.doc_id as old_doc, o.no as old_line, n.doc_id as new_doc, n.no as new_line from r o join r n on o.side = 'old' and n.side = 'new' and o.line = n.line and o.c = n.c""",
    "added_removed_paragraphs": f"""with recursive {_CHANGED}, c as (select line, count(*) filter (where side = 'new') - count(*) filter (where side = 'old') as d from vlines group by line)
select line, case when d > 0 then 'added' else 'removed' end as kind, abs(d) as n from c where d <> 0""",
    "duplicate_adjacent_lines": f"with {_ODD} select doc_id, line_no from again",
    "neighbor_context": f"with {_LINES} select doc_id, line_no, string_agg(line, chr(10)) over (partition by doc_id order by line_no rows between 2 preceding and 2 following) as context from lines",
    "parse_qa_issues": f"with {_ODD} select doc_id, line_no, kind, risk from issues",
    "parse_qa_status": f"""with {_ODD}, c as (select doc_id, count(*) as n_issues, count(*) filter (where risk = 'high') as n_high from issues group by doc_id)
select doc_id, coalesce(n_issues, 0) as n_issues, coalesce(n_high, 0) as n_high, case when n_high > 0 then 'failed' when n_issues > 0 then 'review' else 'ok' end as status from documents left join c using (doc_id)""",
    "llm_candidate_ranking": f"with {_ODD} select doc_id, line_no, kind, risk from issues qualify row_number() over (partition by doc_id order by case when risk = 'high' then 0 else 1 end, line_no, kind) <= 20",
    "version_compare": f"with recursive {_CHANGED} select * from changes",
    "change_kind_counts": f"with recursive {_CHANGED} select kind, count(*) as n from changes group by kind",
    "summary_quota": f"""with recursive {_CHANGED} select doc_id, kind, old_no, new_no, cast(r as int) as rank from (select *, row_number() over (partition by doc_id, kind order by case when kind = 'added' then new_no else old_no end) as r from changes)
where r <= case kind when 'modified' then 20 else 5 end""",
    "absorbed_passages": f"""with recursive {_CHANGED} select c.* from changes c where not (kind = 'removed' and length(old_line) >= 15 and exists (
select 1 from changes m where m.kind = 'modified' and m.doc_id = c.doc_id and (contains(m.old_line, c.old_line) or contains(m.new_line, c.old_line))))""",
    "table_row_diff": f"""with {_ORDERS}, d as (select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey,
case when o.o_orderkey is null then 'added' when n.o_orderkey is null then 'removed' when o.o_orderstatus <> n.o_orderstatus then 'modified' end as kind from o full join n on o.o_orderkey = n.o_orderkey)
select o_orderkey, kind, case when kind = 'modified' then 1 else 0 end as n_cells from d where kind is not null""",
    "table_cell_diff": f"""with {_ORDERS} select o.o_orderkey, 'o_orderstatus' as "column", o.o_orderstatus as old_value, n.o_orderstatus as new_value from o join n on o.o_orderkey = n.o_orderkey where o.o_orderstatus <> n.o_orderstatus""",
    "table_to_rows_text": "select c_custkey, concat_ws('；', 'c_name=' || c_name, 'c_nationkey=' || c_nationkey, 'c_mktsegment=' || c_mktsegment) as text from customer",
    "template_table_filter": """with c as (select source, count(*) * 2 as n_cells, sum(cast(trim(coalesce(lang, '')) in ('', '-', '—', '/', 'N/A') as int) + cast(trim(coalesce(text, '')) in ('', '-', '—', '/', 'N/A') as int)) as n_empty from documents group by source)
select source, n_cells, cast(n_empty as bigint) as n_empty from c where n_empty < 0.6 * n_cells""",
    "row_token_jaccard": """with r as (select o_custkey, o_orderkey, list_distinct([o_orderstatus, o_orderpriority]) as c from orders),
w as (select o_orderkey, c, lag(c) over (partition by o_custkey order by o_orderkey) as p from r)
select o_orderkey, round(len(list_intersect(c, p)) / len(list_distinct(list_concat(c, p))), 6) as likeness from w where p is not null""",
    "assign_chapter_asof": f"""with {_LINES}, h as (select doc_id, page, arg_max(line, line_no) as line from placed where length(line) <= 20 and line like '%.' group by doc_id, page),
p as (select distinct doc_id, page from placed)
select p.doc_id, cast(p.page as bigint) as table_no, cast(p.page as bigint) as page, coalesce(last_value(h.line ignore nulls) over (partition by p.doc_id order by p.page), '') as chapter from p left join h on p.doc_id = h.doc_id and p.page = h.page""",
    "promote_version": f"""with {_LATEST}, m as (select source, min(doc_id) as first from documents where source is not null and source <> 'src1' group by source)
select doc_id, source, case when m.first is null then status when doc_id = m.first then 'active' else 'inactive' end as status from l left join m using (source)""",
    "remove_documents": "select doc_id, source from documents where doc_id is null or doc_id not in (select doc_id from labels where toxic = 1 and doc_id is not null)",
    "doc_ids": "select doc_id, coalesce(source, '') || '#' || left(sha256(coalesce(text, '')), 8) as stored_id from documents",
    "store_counters": f"""with {_LATEST}, x as (select status, length(coalesce(text, '')) as c, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) as p from l)
select count(*) as n_documents, count(*) filter (where status = 'active') as n_active, cast(coalesce(sum(c), 0) as bigint) as n_chars, cast(coalesce(sum(p), 0) as bigint) as n_paragraphs from x""",
    "normalize_citations": "select conv_id, turn, coalesce(text || '[' || turn || ']', '') as text from conversations",
    "html_title_text": """with b as (select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t-\\r]+', ' ', 'g')) as title,
regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<title\\b.*?</title>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') as t from pages)
select page_id, title, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \\t-\\r]+', ' ', 'g')) as text from b""",
    "progress_stream_windows": """with w as (select time_bucket(interval '60 minutes', ts) as window_start, event_type, count(*) as n from events group by all)
select window_start, event_type, n from w where window_start + interval '60 minutes' <= (select max(ts) - interval '2 hours' from events)""",
    "html_table_rows": """with p as (select page_id, case when page_id % 3 > 0 then html || '<table class=''t''><TR><th>Title</th><th scope=col>No &amp; mark</th></TR>' || case when page_id % 3 = 2 then '<tr>' || chr(10) || '<td>' || coalesce(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') || '</td><td><b>' || page_id || '</b> &lt;x&gt;</td></tr>' else '' end || '<tr><td>end</td></tr></table>' else html end as h from pages),
r as (select page_id, regexp_extract_all(h, '(?is)<tr\\b.*?</tr>') as rows from p), e as (select page_id, i - 1 as row_no, regexp_extract_all(rows[i], '(?is)<t[dh]\\b[^>]*>(.*?)</t[dh]>', 1) as c from r, lateral (select unnest(range(1, len(rows) + 1)) as i))
select page_id, cast(row_no as int) as row_no, array_to_string(list_transform(c, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \\t-\\r]+', ' ', 'g'))), '|') as cells from e""",
    "progress_sessions": """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as fresh from events),
h as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n from h group by user_id, k""",
    "progress_state_changes": """select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as p, row_number() over (partition by user_id order by ts, event_id) as r from events)
where event_type is distinct from p""",
}
