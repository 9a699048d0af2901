"""Registered queries on segments, overlap, fragments, rules and answers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.text import is_noise, quantities
from palimpsest.operators import answers, fragments, overlap, paragraphs, retrieval, rules, segments, store
from palimpsest.plans import catalogue as base
from palimpsest.sources.durable import written

#: Cosine from which two findings are one.
SAME_FINDING = 0.85


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _hits(spark, sf_dir, k):
    return base._hits(spark, sf_dir, k)


def _modified(spark, sf_dir):
    return base._changes(spark, sf_dir).where("kind = 'modified'")


def _token_diff(spark, sf_dir):
    rows = _modified(spark, sf_dir).withColumn("f", fragments.token_diff(F.col("old_line"), F.col("new_line")))
    told = fragments.description(F.col("f"), F.col("old_line"), F.col("new_line"))
    rows = rows.withColumn("description", told).withColumn("f", fragments.annotated(F.col("f"), F.col("old_line"), F.col("new_line")))
    return rows.select("doc_id", "old_no", "new_no", "description", F.posexplode("f").alias("fragment_no", "f")).select("doc_id", "old_no", "new_no", "description", "fragment_no", "f.*")


def _direction(spark, sf_dir):
    way = fragments.one_way(F.regexp_replace("old_line", r"\s+", ""), F.regexp_replace("new_line", r"\s+", ""))
    return _modified(spark, sf_dir).withColumn("w", way).where("w.direction is not null").select("doc_id", "old_no", "new_no", "w.*")


def _rule_counts(spark, sf_dir):
    found = rules.classified(_modified(spark, sf_dir))
    return found.groupBy(F.coalesce("category", F.lit("open")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def _versions(spark, sf_dir):
    docs = base._documents(spark, sf_dir)
    return docs, base._second(docs)


def _rounded(df):
    return df.withColumn("likeness", F.round("likeness", 6))


def _stored(spark, sf_dir):
    return store.latest_active(base._documents(spark, sf_dir).select("doc_id", "source", "text"), "source")


def _validation(spark, sf_dir):
    # documents in batches of five; their labels serve as answers, so that unlabelled ones are missing
    batch, index = F.floor(F.col("doc_id") / 5).alias("batch"), (F.col("doc_id") % 5 + 1).alias("index")
    items = base._documents(spark, sf_dir).select(batch)
    return answers.validated(items, _labels(spark, sf_dir).select(batch, index, (F.col("toxic") == 1).alias("inconsistent")))


def _misses(spark, sf_dir):
    docs = base._documents(spark, sf_dir).withColumn("key", answers.answer_key(F.col("lang"), F.col("text")))
    return answers.cache_misses(docs, docs.join(_labels(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_semi")).select("doc_id")


def _groups(spark, sf_dir):
    pairs = base._conflicts(spark, sf_dir)
    return answers.conflict_groups(pairs, base._documents(spark, sf_dir))


def _findings(spark, sf_dir):
    # every fifth vector comes again, but for its first number
    rows = base._embeddings(spark, sf_dir).select("vec_id", "embedding")
    again = rows.where("vec_id % 5 = 0").select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), F.concat(F.array(F.lit(0.0).cast("float")), F.slice("embedding", F.lit(2), F.size("embedding") - 1)).alias("embedding"))
    rows = written(retrieval.first_copies(rows.unionByName(again)), "firsts")
    edges = retrieval.pairs_within(rows, SAME_FINDING).select("a", "b")
    return answers.keep_first(rows.select(F.col("vec_id").alias("id")), edges)


def _above(spark, sf_dir):
    found = _hits(spark, sf_dir, 10).where("score >= 0.2")
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def _noise(spark, sf_dir):
    lines = paragraphs.paragraph_lines(base._documents(spark, sf_dir))
    return lines.select("doc_id", "line_no", is_noise(F.col("line")).alias("noise"))


def _renumbered(spark, sf_dir):
    lines = paragraphs.paragraph_lines(base._documents(spark, sf_dir)).where(F.length(F.trim("line")) >= 10)
    return paragraphs.renumbered(lines).select("doc_id", "paragraph_no", "line")


def _prefixes(spark, sf_dir):
    lines = paragraphs.paragraph_lines(base._documents(spark, sf_dir)).where("trim(line) <> ''")
    return lines.groupBy(F.left("line", F.lit(12)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs")).where("n >= 3")


def _quantities(spark, sf_dir):
    rows = _modified(spark, sf_dir).select("doc_id", "old_no", "new_no", quantities(F.col("old_line")).alias("a"), quantities(F.col("new_line")).alias("b"))
    return rows.where("a <> b").select("doc_id", "old_no", "new_no", F.array_join("a", "|").alias("old_values"), F.array_join("b", "|").alias("new_values"))


QUERIES: dict = {
    "segment_stream": lambda s, d: segments.segments(base._documents(s, d)),
    "cross_page_merge": lambda s, d: segments.merge_pages(segments.segments(base._documents(s, d))),
    "content_overlap": lambda s, d: overlap.content_overlap(*_versions(s, d)).withColumn("overlap", F.round("overlap", 6)),
    "similarity_cluster": lambda s, d: _rounded(overlap.reworded(*_versions(s, d))),
    "token_diff": _token_diff,
    "diff_direction": _direction,
    "prefilter_rules": _rule_counts,
    "judge_validation": _validation,
    "judge_cache_misses": _misses,
    "qa_sources": lambda s, d: answers.sources(_hits(s, d, 5), _stored(s, d)),
    "qa_context_blocks": lambda s, d: answers.contexts(_hits(s, d, 5), _stored(s, d)),
    "conflict_groups": _groups,
    "dedup_findings": _findings,
    "search_threshold": _above,
    "layout_noise_split": _noise,
    "renumber_after_filter": _renumbered,
    "header_prefix_counts": _prefixes,
    "quantity_changes": _quantities,
}

_BEST = f"""{base._LINES.replace('lines as (', 'olines as (').split(', placed as')[0]},
l2 as (select doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: case when (i - 1) % 7 = 3 then null when (i - 1) % 5 = 2 then x || ' 30 GB' else x end) as parts from documents),
n2 as (select doc_id, list_append(list_filter(parts, lambda x: x is not null), 'Added to ' || doc_id) as parts from l2),
nlines as (select doc_id, cast(i as int) as line_no, parts[i + 1] as line from n2, lateral (select unnest(range(len(parts))) as i)),
a as (select doc_id, trim(line) as line, count(*) as n from olines where length(trim(line)) >= 6 group by all),
b as (select doc_id, trim(line) as line, min(line_no) as no from nlines where length(trim(line)) >= 6 group by all),
ag as (select *, list_distinct(list_transform(range(1, length(line)), lambda j: substring(line, j, 2))) as g from a),
bg as (select *, list_distinct(list_transform(range(1, length(line)), lambda j: substring(line, j, 2))) as g from b),
p as (select x.doc_id, x.line, y.line as new_line, y.no, len(list_intersect(x.g, y.g)) as met, len(x.g) + len(y.g) as total from ag x join bg y on x.doc_id = y.doc_id),
s as (select doc_id, line, new_line, no, met / (total - met) as likeness from p where met >= 0.5 * (total - met)),
best as (select doc_id, line, arg_max(new_line, (likeness, -no)) as new_line, max(likeness) as likeness from s group by doc_id, line)"""
_NAMED = base._SCORES + """, h as (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as r from s),
d as (select *, case when doc_id = max(doc_id) over (partition by source) then 'active' else 'inactive' end as status from documents)"""

ORACLES: dict[str, str] = {
    "dedup_findings": """with recursive n as (select vec_id, cast(embedding as double[]) as e from embeddings union all select vec_id + 1000000000, list_concat([0.0::double], cast(embedding[2:] as double[])) from embeddings where vec_id % 5 = 0),
s as (select x.vec_id as lo, y.vec_id as hi, list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) as score from n x join n y on x.vec_id < y.vec_id),
g as (select list({'lo': lo, 'hi': hi} order by lo, hi) as rest, []::bigint[] as gone from s where score >= 0.85
  union all select list_filter(rest, lambda x: x.lo <> rest[1].lo and not list_contains(now, x.lo) and not list_contains(now, x.hi)), now
  from (select rest, list_transform(list_filter(rest, lambda x: x.lo = rest[1].lo), lambda x: x.hi) as now from g where len(rest) > 0))
select vec_id as id from n where vec_id not in (select unnest(gone) from g)""",
    "content_overlap": f"""with {_BEST}, f as (select doc_id, cast(sum(n) as bigint) as n_lines, cast(sum(case when likeness is not null then n else 0 end) as bigint) as n_found from a left join best using (doc_id, line) group by doc_id)
select doc_id, n_lines, n_found, round(n_found / n_lines, 6) as overlap, case when n_found >= 0.5 * n_lines then 'versions' else 'different' end as kind from f""",
    "similarity_cluster": f"with {_BEST} select doc_id, line, new_line, round(likeness, 6) as likeness from best where likeness <= 0.95",
    "judge_validation": """with w as (select doc_id // 5 as batch, count(*) as n_items from documents group by all),
g as (select doc_id // 5 as batch, count(*) as n_answers, count(toxic) as told, count(distinct doc_id % 5) as places from labels group by all)
select batch, n_items, coalesce(n_answers, 0) as n_answers, coalesce(n_answers = n_items and told = n_items and places = n_items, false) as valid from w left join g using (batch)""",
    "judge_cache_misses": """with k as (select doc_id, coalesce(lang, '') || chr(31) || coalesce(text, '') as key from documents)
select doc_id from k where key not in (select key from k where doc_id in (select doc_id from labels))""",
    "qa_sources": f"""with {_NAMED} select query_id, cast(r as int) as rank, vec_id, coalesce(source, 'unknown') as source, coalesce(status, 'unknown') as status
from h left join d on d.doc_id = h.vec_id where r <= 5""",
    "qa_context_blocks": f"""with {_NAMED} select query_id, string_agg('[' || r || '] ' || coalesce(source, 'unknown') || case when status = 'active' then ' [current]' else '' end || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by r) as context
from h join d on d.doc_id = h.vec_id where r <= 5 group by query_id""",
    "conflict_groups": f"""with c as materialized ({base.ORACLES['conflict_pairs_scored']})
select query_id, source, left(trim(coalesce(text, '')), 50) as head, count(*) as n_pairs, min(id_a) as first_id from c join documents d on d.doc_id = c.id_a group by all""",
    "search_threshold": f"""with {base._SCORES}
select query_id, vec_id, cast(r as int) as rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as r from s) where r <= 10 and score >= 0.2""",
    "layout_noise_split": f"""with {base._LINES} select doc_id, line_no, length(trim(line)) < 6 or (length(trim(line)) <= 40 and regexp_matches(trim(line), '^\\d+(?:\\.\\d+)*\\s+\\S')) as noise from lines""",
    "renumber_after_filter": f"""with {base._LINES} select doc_id, cast(row_number() over (partition by doc_id order by line_no) as int) as paragraph_no, line from lines where length(trim(line)) >= 10""",
    "header_prefix_counts": f"""with {base._LINES} select left(line, 12) as prefix, count(*) as n, count(distinct doc_id) as n_docs from lines where trim(line) <> '' group by all having count(*) >= 3""",
}
