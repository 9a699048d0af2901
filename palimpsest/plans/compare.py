"""Registered queries that compare versions and documents: tables, pairing in stages, likeness; and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import changes, pair_chain, store, table_compare
from palimpsest.operators.paragraphs import paragraph_lines
from palimpsest.plans import catalogue as base


def _order_tables(spark, sf_dir):
    """The orders of a customer as a table for each status, and a later version of them.

    By customer the later version has the same columns, a renamed one, the date moved to the
    front, or the date dropped and a total added; some rows go, come or change.
    """
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("shape", F.pmod("o_custkey", F.lit(4)))
    no = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = rows.select(F.col("o_custkey").alias("doc_id"), no.alias("old_no"), "o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice", "shape")
    word = F.element_at(F.array(F.lit("Shipped order"), F.lit("Open order"), F.lit("Partial order")), F.col("old_no") + 1)
    day, priority = F.lit("Date"), F.lit("Priority")
    headers = F.when(F.col("shape") == 1, F.array(word, F.lit("Order priority"), day)).when(F.col("shape") == 2, F.array(day, word, priority)).when(F.col("shape") == 3, F.array(word, priority, F.lit("Total"))).otherwise(F.array(word, priority, day))
    tables = rows.select("doc_id", "old_no", "shape").distinct()
    old_heads = tables.select("doc_id", F.col("old_no").alias("table_no"), F.concat(F.lit("p. "), F.col("old_no") + 1).alias("location"), F.array(word, priority, day).alias("headers"))
    new_heads = tables.select("doc_id", (2 - F.col("old_no")).alias("table_no"), F.lit("").alias("location"), headers.alias("headers"))
    order = Window.partitionBy("doc_id", "table_no").orderBy("key")
    numbered = lambda d: d.select("doc_id", "table_no", (F.row_number().over(order) - 1).alias("row_no"), "cells")
    key, level = F.col("o_orderkey"), F.col("o_orderpriority")
    old_rows = numbered(rows.where("o_orderkey % 19 <> 5").select("doc_id", F.col("old_no").alias("table_no"), key.alias("key"), F.array(key.cast("string"), level, "day").alias("cells")))
    level = F.when(key % 10 == 3, F.lit("X")).otherwise(level)
    cells = F.when(F.col("shape") == 2, F.array(F.col("day"), key.cast("string"), level)).when(F.col("shape") == 3, F.array(key.cast("string"), level, F.col("o_totalprice").cast("int").cast("string"))).otherwise(F.array(key.cast("string"), level, F.col("day")))
    new_rows = numbered(rows.where("o_orderkey % 17 <> 0").select("doc_id", (2 - F.col("old_no")).alias("table_no"), key.alias("key"), cells.alias("cells")))
    return old_heads, old_rows, new_heads, new_rows


def _tables(spark, sf_dir):
    found = table_compare.compare_tables(*_order_tables(spark, sf_dir))
    told = F.array_join(F.transform("cells", lambda c: F.concat(c["column"], F.lit(":"), c["old_value"], F.lit(">"), c["new_value"])), ";")
    return found.drop("similarity").withColumns({"cells": told, "row_index": F.coalesce("row_index", F.lit(0))})


def _chain(spark, sf_dir):
    docs = base._documents(spark, sf_dir)
    found = pair_chain.paragraph_pairs(changes._lines(docs), changes._lines(base._second(docs)))
    return found.withColumn("score", F.round("score", 6))


def _by_name(spark, sf_dir):
    """Lines of documents asked for by stored id, by the name before it, and by a name that isn't there; five of each."""
    docs = base._documents(spark, sf_dir)
    ids = store.document_ids(docs, "source")
    lines = paragraph_lines(docs).join(ids, "doc_id").select("stored_id", F.col("line_no").alias("no"), F.col("page").cast("string").alias("location"), "line")
    names = ids.where("doc_id % 50 = 0").select(F.explode(F.array("stored_id", F.split("stored_id", "#")[0], F.concat("stored_id", F.lit("?")))).alias("name"))
    return store.paragraphs_of(lines, names.withColumn("location", F.lit("1")), 5)


QUERIES: dict = {
    "table_compare": _tables,
    "paragraph_pairs": _chain,
    "change_noise": lambda s, d: changes.change_noise(base._changes(s, d)).select("doc_id", "kind", "old_no", "new_no", "noise"),
    "paragraphs_by_document": _by_name,
}

_TABLES = """with r as (select *, o_custkey % 4 as shape, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as t,
  case o_orderstatus when 'F' then 'Shipped order' when 'O' then 'Open order' else 'Partial order' end as w , strftime(o_orderdate, '%Y-%m-%d') as day from orders),
o as (select *, row_number() over (partition by o_custkey, t order by o_orderkey) as i from r where o_orderkey % 19 <> 5),
n as (select *, case when o_orderkey % 10 = 3 then 'X' else o_orderpriority end as level, cast(trunc(o_totalprice) as int) as total, row_number() over (partition by o_custkey, t order by o_orderkey) as i from r where o_orderkey % 17 <> 0),
p as (select distinct o_custkey, t, shape, w from r where (o_custkey, t) in (select (o_custkey, t) from o) and (o_custkey, t) in (select (o_custkey, t) from n)),
b as (select p.o_custkey, p.t, p.shape, p.w, o.o_orderkey as ok, n.o_orderkey as nk, o.i as oi, n.i as ni, o.o_orderpriority as op, n.level as np, coalesce(o.day, n.day) as day, n.total
  from (select * from o full join n using (o_custkey, t, o_orderkey)) x join p on p.o_custkey = x.o_custkey and p.t = x.t
  left join o on o.o_orderkey = x.o_orderkey left join n on n.o_orderkey = x.o_orderkey),
k as (select *, case when ok is null then 'added' when nk is null then 'removed' when op <> np then 'modified' end as kind,
  ok || ' | ' || op || ' | ' || day as ot, case shape when 2 then day || ' | ' || nk || ' | ' || np when 3 then nk || ' | ' || np || ' | ' || total else nk || ' | ' || np || ' | ' || day end as nt,
  case shape when 1 then 'Order priority' else 'Priority' end as pn from b)
select o_custkey as doc_id, t as old_table, 2 - t as new_table, 'p. ' || (t + 1) as table_name, 'row' as part, kind, coalesce(ok, nk) || '' as row_key, cast(case when kind = 'removed' then oi else ni end as int) as row_index,
  case when kind = 'added' then null else ot end as old_text, case when kind = 'removed' then null else nt end as new_text,
  case kind when 'modified' then 'Priority:' || op || '>' || np when 'removed' then w || ':' || ok || '>;Priority:' || op || '>;Date:' || day || '>'
  else case shape when 2 then 'Date:>' || day || ';' || w || ':>' || nk || ';' || pn || ':>' || np when 3 then w || ':>' || nk || ';' || pn || ':>' || np || ';Total:>' || total else w || ':>' || nk || ';' || pn || ':>' || np || ';Date:>' || day end end as cells
from k where kind is not null
union all select o_custkey, t, 2 - t, 'p. ' || (t + 1), 'column', 'added', null, 0, null, 'Total', '' from p where shape = 3
union all select o_custkey, t, 2 - t, 'p. ' || (t + 1), 'column', 'removed', null, 0, 'Date', null, '' from p where shape = 3"""

_NOISE = "(length(trim(coalesce({0}, ''))) < 6 or (length(trim(coalesce({0}, ''))) <= 40 and regexp_matches(trim(coalesce({0}, '')), '^\\d+(?:\\.\\d+)*\\s+\\S')))"

ORACLES: dict[str, str] = {
    "table_compare": _TABLES,
    "paragraph_pairs": f"""with recursive {base._CHANGED} select doc_id, cast(a as bigint) as a, cast(b as bigint) as b, 1.0::double as score, 'equal' as stage from m1
union all select m.doc_id, a, b, case when rel = 2 then 1.0 else 0.95 end, 'content' from m2 m join w2 using (doc_id, a, b)
union all select doc_id, a, b, round(score, 6), 'near' from m3""",
    "change_noise": f"with recursive {base._CHANGED} select doc_id, kind, old_no, new_no, case kind when 'added' then {_NOISE.format('new_line')} when 'removed' then {_NOISE.format('old_line')} else {_NOISE.format('old_line')} and {_NOISE.format('new_line')} end as noise from changes",
    "paragraphs_by_document": f"""with {base._LINES}, ids as (select doc_id, coalesce(source, '') as source, coalesce(source, '') || '#' || left(sha256(coalesce(text, '')), 8) as stored_id from documents),
p as (select i.stored_id, l.line_no as no, l.page || '' as location, l.line from placed l join ids i using (doc_id)),
names as (select distinct unnest([stored_id, source, stored_id || '?']) as name from ids where doc_id % 50 = 0),
f as (select n.name, p.* from names n join p on p.stored_id = n.name or (starts_with(p.stored_id, n.name || '#') and not exists (select 1 from p q where q.stored_id = n.name)) where p.location = '1')
select * from f qualify row_number() over (partition by name order by stored_id, no) <= 5""",
}
