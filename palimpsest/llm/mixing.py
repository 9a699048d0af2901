"""Mixing sources to target weights by systematic sampling.

Every source gets a target of words.  Within a source the documents stand in order of
size; each is expected target / source size times, the expectations are summed along
the order from one random offset of the source, and a document is emitted once for each
integer that its step crosses.  In order of size, this keeps a source's words within
about one document of its target, and no document is emitted more often than its
expectation rounded up.

The order is made by one range sort of narrow rows (ties by doc_id and text, so that
reruns agree however the table is read, and a source with a third of all rows spreads
over tasks); only per-source and per-partition totals are combined globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, hidden, ranged, stored, table

#: A target is at most so many times the size of its source.
MOST = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """source, n, source_size, target, rate of each source of sizes (source, size).

    Sources in code point order, null last, get the weights in turn.  A target above
    MOST times its source is cut, the excess goes to the others by weight, and so on:
    in order of size / weight the cut sources come first, so running sums tell them.
    The windows run over one row a source, in one task: sources must number millions at most.
    """
    # partial sums come before the shuffle: a hot source sends one row a task
    part = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    named = part.withColumn("w", w.cast("long"))
    by_room = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    named = named.withColumns({
        "left": F.sum("source_size").over(every) - MOST * F.coalesce(F.sum("source_size").over(by_room), F.lit(0)),
        "weight_left": F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_room), F.lit(0)),
    })
    cut = MOST * F.col("source_size") * F.col("weight_left") <= F.col("w") * F.col("left")
    named = named.withColumn("cut", cut)
    rest = Window.partitionBy()
    free = F.when(~F.col("cut"), F.struct(F.col("weight_left"), F.col("left")))
    named = named.withColumn("open", F.max(free).over(rest))
    target = F.when(F.col("cut"), (MOST * F.col("source_size")).cast("double")).otherwise((F.col("w") * F.col("open.left")).cast("double") / F.col("open.weight_left").cast("double"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0)
    return named.withColumn("target", target).select("source", "n", "source_size", "target", rate.alias("rate"))


def _number(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of the text's md5, as a number."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """row, doc_id, source, size, source_size, target, copies of every row of docs.

    docs: doc_id, source, text, and `keep` columns to carry along.  Null texts and texts
    without words have size 0 and stay subject to sampling; a null source is a source of
    its own; a null doc_id sorts first; rows equal in doc_id and text are sampled each,
    and which of them is taken tells nothing; an empty table gives no rows; other columns
    are left out.  A text of any length is one value of an expression.
    """
    tie = _number(F.coalesce("text", F.lit("")), 15).alias("tie")
    sized = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", tie, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *keep)
    # row only deals equal rows to several tasks
    rows, parts = ranged(sized, [F.asc_nulls_last("source"), "size", F.asc_nulls_first("doc_id"), "tie", "row"], "sizes")
    targets = stored(source_targets(rows.select("source", "size"), weights), "targets")
    targets = targets.withColumn("before_source", F.sum("n").over(Window.orderBy(F.asc_nulls_last("source"))) - F.col("n")).withColumnRenamed("source", "s")
    # a row a partition, and a row a source: the latter's true size decides its join
    placed = rows.join(F.broadcast(parts.select("part", "before")), "part").join(targets, F.col("source").eqNullSafe(F.col("s")))
    nth = (F.col("before") + F.col("idx") - F.col("before_source")).cast("double")
    offset = _number(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))), 5) / float(1 << 20)
    copies = F.floor((nth + 1) * F.col("rate") + offset) - F.floor(nth * F.col("rate") + offset)
    return placed.select("row", "doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), *keep)


def emit(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), seed: int = 7) -> DataFrame:
    """The mix itself: every row of docs, with all its columns, as often as it is taken (see `mix`)."""
    key, copy = hidden(docs, "row_of_mix"), hidden(docs, "copy_of_mix")
    kept = stored(docs.withColumn(key, F.monotonically_increasing_id()), "mixed")
    taken = mix(kept, weights, seed, keep=(key,)).where("copies > 0").select(key, F.col("copies").alias(copy))
    out = kept.join(taken, key).withColumn(copy, F.explode(F.sequence(F.lit(1), copy)))
    return out.select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at weights 5, 2, 1, with the words that it takes of each."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
r AS (SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER p, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS weight FROM w WINDOW p AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * source_size * weight <= w * rest AS cut FROM r),
o AS (SELECT *, max(CASE WHEN NOT cut THEN weight END) OVER () AS open_weight, max(CASE WHEN NOT cut THEN rest END) OVER () AS open_rest FROM c),
t AS (SELECT source, source_size, CASE WHEN cut THEN (3 * source_size)::DOUBLE ELSE (w * open_rest)::DOUBLE / open_weight::DOUBLE END AS target, ('0x' || substr(md5('7:' || coalesce(source, '')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS shift FROM o),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END::DOUBLE AS rate FROM t),
k AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST, ('0x' || substr(md5(text), 1, 15))::BIGINT) - 1)::DOUBLE AS nth FROM d)
SELECT doc_id, size, source_size, target, (size * (floor((nth + 1) * rate + shift) - floor(nth * rate + shift)))::BIGINT AS taken
FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source
"""
