"""A store of versioned documents as snapshots: every change gives a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_active(docs: DataFrame, family: str) -> DataFrame:
    """docs with status: active for the newest row (largest doc_id) of a family, else inactive."""
    return _one_active(docs, docs.groupBy(family).agg(F.max("doc_id").alias("doc_id")))


def promote(docs: DataFrame, chosen: DataFrame, family: str) -> DataFrame:
    """docs (with status): in families with a row in chosen (doc_id) that row alone is active, others stay as they are.

    If chosen holds several rows of one family the largest doc_id wins.
    """
    named = docs.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi").groupBy(F.col(family).alias("_family")).agg(F.max("doc_id").alias("_new"))
    status = F.when(F.col("_new").isNull(), F.col("status")).when(F.col("doc_id") == F.col("_new"), "active").otherwise("inactive")
    return docs.join(named, F.col(family).eqNullSafe(F.col("_family")), "left").withColumn("status", status).drop("_new", "_family")


def _one_active(docs: DataFrame, newest: DataFrame) -> DataFrame:
    # joined on the id, not the family, so that a large family is no large key
    marks = newest.select("doc_id", F.lit("active").alias("status"))
    return docs.join(marks, "doc_id", "left").withColumn("status", F.coalesce("status", F.lit("inactive")))


def remove(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in gone."""
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def append(docs: DataFrame, more: DataFrame) -> DataFrame:
    """docs and more, columns by name; those that one side lacks are null there."""
    return docs.unionByName(more, allowMissingColumns=True)


def relabel(docs: DataFrame, label: str, longest: int = 60) -> DataFrame:
    """docs with `label` trimmed and cut."""
    return docs.withColumn(label, F.left(F.trim(label), F.lit(longest)))


def document_ids(docs: DataFrame, name: str) -> DataFrame:
    """doc_id and stored_id: the name, '#', and 8 digits of the content hash."""
    digest = F.left(F.sha2(F.coalesce("text", F.lit("")), 256), F.lit(8))
    return docs.select("doc_id", F.concat(F.coalesce(name, F.lit("")), F.lit("#"), digest).alias("stored_id"))


def counters(docs: DataFrame) -> DataFrame:
    """One row: n_documents, n_active, n_chars and n_paragraphs (lines with text)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).cast("long")
    return docs.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("status") == "active").alias("n_active"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n_chars"), F.coalesce(F.sum(lines), F.lit(0)).alias("n_paragraphs"))


def paragraphs_of(paragraphs: DataFrame, wanted: DataFrame, most: int | None = None) -> DataFrame:
    """name, stored_id, no and the other columns of the paragraphs (stored_id, no) of wanted documents (name, location or null).

    A name is a stored id; if no paragraph has it, it stands for all ids that begin with it
    and '#'.  With a location (paragraphs has that column too) only those there; `most`
    keeps the first of each name in order of id and no.  Ids meet by equality, either whole
    or up to their last '#', so nothing is compared with everything.
    """
    wanted = wanted.select("name", *(["location"] if "location" in wanted.columns else [])).dropDuplicates(["name"])
    ids = paragraphs.select("stored_id").distinct()
    exact = wanted.join(ids, F.col("name") == F.col("stored_id")).select("name", "stored_id")
    prefixes = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("stored_id", "#")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split("stored_id", "#"), F.lit(1), n), "#")), lambda x: x != F.col("stored_id"))
    begun = ids.select("stored_id", F.explode(prefixes).alias("name")).join(wanted.select("name"), "name").join(exact.select("name"), "name", "left_anti").select("name", "stored_id")
    found = paragraphs.join(exact.unionByName(begun), "stored_id")
    if "location" in wanted.columns:
        asked = wanted.select("name", F.col("location").alias("_asked"))
        found = found.join(asked, "name").where((F.coalesce("_asked", F.lit("")) == "") | (F.col("location") == F.col("_asked"))).drop("_asked")
    if most is not None:
        place = F.row_number().over(Window.partitionBy("name").orderBy("stored_id", "no"))
        found = found.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
    return found.select("name", *[c for c in found.columns if c != "name"])
