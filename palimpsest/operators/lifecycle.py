"""What happens to stored documents and to findings about them: listings, removal, migration, ids, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.normal import nfkc


def listed(stored: DataFrame, every: bool = False) -> DataFrame:
    """Active documents, with `every` the inactive ones too; removed ones never. Sorted by added_at and doc_id."""
    shown = ("active", "inactive") if every else ("active",)
    return stored.where(F.col("status").isin(*shown)).orderBy("added_at", "doc_id")


def removed(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """stored (doc_id, status) with the status 'removed' for the doc_ids of gone."""
    marks = gone.select("doc_id").distinct().withColumn("gone", F.lit(True))
    return stored.join(marks, "doc_id", "left").withColumn("status", F.when(F.col("gone"), "removed").otherwise(F.col("status"))).drop("gone")


def active_with_hash(stored: DataFrame, hashes: DataFrame) -> DataFrame:
    """Active rows of stored (sha256, status) whose content is among hashes (sha256)."""
    return stored.where("status = 'active'").join(hashes.select("sha256").distinct(), "sha256", "left_semi")


def family_id(name: Column) -> Column:
    """Short id of a file name: folders, case, white space and compatible characters aside."""
    base = nfkc(F.regexp_extract(name, r"([^/\\]*)$", 1))
    return F.left(F.sha2(F.regexp_replace(F.lower(F.trim(base)), r"\s+", " "), 256), F.lit(16))


def migrated(stored: DataFrame) -> DataFrame:
    """stored (doc_id, name, family, added_at, status) with families filled in and one active row in each.

    Of several active rows of a family the newest stays active; removed rows stay removed.
    """
    filled = stored.withColumn("family", F.coalesce("family", family_id(F.col("name"))))
    active = F.max(F.when(F.col("status") == "active", F.struct("added_at", "doc_id")))
    newest = filled.groupBy("family").agg(active.alias("newest"))
    # met by the row, not by the family, so that a large family is no large key
    kept = newest.where("newest is not null").select(F.col("newest.doc_id").alias("_id"), F.col("newest.added_at").alias("_at"), F.lit(True).alias("_kept"))
    out = filled.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("added_at").eqNullSafe(F.col("_at")), "left")
    status = F.when((F.col("status") == "active") & F.col("_kept").isNull(), "inactive").otherwise(F.col("status"))
    return out.withColumn("status", status).select("doc_id", "family", "status")


def recent_sessions(turns: DataFrame, most: int = 50) -> DataFrame:
    """conv_id and last_turn of the sessions that went on longest: a report of `most` rows."""
    return turns.groupBy("conv_id").agg(F.max("turn").alias("last_turn")).orderBy(F.desc("last_turn"), "conv_id").limit(most)


def first_chapters(lines: DataFrame) -> DataFrame:
    """doc_id, chapter and line_no of the first line of each chapter of a document (doc_id, line_no, chapter)."""
    return lines.where("chapter <> ''").groupBy("doc_id", "chapter").agg(F.min("line_no").alias("line_no"))


def unordered_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each pair of different ends once, the smaller first."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def issue_ids(issues: DataFrame) -> DataFrame:
    """issues (doc_id, kind, line_no) with an id: kind and line, and -2, -3 ... for further ones of one document, in order of their other columns."""
    order = [c for c in issues.columns if c not in ("doc_id", "kind", "line_no")] or ["line_no"]
    place = F.row_number().over(Window.partitionBy("doc_id", "kind", "line_no").orderBy(*order))
    name = F.concat_ws("-", "kind", F.col("line_no").cast("string"))
    return issues.withColumn("place", place).withColumn("issue_id", F.when(F.col("place") == 1, name).otherwise(F.concat_ws("-", name, F.col("place").cast("string")))).drop("place")


def change_summary(kind: Column, old: Column, new: Column) -> Column:
    """A change in a line: 160 characters of what came or went, 80 of each side of what was rewritten."""
    flat = lambda x: F.trim(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" ")))
    old, new = flat(old), flat(new)
    both = F.when((old != "") & (new != ""), F.concat(F.lit("[修改] "), F.left(old, F.lit(80)), F.lit(" → "), F.left(new, F.lit(80)))).otherwise("[修改] 内容发生变化")
    return F.when(kind == "added", F.concat(F.lit("[新增] "), F.left(new, F.lit(160)))).when(kind == "removed", F.concat(F.lit("[删除] "), F.left(old, F.lit(160)))).otherwise(both)


def judged(items: DataFrame) -> DataFrame:
    """items (inconsistent, confidence, evidence, text) with verdict and excerpt.

    A contradiction counts as one only with high confidence and evidence; else it is suspect.
    """
    sure = (F.col("confidence") == "high") & F.coalesce(F.col("evidence"), F.lit(False))
    verdict = F.when(~F.col("inconsistent"), "consistent").when(sure, "inconsistent").otherwise("suspect")
    return items.withColumns({"verdict": verdict, "excerpt": F.left(F.coalesce("text", F.lit("")), F.lit(80))})
