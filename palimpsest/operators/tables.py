"""Tables of two versions, rows as text, template tables, chapters of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import jaccard

PLACEHOLDERS = ("", "-", "—", "/", "N/A")


def _cell(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", "")


def _versions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")


def row_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, kind (added, removed or modified) and n_cells changed, for rows that differ.

    Keys must be unique in each version, null keys match nothing; cells are compared as
    text without white space.
    """
    differs = [(_cell(F.col(f"o.{c}")) != _cell(F.col(f"n.{c}"))).cast("int") for c in columns]
    kind = F.when(F.col(f"o.{key}").isNull(), "added").when(F.col(f"n.{key}").isNull(), "removed").when(sum(differs, F.lit(0)) > 0, "modified")
    both = _versions(old, new, key)
    out = both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), kind.alias("kind"), sum(differs, F.lit(0)).alias("n_cells"))
    return out.where("kind is not null").withColumn("n_cells", F.when(F.col("kind") == "modified", F.col("n_cells")).otherwise(0))


def cell_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column, old_value, new_value (text) of every changed cell of rows in both versions."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"o.{c}").cast("string").alias("old_value"), F.col(f"n.{c}").cast("string").alias("new_value")) for c in columns]
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"))
    changed = both.select(F.col(f"o.{key}").alias(key), F.explode(F.array(*cells)).alias("c")).select(key, "c.*")
    return changed.where(_cell(F.col("old_value")) != _cell(F.col("new_value")))


def rows_text(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and text 'column=value；column=value' of each row with a value; empty cells are left out."""
    parts = [F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}="), F.trim(F.col(c).cast("string")))) for c in columns]
    return table.select(key, F.concat_ws("；", *parts).alias("text")).where("text <> ''")


def template_filter(table: DataFrame, group: str, columns: list[str], most: float = 0.6) -> DataFrame:
    """group, n_cells and n_empty of tables (rows of one group) whose share of empty cells is below `most`."""
    empty = sum((F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).isin(*PLACEHOLDERS).cast("int") for c in columns), F.lit(0))
    out = table.groupBy(group).agg((F.count(F.lit(1)) * len(columns)).alias("n_cells"), F.sum(empty).alias("n_empty"))
    return out.where(F.col("n_empty") < most * F.col("n_cells"))


def neighbour_likeness(table: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """order, and likeness: Jaccard of the cells of a row and of the row before it in its group."""
    cells = F.filter(F.array(*[F.trim(F.col(c).cast("string")) for c in columns]), lambda x: x != "")
    rows = table.select(group, order, F.array_distinct(cells).alias("cells"))
    last = F.lag("cells").over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("last", last).where("last is not null").select(order, jaccard(F.col("cells"), F.col("last")).alias("likeness"))


def chapters_asof(tables: DataFrame, headings: DataFrame) -> DataFrame:
    """tables (doc_id, table_no, page) with the chapter of the last heading (doc_id, page, pos, chapter) at or before the page."""
    one = tables.select("doc_id", "page", F.lit(1).alias("side"), F.col("table_no").alias("pos"), F.lit(None).cast("string").alias("chapter"))
    two = headings.select("doc_id", "page", F.lit(0).alias("side"), "pos", "chapter")
    order = Window.partitionBy("doc_id").orderBy("page", "side", "pos")
    filled = one.unionByName(two).withColumn("chapter", F.last("chapter", ignorenulls=True).over(order))
    return filled.where("side = 1").select("doc_id", F.col("pos").alias("table_no"), "page", F.coalesce("chapter", F.lit("")).alias("chapter"))
