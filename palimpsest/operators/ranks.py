"""Ranks within keys of any size: a key with a third of all rows is cut over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.durable import written


def rank_within(df: DataFrame, key: str, by: list[str], name: str = "k") -> DataFrame:
    """df with the place (from 1) of each row among the rows of its key, ordered by `by`.

    Rows are range-sorted by key and `by`; a key that spans partitions continues with
    the sum of its counts in the earlier ones.  `by` must tell rows of a key apart.
    """
    parted = written(df.repartitionByRange(key, *by).withColumn("_part", F.spark_partition_id()), "ranks")
    counts = parted.groupBy("_part", key).agg(F.count(F.lit(1)).alias("_n"))
    # only the first and last key of a partition can go on in another one
    ends = counts.groupBy("_part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    ends = ends.select("_part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias(key))
    border = counts.join(ends, ["_part", key], "left_semi")
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    border = border.withColumn("_before", F.sum("_n").over(earlier)).where("_before is not null").select("_part", key, "_before")
    place = F.row_number().over(Window.partitionBy("_part", key).orderBy(*by))
    ranked = parted.withColumn("_place", place).join(border, ["_part", key], "left")
    return ranked.withColumn(name, F.col("_place") + F.coalesce("_before", F.lit(0))).drop("_part", "_place", "_before")
