"""What the operators share: stored intermediate tables, row identity, global order."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word wherever an operator counts words: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where all is one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-palimpsest-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of the jobs inside go once their table is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "true")
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, name: str = "t", codec: str = "zstd") -> DataFrame:
    """df, written to the shared folder and read back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hidden(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Parts that a hot key of a salted join is dealt to.
SALTS = 16


def salted_join(rows: DataFrame, named: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """rows left-joined with named (one row a key); rows of one key go to SALTS tasks, by a hash of `spread`."""
    salt = hidden(rows, "salt")
    left = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    right = named.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*keys, salt], "left").drop(salt)


#: Rows of a table that is sent to every task: with some 400 bytes a row, 20 MB.
SMALL = 50_000


def by_group(rows: DataFrame, groups: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """rows joined with groups (few rows a key): sent out if they are counted to be few, else rows of a key are dealt to SALTS tasks."""
    if groups.count() <= SMALL:
        return rows.join(F.broadcast(groups), keys)
    mark = hidden(groups, "met")
    return salted_join(rows, groups.withColumn(mark, F.lit(True)), keys, spread).where(F.col(mark)).drop(mark)


def ranged(df: DataFrame, by: list, name: str = "ranged") -> tuple[DataFrame, DataFrame]:
    """df range-sorted by the columns `by` and stored, with (part, idx); and parts: part, rows, before.

    The place of a row in the whole order is before + idx.  Ties must be broken by
    `by` itself, so that equal keys spread over tasks.  parts has a row for each
    partition, a number that the cluster's settings bound.
    """
    m = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", m)
    kept = stored(placed, name)
    kept = kept.withColumns({"part": F.shiftright("_m", 33), "idx": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m")
    rows = sorted((r["part"], r["n"]) for r in kept.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, out = 0, []
    for part, n in rows:
        out.append((part, n, before))
        before += n
    return kept, df.sparkSession.createDataFrame(out, "part long, rows long, before long")
