"""A library that documents are added to batch by batch, each of them once and wholly or not at all.

A batch's documents and paragraphs are written to folders of their own; last of all its
number goes into the ledger.  Readers see the batches of the ledger alone, so a batch that
failed half-way isn't there, is written anew when it comes again, and one that comes
twice changes nothing.  Nothing is ever changed in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LEDGER = "batch long, n_new long, n_known long"
_DOCUMENTS = "doc_id long, family string, sha256 string, n_paragraphs int, batch long"
_PARAGRAPHS = "doc_id long, no int, text string, batch long"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a table that may not have been written yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """batch, n_new and n_known of the batches that are in the library."""
    return _table(spark, f"{root}/ledger", _LEDGER)


def _committed(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    rows = _table(spark, f"{root}/{name}", schema)
    # one row for each batch ever added
    return rows.join(F.broadcast(ledger(spark, root).select("batch").distinct()), "batch", "left_semi")


def documents(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, family, sha256, n_paragraphs, batch and status: of a family the document added last is active, deleted ones are gone."""
    deleted = _table(spark, f"{root}/deleted", "doc_id long")
    rows = _committed(spark, root, "documents", _DOCUMENTS).join(deleted.distinct(), "doc_id", "left_anti")
    last = rows.groupBy("family").agg(F.max(F.struct("batch", "doc_id")).alias("last")).select(F.col("last.doc_id").alias("doc_id"), F.lit("active").alias("now"))
    return rows.join(last, "doc_id", "left").withColumn("status", F.coalesce("now", F.lit("inactive"))).drop("now")


def paragraphs(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, no, text and batch of the paragraphs of the documents that are there."""
    return _committed(spark, root, "paragraphs", _PARAGRAPHS).join(documents(spark, root).select("doc_id"), "doc_id", "left_semi")


def delete(spark: SparkSession, root: str, ids: DataFrame) -> None:
    """Take documents (doc_id) out of the library; one write, so all of them go or none."""
    ids.select("doc_id").where("doc_id is not null").distinct().coalesce(1).write.mode("append").parquet(f"{root}/deleted")


def reviewed(incoming: DataFrame, library: DataFrame) -> DataFrame:
    """incoming (doc_id, family, text) with sha256 and verdict: new, or known if the content is in the library or comes earlier in the batch."""
    rows = incoming.where("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    # first of a content by a minimum, so that thousands of copies are no group of one task
    first = rows.groupBy("sha256").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = library.select("sha256").distinct().withColumn("there", F.lit(True))
    fresh = first.join(known, "sha256", "left").where("there is null").select("doc_id", "first")
    taken = library.select("doc_id").distinct().withColumn("taken", F.lit(True))
    met = rows.join(fresh, "doc_id", "left").join(taken, "doc_id", "left")
    return met.withColumn("verdict", F.when(F.col("first") & F.col("taken").isNull(), "new").otherwise("known")).drop("first", "taken")


def add_batch(rows: DataFrame, batch: int, root: str, confirm=None) -> None:
    """Add the documents (doc_id, family, text) of one batch that are new, and that `confirm`, a column, agrees to.

    Documents of a content that is there already, and of a doc_id that is taken, are known.
    A batch whose number the ledger has is left alone.
    """
    spark = rows.sparkSession
    if not ledger(spark, root).where(F.col("batch") == batch).isEmpty():
        return
    found = reviewed(rows, documents(spark, root))
    if confirm is not None:
        found = found.withColumn("verdict", F.when((F.col("verdict") == "new") & ~F.coalesce(confirm, F.lit(False)), "refused").otherwise(F.col("verdict")))
    # what was found is kept before it is used: the library is part of its question
    found.write.mode("overwrite").parquet(f"{root}/review/batch={batch}")
    found = spark.read.schema(found.schema).parquet(f"{root}/review/batch={batch}")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    new = found.where("verdict = 'new'")
    new.select("doc_id", "family", "sha256", F.size(lines).alias("n_paragraphs")).write.mode("overwrite").parquet(f"{root}/documents/batch={batch}")
    new.select("doc_id", F.posexplode(lines).alias("no", "text")).write.mode("overwrite").parquet(f"{root}/paragraphs/batch={batch}")
    counts = found.agg(F.count_if(F.col("verdict") == "new").alias("n_new"), F.count_if(F.col("verdict") == "known").alias("n_known"))
    counts.select(F.lit(batch).cast("long").alias("batch"), "n_new", "n_known").coalesce(1).write.mode("append").parquet(f"{root}/ledger")


def follow(landing: DataFrame, root: str, confirm=None):
    """Add every batch of a stream of documents (doc_id, family, text) to the library until no file is left; starts again where it stopped."""
    run = landing.writeStream.foreachBatch(lambda rows, batch: add_batch(rows, batch, root, confirm)).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
