"""Streams that keep tables up to date, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import DataStreamWriter

from ..operators import summaries
from .buckets import BucketTable


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path, on whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


CONTENT = ["patient_id", "sha256_hash"]


def add_new(batch: DataFrame, path: str, buckets: int = 64) -> None:
    """Appends to the table at ``path`` the first document (by ``created_at``, then ``id``) of each patient and content that it lacks; null counts as a value.

    The table is partitioned by ``content_bucket``, a hash of both, and only the buckets that the batch touches are read. A batch that comes
    again, also one that stopped half-way, adds what is missing and nothing else.
    """
    spark = batch.sparkSession
    key = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in CONTENT]
    place = F.row_number().over(W.partitionBy(*CONTENT).orderBy("created_at", "id"))
    first = batch.withColumn("place__", place).where("place__ = 1").drop("place__")
    first = first.withColumn("content_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
    try:
        new = first
        if exists(spark, path):
            touched = [r[0] for r in first.select("content_bucket").distinct().collect()]  # as many as there are buckets at most
            held = spark.read.schema(first.schema).parquet(path).where(F.col("content_bucket").isin(touched)).select("content_bucket", *CONTENT).alias("held")
            same = [F.col(f"new.{c}").eqNullSafe(F.col(f"held.{c}")) for c in ["content_bucket", *CONTENT]]
            new = first.alias("new").join(held, same, "left_anti")
        new.repartition("content_bucket").write.mode("append").partitionBy("content_bucket").parquet(path)
    finally:
        first.unpersist()


def new_documents(arrivals: DataFrame, path: str, buckets: int = 64) -> DataStreamWriter:
    """Arriving documents whose patient and content are new go to the table at ``path``, however late they come: the table itself is the state."""
    return arrivals.writeStream.foreachBatch(lambda batch, _: add_new(batch, path, buckets))


STATUSES = "document_id string, status string, n_events long, at struct<ts: timestamp, id: long>"


def merged_statuses(events: DataFrame, held: DataFrame) -> DataFrame:
    """The last status of each document by time and id, and its number of events, of new events and held rows."""
    order = F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"))
    new = events.groupBy("document_id").agg(F.max_by("status", order).alias("status"), F.count(F.lit(1)).alias("n_events"), F.max(order).alias("at"))
    return held.unionByName(new).groupBy("document_id").agg(F.max_by("status", "at").alias("status"), F.sum("n_events").alias("n_events"), F.max("at").alias("at"))


def upserted_statuses(events: DataFrame, path: str, buckets: int = 64) -> DataStreamWriter:
    """Status events (``id``, ``document_id``, ``status``, ``ts``) keep the table of last statuses at ``path``; they may come in any order, and batches again."""

    def upsert(batch: DataFrame, number: int) -> None:
        BucketTable(batch.sparkSession, path, STATUSES, ["document_id"], buckets).merge(number, batch, merged_statuses)

    return events.writeStream.foreachBatch(upsert)


def statuses_at(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``upserted_statuses`` keeps: (``document_id``, ``status``, ``n_events``)."""
    return BucketTable(spark, path, STATUSES, ["document_id"]).read().drop("at")


def refreshed(reviews: DataFrame, records: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str) -> DataStreamWriter:
    """Each batch of reviews (``record_id``) computes the touched buckets of a derived table anew.

    ``records``: ``patient_id`` and ``record_id``. ``compute`` takes patients (``patient_id``) and returns their rows. A batch that comes again
    computes the same buckets again, so the table is the same.
    """
    def run(batch: DataFrame, _: int) -> None:
        patients = summaries.touched(batch.where(F.col("record_id").isNotNull()), records)
        summaries.rebuild(compute(patients), path)

    return reviews.writeStream.foreachBatch(run)
