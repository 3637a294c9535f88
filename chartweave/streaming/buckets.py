"""Tables kept by streams: partitioned by a hash of the key, one version of a bucket for each batch that changed it, and a ledger of batches.

``data/bucket=b/batch=k`` holds bucket b as batch k left it, ``ledger/k`` says that batch k is in. Readers see, for each bucket, the newest version
of a batch in the ledger, so a batch that failed half-way is not seen, and one that comes again is written again or, if it is in
the ledger, left out. A version is never changed once it is in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BucketTable:
    """The table at ``path`` with rows of ``schema``, by the hash of ``key``; a table that isn't there yet is empty.

    ``buckets`` should grow with the table (a bucket is what a batch rewrites) and stays as it is for the table's life. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, folder: str) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.at(folder))] if self.fs.exists(self.at(folder)) else []

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def batches(self) -> set[int]:
        """The batches in the ledger."""
        return {int(n) for n in self.names("ledger") if n.isdigit()}

    def versions(self, only: list[int] | None = None) -> dict[int, list[int]]:
        """Batches in the ledger by bucket, the newest last."""
        there = self.batches()
        found = [int(n[7:]) for n in self.names("data") if n.startswith("bucket=")] if only is None else only
        held = {b: sorted(k for n in self.names(f"data/bucket={b}") if n.startswith("batch=") and (k := int(n[6:])) in there) for b in found}
        return {b: ks for b, ks in held.items() if ks}

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some."""
        paths = [f"{self.path}/data/bucket={b}/batch={ks[-1]}" for b, ks in self.versions(only).items()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def merge(self, batch: int, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Puts in its place what ``change(rows, held)`` makes of ``rows`` and the rows that their buckets hold; whether it did.

        ``change`` must give all rows of these buckets.
        """
        if batch in self.batches():
            return False
        rows = rows.withColumn("bucket", self.bucket()).persist()
        try:
            touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # as many as there are buckets at most
            for b in touched:  # what an earlier try of this batch has left
                self.fs.delete(self.at(f"data/bucket={b}/batch={batch}"), True)
            if touched:
                new = change(rows.drop("bucket"), self.read(touched)).withColumns({"bucket": self.bucket(), "batch": F.lit(batch)})
                new.repartition("bucket").write.mode("append").partitionBy("bucket", "batch").parquet(f"{self.path}/data")
        finally:
            rows.unpersist()
        self.fs.create(self.at(f"ledger/{batch}"), True).close()
        return True

    def forget(self, keep: int = 2) -> None:
        """Deletes all but the ``keep`` newest versions of each bucket; readers of older ones must be done."""
        for b, ks in self.versions().items():
            for k in ks[:-keep]:
                self.fs.delete(self.at(f"data/bucket={b}/batch={k}"), True)
