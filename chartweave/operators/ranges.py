"""Running numbers and idle gaps of keys of any size: rows are sorted by ranges, so a key with many rows lies in many tasks."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session without that setting (tests) gets a temporary one."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="chartweave-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind those that ``df`` has."""
    taken = {c.lower() for c in df.columns}
    return [reduce(lambda n, _: n + "_" if n.lower() in taken else n, taken, n) for n in names]


def same_key(key: str) -> Column:
    """A key's text that is never null; null differs from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


class Ranges:
    """Rows of ``df`` sorted by ``key`` and ``order``, in parts that tasks hold; a part has rows of several keys, a key rows in several parts.

    ``order`` must tell the rows of a key apart, else rows that it doesn't tell apart come in any order. Windows run over (key, part); what
    crosses parts is summed up from one row for each key and part, so there a window over a key has no more rows than there are parts.
    """

    def __init__(self, df: DataFrame, key: str, order: list[str], descending: bool = False):
        self.part, self.group = free(df, "part__", "group__")
        by = [F.desc(c) if descending else F.asc(c) for c in order]
        rows = df.withColumn(self.group, same_key(key))
        # once for all: another run would draw other ranges
        self.rows = cut(rows.repartitionByRange(F.col(self.group), *by).withColumn(self.part, F.spark_partition_id()))
        self.order, self.columns = order, df.columns
        self.here = W.partitionBy(self.group, self.part).orderBy(*by)
        self.parts = W.partitionBy(self.group).orderBy(self.part)

    def before(self, rows: DataFrame, name: str) -> DataFrame:
        """With the struct ``name`` of the order of the key's row before (null: it is the first); for ascending order."""
        now = F.struct(*self.order)
        ends = self.rows.groupBy(self.group, self.part).agg(F.max(now).alias("last__"))
        ends = ends.select(self.group, self.part, F.lag("last__").over(self.parts).alias("before__"))
        rows = rows.join(ends, [self.group, self.part])
        return rows.withColumn(name, F.coalesce(F.lag(now).over(self.here), F.col("before__"))).drop("before__")

    def running(self, rows: DataFrame, value: Column, name: str) -> DataFrame:
        """With the sum of ``value`` over the key's rows up to this one."""
        rows = rows.withColumn(name, value)
        sums = rows.groupBy(self.group, self.part).agg(F.sum(name).alias("sum__"))
        earlier = F.coalesce(F.sum("sum__").over(self.parts.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        sums = sums.select(self.group, self.part, earlier.alias("earlier__"))
        total = F.sum(name).over(self.here.rowsBetween(W.unboundedPreceding, W.currentRow))
        return rows.withColumn(name, total).join(sums, [self.group, self.part]).withColumn(name, F.col(name) + F.col("earlier__")).drop("earlier__")

    def done(self, rows: DataFrame) -> DataFrame:
        return rows.drop(self.group, self.part)


def numbered(df: DataFrame, key: str, order: list[str], name: str, descending: bool = False) -> DataFrame:
    """With the place (from 1) of each row among those of its key, as ``row_number`` over the key gives it."""
    ranges = Ranges(df, key, order, descending)
    return ranges.done(ranges.running(ranges.rows, F.lit(1).cast("long"), name))


def summed(df: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """With the running sum of ``value`` over the rows of each key in ``order``."""
    ranges = Ranges(df, key, order)
    return ranges.done(ranges.running(ranges.rows, value, name))


def segments(df: DataFrame, key: str, order: list[str], idle: Callable[[Column, Column], Column], name: str = "segment") -> DataFrame:
    """With the number of each row's segment among those of its key: a new one begins where ``idle(before, now)`` holds.

    ``before`` and ``now`` are structs of ``order``. A state machine that forgets all after such a gap may
    run over every segment by itself, so a key is as many tasks' work as it has gaps.
    """
    ranges = Ranges(df, key, order)
    (before,) = free(ranges.rows, "before_row")
    rows = ranges.before(ranges.rows, before)
    starts = F.col(before).isNull() | idle(F.col(before), F.struct(*order))
    return ranges.done(ranges.running(rows, F.coalesce(starts, F.lit(False)).cast("long"), name).drop(before))
