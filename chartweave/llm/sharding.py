"""Histogram sort: shards of near-equal bytes by exact counts below probed key boundaries.

Every row gets a 64-bit key: 28 bits of its text's hash, then 36 bits of its id's hash. Equal texts are
thus neighbours, and a group of copies that is too large for one shard can still be divided. The key space
is probed level by level: one aggregation counts rows and bytes of each cell, and only cells that hold too
many rows, or in which a splitter still misses its tolerance, are divided further. The driver sees counts
of cells only. When all splitters meet the tolerance, rows are exchanged once and get their slots.

DataFrame operations only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import cut, fresh

#: Bits of the key that each level of probing adds: 14 + 7 + 7 of the text's hash, then six times 6 of the id's.
LEVELS = (14, 7, 7, 6, 6, 6, 6, 6, 6)
TEXT_BITS = sum(LEVELS[:3])


def shard_key(text: Column, doc_id: Column) -> Column:
    top = F.shiftrightunsigned(F.xxhash64(text), 64 - TEXT_BITS)
    return F.shiftleft(top, 64 - TEXT_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(doc_id), TEXT_BITS))


def splitters(cells: list[tuple[int, int, int]], shards: int) -> list[int]:
    """For cells (start, bytes, rows) in key order, the number of cells below each of the inner splitters."""
    sums = [0, *accumulate(c[1] for c in cells)]
    out = []
    for k in range(1, shards):
        want = sums[-1] * k / shards
        i = bisect_left(sums, want)
        out.append(i if i == 0 or sums[i] - want <= want - sums[i - 1] else i - 1)
    return out


def histogram_shards(
    df: DataFrame,
    shards: int = 24,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    keep: list[str] | None = None,
    tolerance: float = 0.001,
    cell_rows: int = 128,
) -> DataFrame:
    """The columns ``keep`` (all by default) with ``shard_bytes`` (UTF-8 bytes + 8), ``shard`` (0 ..) and ``slot`` (gapless from 0).

    Splitters stop moving when the bytes below each are within ``tolerance`` of a shard's share, or within
    half of the largest row, of their target. Cells with more than ``cell_rows`` rows, or more than one row
    in 4096 of the table, are divided so that no task has to order a large group of copies.

    A null text has no bytes; null ids and repeated rows are rows as others (rows that agree in text and id
    stay in one cell, in any order). An empty table gives an empty result. Columns of ``df`` may have any
    names but the three added ones.
    """
    key, size, tie, cell, leaf, base = fresh(df, "key__", "size__", "tie__", "cell__", "leaf__", "base__")
    spark, kept = df.sparkSession, df.columns if keep is None else keep
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        *kept, shard_key(body, F.col(doc_id)).alias(key), (F.octet_length(body).cast("long") + 8).alias(size), F.xxhash64(body, F.col(doc_id)).alias(tie)
    )
    probed = cut(rows.select(key, size)) if keep is None else cut(rows)
    rows = rows if keep is None else probed

    def prefix(bits: int) -> Column:
        return F.shiftrightunsigned(F.col(key), 64 - bits)

    most = probed.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"), F.max(size).alias("m")).first()
    if not most["n"]:
        return rows.select(*kept, F.col(size).alias("shard_bytes"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    enough, near = max(cell_rows, most["n"] // 4096), max(tolerance * most["b"] / shards, most["m"] / 2)

    bits, divided = 0, []  # divided: for each level, (bits, the prefixes that go a level deeper)
    cells: dict[tuple[int, int], tuple[int, int]] = {}
    wanted: list[int] | None = None
    for more in LEVELS:
        part = probed
        if wanted is not None:
            part = probed.join(F.broadcast(one_column(spark, cell, wanted)), prefix(bits) == F.col(cell), "left_semi")
            for p in wanted:
                del cells[(bits, p)]
            divided.append((bits, wanted))
        bits += more
        counted = part.groupBy(prefix(bits).alias(cell)).agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n")).collect()
        cells |= {(bits, r[cell]): (r["b"], r["n"]) for r in counted}
        laid = sorted((p << (64 - b), by, n, b, p) for (b, p), (by, n) in cells.items())
        sums = [0, *accumulate(x[1] for x in laid)]
        wanted = {x[4] for x in laid if x[3] == bits and x[2] > enough}
        for k, i in enumerate(splitters([x[:3] for x in laid], shards), 1):
            want = sums[-1] * k / shards
            if abs(sums[i] - want) > near:
                holder = laid[min(len(laid) - 1, max(0, bisect_right(sums, want) - 1))]
                if holder[3] == bits:
                    wanted.add(holder[4])
        wanted = sorted(wanted)
        if not wanted:
            break

    at, shard, below, plan = splitters([x[:3] for x in laid], shards), 0, 0, []
    for i, (_, _, n, b, p) in enumerate(laid):
        while shard < shards - 1 and i >= at[shard]:
            shard, below = shard + 1, 0
        plan.append((b, p, shard, below))
        below += n

    found = rows.withColumn(leaf, F.lit(LEVELS[0])).withColumn(cell, prefix(LEVELS[0]))
    deep = LEVELS[0]
    for (b, gone), more in zip(divided, LEVELS[1:], strict=False):
        deep = b + more
        mark = fresh(found, "deeper__")[0]
        found = found.join(F.broadcast(one_column(spark, mark, gone)), (F.col(leaf) == b) & (F.col(cell) == F.col(mark)), "left")
        found = found.withColumn(leaf, F.when(F.col(mark).isNotNull(), F.lit(deep)).otherwise(F.col(leaf)))
        found = found.withColumn(cell, F.when(F.col(mark).isNotNull(), prefix(deep)).otherwise(F.col(cell))).drop(mark)
    # a row for each cell: at most 16,384 of the first level and 4,096 x 128 of each later one
    where = spark.createDataFrame(plan, f"{leaf} int, {cell} long, shard int, {base} long")
    found = found.join(F.broadcast(where), [leaf, cell])
    rank = F.row_number().over(W.partitionBy(leaf, cell).orderBy(key, tie))
    found = found.withColumn("slot", F.col(base) + rank - 1).withColumn("shard_bytes", F.col(size))
    return found.select(*kept, "shard_bytes", "shard", "slot")


def one_column(spark: SparkSession, name: str, values: list[int]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField(name, T.LongType())]))


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    return histogram_shards(docs, 24, keep=["doc_id", "text_crc32"]).select(
        "doc_id",
        F.col("shard_bytes").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
