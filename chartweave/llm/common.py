"""What the corpus operators share: cutting lineage, adding columns by Arrow batches, hashing words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only a session without that setting and with a local master (tests) gets a temporary folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not named:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="chartweave-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, by a compressed table in the shared folder: for large results that are read several times."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that holds tables of no further use."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def common_keys(rows: DataFrame, key: str, share: int = 1024) -> DataFrame:
    """(``key``, ``salts``): keys with over a ``share``-th of the rows, so fewer than ``share`` of them, which may be broadcast.

    Rows of such a key are dealt to ``salts`` tasks, so that none has more than about a ``share``-th of all. ``rows``
    may be a sample: the keys only say where rows go, not what becomes of them.
    """
    total = rows.count()
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(16, total // share))
    return cut(counts.select(key, F.ceil(F.col("n") * share / max(total, 1)).cast("int").alias("salts")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, lengthened by underscores until ``df`` has no such column (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that Python objects of few rows are held at once."""
    return (whole.slice(k, rows) for whole in batches for k in range(0, whole.num_rows, rows))


def with_arrow(df: DataFrame, of: list[str], fields: list[T.StructField], make: Callable[[], Callable]) -> DataFrame:
    """Add columns computed batch by batch in Python.

    ``make()`` runs once per task and returns a function from the columns ``of`` (as lists) to the
    new columns (Arrow arrays). All columns of ``df`` pass through untouched; a new column whose name is taken gets
    underscores behind it (``fresh``).
    """
    at = [df.columns.index(c) for c in of]
    fields = [T.StructField(n, f.dataType) for n, f in zip(fresh(df, *(f.name for f in fields)), fields, strict=True)]
    schema = T.StructType([*df.schema.fields, *fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in sliced(batches):
            new = work(*(batch.column(i).to_pylist() for i in at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return df.mapInArrow(run, schema)


def text_key(text: Column | str) -> list[Column]:
    """Two 64-bit hashes that stand for a text; 128 bits, so that different texts do not meet."""
    text = F.col(text) if isinstance(text, str) else text
    return [F.xxhash64(text), F.xxhash64(F.lit(0x5DEECE66D), text, F.length(text))]


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table`` (few rows for each key), with the rows of common keys, and of null, dealt by ``by`` to several tasks."""
    salt, salts = fresh(rows.join(table.limit(0), key), "salt__", "salts__")
    common = common_keys(rows.select(key), key).withColumnRenamed("salts", salts)
    dealt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(by), F.lit(4096))).otherwise(F.coalesce(F.pmod(F.xxhash64(by), F.col(salts)), F.lit(0)))
    left = rows.join(F.broadcast(common), key, "left").withColumn(salt, dealt).drop(salts)
    turns = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(salts) - 1, F.lit(0)).cast("long"))
    right = table.join(F.broadcast(common), key, "left").withColumn(salt, F.explode(turns)).drop(salts)
    return left.join(right, [key, salt], how).drop(salt)


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: The six ASCII characters that part words, and a random number for every byte.
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * MIX)
STRETCH = 1 << 20


@lru_cache(4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd factor and of its inverse, modulo 2^64."""
    factor = int(MIX)
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (factor, pow(factor, -1, 2**64)))


def word_hashes(raw: bytes) -> np.ndarray:
    """Stable 64-bit hashes of a text's words (UTF-8, parted by ASCII white space), in order.

    A word's hash is a difference of running sums over the bytes. Texts of over a megabyte are taken in
    stretches that end at white space.
    """
    if len(raw) > STRETCH:
        parts, at = [], 0
        while at < len(raw):
            space = re.compile(rb"[\t-\r ]").search(raw, at + STRETCH)
            end = space.end() if space else len(raw)
            parts.append(hashed_words(raw[at:end]))
            at = end
        return np.concatenate(parts)
    return hashed_words(raw)


def hashed_words(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    space = np.ones(len(b) + 2, bool)
    space[1:-1] = IS_SPACE[b]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(max(4096, 1 << (len(b) + 1).bit_length()))
    sums = np.zeros(len(b) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUES[b] * up[: len(b)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; a shorter text gives one hash of all its words, none if it has no word."""
    n = len(word_hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    # runs of 1, 2, 4, ... words, and those that add up to k
    out, done, power, size, factor = None, 0, word_hashes, 1, int(MIX)
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                part = power[done : n - k + 1 + done]
                out = part.copy() if out is None else out * np.uint64(factor) + part
                done += size
            if done == k:
                return mix64(out)
            power = power[: len(power) - size] * np.uint64(factor) + power[size:]
            size, factor = 2 * size, factor * factor % 2**64


def int_list(rows: Iterable[Iterable[int]], kind: pa.DataType) -> pa.Array:
    """A list array from an iterable of numpy arrays."""
    rows = list(rows)
    ends = np.cumsum([0, *(len(r) for r in rows)])
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))
