"""Token ids in files of patched frame-of-reference blocks, as a Spark data source (``idblocks``).

A file holds the ids of a range of documents in blocks of 1024. A block stores its minimum, the differences to it packed at the width
that a percentile of them needs, and the higher bits of those that need more as a list of exceptions. Behind
the blocks stand the documents (id, number of ids) and where each block starts, so that any document can be read by itself.

Layout (little-endian): ``PFR1``, block size (u32); blocks: minimum (u32), width (u16), exceptions (u16), packed
differences, places of the exceptions (u16 each), their higher bits (u32 each); documents: is null (u8 each), id (i64 each), ids
(u64 each); starts of blocks and their end (u64 each); footer: documents, ids, blocks, place of the documents, place
of the starts (u64 each), ``PFR1``.

Each task writes one file; ``manifest.json`` names the files of the tasks that succeeded, in order, so files of lost or
repeated tasks are never read.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import fresh, shared_folder, sliced
from .tokens import WholeTextEncoder

MAGIC = b"PFR1"
BLOCK = 1024
AT_ONCE = 256
HEAD, FOOT = struct.Struct("<IHH"), struct.Struct("<5Q4s")
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 1024 numbers below ``2 ** width``, as rows of ``128 * width`` bytes."""
    columns = np.ascontiguousarray(values.astype("<u8").reshape(-1, 64).T)
    words = np.zeros((width, columns.shape[1]), "<u8")
    for i in range(64 if width else 0):
        word, bit = divmod(i * width, 64)
        words[word] |= columns[i] << np.uint64(bit)
        if bit + width > 64:
            words[word + 1] |= columns[i] >> np.uint64(64 - bit)
    return np.ascontiguousarray(words.T).view(np.uint8).reshape(len(values), 16 * width * BLOCK // 128)


def unpacked(raw: np.ndarray, width: int) -> np.ndarray:
    """The numbers that ``packed`` was given."""
    words = np.ascontiguousarray(raw.reshape(-1).view("<u8").reshape(-1, width).T) if width else None
    columns = np.zeros((64, len(raw) * BLOCK // 64), "<u8")
    mask = np.uint64((1 << width) - 1)
    for i in range(64 if width else 0):
        word, bit = divmod(i * width, 64)
        x = words[word] >> np.uint64(bit)
        if bit + width > 64:
            x |= words[word + 1] << np.uint64(64 - bit)
        columns[i] = x & mask
    return np.ascontiguousarray(columns.T).astype("<u4").reshape(len(raw), BLOCK)


def packed_blocks(ids: np.ndarray, percentile: float) -> list[bytes]:
    """The blocks of ``ids`` (whole blocks). ``percentile``: the share of each block's differences that fit its width."""
    rows = ids.reshape(-1, BLOCK)
    least = rows.min(axis=1)
    above = rows - least[:, None]
    rank = max(0, min(BLOCK, int(np.ceil(percentile * BLOCK))) - 1)
    widths = np.frexp(np.partition(above, rank, axis=1)[:, rank].astype(float))[1]
    out = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        some = above[at]
        high = (some.astype("<u8") >> np.uint64(width)).astype("<u4")
        low = packed(some & np.uint32((1 << width) - 1), width)
        row, place = np.nonzero(high)
        ends = np.searchsorted(row, np.arange(len(at) + 1))
        places, highs = place.astype("<u2"), high[row, place]
        for k, block in enumerate(at.tolist()):
            a, b = ends[k], ends[k + 1]
            out[block] = HEAD.pack(int(least[block]), width, b - a) + low[k].tobytes() + places[a:b].tobytes() + highs[a:b].tobytes()
    return out


def unpacked_blocks(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """All ids of the blocks at ``starts`` (with the end of the last) in ``raw``."""
    heads = [HEAD.unpack_from(raw, s) for s in starts[:-1].tolist()]
    least, widths, exceptions = (np.array(x) for x in zip(*heads, strict=True))
    out = np.zeros((len(heads), BLOCK), "<u4")
    for width in np.unique(widths).tolist():
        at, size = np.flatnonzero(widths == width), 128 * width
        body = b"".join(raw[s : s + size] for s in (starts[at] + HEAD.size).tolist())
        out[at] = unpacked(np.frombuffer(body, np.uint8).reshape(len(at), size), width)
    for k in np.flatnonzero(exceptions).tolist():
        n, at = int(exceptions[k]), int(starts[k]) + HEAD.size + 128 * int(widths[k])
        places = np.frombuffer(raw, "<u2", n, at)
        out[k, places] |= np.frombuffer(raw, "<u4", n, at + 2 * n) << np.uint32(widths[k])
    return (out + least.astype("<u4")[:, None]).reshape(-1)


class BlockWriter:
    """Writes one file to an open stream, document by document."""

    def __init__(self, out, percentile: float):
        self.out, self.percentile, self.at, self.n_ids = out, percentile, 0, 0
        self.keys: list[int | None] = []
        self.lengths: list[int] = []
        self.starts: list[int] = []
        self.held: list[np.ndarray] = []
        self.size = 0
        self.put(MAGIC + struct.pack("<I", BLOCK))

    def put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.size += len(ids)
        self.n_ids += len(ids)
        if self.size >= AT_ONCE * BLOCK:
            self.flush(self.size // BLOCK * BLOCK)

    def flush(self, n: int) -> None:
        ids = np.concatenate([*self.held, np.zeros(0, "<u4")])
        self.held, self.size = [ids[n:]], len(ids) - n
        for k in range(0, n, AT_ONCE * BLOCK):
            for block in packed_blocks(ids[k : min(n, k + AT_ONCE * BLOCK)], self.percentile):
                self.starts.append(self.at)
                self.put(block)

    def close(self) -> None:
        if short := -self.size % BLOCK:  # the last block is filled with an id that it holds
            self.held = [rest := np.concatenate(self.held), np.repeat(rest[-1:], short)]
            self.size += short
        self.flush(self.size)
        documents = self.at
        self.starts.append(self.at)
        self.put(np.array([k is None for k in self.keys], "u1").tobytes())
        self.put(np.array([k or 0 for k in self.keys], "<i8").tobytes())
        self.put(np.array(self.lengths, "<u8").tobytes())
        index = self.at
        self.put(np.array(self.starts, "<u8").tobytes())
        self.put(FOOT.pack(len(self.keys), self.n_ids, len(self.starts) - 1, documents, index, MAGIC))


class BlockFile:
    """A file open for reading: its documents and any range of its ids."""

    def __init__(self, source):
        self.source = source
        self.size = source.size()
        docs, self.n_ids, blocks, documents, index, magic = FOOT.unpack(self.range(self.size - FOOT.size, FOOT.size))
        if magic != MAGIC or self.range(0, 8) != MAGIC + struct.pack("<I", BLOCK):
            raise ValueError("not a file of id blocks")
        raw = self.range(documents, 17 * docs)
        self.null = np.frombuffer(raw, "u1", docs).astype(bool)
        self.keys = np.frombuffer(raw, "<i8", docs, docs)
        self.ends = np.cumsum(np.frombuffer(raw, "<u8", docs, 9 * docs).astype(np.int64))
        self.starts = np.frombuffer(self.range(index, 8 * (blocks + 1)), "<u8").astype(np.int64)

    def range(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, first: int, end: int) -> np.ndarray:
        """The ids from ``first`` to ``end`` (not included)."""
        if first >= end:
            return np.zeros(0, "<u4")
        a, b = first // BLOCK, -(-end // BLOCK)
        starts = self.starts[a : b + 1]
        raw = self.range(int(starts[0]), int(starts[-1] - starts[0]))
        return unpacked_blocks(raw, starts - starts[0])[first - a * BLOCK : end - a * BLOCK]

    def documents(self, low: int, high: int) -> tuple[int, int]:
        """Numbers of the documents whose first id lies from ``low`` on and below ``high``; an empty one counts where it stands."""
        begins = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        return int(np.searchsorted(begins, low)), int(np.searchsorted(begins, high))


def placed(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``path`` and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    documents: int
    ids: int


@dataclass
class Segment(InputPartition):
    """The documents of a file whose first id lies in a range; ``base``: ids in the files before it."""

    file: str
    base: int
    low: int
    high: int


class IdBlocksWriter(DataSourceArrowWriter):
    def __init__(self, path: str, percentile: float, overwrite: bool):
        self.path, self.percentile, self.overwrite = path, percentile, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, at = placed(self.path)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.idblocks"
        where.create_dir(at, recursive=True)
        with where.open_output_stream(f"{at}/{name}") as out:
            writer = BlockWriter(out, self.percentile)
            for batch in iterator:
                for key, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    writer.add(key, np.frombuffer(ids.as_buffer(), "<u4") if ids.is_valid else np.zeros(0, "<u4"))
                writer.held = [x.copy() for x in writer.held]  # batches go
            writer.close()
        return Written(part, name, len(writer.keys), writer.n_ids)

    def commit(self, messages: list[Written | None]) -> None:
        where, at = placed(self.path)
        where.create_dir(at, recursive=True)
        files = [[m.file, m.documents, m.ids] for m in sorted((m for m in messages if m), key=lambda m: m.partition)]
        old = manifest(self.path) if where.get_file_info(f"{at}/manifest.json").type == fs.FileType.File else []
        with where.open_output_stream(f"{at}/manifest.json") as out:
            out.write(json.dumps(files if self.overwrite else old + files).encode())
        for name, *_ in old if self.overwrite else []:
            where.delete_file(f"{at}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        where, at = placed(self.path)
        for m in filter(None, messages):
            where.delete_file(f"{at}/{m.file}")


def manifest(path: str) -> list[list]:
    """(file, documents, ids) of the files, in the order of their ids."""
    where, at = placed(path)
    with where.open_input_stream(f"{at}/manifest.json") as source:
        return json.loads(source.read())


class IdBlocksReader(DataSourceReader):
    def __init__(self, path: str, segment: int):
        self.path, self.segment = path, segment

    def partitions(self) -> list[Segment]:
        out, base = [], 0
        for name, documents, ids in manifest(self.path):
            # the last segment also has documents without ids that stand at the end
            out += [Segment(name, base, low, low + self.segment if low + self.segment < ids else ids + 1) for low in range(0, max(1, ids) if documents else 0, self.segment)]
            base += ids
        return out or [Segment("", 0, 0, 0)]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        where, at = placed(self.path)
        with where.open_input_file(f"{at}/{partition.file}") as source:
            held = BlockFile(source)
            doc, stop = held.documents(partition.low, partition.high)
            while doc < stop:
                first = int(held.ends[doc - 1]) if doc else 0
                # some documents at once, a longer one by itself
                end = max(doc + 1, min(stop, int(np.searchsorted(held.ends, first + AT_ONCE * BLOCK, "right"))))
                ends = held.ends[doc:end]
                ids = held.ids(first, int(ends[-1]))
                starts = np.concatenate([[first], ends[:-1]])
                spans = pa.py_buffer(np.concatenate([[0], ends - first]).astype("<i4") * np.int32(4))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(held.keys[doc:end], pa.int64(), mask=held.null[doc:end]),
                        pa.array(starts + partition.base, pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.Array.from_buffers(pa.binary(), end - doc, [None, spans, pa.py_buffer(ids.tobytes())]),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )
                doc = end


class IdBlocks(DataSource):
    """``idblocks``: options ``path``; on writing ``percentile`` (0.98), on reading ``segment`` (ids a task, 4,194,304)."""

    @classmethod
    def name(cls) -> str:
        return "idblocks"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: T.StructType) -> IdBlocksReader:
        return IdBlocksReader(self.options["path"], int(self.options.get("segment", 4 << 20)))

    def writer(self, schema: T.StructType, overwrite: bool) -> IdBlocksWriter:
        kinds = [f.dataType for f in schema]
        if kinds != [T.LongType(), T.BinaryType()]:
            raise ValueError("rows must be (document's id: long, ids: binary)")
        return IdBlocksWriter(self.options["path"], float(self.options.get("percentile", 0.98)), overwrite)


def encoded(df: DataFrame, path: str, end_id: int | None = None, *, text: str = "text") -> DataFrame:
    """The columns but the text, with ``ids``: the whole text's ids, then ``end_id``, as little-endian unsigned 32-bit integers.

    A null text counts as empty. If there is a column ``ids``, the new one gets underscores behind it.
    """
    kept = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(*fresh(df.select(*kept), "ids"), T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WholeTextEncoder(path, added=True)
        last = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for batch in sliced(batches):
            ids = [encoder(t or "").tobytes() + last for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary())], names=schema.names)

    return df.select(*kept, text).mapInArrow(run, schema)


def write_ids(df: DataFrame, folder: str, path: str, *, end_id: int | None = None, text: str = "text", doc_id: str = "doc_id", percentile: float = 0.98) -> None:
    """The ids of all texts, by the tokenizer file ``path``, into files of ``folder`` in ascending order of ``doc_id``.

    Rows are dealt by ranges of ids and sorted, then encoded once, task by task. Null ids come first; rows of one id stand
    in the order of their text's hash, and repeated rows in any order, so a common id is dealt to several tasks. A null text counts as empty;
    texts may have any length; an empty table gives a folder that is read as empty. Other columns are left out.
    """
    df.sparkSession.dataSource.register(IdBlocks)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), "hash", "row"]
    rows = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    encoded(rows, path, end_id).write.format("idblocks").option("percentile", percentile).mode("overwrite").save(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of ``write_ids`` (``doc_id``, ``start``: ids of all documents before it, ``n_tokens``, ``ids`` as little-endian unsigned 32-bit integers)."""
    spark.dataSource.register(IdBlocks)
    return spark.read.format("idblocks").load(folder)


def op13_patched_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids in files of patched blocks, and what is read back from them."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    write_ids(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
