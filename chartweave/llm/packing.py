"""Packing by a linear grouping scheme, planned on the histogram of lengths alone.

Lengths are at most the capacity, so the driver plans with a table of that many counts whatever the corpus:
large lengths are rounded up to the largest of their group (groups of equal cardinality), a linear program
over configurations of the few group sizes is solved by column generation, actual lengths take the places of
the rounded ones, and small lengths go to the tightest gaps. The plan says, for each length, where its
documents go by their rank; ranks are made by one exchange in which common lengths are salted.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import cut, fresh, sliced
from .tokens import WholeTextEncoder

#: A run of sequences that are filled alike: their number, and (length, how often) from offset 0 on.
Run = tuple[int, list[tuple[int, int]]]


def grouped(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, longest first, in groups of equal cardinality as (length, count)."""
    total = sum(counts.values())
    out: list[list[tuple[int, int]]] = []
    seen = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = min(groups - 1, seen * groups // total)
            end = -(-total * (k + 1) // groups)
            n = min(left, end - seen)
            while len(out) <= k:
                out.append([])
            out[k].append((length, n))
            seen, left = seen + n, left - n
    return [g for g in out if g]


def best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size make the most worthy filling of one sequence."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    size = np.array(sizes)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fits = size <= c
        if fits.any():
            gain = np.where(fits, best[np.maximum(c - size, 0)] + worth, -1)
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], took[c] = gain[k], k
    out, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            out[took[c]] += 1
            c -= sizes[took[c]]
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 200) -> list[tuple[int, list[int]]]:
    """Whole numbers of configurations, by rounding down the solution of the configuration program."""
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = best_configuration(sizes, worth, capacity)
        if column @ worth <= 1 + 1e-7:
            break
        amount, change = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(change > 1e-9, np.maximum(amount, 0) / change, np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = column
    amount = np.floor(np.maximum(np.linalg.solve(basis, need), 0) + 1e-6).astype(int)
    return [(int(n), basis[:, k].round().astype(int).tolist()) for k, n in enumerate(amount) if n]


class Gaps:
    """Runs by the room that is left in their sequences."""

    def __init__(self):
        self.sizes: list[int] = []
        self.at: dict[int, list[Run]] = defaultdict(list)

    def add(self, gap: int, run: Run) -> None:
        if not self.at[gap]:
            insort(self.sizes, gap)
        self.at[gap].append(run)

    def tightest(self, length: int) -> tuple[int, Run] | None:
        i = bisect_left(self.sizes, length)
        if i == len(self.sizes):
            return None
        gap = self.sizes[i]
        run = self.at[gap].pop()
        if not self.at[gap]:
            del self.sizes[i]
        return gap, run


def plan(counts: dict[int, int], capacity: int, *, small: int | None = None, groups: int = 24) -> list[Run]:
    """Runs that hold every length of ``counts`` (length: number), each sequence within ``capacity``."""
    small = capacity // 8 if small is None else small
    left = {k: n for k, n in counts.items() if n}
    done: list[Run] = []
    if left.get(capacity):
        done.append((left.pop(capacity), [(capacity, 1)]))
    gaps = Gaps()
    large = {k: n for k, n in left.items() if k > small}
    if large:
        members = grouped(large, groups)
        sizes = [g[0][0] for g in members]
        # equal sizes count as one, else the program has many equal solutions
        same: dict[int, list[tuple[int, int]]] = {}
        for s, g in zip(sizes, members, strict=True):
            same.setdefault(s, []).extend(g)
        sizes, members = list(same), list(same.values())
        queues = [list(g) for g in members]
        for number, config in configurations(sizes, [sum(n for _, n in g) for g in members], capacity):
            while number > 0 and any(config):
                # the next run whose places all take one length each, as far as the documents reach
                inside, run = number, []
                merged = [(k, config[k]) for k in range(len(config)) if config[k]]
                for k, times in merged:
                    if queues[k] and queues[k][0][1] >= times:
                        inside = min(inside, queues[k][0][1] // times)
                        run.append((k, times))
                if len(run) == len(merged):
                    lengths = [(queues[k][0][0], times) for k, times in run]
                    for k, times in run:
                        spend(queues[k], inside * times)
                else:  # a place at the joint of two lengths, or documents that have run out: one sequence by itself
                    inside, lengths = 1, []
                    for k, times in merged:
                        for _ in range(times):
                            if queues[k]:
                                lengths.append((queues[k][0][0], 1))
                                spend(queues[k], 1)
                    if not lengths:
                        break
                gaps.add(capacity - sum(x * t for x, t in lengths), (inside, lengths))
                number -= inside
        left = {k: n for k, n in left.items() if k <= small}
        for q in queues:
            for length, n in q:
                left[length] = left.get(length, 0) + n
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            found = gaps.tightest(length)
            gap, (bins, inside) = found or (capacity, (-(-n // (capacity // length)), []))
            each = min(gap // length, n)
            full = min(bins, n // each)
            if full < bins and found:
                gaps.add(gap, (bins - full, inside))
            if not found and full < bins:  # the last new sequence is not full
                bins = full
            gaps.add(gap - each * length, (full, [*inside, (length, each)]))
            n -= full * each
    return done + [run for runs in gaps.at.values() for run in runs]


def best_plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """The plan with the fewest sequences among those that call lengths over a third, or over half, of the capacity large.

    Two large documents fill a sequence in the first, where rounding up costs more; the second leaves more to best fit.
    """
    least = -(-sum(k * n for k, n in counts.items()) // capacity)
    best: list[Run] | None = None
    for part in (3, 2):
        runs = plan(counts, capacity, small=capacity // part)
        if best is None or sum(r[0] for r in runs) < sum(r[0] for r in best):
            best = runs
        if sum(r[0] for r in best) == least:
            break
    return best


def spend(queue: list[tuple[int, int]], n: int) -> None:
    length, have = queue[0]
    if have == n:
        queue.pop(0)
    else:
        queue[0] = (length, have - n)


def allotments(runs: list[Run]) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """For each length, (first rank, first sequence, how many in a sequence, offset) in rank order."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    given: dict[int, int] = defaultdict(int)
    first = 0
    for bins, inside in runs:
        offset = 0
        for length, times in inside:
            out[length].append((given[length], first, times, offset))
            given[length] += bins * times
            offset += length * times
        first += bins
    return sorted(out.items())


def pack(pieces: DataFrame, capacity: int, *, length: str = "length", identity: list[str] | None = None) -> DataFrame:
    """All columns with ``sequence_id`` and ``offset``; lengths are 1 to ``capacity``.

    ``pieces`` is read several times, so it should be cut (checkpointed or a table). ``identity``: columns
    that tell rows apart (all by default); rows that agree in them are interchangeable. An empty table gives
    an empty result. Common lengths are salted: no task orders more than about one row in 65,536. A new column whose
    name is taken gets underscores behind it.
    """
    new_id, new_offset = fresh(pieces, "sequence_id", "offset")
    spark = pieces.sparkSession
    identity = identity or pieces.columns
    salt, base, rank, lots, lot, long, salts, n = fresh(pieces, "salt__", "base__", "rank__", "lots__", "lot__", "len__", "salts__", "n__")
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most `capacity` rows
    if counts and not (min(counts) >= 1 and max(counts) <= capacity):
        raise ValueError(f"lengths must be 1 to {capacity}")
    enough = max(256, sum(counts.values()) // 65_536)
    placed = allotments(best_plan(counts, capacity))
    lot_type = "array<struct<first:long,sequence:long,times:long,offset:long>>"
    # a row for each length, so at most `capacity` rows; their lots do not grow with the corpus
    table = spark.createDataFrame(
        [(k, -(-counts[k] // enough), v) for k, v in placed], f"`{long}` long, `{salts}` long, `{lots}` {lot_type}"
    )
    cells = pieces.withColumn(long, F.col(length).cast("long")).join(F.broadcast(table), long)
    cells = cells.withColumn(salt, F.pmod(F.xxhash64(*identity), F.col(salts)))
    # at most 65,536 + `capacity` rows
    sizes = cells.groupBy(long, salt).agg(F.count(F.lit(1)).alias(n))
    sizes = sizes.withColumn(base, F.coalesce(F.sum(n).over(W.partitionBy(long).orderBy(salt).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop(n)
    ranked = cells.withColumn(rank, F.row_number().over(W.partitionBy(long, salt).orderBy(*identity)) - 1)
    ranked = ranked.join(F.broadcast(sizes), [long, salt]).withColumn(rank, F.col(rank) + F.col(base))
    ranked = ranked.withColumn(lot, F.element_at(F.filter(lots, lambda x: x["first"] <= F.col(rank)), -1))
    inside = F.col(rank) - F.col(lot)["first"]
    times = F.col(lot)["times"]
    return ranked.select(
        *pieces.columns,
        (F.col(lot)["sequence"] + F.floor(inside / times)).cast("long").alias(new_id),
        (F.col(lot)["offset"] + F.pmod(inside, times) * F.col(long)).cast("long").alias(new_offset),
    )


def token_pieces(df: DataFrame, path: str, capacity: int = 2048, *, text: str = "text", end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """The other columns with a row for each piece: ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked, ``ids``.

    A document is its ids and then ``end_id``. Only longer ones than ``capacity`` are cut, so that all pieces
    but the first are full. A null text counts as empty: one piece with the end id alone. Equal rows give equal
    pieces, an empty table gives none; texts may have any length. A new column whose name is taken gets underscores behind it.
    """
    kept = [c for c in df.columns if c != text]
    kinds = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    if keep_ids:
        kinds.append(("ids", T.ArrayType(T.IntegerType())))
    fields = [T.StructField(n, t) for n, (_, t) in zip(fresh(df.select(*kept), *(n for n, _ in kinds)), kinds, strict=True)]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WholeTextEncoder(path, added=True)
        last = np.array([end_id], "<u4").tobytes()
        for batch in sliced(batches):
            others = batch.select(range(len(kept)))
            source, cells = [], [[] for _ in fields]
            for at, t in enumerate(batch.column(len(kept)).to_pylist()):
                raw = encoder(t or "").tobytes() + last
                n = len(raw) // 4
                start, piece = 0, 0
                while start < n:
                    stop = start + ((n - start - 1) % capacity + 1)
                    some = raw[4 * start : 4 * stop]
                    source.append(at)
                    for c, x in zip(cells, (piece, start, stop - start, zlib.crc32(some)), strict=False):
                        c.append(x)
                    if keep_ids:
                        cells[4].append(np.frombuffer(some, "<u4").astype(np.int32))
                    start, piece = stop, piece + 1
            arrays = [pa.array(c, k) for c, k in zip(cells, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=False)]
            yield pa.RecordBatch.from_arrays([*others.take(pa.array(source, pa.int64())).columns, *arrays], names=schema.names)

    return df.select(*kept, text).mapInArrow(run, schema)


def packed_documents(docs: DataFrame, path: str) -> DataFrame:
    pieces = cut(token_pieces(docs.select("doc_id", "text"), path, keep_ids=False))
    return pack(pieces, 2048)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(``sequence_id``, ``ids``): the ids of every sequence, from pieces with ``ids`` and their places."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens; a null or empty text is a piece of one token.

    Ids are not kept: a document's piece is its ids from ``start`` on, and ``token_pieces`` with ``keep_ids``, ``pack`` and
    ``packed_sequences`` make whole sequences.
    """
    import public_tokenizers

    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op3_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
