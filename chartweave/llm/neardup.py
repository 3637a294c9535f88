"""Near-duplicates by BagMinHash signatures of word shingles, bands, and exact multiset overlap.

A text is the multiset of its runs of five words. Every shingle has Poisson processes over discretised
weights: level block 0 holds weights up to 1, block k those over 2^(k-1) up to 2^k. A shingle of weight w
takes part in the blocks below w whole and, by the level marks of its points, in a part of the block that
holds w. Each point falls on one of the signature's places, which keep their earliest point; two
signatures agree in a place with the probability of the weighted Jaccard similarity. Only points before a
time that a text of that total weight surely needs are made; the rare text with an empty place is done again.

Texts that share a band are candidates. In each bucket all are held against two leaders. What then still
lies in a bucket with others of another component is compared in blocks, so that no link between
components is lost and no list of all pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import cut, fresh, int_list, mix64, sliced, spread_join, windows, word_hashes
from .components import components

BANDS, ROWS = 24, 4
PLACES = BANDS * ROWS
#: Pairs whose signatures agree in a smaller share are not compared exactly; at a similarity of 0.8 the
#: share is 4.4 standard deviations higher.
LEAST_AGREEMENT = 0.62


def shingle_bag(words: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and how often each occurs."""
    return np.unique(windows(words, k), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller counts over the sum of the larger ones."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    both = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return both / (total - both)


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers over 0 up to 1 from 64 random bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], places: int = PLACES) -> np.ndarray:
    """The earliest points (as numbers) of each bag in each place; infinity for a bag without shingles."""
    out = np.full((len(bags), places), np.inf)
    todo = np.array([i for i, (h, _) in enumerate(bags) if len(h)], np.int64)
    spare = 6.0
    while len(todo):
        out[todo] = points([bags[i] for i in todo], places, spare)
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        spare = 2 * spare + 10
    return out


def points(bags: list[tuple[np.ndarray, np.ndarray]], places: int, spare: float) -> np.ndarray:
    out = np.full(len(bags) * places, np.inf)
    of = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    shingle = np.concatenate([h for h, _ in bags])
    weight = np.concatenate([w for _, w in bags]).astype(np.int64)
    until = places * (np.log(places) + spare) / np.array([w.sum() for _, w in bags], float)
    block = 0
    with np.errstate(over="ignore"):
        while len(of):
            length = 1 if block == 0 else 2 ** (block - 1)
            seed = mix64(shingle + np.uint64(block + 1) * np.uint64(0xD6E8FEB86659FD93))
            at, where, w, time, step = of, seed, weight, np.zeros(len(of)), 0
            while len(at):
                step += 1
                bits = mix64(where + np.uint64(step) * np.uint64(0x9E3779B97F4A7C15))
                time = time - np.log(uniform(bits)) / length
                on = time <= until[at]
                at, where, w, time, bits = at[on], where[on], w[on], time[on], bits[on]
                mark = mix64(bits ^ np.uint64(0xA0761D6478BD642F))
                place = (mark % np.uint64(places)).astype(np.int64)
                level = length * (block > 0) + np.ceil(uniform(mix64(mark)) * length)
                seen = level <= w
                np.minimum.at(out, at[seen] * places + place[seen], time[seen])
            block += 1
            more = weight > (1 if block == 1 else 2 ** (block - 1))
            of, shingle, weight = of[more], shingle[more], weight[more]
    return out.reshape(len(bags), places)


def bands_of(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A hash of each band of each signature."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), bits.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(bits.shape[2]):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return out.view(np.int64)


def short_form(signature: np.ndarray) -> np.ndarray:
    """A byte for each place."""
    return (mix64(signature.view(np.uint64)) & np.uint64(255)).astype(np.uint8)


SIGNED = "node binary, signature binary, bands array<long>"


def signed(texts: DataFrame, node: str, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``node``, the short signature and the bands (null for texts without words)."""
    schema = T.StructType([*(texts.schema[c] for c in keep), *T._parse_datatype_string(SIGNED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in sliced(batches, 200):
            bags = [shingle_bag(word_hashes((t or "").encode())) for t in some.column(text).to_pylist()]
            full = signatures(bags)
            empty = pa.array([not len(h) for h, _ in bags])
            short = pa.array([x.tobytes() for x in short_form(full)], pa.binary())
            bands = int_list(bands_of(full), pa.int64())
            none = pa.scalar(None, pa.binary()), pa.scalar(None, bands.type)
            new = [some.column(node), pc.if_else(empty, none[0], short), pc.if_else(empty, none[1], bands)]
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), *new], names=schema.names)

    return texts.select(*keep, node, text).mapInArrow(run, schema)


def alike(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose signatures agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PLACES) for c in ("sa", "sb"))
            yield batch.filter(pa.array((x == y).mean(axis=1) >= LEAST_AGREEMENT)).select(["a", "b"])

    one = signs.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    two = signs.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs whose texts (``node``, ``text``) overlap by ``least`` or more as bags of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag = lru_cache(64)(lambda t: shingle_bag(word_hashes(t.encode())))
        for batch in sliced(batches, 100):
            keep = [overlap(bag(x), bag(y)) >= least for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def joined_in_blocks(members: DataFrame, least: float, block: int = 1024, block_bytes: int = 4 << 20) -> DataFrame:
    """Pairs of components (``a``, ``b``) that a link between members of a bucket joins.

    ``members``: ``bucket``, ``node``, ``component``, ``signature``, ``bands``, ``text``.
    Each bucket is dealt into blocks of about ``block`` members or ``block_bytes`` of text, whatever is less, and every two blocks are compared by themselves:
    rows are dealt by the bucket and the second block, so that no task gets a whole bucket. A comparison
    gives a pair for each two components it can join: fewer rows than members. Two texts are compared in
    the first bucket that they share.
    """
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).cast("long")
    dealt = spread_join(members, sizes.select("bucket", parts.alias("parts")), "bucket", "node")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")))
    member = F.struct("node", "component", "signature", "bands", "text")
    blocks = dealt.groupBy("bucket", "block", "parts").agg(F.collect_list(member).alias("members"))
    left = blocks.select("bucket", F.col("block").alias("x"), F.explode(F.sequence(F.col("block"), F.col("parts") - 1)).alias("y"), F.col("members").alias("mx"))
    right = blocks.select("bucket", F.col("block").alias("y"), F.col("members").alias("my"))
    two = left.join(right, ["bucket", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                mx = row.column("mx").to_pylist()[0]
                my = mx if row.column("x")[0] == row.column("y")[0] else row.column("my").to_pylist()[0]
                a, b = block_links(mx, my, row.column("bucket")[0].as_py(), least)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return two.select("bucket", "x", "y", "mx", "my").mapInArrow(run, "a binary, b binary")


def block_links(mx: list[dict], my: list[dict], bucket: int, least: float) -> tuple[list[bytes], list[bytes]]:
    bx, by = (np.array([m["bands"] for m in ms], np.int64) for ms in (mx, my))
    sx, sy = (np.frombuffer(b"".join(m["signature"] for m in ms), np.uint8).reshape(-1, PLACES) for ms in (mx, my))
    parent: dict[bytes, bytes] = {}

    def root(c: bytes) -> bytes:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    bags: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

    def bag(m: dict) -> tuple[np.ndarray, np.ndarray]:
        if m["node"] not in bags:
            bags[m["node"]] = shingle_bag(word_hashes(m["text"].encode()))
        return bags[m["node"]]

    found: tuple[list[bytes], list[bytes]] = [], []
    for i, m in enumerate(mx):
        maybe = np.flatnonzero((sx[i] == sy).mean(axis=1) >= LEAST_AGREEMENT)
        for j in maybe[bx[i][(bx[i] == by[maybe]).argmax(axis=1)] == bucket]:
            n = my[j]
            p, q = root(m["component"]), root(n["component"])
            if p != q and overlap(bag(m), bag(n)) >= least:
                parent[p] = q
                found[0].append(m["component"])
                found[1].append(n["component"])
    return found


WORDS = r"[^\x20\x09-\x0D]"


def near_classes(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", least: float = 0.8) -> DataFrame:
    """One row per distinct text: ``node`` (MD5 of the text), ``class_id``, ``class_node``, ``class_size`` (rows), ``n_texts``.

    Texts belong to one class if links of similarity ``least`` or more join them; ``class_id`` is the smallest
    id of the class (null if all are null) and ``class_node`` its text. Null texts and texts without words have
    no row: they are like nothing. Texts of fewer than five words are one shingle; longer ones may have any length and count
    whole. Repeated rows count in ``class_size``; an empty table gives an empty one.
    """
    docs = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.unhex(F.md5(text)).alias("node")).where(F.col("text").rlike(WORDS))
    rows = signed(docs, "node", "text", ["id"])
    texts = cut(
        rows.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    )
    signs, ids = texts.select("node", "signature"), texts.select("node", "id")
    inside = texts.select("node", F.explode("bands").alias("bucket"))
    order = F.struct(F.xxhash64("node", "bucket"), "node")
    buckets = inside.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("l"), F.max(order).alias("r")).where("size > 1")
    buckets = cut(buckets.select("bucket", "size", F.col("l.node").alias("l"), F.col("r.node").alias("r")))
    members = cut(inside.join(buckets, "bucket"))
    leaders = members.select("node", F.explode(F.array("l", "r")).alias("leader")).where("node != leader")
    pairs = leaders.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    wanted = cut(alike(pairs, signs))
    links = cut(verified(wanted, bodies(docs, ids, wanted.select(F.explode(F.array("a", "b")).alias("node"))), least))
    first = cut(components(links))

    # two leaders know all pairs of three; larger buckets may hold members of several components
    member = members.where("size > 3").select("bucket", "node").join(first, "node", "left")
    member = cut(member.withColumn("component", F.coalesce("component", "node")))
    mixed = member.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("bucket")
    rest = cut(member.join(mixed, "bucket", "left_semi").join(texts.select("node", "signature", "bands"), "node"))
    more = cut(joined_in_blocks(rest.join(bodies(docs, ids, rest.select("node")), "node"), least))
    found = texts.select("node", "id", "n").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if more.head(1):
        second = components(more).select(F.col("node").alias("component"), F.col("component").alias("joined"))
        found = found.join(second, "component", "left").withColumn("component", F.coalesce("joined", "component")).drop("joined")
    found = cut(found)
    by_id = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "node")))
    classes = found.groupBy("component").agg(
        F.coalesce(by_id, F.min(F.struct("id", "node"))).alias("first"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("n_texts")
    )
    classes = classes.select("component", F.col("first.id").alias("class_id"), F.col("first.node").alias("class_node"), "class_size", "n_texts")
    return spread_join(found.select("node", "component"), classes, "component", "node").drop("component")


def bodies(docs: DataFrame, ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(``node``, ``text``) for the asked nodes, taken from the row with the text's smallest id."""
    asked = ids.join(nodes.distinct(), "node").select(F.col("node").alias("node_"), F.col("id").alias("id_"))
    found = docs.join(asked, (F.col("node") == F.col("node_")) & F.col("id").eqNullSafe(F.col("id_"))).select("node", "text")
    return cut(found.dropDuplicates(["node"]))


def one_of_each(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", least: float = 0.8) -> DataFrame:
    """The rows of ``df`` that stay: of each class the row with the smallest id, once if it is repeated.

    Rows with a null text or without words stay.
    """
    node, turn, node_, id_ = fresh(df, "node__", "turn__", "node_", "id_")
    words = F.coalesce(F.col(text).rlike(WORDS), F.lit(False))
    rows = df.where(words).withColumn(node, F.unhex(F.md5(text)))
    classes = near_classes(df, text=text, doc_id=doc_id, least=least)
    stay = classes.where("node = class_node").select(F.col("node").alias(node_), F.col("class_id").alias(id_))
    joined = rows.join(stay, (F.col(node) == F.col(node_)) & F.col(doc_id).eqNullSafe(F.col(id_))).drop(node_, id_)
    joined = joined.withColumn(turn, F.row_number().over(W.partitionBy(node, doc_id).orderBy(node))).where(F.col(turn) == 1)
    return joined.select(*df.columns).unionByName(df.where(~words))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates; documents with a null text or without words stay, equal rows go but for one."""
    return one_of_each(docs)


def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    nodes = docs.select("doc_id", F.unhex(F.md5("text")).alias("node"))
    out = spread_join(nodes, near_classes(docs), "node", "doc_id", "left")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("n_texts", F.lit(1)).alias("n_texts"),
        F.coalesce("class_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )
