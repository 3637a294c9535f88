"""Repeated passages by collinear chaining of shared word k-mers.

Every text gives seeds: runs of K words with a small hash, and the least of every SPARSE runs, so that no
stretch is bare. Seeds of one document only go first. Each other seed makes a pair with the last one in the same text that
ends within SPAN words; an occurrence of a pair is linked to the first document that has the
pair. Links thus grow with the occurrences, never with their squares, and lead to documents that have a whole
stretch, whatever parts of it others have. For two linked documents the matches are chained in order, with a cost for
the gaps, through Fenwick trees of best scores; the words around each chain are then aligned, and aligned
stretches that are long enough are passages. The document with the smallest id keeps a passage, later ones
have it marked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import MIX, common_keys, cut, fresh, mix64, sliced, stored, windows, with_arrow, word_hashes

K = 5
#: One run in DENSE is a seed by its hash; of every SPARSE runs the least is one in any case.
DENSE, SPARSE = 4, 24
#: Words that a pair of seeds may span, two thirds of the shortest passage.
SPAN = 34
#: Cost of each word between two matches of a chain, and the most words that one gap may have.
GAP_COST, MOST_GAP = 0.03, 60
#: Words around a chain that are aligned at first; stretches that come near this end are aligned again with more.
REACH, NEAR_END = 512, 32
LEAST_WORDS, LEAST_IDENTITY = 50, 0.8
#: A gap of a chain with more different words than these, and mostly different ones, parts it.
MOST_DIFFERENT = 12
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sliding(of: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """The smallest or largest of every ``n`` neighbours."""
    size, out = 1, x
    while size < n:
        step = min(size, n - size)
        out = of(out[: len(out) - step], out[step:])
        size += step
    return out


def seeds_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions of a text's seeds.

    A seed that the text has several times is given once more, each time but the first, with its number among
    them, so that runs of one word or line match along a diagonal.
    """
    if len(words) < K:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    runs = windows(words, K)
    chosen = runs < np.uint64(2**64 // DENSE)
    if len(runs) <= SPARSE:
        chosen |= runs == runs.min()
    else:
        none = np.zeros(SPARSE - 1, np.uint64)
        least = sliding(np.minimum, runs, SPARSE)  # of every window; a run is a seed if it is the least of one that holds it
        chosen |= sliding(np.maximum, np.concatenate([none, least, none]), SPARSE) == runs
    at = np.flatnonzero(chosen)
    found = runs[at]
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    again = np.flatnonzero(np.append(False, ranked[1:] == ranked[:-1]))
    if not len(again):
        return found, at
    starts = np.maximum.accumulate(np.where(np.append(True, ranked[1:] != ranked[:-1]), np.arange(len(ranked)), 0))
    with np.errstate(over="ignore"):
        numbered = mix64(ranked[again] + (again - starts[again]).astype(np.uint64) * MIX)
    return np.concatenate([found, numbered]), np.concatenate([at, at[order[again]]])


def seeds(docs: DataFrame) -> DataFrame:
    """(``seed``, ``d``, ``p``) from ``d`` and ``text``."""
    schema = T.StructType([T.StructField("seed", T.LongType()), docs.schema["d"], T.StructField("p", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [seeds_of(word_hashes(t.encode())) for t in batch.column("text").to_pylist()]
            of = pa.array(np.repeat(np.arange(len(found)), [len(h) for h, _ in found]))
            hash_, at = (np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(zip(*found, strict=True) if found else ((), ()), (np.uint64, np.int64), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(hash_.view(np.int64)), batch.column("d").take(of), pa.array(at.astype(np.int32))], names=schema.names)

    return docs.select("d", "text").mapInArrow(run, schema)


def short_words(docs: DataFrame) -> DataFrame:
    """(``id``, ``words``): two bytes of each word's hash."""
    schema = T.StructType([T.StructField("id", docs.schema["d"].dataType), T.StructField("words", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            words = [(word_hashes(t.encode()) & np.uint64(0xFFFF)).astype("<u2").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(words, pa.binary())], names=schema.names)

    return docs.select("d", "text").mapInArrow(run, schema)


def dealt(rows: DataFrame, common: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``common`` (null for other keys) and ``salt``, which parts the rows of common keys."""
    out = rows.join(F.broadcast(common), key, "left")
    return out.withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("d"), F.col("salts"))).cast("int"))


def shared(docs: DataFrame) -> DataFrame:
    """The seeds (``seed``, ``d``, ``p``) that several documents have. Common ones, told from one document in 64, are such."""
    common = common_keys(seeds(docs.where(F.pmod(F.xxhash64(F.lit(64), "d"), F.lit(64)) == 0)), "seed")
    found = dealt(seeds(docs), common, "seed")
    holders = W.partitionBy("seed", "salt")
    found = found.withColumn("several", F.col("salts").isNotNull() | (F.min("d").over(holders) != F.max("d").over(holders)))
    return found.where("several").select("seed", "d", "p")


def pairs(found: DataFrame) -> DataFrame:
    """(``pair``, ``d``, ``p``, ``r``): shared seeds of a text at ``p`` and ``r``, the last that ends within SPAN words."""
    far = F.max(F.struct("p", "seed")).over(W.partitionBy("d").orderBy("p").rangeBetween(1, SPAN - K))
    both = found.withColumn("far", far).where("far is not null")
    return both.select(F.xxhash64("seed", "far.seed").alias("pair"), "d", "p", F.col("far.p").alias("r"))


def links(found: DataFrame) -> DataFrame:
    """(``d``, ``e``, ``p``, ``q``, ``r``, ``s``): pairs of ``d`` at ``p`` and ``r`` that the first document ``e`` with them has at ``q`` and ``s``."""
    first = F.min(F.struct("d", "p", "r"))
    common = common_keys(found, "pair")
    keys = [r["pair"] for r in common.collect()]  # fewer than 1024
    tops = found.where(F.col("pair").isin(keys)).groupBy("pair").agg(first.alias("top"))
    rows = dealt(found, cut(common.join(F.broadcast(tops), "pair", "left")), "pair")
    rows = rows.withColumn("one", F.coalesce("top", first.over(W.partitionBy("pair", "salt")))).where("one.d < d")
    return rows.select("d", F.col("one.d").alias("e"), "p", F.col("one.p").alias("q"), "r", F.col("one.r").alias("s"))


#: How far before a match its predecessor may start, on either side.
SLAB = K + MOST_GAP


class Maxima:
    """Two Fenwick trees over the offsets of a slab: best values up to an offset, and from one on."""

    def __init__(self):
        self.up, self.down = [(0.0, -1)] * (SLAB + 1), [(0.0, -1)] * (SLAB + 1)

    def put(self, offset: int, entry: tuple[float, int]) -> None:
        for tree, i in ((self.up, offset + 1), (self.down, SLAB - offset)):
            while i <= SLAB:
                if tree[i] < entry:
                    tree[i] = entry
                i += i & -i

    @staticmethod
    def best(tree: list, n: int) -> tuple[float, int]:
        """Of the first ``n`` offsets of a tree."""
        out = (0.0, -1)
        while n:
            if tree[n] > out:
                out = tree[n]
            n -= n & -n
        return out


def chains(p: list[int], q: list[int]) -> list[list[int]]:
    """Indices of the matches of each chain of two or more, best chains first; a match is in one chain at most.

    A match's score is K and the best, over the matches that start at most SLAB words before it on both sides, of
    their score less GAP_COST for each word between the starts. Both axes are parted into slabs of that length:
    predecessors lie in the first part of the match's own slab or in the last part of the one before, and
    each of the four is a prefix or a suffix that a Fenwick tree answers for.
    """
    order = sorted(range(len(p)), key=lambda i: (p[i], q[i]))
    score, most, parent = [float(K)] * len(p), [0.0] * len(p), [-1] * len(p)

    def put(trees: dict[int, Maxima], j: int) -> None:
        slab, offset = divmod(q[j], SLAB)
        if slab not in trees:
            trees[slab] = Maxima()
        trees[slab].put(offset, (score[j] + GAP_COST * (p[j] + q[j]), j))

    def ask(trees: dict[int, Maxima], i: int) -> None:
        slab, offset = divmod(q[i], SLAB)
        for tree, n in ((trees[slab].up if slab in trees else None, offset), (trees[slab - 1].down if slab - 1 in trees else None, SLAB - offset)):
            value, j = Maxima.best(tree, n) if tree else (0.0, -1)
            through = value - GAP_COST * (p[i] + q[i])
            if j >= 0 and through > most[i]:
                most[i], parent[i] = through, j

    before, number = [], -2
    for slab, group in groupby(order, key=lambda i: p[i] // SLAB):
        items, trees = list(group), {}
        k = len(before) if number == slab - 1 else 0
        for i in reversed(items):  # the last part of the slab before
            while k and p[before[k - 1]] >= p[i] - SLAB:
                k -= 1
                put(trees, before[k])
            if trees:
                ask(trees, i)
        trees = {}
        for _, level in groupby(items, key=lambda i: p[i]):  # the first part of this one
            level = list(level)
            for i in level:
                ask(trees, i)
                score[i] = K + most[i]
            for i in level:
                put(trees, i)
        before, number = items, slab
    out, used = [], [False] * len(p)
    for i in sorted(order, key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = parent[i]
        if len(chain) > 1:
            out.append(chain[::-1])
    return out


def on_diagonal(p: np.ndarray) -> list[np.ndarray]:
    """What ``chains`` gives for ascending matches on one diagonal: each follows the one before, as no gap within SLAB costs what a match is worth."""
    return [x for x in np.split(p, np.flatnonzero(np.diff(p) > SLAB) + 1) if len(x) > 1]


LISTS, ARROW_LISTS = T.ArrayType(T.ArrayType(T.IntegerType())), pa.list_(pa.list_(pa.int32()))


def chained(matched: DataFrame) -> DataFrame:
    """(``d``, ``e``, ``ps``, ``qs``): the chains of each two documents, each an array of its matches."""
    lists = matched.groupBy("d", "e").agg(F.collect_list(F.struct("p", "q", "r", "s")).alias("m"))
    schema = T.StructType([matched.schema["d"], matched.schema["e"], T.StructField("ps", LISTS), T.StructField("qs", LISTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            of, ps, qs = [], [], []
            for at, m in enumerate(batch.column("m")):
                p, q, r, s = (m.values.field(x).to_numpy().astype(np.int64) for x in range(4))
                both = np.unique(np.concatenate([p << 32 | q, r << 32 | s]))
                p, q = both >> 32, both & 0xFFFFFFFF
                if (p - q == p[0] - q[0]).all():
                    found = [(x.tolist(), (x + (q[0] - p[0])).tolist()) for x in on_diagonal(p)]
                else:
                    p, q = p.tolist(), q.tolist()
                    found = [([p[i] for i in chain], [q[i] for i in chain]) for chain in chains(p, q)]
                if found:
                    of.append(at)
                    ps.append([x for x, _ in found])
                    qs.append([y for _, y in found])
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("d").take(take), batch.column("e").take(take), pa.array(ps, ARROW_LISTS), pa.array(qs, ARROW_LISTS)], names=schema.names)

    return lists.select("d", "e", "m").mapInArrow(run, schema)


def reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two stretches can be followed together from their start, substitutions allowed, while most agree."""
    n = min(len(a), len(b))
    if not n:
        return 0
    worth = np.cumsum(np.where(a[:n] == b[:n], 1, -3))
    best = int(worth.argmax())
    drop = np.flatnonzero(worth < np.maximum.accumulate(np.maximum(worth, 0)) - 12)
    if len(drop):
        best = int(worth[: drop[0] + 1].argmax())
    return best + 1 if worth[best] > 0 else 0


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short stretches."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        row = np.maximum.accumulate(row)
    return int(row[-1])


def aligned(a: np.ndarray, b: np.ndarray, ps: list[int], qs: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(start, end, start, end, equal words) of aligned stretches through the anchors ``ps``, ``qs`` of two word arrays.

    A gap whose words mostly differ parts the chain.
    """
    out = []
    start = (ps[0], qs[0])
    end, same = (ps[0] + K, qs[0] + K), K
    x, y = np.array(ps), np.array(qs)
    if (x - y == ps[0] - qs[0]).all() and np.diff(x).max(initial=0) <= K + MOST_DIFFERENT:  # no gap that could part it
        end = (ps[-1] + K, qs[-1] + K)
        same = int((a[ps[0] : end[0]] == b[qs[0] : end[1]]).sum())
        ps, qs = ps[:1], qs[:1]
    for p, q in zip(ps[1:], qs[1:], strict=True):
        if p - q == end[0] - end[1] and p <= end[0]:  # overlaps the stretch so far, on its diagonal
            same += p + K - end[0]
        else:
            skip = max(0, end[0] - p, end[1] - q)
            ga, gb = a[end[0] : max(p, end[0])], b[end[1] : max(q, end[1])]
            equal = int((ga == gb).sum()) if len(ga) == len(gb) else common(ga, gb)
            if max(len(ga), len(gb)) - equal > MOST_DIFFERENT and equal < 0.6 * max(len(ga), len(gb)):
                out.append((*start, *end, same))
                start, same = (p, q), K
            else:
                same += equal + K - min(skip, K)
        end = (p + K, q + K)
    out.append((*start, *end, same))
    wide = []
    for p0, q0, p1, q1, n in out:
        back = reach(a[:p0][::-1], b[:q0][::-1])
        on = reach(a[p1:], b[q1:])
        n += int((a[p0 - back : p0] == b[q0 - back : q0]).sum()) + int((a[p1 : p1 + on] == b[q1 : q1 + on]).sum())
        wide.append((p0 - back, p1 + on, q0 - back, q1 + on, n))
    return wide


def alignments(found: DataFrame, words: DataFrame, common: DataFrame, around: int) -> DataFrame:
    """(``d``, ``e``, ``start``, ``end``, ``other``, ``equal``) of passages in words; ``other``: start in ``e``.

    ``around``: words on either side of the chains that are looked at. Chains whose stretches come near the end of
    these, while the texts go on, come back as ``ps`` and ``qs`` instead. ``common``: documents ``id`` that
    many chains meet, with ``salts``.
    """
    salted = words.join(F.broadcast(common), "id", "left")
    salted = salted.select("id", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0)))).alias("salt"), "words")
    salts = common.select(F.col("id").alias("e"), "salts")
    window = found.join(F.broadcast(salts), "e", "left")
    window = window.withColumn("salt_e", F.coalesce(F.pmod(F.xxhash64("d"), F.col("salts")), F.lit(0)).cast("int")).withColumn("salt_d", F.lit(0))
    for side, p in (("d", "ps"), ("e", "qs")):
        window = window.withColumn(f"from_{side}", F.greatest(F.array_min(F.flatten(p)) - around, F.lit(0)))
        window = window.withColumn(f"size_{side}", F.array_max(F.flatten(p)) + K + around - F.col(f"from_{side}"))
    for side in ("d", "e"):
        these = salted.select(F.col("id").alias(side), F.col("salt").alias(f"salt_{side}"), F.col("words").alias("w"))
        window = window.join(these, [side, f"salt_{side}"]).withColumn(f"w_{side}", F.col("w").substr(2 * F.col(f"from_{side}") + 1, 2 * F.col(f"size_{side}"))).drop("w")
    schema = T.StructType([found.schema["d"], found.schema["e"], *(T.StructField(n, T.IntegerType()) for n in ("start", "end", "other", "equal")), T.StructField("ps", LISTS), T.StructField("qs", LISTS)])
    columns = ("w_d", "w_e", "from_d", "from_e", "size_d", "size_e", "ps", "qs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            of, rows = [], []
            for at, (x, y, fx, fy, nx, ny, *both) in enumerate(zip(*(batch.column(c).to_pylist() for c in columns), strict=True)):
                a, b = np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")
                # the looked-at words may end inside the texts, and a stretch that comes near such an end may go on
                low, high = ([NEAR_END if f else 0 for f in (fx, fy)], [len(t) - NEAR_END if len(t) == n else len(t) for t, n in ((a, nx), (b, ny))])
                later, seen = ([], []), set()
                for ps, qs in zip(*both, strict=True):
                    spans = aligned(a, b, [i - fx for i in ps], [i - fy for i in qs])
                    if any(s < low[0] or u < low[1] or t > high[0] or v > high[1] for s, t, u, v, _ in spans):
                        later[0].append(ps)
                        later[1].append(qs)
                        continue
                    seen |= {(s + fx, t + fx, u + fy, n) for s, t, u, v, n in spans if t - s >= LEAST_WORDS and n >= LEAST_IDENTITY * max(t - s, v - u)}
                rows += [(*x, None, None) for x in sorted(seen)] + [(None, None, None, None, *later)] * bool(later[0])
                of += [at] * (len(seen) + bool(later[0]))
            take = pa.array(of, pa.int64())
            cells = [pa.array([r[k] for r in rows], pa.int32() if k < 4 else ARROW_LISTS) for k in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column("d").take(take), batch.column("e").take(take), *cells], names=schema.names)

    return window.select("d", "e", *columns).mapInArrow(run, schema)


def repeated_passages(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per passage: ``doc_id``, ``start`` and ``end`` (words), ``first_id`` (the smallest earlier document met there), ``n_links``.

    Passages of a document that overlap are one. A passage has at least 50 words, four in five of them equal
    in order (by 16 bits of their hashes) to those of an earlier document. Which of these are found is a matter of chance where words differ;
    the README says how many. Rows with a null id or text, and texts without words, do not take part; an empty table
    gives an empty one. Equal rows count as one; ids that stand for several different texts get no rows, as their words cannot be told apart. Repeats within one document do
    not count. Texts may have any length; all their words are compared.
    """
    docs = df.select(F.col(doc_id).alias("d"), F.col(text).alias("text")).where(F.col("d").isNotNull() & F.col("text").isNotNull())
    again = cut(docs.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi")).where("n > 1").select("d", (F.col("lo") == F.col("hi")).alias("same")))
    if again.head(1):
        docs = docs.join(again, "d", "left_anti").unionByName(docs.join(again.where("same").select("d"), "d", "left_semi").dropDuplicates(["d"]))
    found = stored(chained(links(stored(pairs(shared(docs))))))
    common = common_keys(found.select(F.col("e").alias("id")), "id")
    words, around, done = short_words(docs), REACH, None
    while True:
        spans = stored(alignments(found, words, common, around))
        whole = spans.where("ps is null").drop("ps", "qs")
        done = whole if done is None else done.unionByName(whole)
        found, around = spans.where("ps is not null").select("d", "e", "ps", "qs"), 16 * around
        if not found.head(1):
            break
        ids = cut(found.select(F.explode(F.array("d", "e")).alias("d")).distinct())
        few = ids.count() <= 100_000
        words = short_words(docs.join(F.broadcast(ids), "d", "left_semi")) if few else words
    return merged_spans(done.distinct()).withColumnRenamed("d", doc_id)


def merged_spans(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a document as one."""
    order = W.partitionBy("d").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    marked = spans.withColumn("new", new).withColumn("passage", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("d", "passage").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("e").alias("first_id"), F.count(F.lit(1)).alias("n_links")
    ).drop("passage")


def without_passages(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", n_chars: str = "n_chars") -> DataFrame:
    """The rows of ``df`` with later copies of passages cut out of their texts.

    A cut takes the words and the white space behind them. A column ``n_chars``, if there is one, follows. Rows
    whose words all went are left out; rows that have no passage stay as they are.
    """
    spans, key = fresh(df, "spans__", "key__")
    found = repeated_passages(df, text=text, doc_id=doc_id)
    lists = found.groupBy(F.col(doc_id).alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(spans))
    joined = df.join(lists, F.col(doc_id) == F.col(key), "left").drop(key)
    left = fresh(joined, "left__")[0]

    def make():
        return lambda texts, lists: [pa.array([t if not s or t is None else cut_words(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, lists, strict=True)], pa.string())]

    out = with_arrow(joined, [text, spans], [T.StructField(left, T.StringType())], make)
    out = out.where(F.col(spans).isNull() | F.col(left).rlike(WORD.pattern))
    changed = {text: F.col(left)}
    if n_chars in df.columns:
        changed[n_chars] = F.when(F.col(spans).isNull(), F.col(n_chars)).otherwise(F.length(left)).cast(df.schema[n_chars].dataType)
    return out.select(*(changed.get(c, F.col(c)).alias(c) for c in df.columns))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    at = [m.start() for m in WORD.finditer(text)]
    at.append(len(text))
    out, done = [], 0
    for s, e in spans:
        out.append(text[done : at[s]])
        done = at[e]
    return "".join([*out, text[done:]])


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated passages."""
    return without_passages(docs)


def op6_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of every document that an earlier document has, too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_passages(docs).withColumn("n_words", F.col("end") - F.col("start"))
