"""Phrases of two and three words that occur together, mined with stripes.

Every prefix keys a counter of the words that come next (the end of a piece is one of them). Tasks count runs of some
millions of words at once, so that a prefix is one stripe a run; stripes of a prefix meet in one exchange and are added up word by word.
A merged stripe holds the counts of the prefix's extensions, the count of the prefix itself as their sum, and the
largest extension, which decides whether the prefix stands by itself. Prefixes that a sample shows to be common are
dealt to several tasks by the next word, so that no task merges more than a small share of all stripes.

Prefixes of one word come first. A phrase of three words is a candidate only if both pairs in it are, so the second pass keeps stripes of pairs that a
bitmap of the first pass's candidates may hold, and counts next words that make no such pair together. The bitmap has a fixed size; where
it is too small, more stripes are made and nothing else changes.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import MIX, STRETCH, mix64, spread_join, stored, word_hashes

#: What ends a piece (and what then stands for it), capitals, and what parts words.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
UNKNOWN = "und"
SHARE = 512
STRIPES = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("deal", pa.int32()), ("total", pa.int64()), ("nexts", pa.string()), ("counts", pa.binary())])
MERGED = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("next", pa.string()), ("f", pa.int64()), ("total", pa.int64()), ("largest", pa.int64())])
Dealt = dict[tuple[str, str], int]


class Numbers(dict):
    """Numbers words as they come; 0 ends a piece, 1 is no word."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Run:
    """Words of one language, until they are counted."""

    def __init__(self, lang: str):
        self.lang, self.words, self.held, self.size = lang, Numbers(), [], 0

    def add(self, raw: bytes) -> None:
        tokens = raw.translate(LOWER).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
        self.held.append(ids[ids != 1])
        self.size += len(tokens)

    def end(self) -> None:
        self.held.append(np.zeros(1, np.int64))

    def stripes(self, dealt: Dealt, bits: np.ndarray | None, levels: tuple[int, ...], ended: bool) -> Iterator[pa.RecordBatch]:
        """The stripes of prefixes of ``levels`` words; the run starts anew, with the last two words if its text has not ended."""
        ids = np.concatenate(self.held)
        if ended:
            ids = np.append(ids, [0, 0])
        words = list(self.words)
        names = pa.array(words, pa.binary()).cast(pa.string())
        self.words, self.held, self.size = Numbers(), [], 0
        if not ended:
            self.held.append(np.fromiter((self.words[words[i]] for i in ids[-2:].tolist()), np.int64, len(ids[-2:])))
        first, second, third = ids[:-2], ids[1:-1], ids[2:]
        there = first > 0
        if not there.any():
            return
        n = len(words)
        pairs, at, counts = np.unique(first[there] * n + second[there], return_inverse=True, return_counts=True)
        one, two = pairs // n, pairs % n
        if 1 in levels:
            yield pa.record_batch([[self.lang], [""], [0], [int(there.sum())], [""], [b""]], schema=STRIPES)
            yield from self.rows(words, names, one, [one], two, counts, dealt)
        if 2 in levels:
            some, after = two[at] > 0, third[there]
            if bits is not None:
                hashes = np.concatenate([np.zeros(2, np.uint64), word_hashes(b" ".join(words[2:]))])
                held = maybe(bits, pair_hashes(hashes[one], hashes[two], self.lang)) & (two > 0)
                # the pair of the second and the third word is the next one, unless the text or the run ends there
                next_held = np.append(held[at][1:], False)
                adjoining = np.append(np.diff(np.flatnonzero(there)) == 1, False)
                some = held[at]
                last = some & ~adjoining & (after > 0)
                kept = next_held & adjoining
                kept[last] = maybe(bits, pair_hashes(hashes[second[there][last]], hashes[after[last]], self.lang))
                after = np.where(kept, after, 0)
            triples, more = np.unique(at[some] * n + after[some], return_counts=True)
            both = triples // n
            yield from self.rows(words, names, both, [one[both], two[both]], triples % n, more, dealt)

    def rows(self, words: list[bytes], names: pa.Array, group: np.ndarray, prefix: list[np.ndarray], after: np.ndarray, counts: np.ndarray, dealt: Dealt) -> Iterator[pa.RecordBatch]:
        """A row for each number in ``group`` (ascending), and for each deal of common ones."""
        deal = np.zeros(len(group), np.int32)
        begins = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        called = pc.binary_join_element_wise(*(names.take(pa.array(p[begins])) for p in prefix), " ")
        if dealt:
            ends = np.append(begins[1:], len(group))
            own = {prefix: parts for (lang, prefix), parts in dealt.items() if lang == self.lang}
            for k in np.flatnonzero(pc.is_in(called, pa.array(list(own), pa.string())).to_numpy(zero_copy_only=False)).tolist():
                a, b, parts = begins[k], ends[k], own[called[k].as_py()]
                deal[a:b] = [zlib.crc32(words[w]) % parts for w in after[a:b].tolist()]
            order = np.lexsort((deal, group))
            group, after, counts, deal = group[order], after[order], counts[order], deal[order]
            old = np.searchsorted(begins, np.arange(len(group)), "right") - 1
            begins = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (deal[1:] != deal[:-1]))) if len(group) else begins
            called = called.take(pa.array(old[begins]))
        if not len(group):
            return
        spans = np.append(begins, len(group))
        nexts = pa.ListArray.from_arrays(pa.array(spans, pa.int32()), names.take(pa.array(np.where(after, after, 1))))
        raw = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer((spans * 4).astype("<i4")), pa.py_buffer(counts.astype("<u4"))])
        whole = pa.record_batch(
            [pa.repeat(self.lang, len(begins)), called, pa.array(deal[begins]), pa.array(np.add.reduceat(counts, begins)), pc.binary_join(nexts, " "), raw], schema=STRIPES
        )
        for k in range(0, len(begins), 50_000):
            yield whole.slice(k, 50_000)


def stretches(raw: bytes) -> Iterator[bytes]:
    """A text in parts of about a megabyte that end at white space."""
    at = 0
    while at < len(raw):
        space = re.compile(rb"[\t-\r ]").search(raw, at + STRETCH)
        end = space.end() if space else len(raw)
        yield raw[at:end]
        at = end


def pair_hashes(first: np.ndarray, second: np.ndarray, lang: str) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(first * MIX + second + np.uint64(zlib.crc32(lang.encode())))


def maybe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bitmap (64-bit words, a power of two of them) has the hashes' bits."""
    at = hashes % np.uint64(64 * len(bits))
    return bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) > 0


def bitmap(pairs: DataFrame, size: int) -> np.ndarray:
    """A bitmap of ``size`` bits that has those of all ``pairs`` (``lang``, ``prefix``, ``next``). The driver gets a row for each 64 bits at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, *words = (c.to_pylist() for c in batch.columns)
            first, second = (word_hashes(" ".join(w).encode()) for w in words)
            seeds = np.array([zlib.crc32(x.encode()) for x in langs], np.uint64)
            with np.errstate(over="ignore"):
                at = mix64(first * MIX + second + seeds) % np.uint64(size)
            yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    rows = pairs.select("lang", "prefix", "next").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def stripes(docs: DataFrame, dealt: Dealt, at_once: int, levels: tuple[int, ...], bits: np.ndarray | None = None) -> DataFrame:
    """The stripes of ``docs`` (``lang``, ``text``) for prefixes of ``levels`` words, counted over runs of about ``at_once`` words.

    ``bits``: the pairs that are kept as prefixes and as ends of their extensions; all without it.
    """
    shared = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, Run] = {}
        size, held = 0, shared and shared.value
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if (now := runs.get(lang)) is None:
                    now = runs[lang] = Run(lang)
                for part in stretches(raw.as_py() or b""):
                    before = now.size
                    now.add(part)
                    size += now.size - before
                    if size >= at_once:
                        for r in runs.values():
                            yield from r.stripes(dealt, held, levels, ended=r is not now)
                        size, runs = 0, {lang: now}
                now.end()
        for r in runs.values():
            yield from r.stripes(dealt, held, levels, ended=True)

    return docs.select("lang", "text").mapInArrow(run, "lang string, prefix string, deal int, total long, nexts string, counts binary")


def common_prefixes(docs: DataFrame, sample: float, at_once: int) -> Dealt:
    """How many tasks prefixes with over a 512th of a sample's words are dealt to: fewer than 512 of each length, so the driver may hold them.

    They decide where stripes go, not what becomes of them.
    """
    found = stripes(docs.sample(sample, seed=11), {}, at_once, (1, 2)).groupBy("lang", "prefix").agg(F.sum("total").alias("total"))
    every = found.where("prefix = ''").agg(F.sum("total")).first()[0] or 0
    rows = found.where((F.col("prefix") != "") & (F.col("total") > max(64, every // SHARE))).collect()
    return {(r["lang"], r["prefix"]): -(-r["total"] * SHARE // every) for r in rows}


def merged(rows: DataFrame, dealt: Dealt, least: int) -> DataFrame:
    """Stripes of one key added up: (``lang``, ``prefix``, ``next``, ``f``, ``total``, ``largest``).

    Rows without ``next`` are prefixes: ``f`` their occurrences and ``largest`` those of their largest extension by a word (0: under ``least``). The
    others are extensions with at least ``least`` occurrences, and ``total`` is the prefix's count; where a prefix is dealt, ``f`` is a
    deal's share of it and ``total`` is null. Prefixes below ``least`` are left out.
    """

    def emit(key: tuple[str, str, int], counts: dict[str, int], total: int, out: list[list]) -> None:
        lang, prefix, _ = key
        split = (lang, prefix) in dealt
        if total < least and not split and prefix:
            return
        often = [(w, c) for w, c in counts.items() if c >= least and w]
        out.append((lang, prefix, None, total, None, max((c for _, c in often), default=0)))
        out += ((lang, prefix, w, c, None if split else total, 0) for w, c in often)

    def add(counts: dict[str, int], nexts: list[str], raws: list[bytes]) -> None:
        for words, raw in zip(nexts, raws, strict=True):
            if raw:
                for w, c in zip(words.split(" "), np.frombuffer(raw, "<u4").tolist(), strict=True):
                    counts[w] += c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts, total = None, defaultdict(int), 0  # the key that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[list] = []
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.logical_or.reduce([pc.not_equal(c.slice(1), c.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False) for c in batch.columns[:3]])
            begins = np.flatnonzero(new)
            ends = np.append(begins[1:], batch.num_rows)
            sums = np.add.reduceat(batch.column(3).to_numpy(), begins)
            langs, prefixes, deals, _, nexts, raws = batch.columns
            # most prefixes are rare, and only the last and the first may belong to other batches, too
            wanted = sums >= least
            wanted[[0, -1]] = True
            for g in np.flatnonzero(wanted).tolist() + ([] if not dealt else dealt_groups(langs, prefixes, begins, wanted, dealt)):
                a, n = int(begins[g]), int(ends[g] - begins[g])
                this = (langs[a].as_py(), prefixes[a].as_py(), deals[a].as_py())
                if g == 0 and this != key:
                    if key:
                        emit(key, counts, total, out)
                    key, counts, total = this, defaultdict(int), 0
                if g == len(begins) - 1 and g:
                    emit(key, counts, total, out)
                    key, counts, total = this, defaultdict(int), 0
                if g in (0, len(begins) - 1):
                    add(counts, nexts.slice(a, n).to_pylist(), raws.slice(a, n).to_pylist())
                    total += int(sums[g])
                else:
                    own: dict[str, int] = defaultdict(int)
                    add(own, nexts.slice(a, n).to_pylist(), raws.slice(a, n).to_pylist())
                    emit(this, own, int(sums[g]), out)
            if out:
                yield pa.record_batch([list(c) for c in zip(*out, strict=True)], schema=MERGED)
        out = []
        if key:
            emit(key, counts, total, out)
        if out:
            yield pa.record_batch([list(c) for c in zip(*out, strict=True)], schema=MERGED)

    at = ["lang", "prefix", "deal"]
    return rows.repartition(*at).sortWithinPartitions(*at).mapInArrow(run, "lang string, prefix string, next string, f long, total long, largest long")


def dealt_groups(langs: pa.Array, prefixes: pa.Array, begins: np.ndarray, wanted: np.ndarray, dealt: Dealt) -> list[int]:
    """Groups of dealt prefixes that are not wanted yet: each deal counts, however few its words."""
    left = np.flatnonzero(~wanted)
    among = pc.is_in(prefixes.take(pa.array(begins[left])), pa.array(sorted({p for _, p in dealt}))).to_numpy(zero_copy_only=False)
    return [g for g in left[among].tolist() if (langs[int(begins[g])].as_py(), prefixes[int(begins[g])].as_py()) in dealt]


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals of 38 digits; counts may reach 10 ** 16."""
    big = lambda x: x.cast("decimal(19,0)")
    product, parts = F.lit(1_000_000).cast("decimal(7,0)") * big(a) * big(a), big(left) * big(right)
    return F.call_function("div", product, parts)


def collocations(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    least: int = 10,
    percent: int = 50,
    top: int = 2000,
    sample: float = 0.02,
    at_once: int = 2_000_000,
    bits: int = 1 << 26,
) -> DataFrame:
    """For each language its first ``top`` phrases: (``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``).

    Capitals A-Z are lowered, texts parted at ``.,;:!?`` and line ends into pieces and these at blanks and tabs into words. Phrases of two or three words
    with ``a`` >= ``least`` occurrences within pieces are candidates; the cut after the first or second word with the lowest
    score counts. Candidates within a longer candidate of at least ``percent`` hundredths of their occurrences go.

    Null texts count as empty and null languages as ``und``; repeated rows count as often as they stand; ties go by occurrences, then by
    the phrase's bytes; texts may have any length. A language without candidates, and an empty table, give no rows. Other columns are left out.
    ``sample`` only decides how common prefixes are dealt, ``at_once`` how many words a task counts together, ``bits`` (a power of two, from 64) how
    many stripes of rare pairs are spared.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    dealt = common_prefixes(rows, sample, at_once)
    ones = stored(merged(stripes(rows, dealt, at_once, (1,)), dealt, least))
    held = bitmap(ones.where("next IS NOT NULL"), bits)
    found = ones.unionByName(stored(merged(stripes(rows, dealt, at_once, (2,), held), dealt, least)))

    key = lambda *c: F.concat_ws("\n", *c)  # noqa: E731  no word holds a line end
    prefixes = found.where("next IS NULL").groupBy("lang", "prefix").agg(F.sum("f").alias("f"), F.max("largest").alias("largest"))
    often = prefixes.where((F.col("prefix") != "") & (F.col("f") >= least))
    words = often.where(~F.col("prefix").contains(" ")).select(key("lang", "prefix").alias("key"), "f")
    pairs = often.where(F.col("prefix").contains(" ")).select(key("lang", "prefix").alias("key"), "f", "largest")

    # counts of the prefixes that are dealt: fewer than 1024 rows
    shared = spark.createDataFrame(sorted(dealt), "lang string, prefix string")
    shared = prefixes.join(F.broadcast(shared), ["lang", "prefix"]).select("lang", "prefix", F.col("f").alias("whole"))
    longer = found.where("next IS NOT NULL").join(F.broadcast(shared), ["lang", "prefix"], "left")
    longer = longer.select("lang", "prefix", "next", F.col("f").alias("a"), F.coalesce("total", "whole").alias("l1"), key("lang", "next").alias("key"))
    longer = spread_join(longer, words.withColumnRenamed("f", "r1"), "key", "prefix").drop("key")
    longer = longer.withColumn("phrase", F.concat_ws(" ", "prefix", "next"))
    longer = stored(longer.withColumn("s1", exact_score(F.col("a"), F.col("l1"), F.col("r1"))))

    three = longer.where(F.col("prefix").contains(" "))
    first, second = F.substring_index("prefix", " ", 1), F.substring_index("prefix", " ", -1)
    three = three.withColumns({"key": key("lang", first), "rest": key("lang", F.concat_ws(" ", second, F.col("next")))})
    three = spread_join(three, words.withColumnRenamed("f", "l0"), "key", "phrase").drop("key").withColumnRenamed("rest", "key")
    inner = three.groupBy("key").agg(F.max("a").alias("behind"))
    three = spread_join(three, pairs.select("key", F.col("f").alias("r0")), "key", "phrase").drop("key")
    three = three.withColumn("s0", exact_score(F.col("a"), F.col("l0"), F.col("r0")))
    lower = F.col("s0") <= F.col("s1")
    three = three.select("lang", "phrase", "a", *(F.when(lower, F.col(x + "0")).otherwise(F.col(x + "1")).alias(y) for x, y in (("l", "l"), ("r", "r"), ("s", "score"))))

    two = longer.where(~F.col("prefix").contains(" ")).withColumn("key", key("lang", "phrase"))
    two = two.join(pairs.select("key", "largest"), "key", "left").join(inner, "key", "left")
    inside = F.greatest(F.coalesce("largest", F.lit(0)), F.coalesce("behind", F.lit(0)))
    two = two.where(inside * 100 < F.col("a") * percent).select("lang", "phrase", "a", F.col("l1").alias("l"), F.col("r1").alias("r"), F.col("s1").alias("score"))

    # each of 32 parts of a language gives its first, so that the last task orders few
    order = [F.desc("score"), F.desc("a"), "phrase"]
    best = two.unionByName(three).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = prefixes.where("prefix = ''").select("lang", F.col("f").alias("n"))
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Counts every run of words by itself and looks its parts up.
OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), placed AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded
), f AS (
  SELECT lang, m, phrase, count(*) AS f
  FROM (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM placed, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(w))
  GROUP BY ALL
), candidates AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 10
), longer AS (
  SELECT lang, inner_phrase AS phrase, max(a) AS most
  FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS inner_phrase FROM candidates WHERE m = 3)
  GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM candidates c, (SELECT unnest([1, 2]) AS k) WHERE k < m
), scored AS (
  SELECT cuts.lang, cuts.m, cuts.phrase, a, k, h.f AS l, t.f AS r, (1000000::HUGEINT * a * a) // (h.f::HUGEINT * t.f) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head AND h.m = k JOIN f t ON t.lang = cuts.lang AND t.phrase = rest AND t.m = cuts.m - k
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT lowest.*, row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, lowest.phrase) AS rank
  FROM lowest LEFT JOIN longer ON m = 2 AND longer.lang = lowest.lang AND longer.phrase = lowest.phrase
  WHERE coalesce(100 * most < 50 * a, true)
), n AS (
  SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
