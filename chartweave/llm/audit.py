"""How filters interact: what each removes, and would remove, in every order in which they can be applied.

One table of failing ids is stored for each filter. Left-semi and left-anti joins with these tables part the failing rows, filter by filter,
until each row's part says which filters it fails. What survives a prefix of an order is all rows without those of the parts that fail one of its
filters, so every prefix of every order is a sum over at most 2^n parts of a source, and rows are joined 2n times instead of once for each prefix.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, remove_folder, shared_folder, spread_join, text_key

#: White space between words, capitals, and characters that fail a text.
APART, CAPITALS, SYMBOLS = "[ \t-\r]+", "[A-Z]", r"[#$%&*|]"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on a text that is not null: few words, few distinct words, many capitals, symbols."""
    words = F.array_remove(F.split(text, APART), "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": F.size(F.array_distinct(words)) * F.lit(100).cast("long") < n * F.lit(65).cast("long"),
        "C": F.regexp_count(text, F.lit(CAPITALS)) * F.lit(100).cast("long") > F.length(text) * F.lit(5).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def repeats(rows: DataFrame, doc_id: str, text_hash: list[str]) -> DataFrame:
    """Rows whose text also stands at a smaller id; rows without an id are none. No join is on the text alone, so a text with many copies is no hot key."""
    known = rows.where(F.col(doc_id).isNotNull())
    firsts = known.groupBy(*text_hash).agg(F.min(doc_id).alias(doc_id))
    return known.join(firsts, [*text_hash, doc_id], "left_anti")


def removals(rows: DataFrame, failing: dict[str, DataFrame], order: str, key: list[str]) -> DataFrame:
    """All rows with ``removed_by``, the first filter of ``order`` whose table holds their ``key`` (null: kept).

    A null in the key meets nothing, so such a row is kept; equal rows are treated alike. If there is a column of the new name, the new
    one gets underscores behind it.
    """
    (name,) = fresh(rows, "removed_by")
    left, out = rows, []
    for letter in order:
        ids = failing[letter].select(*key)
        out.append(left.join(ids, key, "left_semi").withColumn(name, F.lit(letter)))
        left = left.join(ids, key, "left_anti")
    kept = left.withColumn(name, F.lit(None).cast("string"))
    return reduce(DataFrame.unionByName, out, kept)


def failing_parts(rows: DataFrame, failing: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """The rows that fail any filter, with ``fails``: a bit for each filter in the order of ``failing``."""
    ids = {letter: table.select(*key) for letter, table in failing.items()}
    (name,) = fresh(rows, "fails")
    now = cut(rows.join(reduce(DataFrame.unionByName, ids.values()), key, "left_semi").withColumn(name, F.lit(0)))
    for k, table in enumerate(ids.values()):
        fails = now.join(table, key, "left_semi").withColumn(name, F.col(name) + F.lit(1 << k))
        now = cut(fails.unionByName(now.join(table, key, "left_anti")))
    return now


def audit_report(totals: DataFrame, parts: DataFrame, letters: str, *, part: str = "part") -> DataFrame:
    """For each ``part`` of ``totals`` (with its number of rows ``n``), all orders of ``letters`` and all steps: what is counted in COUNTS.

    ``parts``: (``part``, ``fails``, ``n``, ``good``, ``toxic``), the rows of each part by the filters they fail. A part without such rows gets zeros.
    """
    bits = range(1 << len(letters))
    lost = parts.groupBy(part).agg(
        *(
            F.array(*(F.sum(F.when(F.col("fails").bitwiseAND(F.lit(s)) != 0, F.col(c)).otherwise(0)) for s in bits)).alias(f"{c}_gone")
            for c in ("n", "good", "toxic")
        )
    )
    rows = totals.join(lost, part, "left")
    zeros = F.array_repeat(F.lit(0).cast("long"), len(bits))
    rows = rows.select(part, "n", *(F.coalesce(f"{c}_gone", zeros).alias(c + "_gone") for c in ("n", "good", "toxic")))

    def gone(column: str, mask: Column | int) -> Column:
        return F.element_at(column, (F.lit(mask) if isinstance(mask, int) else mask) + 1)

    def shapley(k: int) -> Column:
        """A filter's removals over all orders: each set of filters before it stands for the orders of the set and of the others."""
        out = F.lit(0).cast("long")
        for s in bits:
            if not s >> k & 1:
                before = s.bit_count()
                out += F.lit(factorial(before) * factorial(len(letters) - 1 - before)) * (gone("n_gone", s | 1 << k) - gone("n_gone", s))
        return out

    every = len(bits) - 1
    rows = rows.select(
        "*",
        F.array(*(gone("n_gone", 1 << k) for k in range(len(letters)))).alias("fails"),
        F.array(*(gone("n_gone", every) - gone("n_gone", every ^ 1 << k) for k in range(len(letters)))).alias("unique"),
        F.array(*(shapley(k) for k in range(len(letters)))).alias("shapleys"),
        F.explode(F.array(*(F.lit("".join(p)) for p in permutations(letters)))).alias("filter_order"),
    )
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    seen = [F.instr("filter_order", x) for x in letters]
    before = reduce(Column.__add__, (F.when(at < F.col("step"), 1 << k).otherwise(0) for k, at in enumerate(seen)))
    rows = rows.withColumn("before", before).withColumn("k", F.instr(F.lit(letters), F.expr("substring(filter_order, step, 1)")))
    after = F.col("before") + F.element_at(F.array(*(F.lit(1 << k) for k in range(len(letters)))), F.col("k"))
    removed = gone("n_gone", after) - gone("n_gone", F.col("before"))
    return rows.select(
        part,
        "filter_order",
        "step",
        (F.col("n") - gone("n_gone", after)).alias("kept"),
        removed.alias("removed"),
        (F.element_at("fails", F.col("k")) - removed).alias("redundant"),
        F.element_at("unique", F.col("k")).alias("unique_fails"),
        (gone("good_gone", after) - gone("good_gone", F.col("before"))).alias("good_lost"),
        (gone("toxic_gone", after) - gone("toxic_gone", F.col("before"))).alias("toxic_lost"),
        F.element_at("shapleys", F.col("k")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """The report of ``text_filters`` and, as E, ``repeats``, for each value of ``part`` (null: the empty string).

    A null text counts as empty. Rows without an id fail no E and have no label; rows that agree in id and text fail the same filters and
    each counts. A document with several labels is good, or toxic, if one says so. An empty table gives no rows; other columns are left
    out, whatever their names.
    """
    spark = docs.sparkSession
    at = f"{shared_folder(spark).rstrip('/')}/audit-{uuid.uuid4().hex}"
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    filters = text_filters(F.col("text"))
    t1, t2 = text_key("text")
    # a row's key tells it by id and text, also where the id is null or repeated
    rows = rows.select("doc_id", "part", t1.alias("t1"), t2.alias("t2"), *(c.alias(x) for x, c in filters.items()))
    rows = rows.select("*", F.xxhash64("doc_id", "t1").alias("k1"), F.xxhash64("t2", F.col("doc_id").isNull(), "doc_id").alias("k2"))
    rows.write.parquet(f"{at}/rows")
    rows = spark.read.parquet(f"{at}/rows")
    failing, key = {x: rows.where(x) for x in filters} | {"E": repeats(rows, "doc_id", ["t1", "t2"])}, ["k1", "k2"]
    for letter, table in failing.items():
        table.select("doc_id", *key).write.parquet(f"{at}/fails-{letter}")
    failing = {x: spark.read.parquet(f"{at}/fails-{x}") for x in failing}

    said = labels.groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    fails = failing_parts(rows.select("doc_id", "part", *key), failing, key)
    fails = spread_join(fails, said, "doc_id", "k1", "left")
    parts = fails.groupBy("part", "fails").agg(
        F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic"))
    )
    parts, totals = cut(parts), cut(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    remove_folder(spark, at)
    return audit_report(totals, parts, "".join(failing))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, by source, in all 120 orders."""
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Counts each set of failed filters of a source once, then adds up the sets that a prefix removes.
OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT doc_id, part, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         min(doc_id) OVER (PARTITION BY text) AS first_id
  FROM docs
), flagged AS (
  SELECT part, doc_id,
         (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END)
       + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
       + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END)
       + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
       + (CASE WHEN doc_id > first_id THEN 16 ELSE 0 END) AS fails
  FROM worded
), said AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), sets AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM flagged LEFT JOIN said USING (doc_id) GROUP BY part, fails
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(letter, bit)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counted AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails & before <> 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM sets, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""
