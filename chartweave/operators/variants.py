"""JSON of any shape as variants: entries at any depth, and what differs between two values.

Variants are entered level by level, as many times as the deepest text nests; everything runs row by row in the JVM, without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.norm import stripped

#: Keys of source texts.
SOURCE_KEYS = ("sourceText", "source_text")


def nesting(text: Column) -> Column:
    """How deep the brackets of a JSON text nest (null: 0)."""
    brackets = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    steps = F.transform(F.filter(F.split(brackets, ""), lambda b: b != ""), lambda b: F.when(b.isin("[", "{"), 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    deepest = F.aggregate(
        steps, start, lambda s, d: F.struct((s["now"] + d).alias("now"), F.greatest(s["most"], s["now"] + d).alias("most")), lambda s: s["most"]
    )
    return F.coalesce(deepest, F.lit(0))


def deepest(df: DataFrame, *texts: str) -> int:
    """The deepest nesting of any text in the columns."""
    return df.agg(F.max(F.greatest(*(nesting(F.col(t)) for t in texts), F.lit(0)))).first()[0] or 0


def entries(df: DataFrame, text: str) -> DataFrame:
    """The other columns with an entry of the JSON in ``text`` a row: ``level``, ``key`` (null in arrays), ``pos``, ``value`` (variant). Texts that can't be read give none."""
    kept = [c for c in df.columns if c != text]
    now, levels = df.select(*kept, F.try_parse_json(text).alias("value")), []
    for level in range(1, deepest(df, text) + 1):
        inner = now.select(*kept, F.col("value").alias("outer__"))
        now = inner.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("outer__").outer())).select(*kept, F.lit(level).alias("level"), "key", "pos", "value")
        levels.append(now)
    if not levels:
        return now.select(*kept, F.lit(0).alias("level"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("pos"), "value").where(F.lit(False))
    return reduce(DataFrame.unionByName, levels)


def source_texts(payloads: DataFrame, keys: tuple[str, ...] = SOURCE_KEYS) -> DataFrame:
    """(``document_id``, ``source_text``): the distinct trimmed lower-case texts under ``keys``, at any depth of payloads (``document_id``, ``payload``)."""
    found = entries(payloads.select("document_id", "payload"), "payload").where(F.col("key").isin(*keys) & F.schema_of_variant("value").eqNullSafe("STRING"))
    text = F.lower(stripped(F.try_variant_get("value", "$", "string")))
    return found.select("document_id", text.alias("source_text")).where("source_text <> ''").distinct()


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False))


def changes(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """The other columns with a row for each change between two JSON texts: ``path``, ``from_value``, ``to_value`` (JSON; null: not there).

    Objects are entered as long as both sides are objects; other values, arrays too, are compared whole, whatever the order of their keys. A key with null differs
    from none. Equal texts are not read; one that can't be read counts as an empty object.
    """
    kept = [c for c in pairs.columns if c not in (old, new)]
    differ = pairs.where(~F.col(old).eqNullSafe(F.col(new)))
    empty = F.parse_json(F.lit("{}"))
    now = differ.select(*kept, F.lit("").alias("path"), *(F.coalesce(F.try_parse_json(c), empty).alias(s) for c, s in ((old, "a"), (new, "b"))))
    levels = []
    for _ in range(max(1, deepest(differ, old, new))):
        both = now.where(is_object(F.col("a")) & is_object(F.col("b")))
        both = both.select(*kept, "path", *(F.col(c).cast("map<string,variant>").alias(c) for c in "ab"))
        both = both.withColumn("key", F.explode(F.array_union(F.map_keys("a"), F.map_keys("b"))))
        path = F.when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
        now = both.select(*kept, path.alias("path"), *(F.try_element_at(c, F.col("key")).alias(c) for c in "ab"))
        now = now.where(~F.to_json("a").eqNullSafe(F.to_json("b")))
        levels.append(now.where(~(is_object(F.col("a")) & is_object(F.col("b")))))
    rows = reduce(DataFrame.unionByName, levels)
    return rows.select(*kept, "path", F.to_json("a").alias("from_value"), F.to_json("b").alias("to_value"))
