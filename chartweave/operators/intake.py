"""Uploads, scanned words and regions, extraction payloads."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.norm import any_of, stripped
from . import variants

MOST_BYTES = 20 * 1024 * 1024
#: Words of generated text that need a guard.
RESTRICTED = ["recommend", "prescribe", "cause of your", "diagnose"]
WORD_FIELDS = T.ArrayType(T.StructType([T.StructField("testName", T.StringType()), T.StructField("value", T.StringType()), T.StructField("sourceText", T.StringType())]))
PAYLOAD = T.StructType([T.StructField("documentType", T.StringType()), T.StructField("labResults", WORD_FIELDS)])


def mime_type(content: Column) -> Column:
    """The type that the leading bytes tell; null for others."""
    head = lambda a, n: F.hex(F.substring(content, a, n))
    return (
        F.when(head(1, 4) == "25504446", "application/pdf").when(head(1, 3) == "FFD8FF", "image/jpeg").when(head(1, 4) == "89504E47", "image/png")
        .when((head(1, 4) == "52494646") & (head(9, 4) == "57454250"), "image/webp")
    )


def admitted_uploads(files: DataFrame) -> DataFrame:
    """Uploads with type, fingerprint and whether they are accepted (known type, not empty, at most 20 MiB)."""
    size = F.octet_length("content")
    out = files.withColumns({"mime_type": mime_type(F.col("content")), "sha256": F.sha2("content", 256)})
    return out.withColumn("accepted", F.col("mime_type").isNotNull() & (size > 0) & (size <= MOST_BYTES))


def token_states(tokens: DataFrame, as_of: str) -> DataFrame:
    """``revoked``, ``expired`` or ``valid``."""
    state = F.when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("expires_at") < F.lit(as_of).cast("timestamp"), "expired").otherwise("valid")
    return tokens.withColumn("state", state)


def disclosed(patients: DataFrame, config: DataFrame, columns: list[str], hidden: str = "Redacted / Hidden") -> DataFrame:
    """Patients with columns hidden whose flag ``show_<column>`` is false; without a configuration all show."""
    joined = patients.join(config, patients.id == config.patient_id, "left")
    return joined.select(patients.id, *(F.when(F.coalesce(f"show_{c}", F.lit(True)), F.col(c)).otherwise(hidden).alias(c) for c in columns))


def restricted(text: Column) -> Column:
    return any_of(F.lower(text), RESTRICTED)


def blocks(words: DataFrame, digits: int = 3) -> DataFrame:
    """Scanned words as blocks: text in word order, bounding box, mean confidence (negative ones left out, else 0.8)."""
    in_order = F.sort_array(F.collect_list(F.struct("word_no", "text")))
    sure = F.when(F.col("confidence") >= 0, F.col("confidence"))  # summed as decimals, so in any order
    return words.groupBy("document_id", "page", "block").agg(
        F.array_join(in_order["text"], " ").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"),
        F.round(F.coalesce(F.sum(sure.cast("decimal(20, 6)")).cast("double") / F.count(sure), F.lit(0.8)), digits).alias("confidence"),
    )


def document_texts(found: DataFrame, digits: int = 3) -> DataFrame:
    """Blocks as documents: pages in order, parted by empty lines, blocks by line ends, and the mean confidence."""
    pages = found.groupBy("document_id", "page").agg(F.array_join(F.sort_array(F.collect_list(F.struct("block", "text")))["text"], "\n").alias("text"), F.sum(F.col("confidence").cast("decimal(20, 6)")).alias("s"), F.count(F.lit(1)).alias("n"))
    scale = 10**digits
    return pages.groupBy("document_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("page", "text")))["text"], "\n\n").alias("text"), (F.floor(F.sum("s").cast("double") * scale / F.sum("n") + 0.5) / scale).alias("confidence")
    )


def split_states(regions: DataFrame) -> DataFrame:
    """Of documents with several regions: whether the split waits for review (a confidence below 0.85; unknown ones count as 1)."""
    per = regions.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("confidence", F.lit(1.0))).alias("least"))
    return per.where("n > 1").select("document_id", "n", F.when(F.col("least") < 0.85, "awaiting_split_review").otherwise("split").alias("state"))


def region_documents(regions: DataFrame) -> DataFrame:
    """A child document for each region, numbered from the top, then from the left."""
    order = W.partitionBy("document_id").orderBy("y", "x", "region_id")
    out = regions.withColumn("document_index", F.row_number().over(order) - 1)
    return out.withColumn("file_name", F.concat(F.lit("region_"), F.col("document_index").cast("string"), F.lit("_"), F.col("file_name")))


def payload_facts(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lab results, rejected rows) of payloads (``document_id``, ``payload`` JSON); rejects are malformed or lack a type."""
    read = payloads.withColumn("p", F.from_json("payload", PAYLOAD))
    good = F.coalesce(F.col("p.documentType").isNotNull(), F.lit(False))
    rows = read.where(good).select("document_id", F.col("p.documentType").alias("document_type"), F.posexplode("p.labResults").alias("position", "lab"))
    labs = rows.select("document_id", "document_type", "position", F.col("lab.testName").alias("test_name"), F.col("lab.value").alias("value"), F.sha2(F.concat_ws("|", "document_id", F.lit("lab"), F.col("position").cast("string")), 256).alias("record_id"))
    return labs, read.where(~good).select("document_id")


def coverage(payloads: DataFrame, texts: DataFrame) -> DataFrame:
    """Per document its text blocks (lines of more than five characters), and how many a source text stands for.

    A block is mapped if it contains a source text of the payload, or lies in one.
    """
    sources = F.filter(F.array_distinct(F.transform(F.from_json("payload", PAYLOAD)["labResults"], lambda x: F.lower(stripped(x["sourceText"])))), lambda s: s.isNotNull() & (s != ""))
    found = F.filter(F.transform(F.split("text", "\n"), lambda x: F.lower(stripped(x))), lambda x: F.length(x) > 5)
    both = texts.join(payloads, "document_id").select("document_id", found.alias("blocks"), F.coalesce(sources, F.array().cast("array<string>")).alias("sources"))
    mapped = F.size(F.filter("blocks", lambda b: F.exists("sources", lambda s: s.contains(b) | b.contains(s))))
    return both.select("document_id", F.size("blocks").alias("total"), mapped.alias("mapped"), (F.size("blocks") - mapped).alias("unmapped"))


def changes(old, new, path: str = "") -> list[tuple[str, str | None, str | None]]:
    """Paths at which two JSON values differ, with both; objects are entered, arrays compared whole. For single values; tables go through ``corrections``."""
    if isinstance(old, dict) and isinstance(new, dict):
        keys = list(old) + [k for k in new if k not in old]
        return [c for k in keys for c in changes(old.get(k), new.get(k), f"{path}.{k}" if path else k)]
    if old == new:
        return []
    shown = lambda v: None if v is None else json.dumps(v, sort_keys=True, ensure_ascii=False)
    return [(path, shown(old), shown(new))]


def corrections(pairs: DataFrame) -> DataFrame:
    """A row for each change between two payloads (``document_id``, ``old``, ``new``): ``path``, ``from_value``, ``to_value``."""
    return variants.changes(pairs.select("document_id", "old", "new"))


def question_intents(questions: DataFrame, intents: dict[str, list[str]]) -> DataFrame:
    """A flag for each intent whose words a question contains."""
    text = F.lower("question")
    return questions.select("question_id", *(reduce(lambda a, b: a | b, (text.contains(w) for w in ws)).alias(k) for k, ws in intents.items()))


def question_records(questions: DataFrame, records: DataFrame) -> DataFrame:
    """Records (``patient_id``, ``name``) that a question of the patient names, whole or by a word of over three characters."""
    joined = questions.select("question_id", "patient_id", F.lower("question").alias("q")).join(records.select("patient_id", "name").distinct(), "patient_id")
    low = F.lower("name")
    word = F.exists(F.split(low, r"\s+"), lambda w: (F.length(w) > 3) & F.col("q").contains(w))
    return joined.where(F.col("q").contains(low) | word).select("question_id", "name")
