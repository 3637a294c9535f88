"""Extraction payloads: records and facts from their arrays, source texts, raw entries, training rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.norm import stripped


def _entry(fields: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.BooleanType() if n in ("isChronic", "abnormalFlag") else T.IntegerType() if n == "page" else T.StringType()) for n in fields.split()]))


#: The payload's schema; other keys are not read.
PAYLOAD = T.StructType([
    T.StructField("documentType", T.StringType()),
    T.StructField("documentDate", T.StructType([T.StructField("value", T.StringType()), T.StructField("sourceText", T.StringType())])),
    T.StructField("diagnoses", _entry("name isChronic notes page sourceText")),
    T.StructField("medications", _entry("medicineName strength dosage frequency duration batch expiry quantity page sourceText")),
    T.StructField("labResults", _entry("testName value unit date abnormalFlag page sourceText")),
    T.StructField("procedures", _entry("name date notes page sourceText")),
])
#: Record types with their arrays, titles and own dates.
KINDS = [("diagnosis", "diagnoses", "name", ""), ("medication", "medications", "medicineName", ""), ("lab_result", "labResults", "testName", "date"), ("procedure", "procedures", "name", "date")]


def parsed(payloads: DataFrame) -> DataFrame:
    """Payloads that can be read and have a type, as ``p``."""
    return payloads.withColumn("p", F.from_json("payload", PAYLOAD)).where("p.documentType is not null")


def records(payloads: DataFrame, as_of: str) -> DataFrame:
    """A record for each entry of the four arrays: keys that do not change, title, date (the entry's, else the document's, else ``as_of``), page."""
    read = parsed(payloads)
    rows = []
    for kind, array, title, date in KINDS:
        entry = read.select("document_id", "patient_id", "p", F.posexplode(f"p.{array}").alias("position", "x"))
        own = F.col(f"x.{date}") if date else F.lit(None).cast("string")
        day = F.coalesce(own, "p.documentDate.value", F.lit(as_of)).try_cast("date")
        key = F.sha2(F.concat_ws("|", "document_id", F.lit(kind), F.col("position").cast("string")), 256)
        rows.append(entry.select(
            "document_id", "patient_id", F.lit(kind).alias("record_type"), "position", key.alias("record_id"), F.col(f"x.{title}").alias("title"), day.alias("event_date"),
            F.coalesce("x.page", F.lit(1)).alias("source_page"), F.col("x.sourceText").alias("source_text"), F.lit("pending_review").alias("verification_status"),
        ))
    return reduce(DataFrame.unionByName, rows)


def facts_of(payloads: DataFrame, array: str) -> DataFrame:
    """The entries of one array with all their fields, and their document and position."""
    return parsed(payloads).select("document_id", F.posexplode(f"p.{array}").alias("position", "x")).select("document_id", "position", "x.*")


def source_texts(value: Column, schema: T.DataType) -> Column:
    """The distinct trimmed lower-case ``sourceText`` values anywhere in a nested value, by the paths of its schema."""

    def within(v: Column, kind: T.DataType) -> list[Column]:
        if isinstance(kind, T.StructType):
            own = [F.array(v[f.name]) for f in kind if f.name in ("sourceText", "source_text") and isinstance(f.dataType, T.StringType)]
            return own + [c for f in kind for c in within(v[f.name], f.dataType)]
        if isinstance(kind, T.ArrayType) and (inner := has_texts(kind.elementType)):
            return [F.flatten(F.transform(v, lambda x: F.concat(*within(x, kind.elementType))))] if inner else []
        return []

    def has_texts(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return any(f.name in ("sourceText", "source_text") or has_texts(f.dataType) for f in kind)
        return isinstance(kind, T.ArrayType) and has_texts(kind.elementType)

    none = F.array().cast("array<string>")
    texts = F.concat(*(F.coalesce(c, none) for c in within(value, schema)))
    return F.array_distinct(F.filter(F.transform(texts, lambda t: F.lower(stripped(t))), lambda t: t.isNotNull() & (t != "")))


def event_summaries(payloads: DataFrame) -> DataFrame:
    """A timeline event for each document before review: its type and how much it holds."""
    kind = F.replace(F.lower("p.documentType"), F.lit("_"), F.lit(" "))
    event = F.when(kind == "discharge summary", "Hospital Admission").when(kind == "prescription", "Prescription").when(kind == "lab report", "Lab Test").otherwise("Doctor Visit")
    n = [F.greatest(F.coalesce(F.size(f"p.{a}"), F.lit(0)), F.lit(0)) for a in ("diagnoses", "medications", "labResults")]
    return parsed(payloads).select("document_id", event.alias("event_type"), F.format_string("Document processed. Contains %d diagnoses, %d medications, and %d lab results.", *n).alias("summary"))


def raw_medications(medications: DataFrame, payloads: DataFrame) -> DataFrame:
    """Medications (``document_id``, ``medicine_name``) with batch, expiry and quantity of the first raw entry whose name contains theirs or lies in it."""
    raw = F.col("p.medications")
    joined = medications.join(parsed(payloads).select("document_id", "p"), "document_id", "left")
    mine = F.lower(F.coalesce("medicine_name", F.lit("")))

    def same(x: Column) -> Column:
        name = F.lower(F.coalesce(x["medicineName"], F.lit("")))
        return name.contains(mine) | mine.contains(name)

    first = F.get(F.filter(raw, same), F.lit(0))
    return joined.select("document_id", "medicine_name", *(first[f].alias(f) for f in ("batch", "expiry", "quantity")))


def training_rows(texts: DataFrame, old: DataFrame, new: DataFrame, reason: str = "User Correction") -> DataFrame:
    """Corrected extractions for training: text, both payloads, confidence (1.0 if the correction says none), reason, version (from 1).

    ``new`` may have ``confidence`` and ``version``.
    """
    known = {c: F.coalesce(c, d) if c in new.columns else d for c, d in (("confidence", F.lit(1.0)), ("version", F.lit(1)))}
    fixed = new.select("document_id", F.col("payload").alias("corrected_extraction"), *(v.alias(c) for c, v in known.items()))
    pair = old.select("document_id", F.col("patient_id"), F.col("payload").alias("original_extraction")).join(fixed, "document_id").where("original_extraction <> corrected_extraction")
    pair = pair.where(F.from_json("original_extraction", PAYLOAD).isNotNull() & F.get_json_object("original_extraction", "$").isNotNull())
    rows = texts.select("document_id", F.col("chunk_text").alias("original_ocr")).join(pair, "document_id")
    return rows.select("document_id", "patient_id", "original_ocr", "original_extraction", "corrected_extraction", "confidence", F.lit(reason).alias("reason"), "version")


def exported(rows: DataFrame, path: str) -> None:
    """Training rows added to a folder of JSON lines."""
    rows.write.mode("append").json(path)


def unreadable(payloads: DataFrame, path: str = "$.unreadableSections") -> DataFrame:
    """How many entries the array at ``path`` has in each payload that can be read."""
    n = F.json_array_length(F.get_json_object("payload", path))
    return payloads.select("document_id", n.cast("long").alias("unreadable")).where("unreadable is not null")
