"""Filters, lifecycle, joins and counts over fact tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import rules
from ..functions.norm import any_of, stripped


def verified(facts: DataFrame, statuses: tuple[str, ...] = rules.VERIFIED) -> DataFrame:
    return facts.where(F.col("verification_status").isin(*statuses))


def owned(rows: DataFrame, patients: DataFrame, user_id: str) -> DataFrame:
    """Rows of patients that the user owns."""
    return rows.join(patients.where(F.col("user_id") == user_id).select(F.col("id").alias("patient_id")), "patient_id", "left_semi")


def owned_paths(files: DataFrame, patients: DataFrame, user_id: str, path: str = "storage_path") -> DataFrame:
    """Files that lie in the folder of a patient that the user owns: the path's first segment is "patients", its second such a patient's id."""
    parts = F.split(path, "/")
    mine = patients.where(F.col("user_id") == user_id).select(F.col("id").alias("owner__"))
    return files.join(mine, (F.get(parts, F.lit(0)) == "patients") & (F.get(parts, F.lit(1)) == F.col("owner__")), "left_semi")


def active(medications: DataFrame, as_of: str) -> DataFrame:
    """Without an end, or ending at ``as_of`` (midnight of a day counts as its start) or later."""
    return medications.where(F.col("end_date").isNull() | (F.col("end_date").cast("timestamp") >= F.lit(as_of).cast("timestamp")))


def chronic(name: Column, is_chronic: Column) -> Column:
    return F.coalesce(is_chronic, F.lit(False)) | any_of(F.lower(name), rules.CHRONIC_WORDS)


def long_term(name: Column, duration: Column) -> Column:
    return any_of(F.lower(F.coalesce(duration, F.lit(""))), rules.LONG_TERM_DURATIONS) | any_of(F.lower(name), rules.LONG_TERM_DRUGS)


def review_status(action: Column) -> Column:
    return F.when(action == "confirm", "verified").when(action == "reject", "rejected").when(action == "unreadable", "unreadable").otherwise("corrected")


def confidence_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.90, "HIGH").when(confidence >= 0.65, "MEDIUM").otherwise("LOW")


def not_billing(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows whose document is no bill; rows without a document pass."""
    kind = F.upper(F.coalesce(F.nullif("document_type", F.lit("")), "category", F.lit("")))
    bills = documents.where(kind.isin(*rules.BILLING_TYPES)).select(F.col("id").alias("source_document_id"), F.lit(True).alias("is_bill__"))
    # a left anti join would be made for each part of a union by itself, each with sorts of its own
    return rows.join(bills, "source_document_id", "left").where("is_bill__ is null").drop("is_bill__")


def latest_actions(reviews: DataFrame) -> DataFrame:
    """The last review of each record and field, with the status it gives."""
    last = W.partitionBy("record_id", "field_name").orderBy(F.desc("ts"), F.desc("id"))
    return reviews.withColumn("n", F.row_number().over(last)).where("n = 1").withColumn("status", review_status(F.col("action"))).drop("n")


def current_jobs(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """The state of each document: its last job's, else its own, and the number of attempts."""
    last = jobs.groupBy("document_id").agg(F.max_by("status", F.struct("ts", "id")).alias("job"), F.count(F.lit(1)).alias("n"))
    joined = documents.join(last, documents.id == last.document_id, "left")
    return joined.select(documents.id, F.coalesce("job", "processing_status").alias("status"), F.coalesce("n", F.lit(0)).alias("attempts"))


def next_versions(arrivals: DataFrame) -> DataFrame:
    """Version numbers of extractions in order of arrival; the first new one of a document without any is 2."""
    order = W.partitionBy("document_id").orderBy("ts", "event_id")
    return arrivals.withColumn("version_number", F.row_number().over(order) + 1)


def unduplicated(documents: DataFrame) -> DataFrame:
    """Each document with the first living one of the same patient and content (``existing_id``), null if it is that one."""
    live = documents.where(~F.col("is_deleted"))
    order = W.partitionBy("patient_id", "sha256_hash").orderBy("created_on", "id")
    first = F.first("id").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return live.withColumn("first", first).withColumn("existing_id", F.when(F.col("first") != F.col("id"), F.col("first"))).drop("first")


def not_yet_verified(new: DataFrame, old: DataFrame, statuses: tuple[str, ...] = ("verified",)) -> DataFrame:
    """New entities (``source_document_id``, ``name``) that no verified one of the same document and name stands for."""
    known = verified(old, statuses).select("source_document_id", "name").distinct()
    return new.join(known, ["source_document_id", "name"], "left_anti")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows that are left when the keys of ``gone`` are deleted (of documents or patients)."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def cascade(tables: list[tuple[str, DataFrame]], gone: DataFrame, key: str) -> list[tuple[str, DataFrame]]:
    """What is left of several tables when the keys of ``gone`` are deleted."""
    return [(name, without(df, gone, key)) for name, df in tables]


def fact_union(**kinds: DataFrame) -> DataFrame:
    """Facts of several kinds in one table with ``kind``."""
    tables = [df.withColumn("kind", F.lit(kind)) for kind, df in kinds.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def document_counts(documents: DataFrame, facts: DataFrame, kinds: list[str]) -> DataFrame:
    """How many facts of each kind each document has."""
    per = facts.groupBy("source_document_id").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds))
    joined = documents.join(per, documents.id == per.source_document_id, "left")
    return joined.select(documents.id, *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in kinds))


def mean_confidence(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """Mean confidence of a document's facts (1.0 without any) and its tier."""
    per = facts.groupBy("source_document_id").agg(F.avg("confidence").alias("mean"))
    joined = documents.join(per, documents.id == per.source_document_id, "left").withColumn("mean", F.round(F.coalesce("mean", F.lit(1.0)), 6))
    return joined.select(documents.id, "mean", confidence_tier(F.col("mean")).alias("tier"))


def payload_allergies(payloads: DataFrame) -> DataFrame:
    """(``patient_id``, ``allergy``): distinct trimmed allergies of payloads (``patient_id``, ``payload``), texts or objects with a ``value``; others and blank ones are none."""
    rows = payloads.select("patient_id", F.explode(F.try_variant_get(F.try_parse_json("payload"), "$.allergies", "array<variant>")).alias("x"))
    is_text = lambda v: F.schema_of_variant(v).eqNullSafe("STRING")
    value = F.try_variant_get("x", "$.value", "variant")
    text = F.when(is_text(F.col("x")), F.try_variant_get("x", "$", "string")).when(is_text(value), F.try_variant_get("x", "$.value", "string"))
    return rows.select("patient_id", stripped(text).alias("allergy")).where("allergy <> ''").distinct()


def profiles(patients: DataFrame, diagnoses: DataFrame, medications: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """Each patient's distinct chronic conditions, long-term medications and allergies (own ones and those of ``payloads``), sorted."""
    dx = diagnoses.where(chronic(F.col("name"), F.col("is_chronic"))).groupBy("patient_id").agg(F.sort_array(F.collect_set(stripped(F.col("name")))).alias("conditions"))
    rx = medications.where(long_term(F.col("medicine_name"), F.col("duration"))).groupBy("patient_id").agg(F.sort_array(F.collect_set(stripped(F.col("medicine_name")))).alias("medications"))
    none = F.array().cast("array<string>")
    out = patients.withColumnRenamed("id", "patient_id").join(dx, "patient_id", "left").join(rx, "patient_id", "left")
    mine = F.coalesce(F.filter(F.transform(F.split("allergies", r"\|"), stripped), lambda a: a != ""), none)
    if payloads is not None:
        read = payload_allergies(payloads).groupBy("patient_id").agg(F.collect_list("allergy").alias("read"))
        out = out.join(read, "patient_id", "left")
        mine = F.concat(mine, F.coalesce("read", none))
    return out.select("patient_id", F.coalesce("conditions", none).alias("conditions"), F.coalesce("medications", none).alias("medications"), F.array_sort(F.array_distinct(mine)).alias("allergies"))


def blood_groups(patients: DataFrame, labs: DataFrame) -> DataFrame:
    """The manual blood group against a verified lab: ``conflict``, ``document-verified``, ``patient-entered`` or ``unknown``."""
    name = F.lower("test_name")
    seen = labs.where((F.col("verification_status") == "verified") & any_of(name, ["blood type", "abo", "blood group"]))
    seen = seen.groupBy("patient_id").agg(F.min_by("value", "id").alias("lab_value"))
    out = patients.withColumnRenamed("id", "patient_id").join(seen, "patient_id", "left")
    same = F.lower(stripped(F.col("blood_group"))) == F.lower(stripped(F.col("lab_value")))
    state = F.when(F.col("lab_value").isNotNull() & F.col("blood_group").isNotNull() & ~same, "conflict").when(F.col("lab_value").isNotNull(), "document-verified")
    state = state.when(F.col("blood_group").isNotNull(), "patient-entered").otherwise("unknown")
    return out.select("patient_id", "blood_group", "lab_value", state.alias("provenance"))
