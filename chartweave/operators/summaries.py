"""Per-patient texts and profiles, citations, checks and rebuilds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.norm import canonical, stripped
from .ranges import numbered


def cited(facts: DataFrame, documents: DataFrame, default: str = "Medical Document") -> DataFrame:
    """Facts with the file name of their document."""
    names = documents.select(F.col("id").alias("source_document_id"), "file_name")
    return facts.join(names, "source_document_id", "left").withColumn("title", F.coalesce("file_name", F.lit(default))).drop("file_name")


def dated(facts: DataFrame, records: DataFrame) -> DataFrame:
    """Facts with the event date of their record."""
    return facts.join(records, "record_id", "left")


def review_queue(documents: DataFrame) -> DataFrame:
    """Documents of each patient that wait for review."""
    return documents.where((F.col("processing_status") == "awaiting_review") & ~F.col("is_deleted")).groupBy("patient_id").agg(F.count(F.lit(1)).alias("waiting"), F.min("created_on").alias("oldest"))


def listed(items, none: str = "None"):
    return F.coalesce(F.nullif(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("")), F.lit(none))


def memories(patients: DataFrame, diagnoses: DataFrame, medications: DataFrame) -> DataFrame:
    """A short text for each patient: chronic conditions, long-term medications with strength, allergies."""
    dx = diagnoses.where("is_chronic").groupBy("patient_id").agg(F.sort_array(F.collect_set(canonical(F.col("name"), "diagnosis"))).alias("conditions"))
    lasting = F.col("end_date").isNull() | F.lower("duration").contains("ongoing") | F.lower("duration").contains("chronic")
    shown = F.concat(canonical(F.col("medicine_name"), "medication"), F.lit(" ("), F.coalesce("strength", F.lit("N/A")), F.lit(")"))
    rx = medications.where(lasting).groupBy("patient_id").agg(F.sort_array(F.collect_set(shown)).alias("medications"))
    none = F.array().cast("array<string>")
    out = patients.withColumnRenamed("id", "patient_id").join(dx, "patient_id", "left").join(rx, "patient_id", "left")
    allergies = F.filter(F.transform(F.split(F.coalesce("allergies", F.lit("")), r"\|"), stripped), lambda a: a != "")
    text = F.concat(
        F.lit("[PATIENT COMPACT CLINICAL MEMORY]\nPatient Name: "), F.coalesce("full_name", F.lit("Patient")), F.lit("\nBlood Group: "), F.coalesce("blood_group", F.lit("N/A")),
        F.lit("\n\nActive Chronic Conditions:\n"), listed(F.coalesce("conditions", none)), F.lit("\n\nActive Long-term Medications:\n"), listed(F.coalesce("medications", none)),
        F.lit("\n\nKnown Allergies:\n"), listed(allergies),
    )
    return out.select("patient_id", text.alias("memory"))


def emergency_conditions(patients: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Manual conditions (``patient-entered``) and verified chronic ones that are not among them (``document-verified``)."""
    manual = patients.where("manual_condition is not null").select(F.col("id").alias("patient_id"), F.col("manual_condition").alias("name"))
    found = diagnoses.where("is_chronic and verification_status = 'verified'").select("patient_id", "name").distinct()
    more = found.join(manual, (found.patient_id == manual.patient_id) & (F.lower(found.name) == F.lower(manual.name)), "left_anti")
    return manual.withColumn("provenance", F.lit("patient-entered")).unionByName(more.withColumn("provenance", F.lit("document-verified")))


def version_ends(versions: DataFrame) -> DataFrame:
    """The first and the latest version of each document (``ts``, ``event_id`` order)."""
    order = F.struct("ts", "event_id")
    return versions.groupBy("document_id").agg(F.min_by("event_id", order).alias("first_id"), F.max_by("event_id", order).alias("latest_id"), F.count(F.lit(1)).alias("n"))


def session_context(briefs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Briefs with their session's reason, place and description, or defaults."""
    joined = briefs.join(sessions.select("session_id", "reason_category", "problem_location", "description"), "session_id", "left")
    return joined.select("session_id", F.coalesce("reason_category", F.lit("General Consultation")).alias("reason"), F.coalesce("problem_location", F.lit("Not specified")).alias("place"), F.coalesce("description", F.lit("")).alias("description"))


def lab_errors(labs: DataFrame) -> DataFrame:
    """Results without a digit and dates after ``created_on`` of their record: (``id``, ``field``, ``severity``)."""
    errors = F.array_compact(F.array(
        F.when(~F.col("value").rlike(r"\d"), F.struct(F.lit("value").alias("field"), F.lit("warning").alias("severity"))),
        F.when(F.col("test_date") > F.col("event_date"), F.struct(F.lit("test_date").alias("field"), F.lit("error").alias("severity"))),
    ))
    return labs.select("id", F.explode(errors).alias("e")).select("id", "e.field", "e.severity")


def feedback(documents: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Training rows of corrections: text, both payloads, version and confidence."""
    pair = old.withColumnRenamed("payload", "original").join(new.withColumnRenamed("payload", "corrected"), "document_id").where("original <> corrected")
    return documents.join(pair, "document_id").select("document_id", F.col("chunk_text").alias("original_ocr"), "original", "corrected", F.lit(1).alias("version"), F.lit(1.0).alias("confidence"))


BUCKETS = 64


def bucketed(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """With ``patient_bucket``, by which derived tables are partitioned (never one partition for each patient)."""
    return df.withColumn("patient_bucket", F.pmod(F.xxhash64("patient_id"), F.lit(buckets)).cast(T.IntegerType()))


def rebuild(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replace a derived table's buckets that ``df`` touches; ``df`` must hold all patients of those buckets."""
    bucketed(df, buckets).repartition("patient_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("patient_bucket").parquet(path)


def touched(events: DataFrame, patients_of: DataFrame) -> DataFrame:
    """All patients of the buckets in which an event (``record_id``) touches one: those to compute anew."""
    hit = bucketed(patients_of.join(events.select("record_id").distinct(), "record_id", "left_semi").select("patient_id").distinct())
    return bucketed(patients_of.select("patient_id").distinct()).join(hit.select("patient_bucket").distinct(), "patient_bucket", "left_semi").drop("patient_bucket")


def appended(df: DataFrame, path: str) -> None:
    """Rows added to an append-only table (audit, versions, feedback)."""
    df.write.mode("append").parquet(path)


def newest(rows: DataFrame, by: str, order: str, tie: str) -> DataFrame:
    """All rows with their ``place`` among those of their key, the newest first; keys may have any number of rows."""
    return numbered(rows, by, [order, tie], "place", descending=True)
