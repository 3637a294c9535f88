"""Complaint-driven history, chunk ranking, chunking of texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.norm import any_of
from .facts import active


def complaint_areas(sessions: DataFrame) -> DataFrame:
    """A flag for each body area that a complaint names."""
    text = F.lower(F.concat_ws(" ", "reason_category", F.coalesce("problem_location", F.lit("")), F.coalesce("description", F.lit(""))))
    flags = {area: any_of(text, words[0]) for area, words in rules.AREAS.items()}
    flags["accident"] = flags["accident"] | (F.col("reason_category") == "Accident / Injury")
    return sessions.select("session_id", "patient_id", *(f.alias(f"is_{a}") for a, f in flags.items()))


def relevant_history(sessions: DataFrame, diagnoses: DataFrame, medications: DataFrame, labs: DataFrame, procedures: DataFrame, as_of: str, records: DataFrame | None = None) -> DataFrame:
    """Facts that bear on each complaint, with the first ``reason`` that holds, in the order of the areas.

    With ``title``, ``date`` (the fact's own, else its record's of ``records``, else ``as_of``), ``details`` and where they stand: ``source_document_id``, ``source_page``, ``source_text``.
    """
    asked = complaint_areas(sessions)
    days = None if records is None else records.select("record_id", F.col("event_date").alias("recorded"))

    def shown(facts, kind, reason, title, own, details):
        """``facts``: joined to sessions."""
        facts = facts if days is None or "record_id" not in facts.columns else facts.join(days, "record_id", "left")
        have = lambda c, t: F.col(c).cast(t) if c in facts.columns else F.lit(None).cast(t)
        date = F.coalesce(have(own, "date"), have("recorded", "date"), F.lit(as_of).cast("date"))
        return facts.withColumn("reason", reason).where("reason is not null").select(
            "session_id", "patient_id", "id", F.lit(kind).alias("type"), "reason", title.alias("title"), date.alias("date"), details.alias("details"),
            have("source_document_id", "string").alias("source_document_id"), have("source_page", "int").alias("source_page"), have("source_text", "string").alias("source_text"),
        )

    def by_area(kind, text, k, more=None):
        chain = F
        for area, words in rules.AREAS.items():
            hit = any_of(text, words[k])
            if more is not None and area == "accident":
                hit = hit | more
            chain = chain.when(F.col(f"is_{area}") & hit, rules.RELEVANCE[kind, area])
        return chain

    noted = F.lower(F.concat_ws(" ", "name", F.coalesce("notes", F.lit(""))))
    said = lambda c, text: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(text))
    of = lambda facts: asked.join(facts, "patient_id")
    dx = shown(of(diagnoses), "diagnosis", by_area("diagnosis", noted, 1, F.coalesce("is_chronic", F.lit(False))), F.col("name"), "event_date", said("notes", rules.NO_NOTES))
    span = F.coalesce("reference_range", F.lit("N/A")) if "reference_range" in labs.columns else F.lit("N/A")
    found = F.concat(F.lit("Reference Range: "), span, F.lit(". "), F.when(F.coalesce("abnormal_flag", F.lit(False)), "Flagged ABNORMAL.").otherwise(""))
    result = F.concat("test_name", F.lit(": "), "value", F.lit(" "), F.coalesce("unit", F.lit("")))
    lab = shown(of(labs), "lab_result", by_area("lab_result", F.lower("test_name"), 2), result, "test_date", found)
    done = shown(of(procedures), "procedure", by_area("procedure", noted, 3), F.col("name"), "done_on", said("notes", rules.NO_PROCEDURE_NOTES))
    special = F.col("is_accident") & any_of(F.lower("medicine_name"), rules.ACCIDENT_DRUGS)
    reason = F.when(special, rules.RELEVANCE["medication", "accident"]).otherwise(rules.RELEVANCE["medication", ""])
    doses = F.concat(F.lit("Strength: "), said("strength", "N/A"), F.lit(", Dosage: "), said("dosage", "N/A"), F.lit(", Frequency: "), said("frequency", "N/A"))
    rx = shown(of(active(medications, as_of)), "medication", reason, F.col("medicine_name"), "start_date", doses)
    return reduce(DataFrame.unionByName, (dx, rx, lab, done))


def session_profiles(sessions: DataFrame, patients: DataFrame, labs: DataFrame) -> DataFrame:
    """(``session_id``, ``patient_id``, ``allergies``, ``blood_group``, ``blood_group_provenance``): what stands beside each session's relevant history.

    Allergies (names parted by bars) are the patient's own; a blood group is, too, unless a lab result of the patient names one.
    """
    named = F.lower("test_name").contains("blood group") | F.lower("test_name").contains("blood type")
    tested = labs.where(named).select("patient_id").distinct().withColumn("tested", F.lit(True))
    names = F.filter(F.transform(F.split(F.coalesce("allergies", F.lit("")), r"\|"), lambda a: F.trim(a)), lambda a: a != "")
    people = patients.select(
        F.col("id").alias("patient_id"), F.transform(names, lambda a: F.struct(a.alias("name"), F.lit("patient-entered").alias("provenance"))).alias("allergies"), F.nullif("blood_group", F.lit("")).alias("group")
    )
    rows = sessions.select("session_id", "patient_id").join(people, "patient_id", "left").join(tested, "patient_id", "left")
    provenance = F.when(F.col("group").isNull(), "unknown").when(F.col("tested"), "verified").otherwise("patient-entered")
    none = F.array().cast("array<struct<name:string,provenance:string>>")
    return rows.select("session_id", "patient_id", F.coalesce("allergies", none).alias("allergies"), F.coalesce("group", F.lit("Unknown")).alias("blood_group"), provenance.alias("blood_group_provenance"))


def packed_lines(text: str, most: int = 1000) -> list[str]:
    """Lines packed into chunks of at most ``most`` characters; a longer line is a chunk of its own."""
    out, now = [], ""
    for line in text.split("\n"):
        if len(now) + len(line) + 1 > most:
            if now.strip():
                out.append(now.strip())
            now = line
        else:
            now = f"{now}\n{line}" if now else line
    if now.strip():
        out.append(now.strip())
    return out


def text_chunks(documents: DataFrame, most: int = 1000) -> DataFrame:
    """(``document_id``, ``chunk``, ``chunk_text``) of every text (``chunk_text``, null: none)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(i, k, c) for i, t in zip(pdf["document_id"], pdf["chunk_text"], strict=True) if t for k, c in enumerate(packed_lines(t, most))]
            yield pd.DataFrame(rows, columns=["document_id", "chunk", "chunk_text"])

    return documents.select("document_id", "chunk_text").mapInPandas(run, "document_id long, chunk int, chunk_text string")


def paragraphs(documents: DataFrame) -> DataFrame:
    """Paragraphs (lines) of more than five characters and how long they are."""
    lines = documents.select("document_id", F.posexplode(F.split("chunk_text", "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.trim("line")).where(F.length("line") > 5)


def page_texts(documents: DataFrame) -> DataFrame:
    """Pages parted by form feeds, trimmed, with their numbers; only of texts with more than 50 visible characters."""
    full = documents.where(F.length(F.regexp_replace("chunk_text", r"\s", "")) > 50)
    pages = full.select("document_id", F.posexplode(F.split("chunk_text", "\f")).alias("k", "page_text"))
    return pages.select("document_id", (F.col("k") + 1).alias("page_number"), F.trim("page_text").alias("page_text")).where("page_text <> ''")
