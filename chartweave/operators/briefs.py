"""Triage sessions, doctor briefs, emergency medications, memory texts and what a document type shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import rules
from ..functions.norm import canonical, stripped
from .summaries import listed


def triage_rows(sessions: DataFrame) -> DataFrame:
    """Sessions with defaults, and whether reason, onset and severity are there (``is_valid``)."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return sessions.select(
        "session_id", "patient_id", "reason_category", "onset", "severity", F.coalesce("symptoms", F.lit("")).alias("symptoms"), F.coalesce("language", F.lit("en")).alias("language"),
        (given("reason_category") & given("onset") & given("severity")).alias("is_valid"),
    )


def shown_facts(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts (``kind``, ``source_document_id``) of the kinds that their document's type shows for review."""
    kind = F.regexp_replace(F.upper(F.coalesce(F.nullif("category", F.lit("")), "document_type", F.lit(""))), r"\s+", "_")
    rows = [(t, k) for k, ts in rules.SHOWN_KINDS.items() for t in ts]
    table = documents.sparkSession.createDataFrame(rows, "type string, kind string")
    shows = documents.select(F.col("id").alias("source_document_id"), kind.alias("type")).join(F.broadcast(table), "type")
    return facts.join(shows.select("source_document_id", "kind"), ["source_document_id", "kind"], "left_semi")


def first_results(labs: DataFrame) -> DataFrame:
    """The first result of each test name (in lower case) of a document."""
    name = F.lower("test_name")
    order = W.partitionBy("source_document_id", "name").orderBy("test_date", "id")
    return labs.withColumn("name", name).withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def is_clean_unit(unit: Column) -> Column:
    return F.coalesce(unit.isin(rules.PLAIN_UNITS) | unit.rlike(r"(?i)^(x|10\^)?10\^\d+/(ul|cumm)$"), F.lit(False))


def emergency_medications(manual: DataFrame, medications: DataFrame) -> DataFrame:
    """Manual medications (``patient_id``, ``name``) and verified active ones whose name, bare or with its strength, is not among them."""
    found = medications.select("patient_id", "medicine_name", "strength").distinct()
    whole = F.concat("medicine_name", F.coalesce(F.concat(F.lit(" "), "strength"), F.lit("")))
    named = found.withColumn("name", whole).withColumn("forms", F.array(F.lower("medicine_name"), F.lower(F.concat("medicine_name", F.lit(" "), F.coalesce("strength", F.lit(""))))))
    listed_ = manual.groupBy("patient_id").agg(F.collect_set(F.lower("name")).alias("known"))
    more = named.join(listed_, "patient_id", "left").where(~F.coalesce(F.arrays_overlap("known", "forms"), F.lit(False)))
    return manual.select("patient_id", "name", F.lit("patient-entered").alias("provenance")).unionByName(more.select("patient_id", "name", F.lit("document-verified").alias("provenance")))


def emergency_profiles(patients: DataFrame, config: DataFrame, groups: DataFrame, conditions: DataFrame, medications: DataFrame) -> DataFrame:
    """One row for each patient, as far as its configuration shows it: name, blood group, allergies, conditions and medications, each with where it comes from.

    ``config``: ``patient_id`` and flags ``show_<part>`` (a missing one shows); ``groups``: of ``facts.blood_groups``; ``conditions``, ``medications``:
    ``patient_id``, ``name``, ``provenance``. What patients entered comes first, then by name.
    """
    def shows(part: str) -> Column:
        return F.coalesce(F.col(f"show_{part}"), F.lit(True)) if f"show_{part}" in config.columns else F.lit(True)

    entry = "array<struct<value:string,provenance:string>>"

    def gathered(rows: DataFrame, name: str) -> DataFrame:
        order = F.struct((F.col("provenance") != "patient-entered").alias("later"), F.col("name"), F.struct(F.col("name").alias("value"), "provenance").alias("x"))
        return rows.groupBy("patient_id").agg(F.sort_array(F.collect_list(order))["x"].cast(entry).alias(name))

    rows = patients.withColumnRenamed("id", "patient_id").drop("blood_group").join(config, "patient_id", "left").join(groups, "patient_id", "left")
    rows = rows.join(gathered(conditions, "conditions"), "patient_id", "left").join(gathered(medications, "medications"), "patient_id", "left")
    both = F.format_string("%s (Manual) / %s (Lab)", "blood_group", "lab_value")
    value = F.when(F.col("provenance") == "conflict", both).otherwise(F.coalesce("lab_value", "blood_group", F.lit("Unknown")))
    message = F.when(F.col("provenance") == "conflict", rules.GROUP_CONFLICT)
    group = lambda v, p, m: F.struct(v.alias("value"), p.alias("provenance"), m.alias("message"))
    hidden = F.lit(rules.HIDDEN)
    allergies = F.filter(F.transform(F.split(F.coalesce("allergies", F.lit("")), r"\|"), stripped), lambda a: a != "")
    own = F.transform(allergies, lambda a: F.struct(a.alias("value"), F.lit("patient-entered").alias("provenance")))
    part = lambda c, name: F.when(shows(name), F.coalesce(c, F.array().cast(entry))).otherwise(F.array().cast(entry))
    return rows.select(
        "patient_id", F.when(shows("full_name"), F.col("full_name")).otherwise(hidden).alias("full_name"),
        F.when(shows("blood_group"), group(value, F.col("provenance"), message)).otherwise(group(hidden, F.lit("redacted"), F.lit(None).cast("string"))).alias("blood_group"),
        part(own, "allergies").alias("allergies"), part(F.col("conditions"), "conditions").alias("conditions"), part(F.col("medications"), "medications").alias("medications"),
    )


def memories(patients: DataFrame, diagnoses: DataFrame, medications: DataFrame) -> DataFrame:
    """A compact text for each patient: chronic and resolved conditions, long-term medications with strength, allergies."""
    name = canonical(F.col("name"), "diagnosis")
    resolved = F.lower("verification_status").contains("resolved")
    dx = diagnoses.groupBy("patient_id").agg(F.sort_array(F.collect_set(F.when(F.col("is_chronic"), name))).alias("conditions"), F.sort_array(F.collect_set(F.when(resolved, name))).alias("resolved"))
    lasting = F.col("end_date").isNull() | F.lower("duration").contains("ongoing") | F.lower("duration").contains("chronic")
    shown = F.concat(canonical(F.col("medicine_name"), "medication"), F.lit(" ("), F.coalesce("strength", F.lit("N/A")), F.lit(")"))
    rx = medications.where(lasting).groupBy("patient_id").agg(F.sort_array(F.collect_set(shown)).alias("medications"))
    none = F.array().cast("array<string>")
    out = patients.withColumnRenamed("id", "patient_id").join(dx, "patient_id", "left").join(rx, "patient_id", "left")
    allergies = F.filter(F.transform(F.split(F.coalesce("allergies", F.lit("")), r"\|"), stripped), lambda a: a != "")
    birth = F.col("date_of_birth").cast("string") if "date_of_birth" in patients.columns else F.lit(None).cast("string")
    head = ["[PATIENT COMPACT CLINICAL MEMORY]", F.concat(F.lit("Patient Name: "), F.coalesce("full_name", F.lit("Patient"))), F.concat(F.lit("Age/DOB: "), F.coalesce(birth, F.lit("N/A"))), F.concat(F.lit("Blood Group: "), F.coalesce("blood_group", F.lit("N/A")))]
    lists = [("Active Chronic Conditions:", F.coalesce("conditions", none)), ("Resolved Conditions:", F.coalesce("resolved", none)), ("Active Long-term Medications:", F.coalesce("medications", none)), ("Known Allergies:", allergies)]
    parts = [*head, *(x for title, items in lists for x in ("", title, listed(items)))]
    return out.select("patient_id", F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in parts)).alias("memory"))


def doctor_briefs(sessions: DataFrame, history: DataFrame, named: DataFrame | None, patients: DataFrame) -> DataFrame:
    """A brief for each valid session: summary, reason, history, medications, investigations, allergies, limits, and a snapshot of the facts it rests on.

    ``history``: of ``retrieval.relevant_history``; ``named``: ``id``, ``kind``, ``name`` of facts, else the history's titles are their names.
    """
    fact = F.struct("type", "id", "title", "date", "details", F.col("reason").alias("relevance"), F.col("source_document_id").alias("document_id"))
    of = lambda *kinds: F.array_join(F.sort_array(F.collect_list(F.when(F.col("type").isin(*kinds), F.struct("type", "id", "name"))))["name"], "; ")
    lists = (of("diagnosis", "procedure").alias("relevant_history"), of("medication").alias("current_medications"), of("lab_result").alias("relevant_investigations"))
    sources = F.sort_array(F.collect_list(fact)).alias("sources")
    if named is None:
        found = history.withColumn("name", F.col("title")).groupBy("session_id").agg(sources, *lists)
    else:
        titles = history.join(named.select("id", F.col("kind").alias("type"), "name"), ["id", "type"])
        found = history.groupBy("session_id").agg(sources).join(titles.groupBy("session_id").agg(*lists), "session_id", "left")
    rows = triage_rows(sessions).where("is_valid").join(found, "session_id", "left").join(patients.select(F.col("id").alias("patient_id"), "allergies"), "patient_id", "left")
    symptoms = F.coalesce(F.nullif(F.replace("symptoms", F.lit("|"), F.lit(", ")), F.lit("")), F.lit("no associated symptoms selected"))
    summary = F.format_string("Patient presents with self-reported %s starting %s (%s).", "reason_category", "onset", symptoms)
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    chosen = F.filter(F.split(F.coalesce("symptoms", F.lit("")), r"\|"), lambda x: x != "")
    reason = F.struct(F.col("reason_category").alias("category"), "onset", "severity", chosen.alias("symptoms"))
    none = F.array().cast(found.schema["sources"].dataType)
    return rows.select("session_id", summary.alias("patient_summary"), reason.alias("current_reason"), F.coalesce("sources", none).alias("sources"), "severity", *map(empty, ("relevant_history", "current_medications", "relevant_investigations", "allergies")), F.lit(rules.BRIEF_LIMITATIONS).alias("limitations"))
