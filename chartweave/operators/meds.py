"""Medication safety and switches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import rules
from ..functions.norm import any_of, canonical, stripped
from .folds import folded
from .labs import high_pressure


def duplicates(active: DataFrame, key: str = "exact") -> DataFrame:
    """Names that a patient takes more than once; ``key``: ``exact`` lower-case names, or ``canonical`` ones."""
    name = F.lower(stripped(F.col("medicine_name"))) if key == "exact" else F.lower(canonical(F.col("medicine_name"), "medication"))
    named = active.withColumn("name", name).where("name <> ''")
    return named.groupBy("patient_id", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def allergy_conflicts(active: DataFrame, patients: DataFrame) -> DataFrame:
    """Active medicines whose name contains an allergy, or the other way round."""
    allergies = patients.select(F.col("id").alias("patient_id"), F.explode(F.split("allergies", r"\|")).alias("allergy")).where(stripped(F.col("allergy")) != "")
    med, allergy = F.lower(F.coalesce("medicine_name", F.lit(""))), F.lower(stripped(F.col("allergy")))
    joined = active.join(allergies, "patient_id")
    return joined.where(med.contains(allergy) | allergy.contains(med)).select("patient_id", "id", "medicine_name", "allergy")


def interactions(active: DataFrame) -> DataFrame:
    """Rule pairs both of whose drugs a patient takes, with the first name for each."""
    rows = [(n, k, d, len(ds), text) for n, ds, text in rules.INTERACTIONS for k, d in enumerate(ds)]
    table = active.sparkSession.createDataFrame(rows, "rule int, k int, drug string, size int, message string")
    hits = active.join(F.broadcast(table), F.lower("medicine_name").contains(F.col("drug")))
    per = hits.groupBy("patient_id", "rule", "k", "size", "message").agg(F.min_by("medicine_name", "id").alias("name"))
    both = per.groupBy("patient_id", "rule", "size", "message").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("k", "name"))).alias("names"))
    return both.where("n = size").select("patient_id", "rule", "message", F.array_join("names.name", " + ").alias("names"))


def safety_alerts(active: DataFrame, patients: DataFrame) -> DataFrame:
    """Duplicates, allergy conflicts and interactions in one table."""
    one = duplicates(active).select("patient_id", F.lit("duplicate").alias("type"), F.lit("warning").alias("severity"), F.col("name").alias("items"))
    two = allergy_conflicts(active, patients).select("patient_id", F.lit("allergy_conflict").alias("type"), F.lit("critical").alias("severity"), F.concat_ws(" + ", "medicine_name", "allergy").alias("items"))
    three = interactions(active).select("patient_id", F.lit("drug_interaction").alias("type"), F.lit("critical").alias("severity"), F.col("names").alias("items"))
    return one.unionByName(two).unionByName(three)


def frequent_antibiotics(medications: DataFrame, least: int = 3) -> DataFrame:
    hit = medications.where(any_of(F.lower("medicine_name"), rules.ANTIBIOTICS))
    return hit.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


SWITCHES = "patient_id string, seq int, type string, medicine string, from_value string, to_value string, date date, reason string, evidence string, citations array<string>"


class Switches:
    """A patient's medications so far (``name``: ``strength``, ``dosage``, document), in the order in which they came; says what each new one changes."""

    def __init__(self, patient: object):
        self.patient, self.seq, self.taken = patient, 0, {}

    def said(self, *event) -> tuple:
        self.seq += 1
        return (self.patient, self.seq, *event)

    def row(self, patient, id_, name, strength, dosage, date, pressure, document) -> list[tuple]:
        out = []
        if name in self.taken:
            *old, before = self.taken[name]
            if old != [strength, dosage]:
                was, now = old[0] or old[1], strength or dosage
                evidence = rules.DOSE_EVIDENCE.format(was="null" if was is None else was, now="null" if now is None else now)
                out.append(self.said("Dose changed", name, was or "Previous Dose", now or "New Dose", date, None, evidence, [before, document]))
            self.taken[name] = (strength, dosage, document)
            return out
        if name.lower() in rules.ANTIHYPERTENSIVES:
            other = next((k for k in self.taken if k.lower() in rules.ANTIHYPERTENSIVES), None)
            if other is not None:
                reason = rules.PRESSURE_REASON if pressure else rules.OTHER_REASON
                out.append(self.said("Replacement", name, other, name, date, reason, rules.REPLACED_EVIDENCE.format(new=name, old=other, reason=reason), [self.taken.pop(other)[2], document]))
        self.taken[name] = (strength, dosage, document)
        return [*out, self.said("Started", name, None, None, date, None, rules.STARTED_EVIDENCE.format(new=name), [document])]

    def end(self) -> list[tuple]:
        return []


def switches(medications: DataFrame, labs: DataFrame) -> DataFrame:
    """Starts, dose changes and replacements of each patient, in order of start (else creation) date, then id, with evidence and the documents they stand in."""
    pressed = high_pressure(labs).withColumn("pressure", F.lit(True))
    date = F.coalesce("start_date", "created_on")
    document = F.col("source_document_id") if "source_document_id" in medications.columns else F.lit(None).cast("string")
    slim = medications.select("patient_id", "id", canonical(F.col("medicine_name"), "medication").alias("name"), "strength", "dosage", date.alias("date"), document.alias("document"))
    slim = slim.join(pressed, "patient_id", "left").withColumn("pressure", F.coalesce("pressure", F.lit(False)))
    slim = slim.select("patient_id", "id", "name", "strength", "dosage", "date", "pressure", "document")
    return folded(slim, "patient_id", ["date", "id"], Switches, SWITCHES)


def dose_changes(medications: DataFrame) -> DataFrame:
    """Rows of a canonical drug whose strength or dosage differs from those of the patient's row before."""
    name = canonical(F.col("medicine_name"), "medication")
    order = W.partitionBy("patient_id", "name").orderBy(F.coalesce("start_date", "created_on"), "id")
    rows = medications.withColumn("name", name).withColumns({"old": F.lag(F.struct("strength", "dosage")).over(order)})
    changed = F.col("old").isNotNull() & ~(F.col("old.strength").eqNullSafe(F.col("strength")) & F.col("old.dosage").eqNullSafe(F.col("dosage")))
    return rows.where(changed).select("patient_id", "id", "name", F.coalesce("old.strength", "old.dosage").alias("from_value"), F.coalesce("strength", "dosage").alias("to_value"))
