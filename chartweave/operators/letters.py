"""Document types, header fields and medication lines of letters, and checks of what was extracted.

All rules run on the row of a document: its text is split into lines once, and array functions pick from them,
so that no line leaves its row before it is a result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.norm import any_of, leading_number, same_identity, stripped
from .ranges import cut, free


def flags(text: Column, words: dict[str, list[str]]) -> dict[str, Column]:
    low = F.lower(text)
    return {k: any_of(low, ws) for k, ws in words.items()}


def spread(letters: DataFrame) -> DataFrame:
    """Letters dealt by their ids: rules cost far more than reading, so a file of few row groups would be few tasks' work."""
    return letters.repartition("document_id")


def with_pattern_types(letters: DataFrame) -> DataFrame:
    """Letters with ``document_type``: discharge, invoice, bill, prescription, laboratory, else for review."""
    (lower,) = free(letters, "low__")
    text, low = F.col("text"), F.col(lower)
    has = {k: any_of(low, ws) for k, ws in rules.PATTERN_WORDS.items()}
    discharge = has["discharge"] | (low.contains("date of admission") & low.contains("date of discharge"))
    laboratory = text.rlike(rules.LAB_NAMES) | (has["ranges"] & has["units"])
    kind = (
        F.when(discharge, "DISCHARGE_SUMMARY").when(has["billing"] & has["totals"] & has["medicines"], "PHARMACY_INVOICE")
        .when(has["billing"] & has["totals"] & has["outpatient"], "OP_BILL_RECEIPT").when(text.rlike(rules.PRESCRIBED) & ~has["billing"] & ~has["totals"], "PRESCRIPTION")
        .when(laboratory & ~has["totals"], "LAB_REPORT").otherwise("NEEDS_REVIEW")
    )
    return letters.withColumn(lower, F.lower("text")).withColumn("document_type", kind).drop(lower)


def pattern_types(letters: DataFrame) -> DataFrame:
    """(``document_id``, ``document_type``, ``confidence``) of ``with_pattern_types``."""
    kind = F.col("document_type")
    sure = F.when(kind == "NEEDS_REVIEW", 0.5).when(kind.isin("OP_BILL_RECEIPT", "PRESCRIPTION"), 0.9).otherwise(0.95)
    return with_pattern_types(letters).select("document_id", "document_type", sure.alias("confidence"))


def rule_types(letters: DataFrame) -> DataFrame:
    """As ``pattern_types`` by other rules, with nine types; a ``category`` that a user has set comes first (confidence 1)."""
    has, text = flags(F.col("text"), rules.RULE_WORDS), F.col("text")
    bill = has["billing"]
    kind = (
        F.when(bill & has["pharmacy"], "PHARMACY_INVOICE").when(bill, "OP_BILL_RECEIPT").when(text.rlike(rules.LAB_NAMES) | has["results"], "LAB_REPORT")
        .when(text.rlike(rules.PRESCRIBED), "PRESCRIPTION").when(has["discharge"], "DISCHARGE_SUMMARY").when(has["certificate"], "MEDICAL_CERTIFICATE")
        .when(has["imaging"], "IMAGING_REPORT").when(has["vaccination"], "VACCINATION_RECORD").otherwise("OTHER_MEDICAL_DOCUMENT")
    )
    sure = (
        F.when(bill & ~has["pharmacy"] & ~has["outpatient"], 0.8).when(kind.isin("PRESCRIPTION", "VACCINATION_RECORD"), 0.9)
        .when(kind == "OTHER_MEDICAL_DOCUMENT", 0.5).otherwise(0.95)
    )
    set_ = F.coalesce("category", F.lit(""))
    by_hand = ~set_.isin("", "Auto Detect")
    upper = F.regexp_replace(F.upper(set_), r"\s+", "_")
    kind = F.when(by_hand & upper.isin(rules.SET_CATEGORIES), upper).otherwise(kind)
    return letters.select("document_id", kind.alias("document_type"), F.when(by_hand, 1.0).otherwise(sure).alias("confidence"))


def line_array(text: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != "")


def last_of(lines: Column, value) -> Column:
    """The last value that is not null and not empty."""
    return F.get(F.reverse(F.filter(F.transform(lines, value), lambda v: v.isNotNull() & (v != ""))), F.lit(0))


def after_colon(line: Column) -> Column:
    return stripped(F.get(F.split(line, ":"), F.lit(1)))


def headers(letters: DataFrame, *kept: str) -> DataFrame:
    """Title, first date, patient name, age, gender and record number of each letter, with the columns ``kept``; the last line counts but for title and date."""
    (own,) = free(letters, "lines__")
    # a column, not an expression: each field would split the text anew
    letters, lines = letters.withColumn(own, line_array(F.col("text"))), F.col(own)
    low = F.lower
    titled = F.filter(lines, lambda x: (low(x).startswith("report title:") | low(x).startswith("title:")) & (F.coalesce(F.get(F.split(x, ":"), F.lit(1)), F.lit("")) != ""))
    name = last_of(lines, lambda x: F.when(low(x).startswith("patient name:") | low(x).startswith("name:"), after_colon(x)))

    def age(x):
        found = F.coalesce(F.nullif(stripped(F.get(F.split(x, "(?i)age:"), F.lit(1))), F.lit("")), stripped(F.regexp_replace(x, "(?i)^(.*?)age", "$1")))
        return F.when(low(x).contains("age:") | low(x).startswith("age "), F.regexp_extract(found, r"(\d+)", 1))

    def gender(x):
        said = stripped(F.get(F.split(x, "(?i)gender:|sex:"), F.lit(1)))
        shown = F.when(low(said).startswith("m"), "Male").when(low(said).startswith("f"), "Female").otherwise(said)
        return F.when(low(x).contains("gender:") | low(x).contains("sex:"), shown)

    def number(x):
        said = stripped(F.get(F.split(x, "(?i)mrn:|patient id:"), F.lit(1)))
        return F.when(low(x).contains("mrn:") | low(x).contains("patient id:"), said)

    return letters.select(
        "document_id", after_colon(F.get(titled, F.lit(0))).alias("title"), F.nullif(F.regexp_extract("text", f"({rules.ANY_DATE})", 1), F.lit("")).alias("document_date"),
        name.alias("patient_name"), last_of(lines, age).alias("age"), last_of(lines, gender).alias("gender"), last_of(lines, number).alias("record_number"), *kept,
    )


def visited(letters: DataFrame) -> DataFrame:
    """Hospital and doctor of each letter, the last line that names one."""
    lines = line_array(F.col("text"))

    def hospital(x):
        return F.when(any_of(F.lower(x), rules.FACILITY_WORDS) & ~F.lower(x).contains("date:") & (F.length(x) < 50), x)

    def doctor(x):
        labeled, plain = (stripped(F.regexp_extract(x, p, 1)) for p in (rules.LABELED_DOCTOR, rules.ANY_DOCTOR))
        named = F.when(F.length(labeled) > 2, F.regexp_replace(labeled, r"(?i)^dr\.?\s+", "")).when(F.length(plain) > 2, plain)
        return F.when(any_of(F.lower(x), rules.DOCTOR_WORDS), F.concat(F.lit("Dr. "), named))

    return letters.select("document_id", last_of(lines, hospital).alias("hospital"), last_of(lines, doctor).alias("doctor"))


def before_strength(line: Column, strength: Column, words: int) -> Column:
    """The part of a line before its strength, or its first words without one, without a dosage form in front."""
    cut = F.when(strength != "", stripped(F.substring(line, F.lit(1), F.instr(F.lower(line), F.lower(strength)) - 1))).otherwise(F.array_join(F.slice(F.split(line, r"\s+"), 1, words), " "))
    return stripped(F.regexp_replace(cut, rules.DRUG_FORM, ""))


def medication_lines(letters: DataFrame) -> DataFrame:
    """(``document_id``, ``line_no``, ``medicine_name``, ``strength``) of lines of fewer than 120 characters with a dosage word."""
    lines = letters.select("document_id", F.posexplode(line_array(F.col("text"))).alias("line_no", "raw"))
    lines = lines.withColumn("line", stripped(F.regexp_replace("raw", rules.DRUG_PREFIX, ""))).where(F.col("line").rlike(rules.DRUG_LINE) & (F.length("line") < 120))
    lines = lines.withColumn("strength", F.regexp_extract("line", rules.DRUG_STRENGTH, 1))
    out = lines.withColumn("medicine_name", before_strength(F.col("line"), F.col("strength"), 3))
    return out.where(F.length("medicine_name") > 2).select("document_id", "line_no", "medicine_name", F.nullif("strength", F.lit("")).alias("strength"))


def plain_facts(letters: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(``document_id``, ``kind``, ``position``, ``name``, ``value``, ``unit``) by the plain rules of a document's type: that of ``types``, else of ``pattern_types``.

    At most 15 results of laboratory reports and 10 medicines of a document count; of discharge summaries the first
    two dates, if there are two.
    """
    typed = with_pattern_types(letters) if types is None else letters.join(types.select("document_id", "document_type"), "document_id")
    every = lambda text, pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    fact = lambda name, value, unit: F.struct(name.alias("name"), value.alias("value"), unit.alias("unit"))
    none, text = F.lit(None).cast("string"), F.col("text")
    # the text is searched once, its matches are parted by themselves
    part = lambda m, group: F.regexp_extract(m, rules.PLAIN_LAB, group)
    labs = F.transform(every(text, rules.PLAIN_LAB, 0), lambda m: fact(stripped(part(m, 1)), part(m, 2), part(m, 3)))
    labs = F.slice(F.filter(labs, lambda f: (F.length(f["name"]) > 5) & (F.length(f["name"]) < 40) & ~any_of(F.lower(f["name"]), rules.NOT_LABS)), 1, 15)
    sold = F.filter(F.transform(every(text, rules.PLAIN_SOLD, 1), stripped), lambda n: (F.length(n) > 5) & (F.length(n) < 50))
    sold = F.slice(F.transform(sold, lambda n: fact(n, none, none)), 1, 10)

    def drug(line):
        strength = F.regexp_extract(line, rules.DRUG_STRENGTH, 1)
        name = before_strength(line, strength, 4)
        return fact(F.coalesce(F.nullif(name, F.lit("")), line), F.nullif(strength, F.lit("")), none)

    lines = F.filter(F.transform(F.split("text", "\n"), stripped), lambda x: x.rlike(rules.PLAIN_DRUG_LINE) & (F.length(x) > 3) & (F.length(x) < 120))
    taken = F.slice(F.transform(lines, drug), 1, 10)
    dates = F.regexp_extract_all("text", F.lit(f"({rules.PLAIN_DATE})"), F.lit(1))
    stay = F.when(F.size(dates) >= 2, F.array(fact(F.lit("admission"), F.get(dates, F.lit(0)), none), fact(F.lit("discharge"), F.get(dates, F.lit(1)), none)))
    kinds = [("LAB_REPORT", "lab", labs), ("PHARMACY_INVOICE", "medication", sold), ("PRESCRIPTION", "medication", taken), ("DISCHARGE_SUMMARY", "date", stay)]
    chosen = reduce(lambda chain, k: chain.when(F.col("document_type") == k[0], k[2]), kinds, F)
    kind = reduce(lambda chain, k: chain.when(F.col("document_type") == k[0], k[1]), kinds, F)
    rows = typed.select("document_id", kind.alias("kind"), F.posexplode(chosen).alias("position", "f"))
    return rows.select("document_id", "kind", "position", "f.name", "f.value", "f.unit")


#: Forms of dates that count as such.
DATE_FORMS = ["yyyy-MM-dd", "M/d/yyyy", "d-MMM-yyyy"]


def parsed_date(text: Column) -> Column:
    return F.coalesce(*(F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in DATE_FORMS))


def error(field: str, severity: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity")))


def general_errors(found: DataFrame, as_of: str) -> DataFrame:
    """(``document_id``, ``field``, ``severity``): ages over 120, dates that cannot be read or lie after ``as_of``, names that are not the patient's, no type.

    ``found``: ``document_id``, ``age``, ``document_date``, ``patient_name``, ``full_name``, ``document_type``.
    """
    date = parsed_date(F.col("document_date"))
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    other = said(F.col("patient_name")) & said(F.col("full_name")) & ~same_identity(F.col("patient_name"), F.col("full_name"))
    errors = F.array_compact(F.array(
        error("age", "warning", F.regexp_replace("age", r"\D", "").try_cast("int") > 120),
        error("documentDate", "error", said(F.col("document_date")) & (date.isNull() | (date > F.lit(as_of).cast("date")))),
        error("patientName", "warning", other),
        error("documentType", "error", F.coalesce("document_type", F.lit("")).isin("", "Auto Detect")),
    ))
    return found.select("document_id", F.explode(errors).alias("e")).select("document_id", "e.field", "e.severity")


def lab_sanity(labs: DataFrame) -> DataFrame:
    """(``id``, ``field``, ``severity``) of results without a number and of blood-count units that are doubtful."""
    from ..functions.norm import clean_unit, digits_number

    bad = clean_unit(F.col("test_name"), F.col("value"), F.col("unit"))["status"] == "needs_review"
    errors = F.array_compact(F.array(error("value", "warning", digits_number(F.col("value")).isNull()), error("unit", "warning", bad)))
    return labs.select("id", F.explode(errors).alias("e")).select("id", "e.field", "e.severity")


def ambiguous_dosages(medications: DataFrame) -> DataFrame:
    """Medications whose dosage has neither a digit nor a known word."""
    dosage = F.coalesce("dosage", F.lit(""))
    return medications.where((dosage != "") & ~dosage.rlike(r"\d") & ~any_of(F.lower(dosage), rules.DOSAGE_WORDS)).select("id", "dosage")


def type_errors(typed: DataFrame, labs: DataFrame, medications: DataFrame, stays: DataFrame) -> DataFrame:
    """(``document_id``, ``field``, ``error``, ``severity``): what a document of its subtype must hold and lacks, and medicine names that can't be.

    ``typed``: ``document_id``, ``document_type``, ``patient_name``; ``labs``: ``document_id``, ``test_name``, ``value``;
    ``medications``: ``document_id``, ``medicine_name``; ``stays``: ``document_id`` of documents with both dates.
    """
    name = F.lower("test_name")
    number = leading_number(F.col("value"))
    # by document: whether markers are there, and the smallest HbA1c value that can't be
    has = labs.groupBy("document_id").agg(
        F.bool_or(name.rlike("haemoglobin|hemoglobin|hb")).alias("hb"), F.bool_or(name.rlike("wbc|white blood")).alias("wbc"), F.bool_or(name.contains("platelet")).alias("plt"),
        F.bool_or(name.contains("cholesterol")).alias("chol"), F.bool_or(name.contains("trig")).alias("trig"), F.bool_or(name.contains("hba1c")).alias("sugar"),
        F.min(F.when(name.contains("hba1c") & (number.isNull() | (number < 2) | (number > 25)), F.coalesce("value", F.lit("null")))).alias("odd"),
    )
    drugs = medications.select("document_id").distinct().withColumn("drugs", F.lit(True))
    rows = typed.join(has, "document_id", "left").join(drugs, "document_id", "left").join(stays.select("document_id", F.lit(True).alias("dated")), "document_id", "left")
    is_ = lambda kind: F.col("document_type") == kind
    lacks = lambda c: ~F.coalesce(c, F.lit(False))

    def told(field: str, severity: str, hit: Column, text: Column | None = None) -> Column:
        return F.when(hit, F.struct(F.lit(field).alias("field"), (F.lit(rules.TYPE_ERRORS[field]) if text is None else text).alias("error"), F.lit(severity).alias("severity")))

    errors = F.array_compact(F.array(
        told("labResults.hemoglobin", "error", is_("CBC") & lacks("hb")), told("labResults.wbc", "error", is_("CBC") & lacks("wbc")), told("labResults.platelets", "error", is_("CBC") & lacks("plt")),
        told("medications", "error", is_("Prescription") & lacks("drugs")),
        told("patientName", "warning", is_("Discharge Summary") & (F.coalesce("patient_name", F.lit("")) == "")), told("dates", "warning", is_("Discharge Summary") & lacks("dated")),
        told("labResults.cholesterol", "error", is_("Lipid Profile") & lacks("chol")), told("labResults.triglycerides", "error", is_("Lipid Profile") & lacks("trig")),
        told("labResults.hba1c", "error", is_("HbA1c") & lacks("sugar")),
        told("labResults.hba1c.value", "error", is_("HbA1c") & F.col("odd").isNotNull(), F.format_string(rules.ODD_SUGAR, "odd")),
    ))
    found = rows.select("document_id", F.explode(errors).alias("e")).select("document_id", "e.*")
    # each medicine of a prescription by itself
    given = F.nullif("medicine_name", F.lit(""))
    taken = medications.join(typed.where(is_("Prescription")).select("document_id"), "document_id", "left_semi")
    short = F.length(F.coalesce(stripped(given), F.lit(""))) < 3
    each = F.array_compact(F.array(
        F.when(short, F.struct(F.concat(F.lit("medications."), F.coalesce(given, F.lit("item"))).alias("field"), F.lit(rules.SHORT_NAME).alias("error"))),
        F.when(F.length(given) > MOST_NAME, F.struct(F.concat(F.lit("medications."), F.substring(given, 1, 20)).alias("field"), F.lit(rules.LONG_NAME).alias("error"))),
    ))
    named = taken.select("document_id", F.explode(each).alias("e")).select("document_id", "e.field", "e.error", F.lit("error").alias("severity"))
    return found.unionByName(named)


#: The longest name of a medicine; a longer one is likely a stretch of the text.
MOST_NAME = 100


def valid_names(medications: DataFrame) -> DataFrame:
    """Medications with over-long names replaced, as they are stored."""
    name = F.col("medicine_name")
    return medications.withColumn("medicine_name", F.when(F.length(name) > MOST_NAME, rules.REPLACED_NAME).otherwise(name))


def validity(typed: DataFrame, errors: DataFrame) -> DataFrame:
    """(``document_id``, ``is_valid``, ``n_errors``, ``n_warnings``) of all documents."""
    count = lambda kind: F.count_if(F.col("severity") == kind)
    per = errors.groupBy("document_id").agg(count("error").alias("e"), count("warning").alias("w"))
    rows = typed.select("document_id").join(per, "document_id", "left").select("document_id", *(F.coalesce(c, F.lit(0)).alias(n) for c, n in (("e", "n_errors"), ("w", "n_warnings"))))
    return rows.withColumn("is_valid", F.col("n_errors") == 0)


def final_status(documents: DataFrame, errors: DataFrame) -> DataFrame:
    """``completed`` for documents (``document_id``, ``document_type``) of a sure type without an error, else ``awaiting_review``."""
    bad = errors.where("severity = 'error'").select("document_id").distinct().withColumn("bad", F.lit(True))
    rows = documents.join(bad, "document_id", "left")
    good = F.col("bad").isNull() & (F.col("document_type") != "NEEDS_REVIEW")
    return rows.select("document_id", F.when(good, "completed").otherwise("awaiting_review").alias("status"))


def extracted(reports: DataFrame) -> DataFrame:
    """(``document_id``, ``kind``, ``name``, ``value``): facts by the rules of a document's subtype, by general ones where it has none.

    ``reports``: ``document_id``, ``text``.
    """
    from . import reports as r

    typed = cut(r.with_types(reports.select("document_id", "text")))
    own = ["CBC", "LFT", "KFT", "Lipid Profile", "HbA1c", "Prescription", "OP Bill", "Pharmacy Invoice"]
    other = typed.where(~F.col("document_type").isin(own))
    say = lambda df, kind, name, value: df.select("document_id", F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"))
    tables = [
        say(r.marker_values(typed), "lab", F.col("marker"), F.concat_ws(" ", "value", "unit")), say(r.long_term_sugar(typed), "lab", F.lit("HbA1c"), F.concat("value", F.lit(" %"))),
        say(r.prescribed(typed), "medication", F.col("medicine_name"), F.col("dosage")), say(r.bill_totals(typed), "bill", F.lit("total"), F.col("total")),
        say(r.invoiced(typed.where("document_type = 'Pharmacy Invoice'")), "medication", F.col("medicine_name"), F.col("batch")),
        say(r.lab_values(other), "lab", F.col("test_name"), F.concat_ws(" ", "value", "unit")), say(r.vitals(other), "vital", F.col("vital"), F.col("value")),
        say(r.stated_diagnoses(other), "diagnosis", F.col("name"), F.lit(None).cast("string")), say(medication_lines(other), "medication", F.col("medicine_name"), F.col("strength")),
    ]
    return reduce(DataFrame.unionByName, tables)


def plugged(documents: DataFrame, extractor, schema: str) -> DataFrame:
    """A caller's own extractor: ``extractor(text)`` gives dicts of the fields of ``schema`` (DDL without ``document_id``) for each text.

    It runs in Arrow batches beside Spark's tasks; a null text gives nothing.
    """
    import pandas as pd

    def run(frames):
        for pdf in frames:
            rows = [{"document_id": i, **row} for i, t in zip(pdf["document_id"], pdf["text"], strict=True) if t is not None for row in extractor(t)]
            yield pd.DataFrame(rows, columns=names)

    kind = documents.schema["document_id"].dataType.simpleString()
    whole = f"document_id {kind}, {schema}"
    names = documents.sparkSession.createDataFrame([], whole).columns
    return documents.select("document_id", "text").mapInPandas(run, whole)
