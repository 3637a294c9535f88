"""Report texts: classification, rule extraction, validation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import rules
from ..functions.norm import any_of
from ..rules import DIAGNOSIS_PREFIXES, GROUPED_NUMBER, INVOICE_WORDS, NUMBER, VITALS
from .lexicon import classification
from .ranges import cut


def with_types(reports: DataFrame) -> DataFrame:
    """Reports with ``document_type``; text goes through the lexicon once, in place."""
    return reports.withColumn("document_type", classification("text")["document_type"])


def checked_types(reports: DataFrame) -> DataFrame:
    """(``document_id``, ``document_type``, ``text``, ``patient_name``, ``dated``: it has two dates) of all reports, computed once.

    Only subtypes with rules for their lines keep the text.
    """
    rows = with_types(reports.select("document_id", "text"))
    ruled = F.col("document_type").isin("Prescription", *dict.fromkeys(m[0] for m in rules.REPORT_MARKERS), "HbA1c")
    dated = F.size(F.regexp_extract_all("text", F.lit(f"({rules.PLAIN_DATE})"), F.lit(1))) >= 2
    return cut(rows.select("document_id", "document_type", F.when(ruled, F.col("text")).alias("text"), patient_name(F.col("text")).alias("patient_name"), F.coalesce(dated, F.lit(False)).alias("dated")))


def classified(reports: DataFrame) -> DataFrame:
    """(``document_id``, ``document_type``, ``confidence``, ``n_matched``, ``matched_evidence``, ``explanation``, ``reason``, ``patient_name``, ``hospital_name``, ``doctor_name``).

    The best-scored subtype by ``lexicon.classify``, and the names that the text states. A null text is of type Other.
    """
    rows = reports.select("document_id", "text", classification("text").alias("c"))
    return rows.select("document_id", "c.*", patient_name(F.col("text")).alias("patient_name"), hospital_name(F.col("text")).alias("hospital_name"), doctor_name(F.col("text")).alias("doctor_name"))


def first_group(text: Column, *patterns: str) -> Column:
    """What the first pattern that the text meets has in its group; null if it meets none."""
    return F.coalesce(*(F.when(F.regexp_like(F.trim(text), F.lit(p)), F.regexp_extract(F.trim(text), p, 1)) for p in patterns))


def before_other_fields(name: Column) -> Column:
    return F.trim(F.get(F.split(F.trim(name), rules.NAME_ENDS), F.lit(0)))


def patient_name(text: Column) -> Column:
    """The name behind "patient name:", "patient:" or "name:", without what follows it and without a title."""
    found = F.regexp_extract(F.trim(text), r"(?i)(?:patient name|patient|name)\s*:\s*([^\n\r,;:\t]+)", 1)
    return F.nullif(F.trim(F.regexp_replace(before_other_fields(found), r"(?i)^(mr\.|ms\.|mrs\.)", "")), F.lit(""))


def hospital_name(text: Column) -> Column:
    """The name behind a label such as "hospital:", else the first line up to such a word."""
    return F.nullif(F.trim(first_group(text, "(?i)" + rules.HOSPITAL_LABEL, "(?im)" + rules.HOSPITAL_LINE)), F.lit(""))


def doctor_name(text: Column) -> Column:
    """The name behind a label such as "doctor:", else behind "Dr.", without what follows it."""
    return F.nullif(before_other_fields(first_group(text, "(?i)" + rules.DOCTOR_LABEL, "(?i)" + rules.DOCTOR_NAME)), F.lit(""))


def patient_names(reports: DataFrame) -> DataFrame:
    """(``document_id``, ``patient_name``), the names by ``patient_name``."""
    return reports.select("document_id", patient_name(F.col("text")).alias("patient_name"))


def document_names(reports: DataFrame) -> DataFrame:
    """(``document_id``, ``patient_name``, ``hospital_name``, ``doctor_name``) that the texts state."""
    text = F.col("text")
    return reports.select("document_id", patient_name(text).alias("patient_name"), hospital_name(text).alias("hospital_name"), doctor_name(text).alias("doctor_name"))


def lines(reports: DataFrame) -> DataFrame:
    return reports.select("document_id", "document_type", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def marker_values(reports: DataFrame) -> DataFrame:
    """Per document and marker of its subtype: value, unit and abnormal flag of the first line with a number.

    ``reports``: ``document_id``, ``document_type``, ``text``.
    """
    found = [
        F.when((F.col("document_type") == kind) & F.col("line").rlike(f"(?i){pattern}"), F.struct(F.lit(marker).alias("marker"), F.lit(unit).alias("unit"), F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high")))
        for kind, marker, pattern, unit, low, high in rules.REPORT_MARKERS
    ]
    asked = F.col("document_type").isin(list(dict.fromkeys(m[0] for m in rules.REPORT_MARKERS)))
    hits = lines(reports.where(asked)).select("document_id", "document_type", "line_no", "line", F.explode(F.array_compact(F.array(*found))).alias("m")).select("*", "m.*")
    number = F.when(F.col("document_type") == "CBC", F.regexp_replace(F.regexp_extract("line", GROUPED_NUMBER, 1), ",", "")).otherwise(F.regexp_extract("line", NUMBER, 1))
    hits = hits.withColumn("value", number).where("value <> ''")
    first = hits.withColumn("k", F.row_number().over(W.partitionBy("document_id", "marker").orderBy("line_no"))).where("k = 1")
    low = F.lower("line")
    unit = F.when(F.col("document_type") != "CBC", F.col("unit")).when(low.contains("g/dl"), "g/dL").when(low.contains("10^3") | low.contains("10-3"), "10^3/uL")
    unit = unit.when(low.contains("10^6") | low.contains("millions"), "10^6/uL").otherwise(F.col("unit"))
    x = F.col("value").cast("double")
    flag = F.coalesce(x < F.col("low"), F.lit(False)) | F.coalesce(x > F.col("high"), F.lit(False))
    return first.select("document_id", "marker", "value", unit.alias("unit"), flag.alias("abnormal_flag"))


def long_term_sugar(reports: DataFrame) -> DataFrame:
    """HbA1c of documents of that subtype: the first line with a number, the name's digits left out; abnormal from 5.7."""
    rows = lines(reports).where((F.col("document_type") == "HbA1c") & F.col("line").rlike("(?i)hba1c|glycated"))
    clean = F.regexp_replace(F.regexp_replace("line", "(?i)hba1c", ""), "(?i)1c", "")
    rows = rows.withColumn("value", F.regexp_extract(clean, NUMBER, 1)).where("value <> ''")
    first = rows.withColumn("k", F.row_number().over(W.partitionBy("document_id").orderBy("line_no"))).where("k = 1")
    return first.select("document_id", "value", (F.col("value").cast("double") >= 5.7).alias("abnormal_flag"))


def prescribed(reports: DataFrame) -> DataFrame:
    """Medicines of prescriptions: lines with a dosage form and a digit give a name (three characters or more), dosage, frequency."""
    rows = lines(reports).where((F.col("document_type") == "Prescription") & any_of(F.lower("line"), rules.DOSAGE_FORMS) & F.col("line").rlike(r"\d"))
    low = F.lower("line")
    dosage = F.trim(F.regexp_extract("line", rules.DOSE, 1))
    name = F.trim(F.get(F.split("line", rules.NAME_END), F.lit(0)))
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"(?i)^rx\b", ""), r"^[^\w\s]+", ""))
    often = F.when(low.contains("twice") | low.contains(" bd "), "Twice Daily").when(low.contains("thrice") | low.contains(" tid ") | low.contains("three times"), "Three Times Daily").otherwise("Once Daily")
    out = rows.select("document_id", "line_no", name.alias("medicine_name"), F.when(dosage == "", "1 tablet").otherwise(dosage).alias("dosage"), often.alias("frequency"))
    return out.where(F.length("medicine_name") >= 3)


def bill_totals(reports: DataFrame) -> DataFrame:
    """Total and tax of bills: the last line of each with a number."""
    rows = lines(reports).where(F.col("document_type") == "OP Bill").withColumn("x", F.regexp_extract("line", NUMBER, 1)).where("x <> ''")
    low = F.lower("line")
    total = F.when(low.contains("total") | low.contains("paid") | low.contains("net amount"), F.col("line_no"))
    tax = F.when(low.contains("gst") | low.contains("tax"), F.col("line_no"))
    return rows.groupBy("document_id").agg(F.coalesce(F.max_by("x", total), F.lit("0.00")).alias("total"), F.max_by("x", tax).alias("tax"))


def missing_markers(reports: DataFrame, values: DataFrame) -> DataFrame:
    """Documents whose subtype asks for markers that they lack: (``document_id``, ``marker``)."""
    asked = [("CBC", "HEMOGLOBIN"), ("CBC", "WBC"), ("CBC", "PLATELETS"), ("Lipid Profile", "Cholesterol Total"), ("Lipid Profile", "Triglycerides")]
    table = reports.sparkSession.createDataFrame(asked, "document_type string, marker string")
    want = reports.select("document_id", "document_type").join(F.broadcast(table), "document_type").select("document_id", "marker")
    return want.join(values.select("document_id", "marker"), ["document_id", "marker"], "left_anti")


UNITS = "|".join([*rules.UNIT_FORMS, *(re.escape(u) for u in dict.fromkeys(u.lower() for u in rules.PLAIN_UNITS))])
MEASURED = re.compile(rf"(\d+(?:[.,]\d+)?)\s*[.\-\s]*({UNITS})(?![a-zA-Z0-9])", re.I)
#: Characters between a name and its number, and those that end a name.
BETWEEN, ENDS = "|*-–—", "\n|;()"
VALUES = "document_id string, position int, test_name string, value string, unit string, status string"


def clean_lab_unit(unit: str) -> bool:
    return unit in rules.PLAIN_UNITS or bool(re.fullmatch(r"(?:x|10\^)?10\^\d+/(?:ul|cumm)", unit, re.I))


def stretch_before(text: str, start: int, end: int) -> str:
    """The nearest stretch before ``end`` without a character of ENDS, not before ``start``; what stands between may be of BETWEEN or white space."""
    while end > start and (text[end - 1] in BETWEEN or text[end - 1].isspace()):
        end -= 1
    begin = end
    while begin > start and text[begin - 1] not in ENDS:
        begin -= 1
    return text[begin:end].strip()


def named_values(text: str) -> list[tuple[str, str, str, str]]:
    """(name, value, unit, status) of numbers with units: the name stands before, up to a line end, bar, semicolon or bracket.

    Of equal names the first counts; names of over 60 characters keep their last four words.
    """
    out, seen, start = [], set(), 0
    for m in MEASURED.finditer(text):
        name = re.sub(r"[:\-\s*+/()]+\Z", "", re.sub(r"\A[*\-–—+\s:/()]+", "", stretch_before(text, start, m.start())))
        start = m.end()
        if len(name) > 60:
            name = " ".join(name.split()[-4:])
        key = " ".join(name.lower().split())
        if len(name) >= 3 and key not in seen:
            seen.add(key)
            out.append((name, m[1].replace(",", "."), m[2], "normalized" if clean_lab_unit(m[2]) else "needs_review"))
    return out


def lab_values(reports: DataFrame) -> DataFrame:
    """Lab values anywhere in the texts, in order."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(i, k, *v) for i, t in zip(pdf["document_id"], pdf["text"], strict=True) if t for k, v in enumerate(named_values(t))]
            yield pd.DataFrame(rows, columns=["document_id", "position", "test_name", "value", "unit", "status"])

    return reports.select("document_id", "text").mapInPandas(run, VALUES)


def note_lines(notes: DataFrame) -> DataFrame:
    return notes.select("document_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("low", F.lower("line"))


def vitals(notes: DataFrame) -> DataFrame:
    """Vital signs by line; the last line with a value counts. A temperature is in C if its line has any letter c."""
    found = []
    for kind, words, pattern, unit in VITALS:
        value = F.regexp_extract("line", f"({pattern})", 1)
        shown = F.concat(value, F.when(F.col("low").contains("c"), " °C").otherwise(" °F")) if kind == "temp" else F.concat(value, F.lit(unit))
        found.append(F.when(any_of(F.col("low"), words) & (value != ""), F.struct(F.lit(kind).alias("vital"), shown.alias("value"))))
    rows = note_lines(notes).select("document_id", "line_no", F.explode(F.array_compact(F.array(*found))).alias("v"))
    return rows.groupBy("document_id", F.col("v.vital").alias("vital")).agg(F.max_by("v.value", "line_no").alias("value"))


def stated_diagnoses(notes: DataFrame) -> DataFrame:
    """What stands behind a diagnosis prefix at the start of a line, if longer than two characters."""
    chain = F
    for p in DIAGNOSIS_PREFIXES:
        chain = chain.when(F.col("low").startswith(p), F.trim(F.expr(f"substring(line, {len(p) + 1})")))
    rows = note_lines(notes).withColumn("name", chain).where(F.length("name") > 2)
    return rows.select("document_id", "line_no", "name")


def invoiced(notes: DataFrame) -> DataFrame:
    """Medicines of invoice lines (with a batch, an expiry, or a quantity and a digit): name, batch, expiry."""
    rows = note_lines(notes)
    quantity = F.col("low").rlike(r"\bqty\b") | F.col("low").contains(" quantity ") | F.col("low").contains(" x ")
    rows = rows.where(F.col("low").rlike("batch|exp") | (quantity & F.col("line").rlike(r"\d")))
    words = F.filter(F.split(F.trim("line"), r"\s+"), lambda w: w.rlike("^[a-zA-Z]{4,}$") & ~F.lower(w).isin(INVOICE_WORDS))
    batch = F.nullif(F.regexp_extract("line", rules.BATCH, 1), F.lit(""))
    expiry = F.nullif(F.regexp_extract("line", rules.EXPIRY, 1), F.lit(""))
    out = rows.select("document_id", "line_no", F.array_join(words, " ").alias("medicine_name"), F.coalesce(batch, F.lit("N/A")).alias("batch"), F.coalesce(expiry, F.lit("N/A")).alias("expiry"))
    return out.where(F.length("medicine_name") >= 3)
