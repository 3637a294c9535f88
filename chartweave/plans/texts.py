"""Queries over letters and reports: types, headers, plain rules, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions.norm import like_any
from ..operators import letters, reports
from .queries import LINES, PRESCRIBED, SUGAR, VALUES, query

AS_OF = "2025-01-01"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


_w, _r = rules.PATTERN_WORDS, rules.RULE_WORDS
PATTERN_TYPES = f"""
, lo AS (SELECT document_id, category, text, lower(text) AS low FROM c_letters)
, f AS (SELECT *, {", ".join(f"{_any(ws)} AS {k}" for k, ws in _w.items())} FROM lo)
, pt AS (SELECT document_id, CASE WHEN discharge OR (contains(low, 'date of admission') AND contains(low, 'date of discharge')) THEN 'DISCHARGE_SUMMARY' WHEN billing AND totals AND medicines THEN 'PHARMACY_INVOICE'
  WHEN billing AND totals AND outpatient THEN 'OP_BILL_RECEIPT' WHEN regexp_matches(text, '{rules.PRESCRIBED}') AND NOT billing AND NOT totals THEN 'PRESCRIPTION'
  WHEN (regexp_matches(text, '{rules.LAB_NAMES}') OR (ranges AND units)) AND NOT totals THEN 'LAB_REPORT' ELSE 'NEEDS_REVIEW' END AS document_type FROM f)"""


@query("c2_pattern_types", "letters", PATTERN_TYPES + " SELECT *, CASE document_type WHEN 'NEEDS_REVIEW' THEN 0.5 WHEN 'OP_BILL_RECEIPT' THEN 0.9 WHEN 'PRESCRIPTION' THEN 0.9 ELSE 0.95 END::DOUBLE AS confidence FROM pt")
def pattern_types(l):
    return letters.pattern_types(l)


@query("c3_rule_types", "letters", f"""
, lo AS (SELECT document_id, coalesce(category, '') AS category, text, lower(text) AS low FROM c_letters)
, f AS (SELECT *, {", ".join(f"{_any(ws)} AS {k}" for k, ws in _r.items())}, upper(regexp_replace(category, '\\s+', '_', 'g')) AS up FROM lo)
, k AS (SELECT *, CASE WHEN billing AND pharmacy THEN 'PHARMACY_INVOICE' WHEN billing THEN 'OP_BILL_RECEIPT' WHEN results OR regexp_matches(text, '{rules.LAB_NAMES}') THEN 'LAB_REPORT' WHEN regexp_matches(text, '{rules.PRESCRIBED}') THEN 'PRESCRIPTION'
  WHEN discharge THEN 'DISCHARGE_SUMMARY' WHEN certificate THEN 'MEDICAL_CERTIFICATE' WHEN imaging THEN 'IMAGING_REPORT' WHEN vaccination THEN 'VACCINATION_RECORD' ELSE 'OTHER_MEDICAL_DOCUMENT' END AS kind FROM f)
SELECT document_id, CASE WHEN up IN ({", ".join(f"'{c}'" for c in rules.SET_CATEGORIES)}) THEN up ELSE kind END AS document_type,
  CASE WHEN category NOT IN ('', 'Auto Detect') THEN 1.0 WHEN kind = 'OP_BILL_RECEIPT' AND NOT outpatient THEN 0.8 WHEN kind IN ('PRESCRIPTION', 'VACCINATION_RECORD') THEN 0.9 WHEN kind = 'OTHER_MEDICAL_DOCUMENT' THEN 0.5 ELSE 0.95 END::DOUBLE AS confidence FROM k""")  # fmt: skip
def rule_types(l):
    return letters.rule_types(l)


LETTER_LINES = f"""
, l0 AS (SELECT document_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM c_letters)
, l1 AS (SELECT *, lower(line) AS low FROM (SELECT document_id, line_no, {_strip("raw")} AS line FROM l0) WHERE line <> '')"""
HEADERS = LETTER_LINES + rf"""
, h0 AS (SELECT *, CASE WHEN starts_with(low, 'patient name:') OR starts_with(low, 'name:') THEN nullif({_strip("split_part(line, ':', 2)")}, '') END AS n,
  CASE WHEN contains(low, 'age:') OR starts_with(low, 'age ') THEN nullif(regexp_extract(coalesce(nullif({_strip("string_split_regex(line, '(?i)age:')[2]")}, ''), regexp_replace(line, 'age', '', 'i')), '(\d+)', 1), '') END AS a,
  CASE WHEN contains(low, 'gender:') OR contains(low, 'sex:') THEN nullif({_strip("string_split_regex(line, '(?i)gender:|sex:')[2]")}, '') END AS g,
  CASE WHEN contains(low, 'mrn:') OR contains(low, 'patient id:') THEN nullif({_strip("string_split_regex(line, '(?i)mrn:|patient id:')[2]")}, '') END AS m,
  CASE WHEN starts_with(low, 'report title:') OR starts_with(low, 'title:') THEN nullif(split_part(line, ':', 2), '') END AS t FROM l1)
, h1 AS (SELECT document_id, arg_min({_strip("t")}, line_no) FILTER (t IS NOT NULL) AS title, arg_max(n, line_no) FILTER (n IS NOT NULL) AS patient_name, arg_max(a, line_no) FILTER (a IS NOT NULL) AS age,
  arg_max(CASE WHEN lower(g) LIKE 'm%' THEN 'Male' WHEN lower(g) LIKE 'f%' THEN 'Female' ELSE g END, line_no) FILTER (g IS NOT NULL) AS gender, arg_max(m, line_no) FILTER (m IS NOT NULL) AS record_number FROM h0 GROUP BY 1)
, hd AS (SELECT document_id, nullif(regexp_extract(text, '({rules.ANY_DATE})', 1), '') AS document_date, title, patient_name, age, gender, record_number FROM c_letters LEFT JOIN h1 USING (document_id))"""


@query("e9_headers", "letters", HEADERS + " SELECT * FROM hd")
def headers(l):
    return letters.headers(l)


@query("e10_visited", "letters", LETTER_LINES + f"""
, v AS (SELECT document_id, line_no, CASE WHEN {_any(rules.FACILITY_WORDS)} AND NOT contains(low, 'date:') AND length(line) < 50 THEN line END AS h,
  CASE WHEN {_any(rules.DOCTOR_WORDS)} THEN 'Dr. ' || CASE WHEN length(trim(regexp_extract(line, '{rules.LABELED_DOCTOR}', 1))) > 2 THEN regexp_replace(trim(regexp_extract(line, '{rules.LABELED_DOCTOR}', 1)), '^dr\\.?\\s+', '', 'i')
   WHEN length(trim(regexp_extract(line, '{rules.ANY_DOCTOR}', 1))) > 2 THEN trim(regexp_extract(line, '{rules.ANY_DOCTOR}', 1)) END END AS d FROM l1)
SELECT c.document_id, hospital, doctor FROM c_letters c LEFT JOIN (SELECT document_id, arg_max(h, line_no) FILTER (h IS NOT NULL) AS hospital, arg_max(d, line_no) FILTER (d IS NOT NULL) AS doctor FROM v GROUP BY 1) USING (document_id)""")  # fmt: skip
def visited(l):
    return letters.visited(l)


def _before_strength(words: int) -> str:
    cut = f"CASE WHEN strength <> '' THEN {_strip('substr(line, 1, strpos(lower(line), lower(strength)) - 1)')} ELSE array_to_string(string_split_regex(line, '\\s+')[1:{words}], ' ') END"
    return _strip(f"regexp_replace({cut}, '{rules.DRUG_FORM}', '')")


@query("e12_medication_lines", "letters", LETTER_LINES + f"""
, n AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY line_no) - 1 AS line_no, {_strip(f"regexp_replace(line, '{rules.DRUG_PREFIX}', '')")} AS line FROM l1)
, s AS (SELECT *, regexp_extract(line, '{rules.DRUG_STRENGTH}', 1) AS strength FROM n WHERE regexp_matches(line, '{rules.DRUG_LINE}') AND length(line) < 120)
SELECT document_id, line_no, medicine_name, nullif(strength, '') AS strength FROM (SELECT *, {_before_strength(3)} AS medicine_name FROM s) WHERE length(medicine_name) > 2""")  # fmt: skip
def medication_lines(l):
    return letters.medication_lines(l)


def _listed(kind: str, pattern: str, groups: list[int]) -> str:
    cells = ", ".join(f"unnest(regexp_extract_all(text, '{pattern}', {g})) AS g{g}" for g in groups)
    return f"SELECT document_id, {cells}, generate_subscripts(regexp_extract_all(text, '{pattern}', 1), 1) AS k FROM tx WHERE document_type = '{kind}'"


_nth = "row_number() OVER (PARTITION BY document_id ORDER BY k) - 1"


@query("e13_plain_facts", "letters", PATTERN_TYPES + f"""
, tx AS (SELECT document_id, text, document_type FROM c_letters JOIN pt USING (document_id))
, la AS (SELECT document_id, 'lab' AS kind, {_nth} AS position, {_strip("g1")} AS name, g2 AS value, coalesce(g3, '') AS unit FROM ({_listed("LAB_REPORT", rules.PLAIN_LAB, [1, 2, 3])}) WHERE length({_strip("g1")}) BETWEEN 6 AND 39 AND NOT {like_any("lower(g1)", rules.NOT_LABS)})
, so AS (SELECT document_id, 'medication' AS kind, {_nth} AS position, {_strip("g1")} AS name, NULL AS value, NULL AS unit FROM ({_listed("PHARMACY_INVOICE", rules.PLAIN_SOLD, [1])}) WHERE length({_strip("g1")}) BETWEEN 6 AND 49)
, l2 AS (SELECT document_id, {_strip("raw")} AS line, k FROM (SELECT document_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM tx WHERE document_type = 'PRESCRIPTION'))
, l3 AS (SELECT *, regexp_extract(line, '{rules.DRUG_STRENGTH}', 1) AS strength FROM l2 WHERE regexp_matches(line, '{rules.PLAIN_DRUG_LINE}') AND length(line) BETWEEN 4 AND 119)
, dr AS (SELECT document_id, 'medication' AS kind, {_nth} AS position, coalesce(nullif({_before_strength(4)}, ''), line) AS name, nullif(strength, '') AS value, NULL AS unit FROM l3)
, da AS (SELECT document_id, 'date' AS kind, k - 1 AS position, CASE k WHEN 1 THEN 'admission' ELSE 'discharge' END AS name, g1 AS value, NULL AS unit FROM (SELECT *, count(*) OVER (PARTITION BY document_id) AS n FROM ({_listed("DISCHARGE_SUMMARY", "(" + rules.PLAIN_DATE + ")", [1])})) WHERE n >= 2 AND k <= 2)
SELECT * FROM la WHERE position < 15 UNION ALL SELECT * FROM so WHERE position < 10 UNION ALL SELECT * FROM dr WHERE position < 10 UNION ALL SELECT * FROM da""")  # fmt: skip
def plain_facts(l):
    return letters.plain_facts(letters.spread(l))


@query("e14_extracted_facts", "reports")
def extracted(r):
    return letters.extracted(r)


GENERAL = HEADERS + PATTERN_TYPES.replace("lo AS", "lq AS").replace("FROM lo", "FROM lq") + rf"""
, g0 AS (SELECT hd.*, full_name, document_type, coalesce(try_strptime(document_date, '%Y-%m-%d'), try_strptime(document_date, '%m/%d/%Y'), try_strptime(document_date, '%d-%b-%Y'))::DATE AS on_day,
  regexp_replace(lower(patient_name), '[^a-z0-9]', '', 'g') AS x, regexp_replace(lower(full_name), '[^a-z0-9]', '', 'g') AS y FROM hd JOIN c_letters USING (document_id) JOIN pt USING (document_id) JOIN c_patients p ON p.id = c_letters.patient_id)
, ge AS (SELECT document_id, 'age' AS field, 'warning' AS severity FROM g0 WHERE TRY_CAST(age AS INT) > 120 UNION ALL SELECT document_id, 'documentDate', 'error' FROM g0 WHERE document_date IS NOT NULL AND (on_day IS NULL OR on_day > DATE '{AS_OF}')
  UNION ALL SELECT document_id, 'patientName', 'warning' FROM g0 WHERE patient_name <> '' AND full_name <> '' AND NOT contains(x, y) AND NOT contains(y, x))"""


def general(l, p):
    found = letters.headers(letters.with_pattern_types(letters.spread(l)), "patient_id", "document_type")
    return found.join(p.select(F.col("id").alias("patient_id"), "full_name"), "patient_id")


@query("d2_d3_general_errors", "letters patients", GENERAL + " SELECT * FROM ge")
def general_errors(l, p):
    return letters.general_errors(general(l, p), AS_OF)


@query("d4_final_states", "letters patients", GENERAL + " SELECT document_id, CASE WHEN document_type <> 'NEEDS_REVIEW' AND document_id NOT IN (SELECT document_id FROM ge WHERE severity = 'error') THEN 'completed' ELSE 'awaiting_review' END AS status FROM pt")
def final_states(l, p):
    return letters.final_status(letters.pattern_types(l), letters.general_errors(general(l, p), AS_OF))


TYPE_ERRORS = VALUES + SUGAR + PRESCRIBED + r"""
, lb AS (SELECT document_id, lower(marker) AS n, value FROM va UNION ALL SELECT document_id, 'hba1c', value FROM su)
, hs AS (SELECT document_id, bool_or(regexp_matches(n, 'haemoglobin|hemoglobin|hb')) AS hb, bool_or(regexp_matches(n, 'wbc|white blood')) AS wbc, bool_or(contains(n, 'platelet')) AS plt, bool_or(contains(n, 'cholesterol')) AS chol, bool_or(contains(n, 'trig')) AS trig,
   bool_or(contains(n, 'hba1c')) AS sugar, min(CASE WHEN contains(n, 'hba1c') AND NOT value::DOUBLE BETWEEN 2 AND 25 THEN value END) AS odd FROM lb GROUP BY 1)
, md AS (SELECT DISTINCT document_id FROM pr)
, pn AS (SELECT document_id, regexp_matches(text, '(?:patient name|patient|name)\s*:\s*[^\n\r,;:\t]+', 'i') AS named, len(regexp_extract_all(text, '\b\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\b')) >= 2 AS dated FROM c_reports)
, al AS (SELECT cl.document_id, document_type AS t, coalesce(hb, false) AS hb, coalesce(wbc, false) AS wbc, coalesce(plt, false) AS plt, coalesce(chol, false) AS chol, coalesce(trig, false) AS trig, coalesce(sugar, false) AS sugar, odd,
   md.document_id IS NOT NULL AS drugs, named, dated FROM cl JOIN pn USING (document_id) LEFT JOIN hs USING (document_id) LEFT JOIN md USING (document_id))
, er AS (""" + " UNION ALL ".join(f"SELECT document_id, '{field}' AS field, {text} AS error, '{severity}' AS severity FROM al WHERE t = '{kind}' AND {test}" for kind, field, severity, test, text in [
    *((kind, field, severity, test, f"'{rules.TYPE_ERRORS[field]}'") for kind, field, severity, test in [
        ("CBC", "labResults.hemoglobin", "error", "NOT hb"), ("CBC", "labResults.wbc", "error", "NOT wbc"), ("CBC", "labResults.platelets", "error", "NOT plt"),
        ("Prescription", "medications", "error", "NOT drugs"), ("Discharge Summary", "patientName", "warning", "NOT named"), ("Discharge Summary", "dates", "warning", "NOT dated"),
        ("Lipid Profile", "labResults.cholesterol", "error", "NOT chol"), ("Lipid Profile", "labResults.triglycerides", "error", "NOT trig"), ("HbA1c", "labResults.hba1c", "error", "NOT sugar"),
    ]),
    ("HbA1c", "labResults.hba1c.value", "error", "odd IS NOT NULL", "'" + rules.ODD_SUGAR.replace("%s%%", "' || odd || '%'")),
]) + f"""
  UNION ALL SELECT document_id, 'medications.' || coalesce(nullif(medicine_name, ''), 'item'), '{rules.SHORT_NAME}', 'error' FROM pr WHERE length(trim(medicine_name)) < 3
  UNION ALL SELECT document_id, 'medications.' || medicine_name[1:20], '{rules.LONG_NAME}', 'error' FROM pr WHERE length(medicine_name) > 100)"""


def checked(r):
    t = reports.checked_types(r)
    labs = reports.marker_values(t).select("document_id", F.col("marker").alias("test_name"), "value").unionByName(reports.long_term_sugar(t).select("document_id", F.lit("HbA1c").alias("test_name"), "value"))
    return t, letters.type_errors(t.drop("dated"), labs, reports.prescribed(t), t.where("dated"))


@query("d1_type_errors", "reports", TYPE_ERRORS + " SELECT * FROM er")
def type_errors(r):
    return checked(r)[1]


@query("d1_valid_documents", "reports", TYPE_ERRORS + " SELECT cl.document_id, count(*) FILTER (severity = 'error') = 0 AS is_valid, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings FROM cl LEFT JOIN er USING (document_id) GROUP BY 1")
def valid_documents(r):
    return letters.validity(*checked(r))


@query("d3_lab_sanity", "labs", r"""
, u AS (SELECT id, value, lower(regexp_replace(coalesce(unit, ''), '\s', '', 'g')) AS raw, lower(test_name) IN ('wbc count', 'platelet count', 'rbc count', 'wbc', 'rbc', 'platelets') AS counts FROM c_labs)
SELECT id, 'value' AS field, 'warning' AS severity FROM u WHERE TRY_CAST(regexp_extract(regexp_replace(value, '[^\d.]', '', 'g'), '^(\d+\.?\d*|\.\d+)', 1) AS DOUBLE) IS NULL UNION ALL
SELECT id, 'unit', 'warning' FROM u WHERE counts AND (regexp_matches(raw, '[^a-z0-9/^]') OR (regexp_matches(value, '^\s*\d+\.\d+\s*$') AND raw IN ('/ul', '/cumm', 'ul', 'cumm')))""")  # fmt: skip
def lab_sanity(l):
    return letters.lab_sanity(l)


@query("d3_ambiguous_dosages", "medications", f"SELECT id, frequency AS dosage FROM c_medications WHERE frequency <> '' AND NOT regexp_matches(frequency, '[0-9]') AND NOT {like_any('lower(frequency)', rules.DOSAGE_WORDS)}")
def ambiguous_dosages(m):
    return letters.ambiguous_dosages(m.select("id", F.col("frequency").alias("dosage")))


def lines_with_units(text: str) -> list[dict]:
    """An extractor as a caller may plug in: lines that state milligrams a decilitre."""
    return [{"line": line} for line in text.split("\n") if "mg/dl" in line.lower()]


@query("u0_plugged_extractor", "reports", "SELECT * FROM (SELECT document_id, unnest(string_split(text, chr(10))) AS line FROM c_reports) WHERE contains(lower(line), 'mg/dl')")
def plugged_extractor(r):
    return letters.plugged(r, lines_with_units, "line string")
