"""Registered queries over the driver's tables, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions.norm import canonical, canonical_sql, clean_unit, leading_number, like_any, safe_file_name
from ..operators import facts, intake, labs, lexicon, meds, questions, reports, retrieval, summaries, timeline
from ..sources import schemas
from ..sources.adapters import table, with_tables
from ..streaming import admission

AS_OF = "2000-01-01"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, tables: str = "", sql: str = ""):
    """Register a function of clinical tables, in the order named."""
    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(table(spark, sf_dir, t) for t in tables.split()))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = with_tables(tables, sql)
        return f

    return keep


def shown_json(column: str):
    """A column as JSON with all its fields, as SQL's to_json gives it."""
    return F.to_json(column, {"ignoreNullFields": "false"})


SURE = "verification_status IN ('verified', 'corrected')"
NUMBER = r"TRY_CAST(regexp_extract(value, '^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)', 1) AS DOUBLE)"
DIGITS = r"TRY_CAST(regexp_extract(regexp_replace(value, '[^\d.]', '', 'g'), '^\s*((\d+\.?\d*|\.\d+))', 1) AS DOUBLE)"
ACTIVE = f"(end_date IS NULL OR end_date >= DATE '{AS_OF}')"
MARKERS = ", ".join(f"('{p}', '{m}')" for p, ms in rules.PANELS.items() for m in ms)
PANEL_SQL = f"""
, hits AS (SELECT l.*, m.panel, m.marker, {NUMBER} AS x FROM c_labs l JOIN (VALUES {MARKERS}) m(panel, marker) ON contains(lower(l.test_name), m.marker) WHERE {SURE})
, flagged AS (SELECT *, lag(abnormal_flag) OVER (PARTITION BY patient_id, panel, marker ORDER BY test_date, id) AS before,
    row_number() OVER (PARTITION BY patient_id, panel, marker ORDER BY test_date, id) AS up,
    row_number() OVER (PARTITION BY patient_id, panel, marker ORDER BY test_date DESC, id DESC) AS down FROM hits)
, g AS (SELECT patient_id, panel, marker, max(CASE WHEN down = 1 THEN value END) AS latest, max(CASE WHEN down = 1 THEN unit END) AS unit,
    max(CASE WHEN down = 1 THEN x END) AS lx, max(CASE WHEN up = 1 THEN x END) AS fx, max(CASE WHEN down = 1 THEN test_date END) AS ld, max(CASE WHEN up = 1 THEN test_date END) AS fd,
    max(x) AS highest, min(x) AS lowest, round(median(x), 6) AS median, bool_or(coalesce(abnormal_flag AND before, false)) AS persistent_abnormality, count(*) AS n_points,
    to_json(list(struct_pack("date" := test_date, "value" := value) ORDER BY test_date, id))::VARCHAR AS points FROM flagged GROUP BY 1, 2, 3 HAVING max(x) IS NOT NULL)
SELECT patient_id, panel, upper(marker) AS marker, latest, coalesce(unit, '') AS unit, highest, lowest, median,
    CASE WHEN n_points < 2 OR ld = fd THEN 0.0 ELSE round((lx - fx) / abs(date_diff('day', fd, ld)), 3) + 0.0 END AS change_per_day, persistent_abnormality, n_points, points FROM g"""


@query("a3_lab_panels", "labs", PANEL_SQL)
def lab_panels(l):
    return labs.panels(facts.verified(l)).withColumn("points", shown_json("points"))


ASKED = ", ".join(f"('{t}')" for t in rules.TREND_TESTS)


@query("a4_lab_trends", "labs", f"""
, hits AS (SELECT l.*, a.asked, {DIGITS} AS x FROM c_labs l JOIN (VALUES {ASKED}) a(asked) ON contains(lower(test_name), lower(asked)) OR contains(lower(asked), lower(test_name)) WHERE {SURE})
, p AS (SELECT *, row_number() OVER (PARTITION BY patient_id, asked ORDER BY test_date DESC, id DESC) AS k FROM hits WHERE x IS NOT NULL)
, g AS (SELECT patient_id, asked, max(CASE WHEN k = 1 THEN x END) AS latest_value, max(CASE WHEN k = 1 THEN coalesce(unit, '') END) AS latest_unit, max(CASE WHEN k = 2 THEN x END) AS prev, min(x) AS min_val, max(x) AS max_val, count(*) AS n_points,
    to_json(list(struct_pack("date" := test_date, "value" := x, unit := coalesce(unit, ''), is_abnormal := coalesce(abnormal_flag, false), reference_range := NULL::VARCHAR) ORDER BY test_date, id))::VARCHAR AS points FROM p GROUP BY 1, 2)
SELECT patient_id, asked, latest_value, latest_unit, points, CASE WHEN n_points < 2 THEN 'NONE' WHEN latest_value > prev THEN 'UPWARD' WHEN latest_value < prev THEN 'DOWNWARD' ELSE 'STABLE' END AS trend_direction, min_val, max_val, n_points FROM g""")  # fmt: skip
def lab_trends(l):
    return labs.trends(facts.verified(l)).withColumn("points", shown_json("points"))


@query("w1_progression_alerts", "labs", f"""
, t AS (SELECT *, {NUMBER} AS x, CASE WHEN contains(lower(test_name), 'hba1c') THEN 'hba1c' WHEN lower(test_name) IN ('hemoglobin', 'hb') THEN 'hemoglobin' END AS kind FROM c_labs WHERE {SURE})
, k AS (SELECT *, row_number() OVER (PARTITION BY patient_id, kind ORDER BY test_date, id) AS up, row_number() OVER (PARTITION BY patient_id, kind ORDER BY test_date DESC, id DESC) AS down FROM t WHERE kind IS NOT NULL)
, g AS (SELECT patient_id, kind, max(CASE WHEN up = 1 THEN x END) AS "first", max(CASE WHEN down = 1 THEN x END) AS "last", count(*) AS n FROM k GROUP BY 1, 2)
SELECT patient_id, CASE WHEN kind = 'hba1c' THEN 'Diabetes Progression Risk (Rising HbA1c)' ELSE 'Anemia Alert (Falling Hemoglobin)' END AS title,
    CASE WHEN (kind = 'hba1c' AND "last" >= 6.5) OR (kind = 'hemoglobin' AND "last" < 10) THEN 'critical' ELSE 'warning' END AS severity, "first", "last", n
FROM g WHERE n >= 2 AND ((kind = 'hba1c' AND "last" > "first") OR (kind = 'hemoglobin' AND "last" < "first" AND "last" < 12))""")  # fmt: skip
def progression_alerts(l):
    return labs.progressions(facts.verified(l))


@query("j16_high_pressure", "labs", f"SELECT DISTINCT patient_id FROM c_labs WHERE (contains(lower(test_name), 'bp') OR contains(lower(test_name), 'blood pressure')) AND {NUMBER} > 140")
def high_pressure(l):
    return labs.high_pressure(l)


@query("x2_lenient_numbers", "labs", f"SELECT id, value, {NUMBER} AS number FROM c_labs")
def lenient_numbers(l):
    return l.select("id", "value", leading_number(F.col("value")).alias("number"))


@query("x4_count_units", "labs", r"""
, u AS (SELECT id, value, unit, lower(regexp_replace(coalesce(unit, ''), '\s', '', 'g')) AS raw, lower(test_name) IN ('wbc', 'wbc count', 'rbc', 'rbc count', 'platelets', 'platelet count') AS counts FROM c_labs)
, b AS (SELECT *, counts AND (regexp_matches(raw, '[^a-z0-9/^]') OR (regexp_matches(value, '^\s*\d+\.\d+\s*$') AND raw IN ('/ul', '/cumm', 'ul', 'cumm'))) AS bad FROM u)
SELECT id, CASE WHEN NOT bad THEN value END AS normalized_value,
    CASE WHEN NOT bad THEN CASE WHEN NOT counts THEN unit WHEN contains(raw, '10^3') THEN '10^3/uL' WHEN contains(raw, '10^6') OR contains(raw, 'millions') THEN '10^6/uL' ELSE coalesce(unit, '') END END AS normalized_unit,
    CASE WHEN bad THEN 'needs_review' ELSE 'normalized' END AS status FROM b""")  # fmt: skip
def count_units(l):
    c = clean_unit(F.col("test_name"), F.col("value"), F.col("unit"))
    return l.select("id", c["value"].alias("normalized_value"), c["unit"].alias("normalized_unit"), c["status"].alias("status"))


@query("x1_canonical_names", "medications diagnoses", f"SELECT id, {canonical_sql('medicine_name', 'medication')} AS canonical FROM c_medications UNION ALL SELECT id, {canonical_sql('name', 'diagnosis')} AS canonical FROM c_diagnoses")
def canonical_names(m, d):
    return m.select("id", canonical(F.col("medicine_name"), "medication").alias("canonical")).unionByName(d.select("id", canonical(F.col("name"), "diagnosis").alias("canonical")))


@query("f3_active_medications", "medications", f"SELECT patient_id, id, medicine_name, end_date FROM c_medications WHERE {SURE} AND {ACTIVE}")
def active_medications(m):
    return facts.active(facts.verified(m), AS_OF).select("patient_id", "id", "medicine_name", "end_date")


DUPLICATES = f"SELECT patient_id, lower(trim(medicine_name)) AS name, count(*) AS n FROM c_medications WHERE {SURE} AND {ACTIVE} GROUP BY 1, 2 HAVING count(*) > 1"


@query("a1_duplicate_medications", "medications", DUPLICATES)
def duplicate_medications(m):
    return meds.duplicates(facts.active(facts.verified(m), AS_OF))


CONFLICTS = f"""SELECT m.patient_id, m.id, m.medicine_name, a.allergy FROM c_medications m JOIN (SELECT id, unnest(string_split(allergies, '|')) AS allergy FROM c_patients) a ON m.patient_id = a.id
WHERE {SURE} AND {ACTIVE} AND trim(a.allergy) <> '' AND (contains(lower(m.medicine_name), lower(trim(a.allergy))) OR contains(lower(trim(a.allergy)), lower(m.medicine_name)))"""


@query("j4_allergy_conflicts", "medications patients", CONFLICTS)
def allergy_conflicts(m, p):
    return meds.allergy_conflicts(facts.active(facts.verified(m), AS_OF), p)


PAIRS = ", ".join(f"({n}, {k}, '{d}', '{t}')" for n, ds, t in rules.INTERACTIONS for k, d in enumerate(ds))
INTERACTING = f""", h AS (SELECT m.patient_id, r.rule, r.k, r.message, first(medicine_name ORDER BY id) AS name FROM c_medications m JOIN (VALUES {PAIRS}) r(rule, k, drug, message) ON contains(lower(medicine_name), drug) WHERE {SURE} AND {ACTIVE} GROUP BY 1, 2, 3, 4)
, inter AS (SELECT patient_id, rule, message, string_agg(name, ' + ' ORDER BY k) AS names FROM h GROUP BY 1, 2, 3 HAVING count(*) = 2)"""


@query("j5_drug_interactions", "medications", INTERACTING + " SELECT * FROM inter")
def drug_interactions(m):
    return meds.interactions(facts.active(facts.verified(m), AS_OF))


@query("g6_safety_alerts", "medications patients", INTERACTING + f"""
SELECT patient_id, 'duplicate' AS type, 'warning' AS severity, name AS items FROM ({DUPLICATES}) UNION ALL
SELECT patient_id, 'allergy_conflict', 'critical', medicine_name || ' + ' || allergy FROM ({CONFLICTS}) UNION ALL SELECT patient_id, 'drug_interaction', 'critical', names FROM inter""")  # fmt: skip
def safety_alerts(m, p):
    return meds.safety_alerts(facts.active(facts.verified(m), AS_OF), p)


@query("a12_frequent_antibiotics", "medications", f"SELECT patient_id, count(*) AS n FROM c_medications WHERE {SURE} AND {like_any('lower(medicine_name)', rules.ANTIBIOTICS)} GROUP BY 1 HAVING count(*) >= 3")
def frequent_antibiotics(m):
    return meds.frequent_antibiotics(facts.verified(m))


@query("a12_hospitalisations", "documents", "SELECT patient_id, count(*) AS n FROM c_documents WHERE processing_status IN ('completed', 'awaiting_review') AND (lower(category) = 'discharge summary' OR contains(lower(file_name), 'discharge')) GROUP BY 1 HAVING count(*) >= 2")
def hospitalisations(d):
    stay = (F.lower("category") == "discharge summary") | F.lower("file_name").contains("discharge")
    return d.where(F.col("processing_status").isin("completed", "awaiting_review") & stay).groupBy("patient_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("f11_chronic_diagnoses", "diagnoses", f"SELECT id, name FROM c_diagnoses WHERE is_chronic OR {like_any('lower(name)', rules.CHRONIC_WORDS)}")
def chronic_diagnoses(d):
    return d.where(facts.chronic(F.col("name"), F.col("is_chronic"))).select("id", "name")


@query("f12_long_term_medications", "medications", f"SELECT id, medicine_name FROM c_medications WHERE {like_any('lower(coalesce(duration, $$))'.replace('$$', chr(39) * 2), rules.LONG_TERM_DURATIONS)} OR {like_any('lower(medicine_name)', rules.LONG_TERM_DRUGS)}")
def long_term_medications(m):
    return m.where(facts.long_term(F.col("medicine_name"), F.col("duration"))).select("id", "medicine_name")


@query("f2_owned_documents", "documents patients", "SELECT id, patient_id FROM c_documents WHERE patient_id IN (SELECT id FROM c_patients WHERE user_id = 'u3')")
def owned_documents(d, p):
    return facts.owned(d, p, "u3").select("id", "patient_id")


_place = "CASE WHEN is_deleted THEN 'trash/' ELSE 'patients/' END || patient_id || '/documents/' || id || '/' || file_name"


@query("f2_owned_files", "documents patients", f"SELECT id, storage_path FROM (SELECT *, {_place} AS storage_path FROM c_documents) WHERE split_part(storage_path, '/', 1) = 'patients' AND split_part(storage_path, '/', 2) IN (SELECT id FROM c_patients WHERE user_id = 'u3')")
def owned_files(d, p):
    return facts.owned_paths(d.withColumn("storage_path", F.expr(_place)), p, "u3").select("id", "storage_path")


@query("s3_safe_file_names", "documents", "SELECT id, regexp_replace(file_name, '[^a-zA-Z0-9._-]', '_', 'g') AS safe_name FROM c_documents WHERE NOT is_deleted")
def safe_names(d):
    return d.where("not is_deleted").select("id", safe_file_name(F.col("file_name")).alias("safe_name"))


@query("j7_duplicate_documents", "documents", "SELECT id, CASE WHEN first(id) OVER w <> id THEN first(id) OVER w END AS existing_id FROM c_documents WHERE NOT is_deleted WINDOW w AS (PARTITION BY patient_id, sha256_hash ORDER BY created_on, id)")
def duplicate_documents(d):
    return facts.unduplicated(d).select("id", "existing_id")


@query("j8_reprocessed_diagnoses", "diagnoses", "SELECT n.id FROM c_diagnoses n WHERE n.verification_status = 'pending_review' AND NOT EXISTS (SELECT 1 FROM c_diagnoses o WHERE o.verification_status = 'verified' AND o.source_document_id = n.source_document_id AND o.name = n.name)")
def reprocessed(d):
    return facts.not_yet_verified(d.where("verification_status = 'pending_review'"), d).select("id")


@query("j9_document_delete", "labs documents", "SELECT id FROM c_labs WHERE source_document_id NOT IN (SELECT id FROM c_documents WHERE is_deleted)")
def document_delete(l, d):
    return facts.without(l, d.where("is_deleted").select(F.col("id").alias("source_document_id")), "source_document_id").select("id")


@query("j10_account_delete", "medications patients", "SELECT id FROM c_medications WHERE patient_id NOT IN (SELECT id FROM c_patients WHERE user_id = 'u7')")
def account_delete(m, p):
    return facts.without(m, p.where("user_id = 'u7'").select(F.col("id").alias("patient_id")), "patient_id").select("id")


@query("w13_latest_reviews", "reviews", """
SELECT record_id, field_name, action, CASE action WHEN 'confirm' THEN 'verified' WHEN 'reject' THEN 'rejected' WHEN 'unreadable' THEN 'unreadable' ELSE 'corrected' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY record_id, field_name ORDER BY ts DESC, id DESC) AS k FROM c_reviews) WHERE k = 1""")  # fmt: skip
def latest_reviews(r):
    return facts.latest_actions(r).select("record_id", "field_name", "action", "status")


@query("w14_current_jobs", "documents jobs", """
SELECT d.id, coalesce(j.status, d.processing_status) AS status, coalesce(j.n, 0) AS attempts FROM c_documents d LEFT JOIN
(SELECT document_id, arg_max(status, ts) AS status, count(*) AS n FROM c_jobs GROUP BY 1) j ON d.id = j.document_id""")  # fmt: skip
def current_jobs(d, j):
    return facts.current_jobs(d, j)


@query("w6_next_versions", "versions", "SELECT document_id, event_id, row_number() OVER (PARTITION BY document_id ORDER BY ts, event_id) + 1 AS version_number FROM c_versions")
def next_versions(v):
    return facts.next_versions(v).select("document_id", "event_id", "version_number")


ALL_FACTS = "SELECT source_document_id, 'diagnosis' AS kind, verification_status FROM c_diagnoses UNION ALL SELECT source_document_id, 'medication', verification_status FROM c_medications UNION ALL SELECT source_document_id, 'lab', verification_status FROM c_labs UNION ALL SELECT source_document_id, 'procedure', verification_status FROM c_procedures"
KINDS = ["diagnosis", "medication", "lab", "procedure"]


@query("a6_document_counts", "documents diagnoses medications labs procedures", f"""
, f AS ({ALL_FACTS}), g AS (SELECT source_document_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)} FROM f GROUP BY 1)
SELECT d.id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)} FROM c_documents d LEFT JOIN g ON d.id = g.source_document_id""")  # fmt: skip
def document_counts(d, x, m, l, p):
    return facts.document_counts(d, facts.fact_union(diagnosis=x, medication=m, lab=l, procedure=p), KINDS)


@query("a7_mean_confidence", "documents diagnoses medications labs procedures", f"""
, f AS (SELECT source_document_id, CASE verification_status WHEN 'verified' THEN 0.95 WHEN 'corrected' THEN 0.8 ELSE 0.5 END AS confidence FROM ({ALL_FACTS})), g AS (SELECT source_document_id, avg(confidence) AS mean FROM f GROUP BY 1)
SELECT id, mean, CASE WHEN mean >= 0.9 THEN 'HIGH' WHEN mean >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM (SELECT d.id, round(coalesce(g.mean, 1.0), 6) AS mean FROM c_documents d LEFT JOIN g ON d.id = g.source_document_id)""")  # fmt: skip
def mean_confidence(d, x, m, l, p):
    rows = facts.fact_union(diagnosis=x, medication=m, lab=l, procedure=p)
    status = F.col("verification_status")
    return facts.mean_confidence(d, rows.withColumn("confidence", F.when(status == "verified", 0.95).when(status == "corrected", 0.8).otherwise(0.5)))


_allergic = """replace(payload, '"procedures": [', '"allergies": ["Dust ", {"value": " Pollen"}, {"value": null}, {"value": 3}, 4, ""], "procedures": [')"""


@query("a2_profile_sync", "patients diagnoses medications full_payloads", f"""
, dx AS (SELECT patient_id, string_agg(DISTINCT trim(name), ';' ORDER BY trim(name)) AS s FROM c_diagnoses WHERE {SURE} AND (is_chronic OR {like_any('lower(name)', rules.CHRONIC_WORDS)}) GROUP BY 1)
, rx AS (SELECT patient_id, string_agg(DISTINCT trim(medicine_name), ';' ORDER BY trim(medicine_name)) AS s FROM c_medications WHERE {SURE} AND ({like_any("lower(coalesce(duration, ''))", rules.LONG_TERM_DURATIONS)} OR {like_any('lower(medicine_name)', rules.LONG_TERM_DRUGS)}) GROUP BY 1)
, al AS (SELECT id, string_agg(a, ';' ORDER BY a) AS s FROM (SELECT id, trim(unnest(string_split(allergies, '|'))) AS a FROM c_patients UNION SELECT document_id::VARCHAR, unnest(['Dust', 'Pollen']) FROM c_full_payloads WHERE json_valid(payload) AND contains(payload, '"procedures": [')) WHERE a <> '' GROUP BY 1)
SELECT p.id AS patient_id, coalesce(dx.s, '') AS conditions, coalesce(rx.s, '') AS medications, coalesce(al.s, '') AS allergies FROM c_patients p LEFT JOIN dx ON p.id = dx.patient_id LEFT JOIN rx ON p.id = rx.patient_id LEFT JOIN al ON p.id = al.id""")  # fmt: skip
def profile_sync(p, d, m, read):
    read = read.select(F.col("document_id").cast("string").alias("patient_id"), F.expr(_allergic).alias("payload"))
    out = facts.profiles(p, facts.verified(d), facts.verified(m), read)
    return out.select("patient_id", *(F.array_join(c, ";").alias(c) for c in ("conditions", "medications", "allergies")))


BLOOD_GROUP_SQL = """
, s AS (SELECT patient_id, arg_min(value, id) AS lab_value FROM c_labs WHERE verification_status = 'verified' AND (contains(lower(test_name), 'blood type') OR contains(lower(test_name), 'abo') OR contains(lower(test_name), 'blood group')) GROUP BY 1)
SELECT p.id AS patient_id, blood_group, lab_value, CASE WHEN lab_value IS NOT NULL AND blood_group IS NOT NULL AND lower(trim(blood_group)) <> lower(trim(lab_value)) THEN 'conflict' WHEN lab_value IS NOT NULL THEN 'document-verified' WHEN blood_group IS NOT NULL THEN 'patient-entered' ELSE 'unknown' END AS provenance FROM c_patients p LEFT JOIN s ON p.id = s.patient_id"""


@query("j13_blood_groups", "patients labs", BLOOD_GROUP_SQL)
def blood_groups(p, l):
    return facts.blood_groups(p, l)


TIMELINE = """
, e AS (SELECT id, patient_id, record_id, source_document_id, 'Diagnosis' AS event_type, 'Diagnosed with ' || name AS title, coalesce(notes, 'Diagnosis verified.') AS summary, verification_status AS s FROM c_diagnoses UNION ALL
  SELECT id, patient_id, record_id, source_document_id, 'Medication Start', 'Started Medication: ' || medicine_name, 'Dosage: ' || coalesce(dosage, '') || ' ' || coalesce(strength, '') || '. Frequency: ' || coalesce(frequency, '') || '. Duration: ' || coalesce(duration, '') || '.', verification_status FROM c_medications UNION ALL
  SELECT id, patient_id, record_id, source_document_id, 'Lab Test', 'Lab Result: ' || test_name, 'Result: ' || value || ' ' || coalesce(unit, '') || CASE WHEN abnormal_flag THEN '. Flagged as ABNORMAL.' ELSE '.' END, verification_status FROM c_labs UNION ALL
  SELECT id, patient_id, record_id, source_document_id, 'Procedure', 'Procedure: ' || name, coalesce(notes, 'Procedure verified.'), verification_status FROM c_procedures)
, t AS (SELECT e.source_document_id, e.id, e.patient_id, e.event_type, e.title, e.summary, r.event_date FROM e JOIN c_records r USING (record_id) WHERE s = 'verified'
  AND e.source_document_id NOT IN (SELECT id FROM c_documents WHERE upper(coalesce(document_type, category)) IN ('PHARMACY_INVOICE', 'OP_BILL_RECEIPT')))"""
TIMELINE_TABLES = "records documents diagnoses medications labs procedures"


@query("g1_timeline_events", TIMELINE_TABLES, TIMELINE + " SELECT * FROM t")
def timeline_events(*tables):
    return timeline.events(*tables)


@query("t2_recent_events", TIMELINE_TABLES, TIMELINE + " SELECT patient_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY event_date DESC, id DESC) AS place FROM t) WHERE place <= 4")
def recent_events(*tables):
    return timeline.recent(timeline.events(*tables)).select("patient_id", "id", "place")


@query("a13_timeline_by_year", TIMELINE_TABLES, TIMELINE + " SELECT patient_id, year(event_date) AS year, event_type, count(*) AS n FROM t GROUP BY 1, 2, 3")
def timeline_by_year(*tables):
    return timeline.by_year(timeline.events(*tables))


@query("f5_timeline_search", TIMELINE_TABLES, TIMELINE + " SELECT id, title FROM t WHERE (contains(lower(title), 'metformin') OR contains(lower(summary), 'metformin')) AND starts_with(event_type, 'Medication')")
def timeline_search(*tables):
    return timeline.search(timeline.events(*tables), "Metformin", "Medications").select("id", "title")


@query("f5_place_search", TIMELINE_TABLES, TIMELINE + " SELECT t.id, hospital FROM t JOIN c_documents d ON d.id = t.source_document_id WHERE contains(lower(title), 'lake') OR contains(lower(summary), 'lake') OR contains(lower(hospital), 'lake') OR contains(lower(doctor), 'lake')")
def place_search(r, d, *kinds):
    places = d.select(F.col("id").alias("source_document_id"), "hospital", "doctor")
    return timeline.search(timeline.events(r, d, *kinds).join(places, "source_document_id"), "Lake").select("id", "hospital")


JOURNEY_SQL = f"""
, s AS (SELECT patient_id, id, created_on, coalesce(notes, '') AS notes, source_document_id, {canonical_sql("name", "diagnosis")} AS canonical, CASE WHEN contains(lower(coalesce(notes, '')), 'worsening') OR contains(lower(coalesce(notes, '')), 'progression') THEN 'Progressing'
  WHEN contains(lower(coalesce(notes, '')), 'improving') OR contains(lower(coalesce(notes, '')), 'resolved') THEN 'Resolved' WHEN is_chronic THEN 'Chronic (Stable)' WHEN verification_status = 'verified' THEN 'Confirmed' ELSE 'Confirmed (Corrected)' END AS status FROM c_diagnoses WHERE {SURE})
SELECT patient_id, canonical, last(status ORDER BY created_on, id) AS status, count(*) AS milestones, string_agg(status, ' > ' ORDER BY created_on, id) AS path,
  to_json(list(struct_pack("date" := created_on, status := status, notes := notes, document_id := source_document_id) ORDER BY created_on, id))::VARCHAR AS timeline FROM s GROUP BY 1, 2"""


@query("w8_disease_journeys", "diagnoses", JOURNEY_SQL)
def disease_journeys(d):
    return timeline.journeys(facts.verified(d)).withColumn("timeline", shown_json("timeline"))


def _history_sql() -> str:
    text = "lower(reason_category || ' ' || coalesce(problem_location, '') || ' ' || coalesce(description, ''))"
    flags = ", ".join(f"{like_any(text, w[0])}{' OR reason_category = $Accident / Injury$' if a == 'accident' else ''} AS is_{a}".replace("$", "'") for a, w in rules.AREAS.items())
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    source = "source_document_id, NULL::INT AS source_page, NULL::VARCHAR AS source_text"
    records = "LEFT JOIN c_records r USING (record_id)"
    said = lambda c, text: f"coalesce(nullif({c}, ''), '{text}')"

    def part(table, kind, expr, k, title, own, details, more=""):
        cases = " ".join(f"WHEN is_{a} AND ({like_any(expr, w[k])}{more if a == 'accident' else ''}) THEN {quoted(rules.RELEVANCE[kind, a])}" for a, w in rules.AREAS.items())
        return f"SELECT * FROM (SELECT a.session_id, a.patient_id, f.id, '{kind}' AS type, CASE {cases} END AS reason, {title} AS title, coalesce({own}, r.event_date, DATE '{AS_OF}') AS \"date\", {details} AS details, {source} FROM asked a JOIN {table} f ON a.patient_id = f.patient_id {records} WHERE {SURE}) WHERE reason IS NOT NULL"

    noted = "lower(name || ' ' || coalesce(notes, ''))"
    drugs = f"SELECT a.session_id, a.patient_id, f.id, 'medication', CASE WHEN is_accident AND {like_any('lower(medicine_name)', rules.ACCIDENT_DRUGS)} THEN {quoted(rules.RELEVANCE['medication', 'accident'])} ELSE {quoted(rules.RELEVANCE['medication', ''])} END, medicine_name, coalesce(start_date, r.event_date, DATE '{AS_OF}'), 'Strength: ' || {said('strength', 'N/A')} || ', Dosage: ' || {said('dosage', 'N/A')} || ', Frequency: ' || {said('frequency', 'N/A')}, {source} FROM asked a JOIN c_medications f ON a.patient_id = f.patient_id {records} WHERE {SURE} AND {ACTIVE}"
    return f", asked AS (SELECT session_id, patient_id, {flags} FROM c_sessions) " + " UNION ALL ".join([
        part("c_diagnoses", "diagnosis", noted, 1, "name", "NULL::DATE", said("notes", rules.NO_NOTES), " OR is_chronic"), drugs,
        part("c_labs", "lab_result", "lower(test_name)", 2, "test_name || ': ' || value || ' ' || coalesce(unit, '')", "test_date", "'Reference Range: N/A. ' || CASE WHEN abnormal_flag THEN 'Flagged ABNORMAL.' ELSE '' END"),
        part("c_procedures", "procedure", noted, 3, "name", "done_on", said("notes", rules.NO_PROCEDURE_NOTES)),
    ])


@query("j14_relevant_history", "sessions diagnoses medications labs procedures records", _history_sql())
def relevant_history(s, d, m, l, p, r):
    return retrieval.relevant_history(s, *(facts.verified(k) for k in (d, m, l, p)), AS_OF, r)


@query("j14_session_profiles", "sessions patients labs", f"""
, al AS (SELECT id, list_filter(list_transform(string_split(coalesce(allergies, ''), '|'), lambda a: trim(a)), lambda a: a <> '') AS a, nullif(blood_group, '') AS g FROM c_patients)
, te AS (SELECT DISTINCT patient_id FROM c_labs WHERE {SURE} AND (contains(lower(test_name), 'blood group') OR contains(lower(test_name), 'blood type')))
SELECT session_id, s.patient_id, coalesce(to_json(list_transform(a, lambda x: struct_pack(name := x, provenance := 'patient-entered')))::VARCHAR, '[]') AS allergies, coalesce(g, 'Unknown') AS blood_group,
  CASE WHEN g IS NULL THEN 'unknown' WHEN te.patient_id IS NOT NULL THEN 'verified' ELSE 'patient-entered' END AS blood_group_provenance FROM c_sessions s LEFT JOIN al ON al.id = s.patient_id LEFT JOIN te ON te.patient_id = s.patient_id""")  # fmt: skip
def session_profiles(s, p, l):
    return retrieval.session_profiles(s, p, facts.verified(l)).withColumn("allergies", shown_json("allergies"))


@query("t3_ranked_chunks", "questions chunks", r"""
, q AS (SELECT question_id, patient_id, list_filter(string_split_regex(regexp_replace(lower(question), '[^a-z0-9_\s]', '', 'g'), '\s+'), lambda t: length(t) > 3) AS terms FROM c_questions)
, s AS (SELECT question_id, document_id, len(list_filter(terms, lambda t: contains(lower(chunk_text), t))) AS score FROM q JOIN c_chunks USING (patient_id))
SELECT question_id, document_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id) AS place FROM s) WHERE place <= 15""")  # fmt: skip
def ranked_chunks(q, c):
    return questions.ranked(q, c)


@query("x12_text_chunks", "chunks", r"""
, lc AS (SELECT document_id, string_split(chunk_text, chr(10)) AS ls FROM c_chunks WHERE chunk_text <> '')
, pk AS (SELECT document_id, 0::BIGINT AS k, '' AS held, '' AS done FROM lc UNION ALL SELECT document_id, k + 1, CASE WHEN length(held) + length(line) + 1 > 1000 THEN line WHEN held <> '' THEN held || chr(10) || line ELSE line END, CASE WHEN length(held) + length(line) + 1 > 1000 THEN held ELSE '' END
  FROM (SELECT pk.document_id, k, held, ls[k + 1] AS line FROM pk JOIN lc ON lc.document_id = pk.document_id WHERE k < len(ls)))
, ch AS (SELECT document_id, k, regexp_replace(done, '^\s+|\s+$', '', 'g') AS c FROM pk UNION ALL SELECT document_id, max(k) + 1, regexp_replace(arg_max(held, k), '^\s+|\s+$', '', 'g') FROM pk GROUP BY 1)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY k) - 1 AS chunk, c AS chunk_text FROM ch WHERE c <> ''""")  # fmt: skip
def text_chunks(c):
    return retrieval.text_chunks(c)


@query("x13_paragraphs", "chunks", r"SELECT document_id, line_no, trim(line) AS line FROM (SELECT document_id, unnest(string_split(chunk_text, chr(10))) AS line, generate_subscripts(string_split(chunk_text, chr(10)), 1) - 1 AS line_no FROM c_chunks) WHERE length(trim(line)) > 5")
def paragraphs(c):
    return retrieval.paragraphs(c)


@query("x11_page_texts", "chunks", r"SELECT document_id, 1 AS page_number, trim(chunk_text) AS page_text FROM c_chunks WHERE length(regexp_replace(chunk_text, '\s', '', 'g')) > 50 AND trim(chunk_text) <> ''")
def page_texts(c):
    return retrieval.page_texts(c)


_limit = "CASE action " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.RATE_LIMITS.items()) + " END::DOUBLE"


@query("r1_admissions", "requests", f"""
, rq AS (SELECT event_id, user_id, action, epoch_us(ts::TIMESTAMP)::DOUBLE / 1000 AS now, {_limit} AS lim, row_number() OVER (PARTITION BY action, user_id ORDER BY ts, event_id) AS k FROM c_requests)
, bu AS (SELECT action, user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::DOUBLE AS tokens, NULL::DOUBLE AS had, NULL::DOUBLE AS last FROM (SELECT DISTINCT action, user_id FROM rq)
  UNION ALL SELECT action, user_id, k, event_id, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t, now FROM (SELECT rq.action, rq.user_id, rq.k, rq.event_id, rq.now, least(lim, coalesce(tokens, lim) + (rq.now - coalesce(last, rq.now)) * (lim / {rules.RATE_INTERVAL_MS})) AS t FROM bu JOIN rq ON rq.action = bu.action AND rq.user_id = bu.user_id AND rq.k = bu.k + 1))
SELECT event_id, user_id, action, had >= 1 AS allowed, CASE WHEN had >= 1 THEN 0 ELSE greatest(1, ceil((1 - had) / ({_limit} / {rules.RATE_INTERVAL_MS}) / 1000))::INT END AS retry_after FROM bu WHERE k > 0""")  # fmt: skip
def admissions(r):
    return admission.admissions(r)


@query("r3_latest_status", "jobs", "SELECT document_id, arg_max(status, ts) AS status, count(*) AS n_events FROM c_jobs GROUP BY 1")
def latest_status(j):
    return admission.latest_status(j)


def _escaped(word: str) -> str:
    return re.sub(r"([.^$*+?()\[\]{}|\\/])", r"\\\1", word)


def _classified_sql() -> str:
    parts = []
    for i, (name, (least, mandatory, words)) in enumerate(rules.SUBTYPES.items()):
        hit = lambda w: f"regexp_matches(t, '\\b{_escaped(w)}\\b')" if len(w) <= 4 else f"contains(t, '{w}')"
        found = "list_filter([" + ", ".join(f"CASE WHEN {hit(w)} THEN '{w}' END" for w in words) + "], lambda x: x IS NOT NULL)"
        must = " + ".join("(" + " OR ".join(f"contains(t, '{v}')" for v in m.split("|")) + ")::INT" for m in mandatory)
        parts.append(f"SELECT document_id, '{name}' AS name, '{rules.SHOWN_TYPES.get(name, name)}' AS shown, {i} AS o, ev, len(ev)::INT AS n, must, must * 0.65::DOUBLE + least(1.0::DOUBLE, len(ev) / {lexicon.target(least, len(words))}::DOUBLE) * 0.35::DOUBLE AS score FROM (SELECT document_id, {found} AS ev, ({must}) / {len(mandatory)}::DOUBLE AS must FROM lo) WHERE len(ev) >= {least}")
    says = lambda text, **x: "'" + text.format(**{k: f"' || {v} || '" for k, v in x.items()}) + "'"
    whole = lambda x: f"floor({x} * 100 + 0.5)::INT"
    sure, unsure = says(rules.SURE_TYPE, name="shown", percent=whole("confidence")), says(rules.UNSURE_TYPE, percent=whole("confidence"), least="80")
    return ", lo AS (SELECT document_id, lower(text) AS t FROM c_reports), sc AS (" + " UNION ALL ".join(parts) + f""")
, b AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, o) AS k FROM sc)
, cb AS (SELECT l.document_id, name, shown, ev, n, must, round(coalesce(score, 0), 3) AS confidence FROM lo l LEFT JOIN (SELECT * FROM b WHERE k = 1) b ON l.document_id = b.document_id)
, cl AS (SELECT document_id, CASE WHEN confidence >= 0.8 THEN name ELSE 'Other' END AS document_type, confidence, coalesce(n, 0) AS n_matched, coalesce(ev, []) AS matched_evidence,
   CASE WHEN name IS NULL THEN '{rules.NO_TYPE}' ELSE {says(rules.TYPE_FOUND, n="n", name="shown", percent=whole("must"))} END AS explanation, CASE WHEN confidence >= 0.8 THEN {sure} ELSE {unsure} END AS reason FROM cb)"""


CLASSIFIED = _classified_sql()
_before_fields = lambda s: f"nullif(trim(string_split_regex(trim({s}), '{rules.NAME_ENDS}')[1]), '')"
_group = lambda p, q, o: f"CASE WHEN regexp_matches(trim(text), '{p}', 'i') THEN regexp_extract(trim(text), '{p}', 1, 'i') WHEN regexp_matches(trim(text), '{q}', '{o}') THEN regexp_extract(trim(text), '{q}', 1, '{o}') END"
NAMES = rf"""
, nf AS (SELECT *, regexp_extract(trim(text), '(?:patient name|patient|name)\s*:\s*([^\n\r,;:\t]+)', 1, 'i') AS s FROM c_reports)
, nm AS (SELECT document_id, nullif(trim(regexp_replace(trim(string_split_regex(trim(s), '{rules.NAME_ENDS}')[1]), '^(mr\.|ms\.|mrs\.)', '', 'i')), '') AS patient_name,
   nullif(trim({_group(rules.HOSPITAL_LABEL, "(?m)" + rules.HOSPITAL_LINE, "i")}), '') AS hospital_name, {_before_fields(_group(rules.DOCTOR_LABEL, rules.DOCTOR_NAME, "i"))} AS doctor_name FROM nf)"""


@query("c1_document_types", "reports", CLASSIFIED + NAMES + " SELECT document_id, document_type, confidence, n_matched, to_json(matched_evidence)::VARCHAR AS matched_evidence, explanation, reason, patient_name, hospital_name, doctor_name FROM cl JOIN nm USING (document_id)")
def document_types(r):
    return reports.classified(r).withColumn("matched_evidence", F.to_json("matched_evidence"))


@query("c4_patient_names", "reports", NAMES + " SELECT document_id, patient_name, hospital_name, doctor_name FROM nm")
def patient_names(r):
    return reports.document_names(r)


def typed(r):
    return reports.with_types(r)


LINES = CLASSIFIED + """
, ln AS (SELECT document_id, document_type, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM c_reports JOIN cl USING (document_id))"""
_cell = lambda x: "NULL::DOUBLE" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE"
VALUES = LINES + r"""
, mk(document_type, marker, pattern, unit, low, high) AS (VALUES """ + ", ".join("(" + ", ".join(map(_cell, m)) + ")" for m in rules.REPORT_MARKERS) + r""")
, hi AS (SELECT ln.*, marker, unit, low, high, CASE WHEN document_type = 'CBC' THEN replace(regexp_extract(line, '(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\.\d+)', 1), ',', '') ELSE regexp_extract(line, '(\d+(?:\.\d+)?)', 1) END AS value
  FROM ln JOIN mk USING (document_type) WHERE regexp_matches(line, pattern, 'i'))
, fi AS (SELECT *, row_number() OVER (PARTITION BY document_id, marker ORDER BY line_no) AS k FROM hi WHERE value <> '')
, va AS (SELECT document_id, marker, value, CASE WHEN document_type <> 'CBC' THEN unit WHEN contains(lower(line), 'g/dl') THEN 'g/dL' WHEN contains(lower(line), '10^3') OR contains(lower(line), '10-3') THEN '10^3/uL' WHEN contains(lower(line), '10^6') OR contains(lower(line), 'millions') THEN '10^6/uL' ELSE unit END AS unit,
  coalesce(value::DOUBLE < low, false) OR coalesce(value::DOUBLE > high, false) AS abnormal_flag FROM fi WHERE k = 1)"""


@query("e1_e3_marker_values", "reports", VALUES + " SELECT * FROM va")
def marker_values(r):
    return reports.marker_values(typed(r))


SUGAR = r"""
, s AS (SELECT document_id, line_no, regexp_extract(regexp_replace(regexp_replace(line, 'hba1c', '', 'gi'), '1c', '', 'gi'), '(\d+(?:\.\d+)?)', 1) AS value FROM ln WHERE document_type = 'HbA1c' AND regexp_matches(line, 'hba1c|glycated', 'i'))
, su AS (SELECT document_id, value, value::DOUBLE >= 5.7 AS abnormal_flag FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY line_no) AS k FROM s WHERE value <> '') WHERE k = 1)"""


@query("e4_long_term_sugar", "reports", LINES + SUGAR + " SELECT * FROM su")
def long_term_sugar(r):
    return reports.long_term_sugar(typed(r))


PRESCRIBED = r"""
, p AS (SELECT document_id, line_no, lower(line) AS low, trim(regexp_extract(line, '(\d+\s*(?:mg|ml|mcg|g|ug|tablet|capsule|tab|cap)\b)', 1, 'i')) AS d,
  trim(regexp_replace(regexp_replace(trim(string_split_regex(line, '\b\d| - ')[1]), '^rx\b', '', 'i'), '^[^\w\s]+', '')) AS medicine_name FROM ln WHERE document_type = 'Prescription' AND regexp_matches(line, '\d') AND regexp_matches(line, 'tab|cap|mg|tablet|capsule|syrup|ointment', 'i'))
, pr AS (SELECT document_id, line_no, medicine_name, CASE WHEN d = '' THEN '1 tablet' ELSE d END AS dosage, CASE WHEN contains(low, 'twice') OR contains(low, ' bd ') THEN 'Twice Daily' WHEN contains(low, 'thrice') OR contains(low, ' tid ') OR contains(low, 'three times') THEN 'Three Times Daily' ELSE 'Once Daily' END AS frequency FROM p WHERE length(medicine_name) >= 3)"""


@query("e5_prescribed_medicines", "reports", LINES + PRESCRIBED + " SELECT * FROM pr")
def prescribed_medicines(r):
    return reports.prescribed(typed(r))


@query("e6_bill_totals", "reports", LINES + r"""
, x AS (SELECT *, regexp_extract(line, '(\d+(?:\.\d+)?)', 1) AS x, lower(line) AS low FROM ln WHERE document_type = 'OP Bill')
SELECT document_id, coalesce(arg_max(x, line_no) FILTER (contains(low, 'total') OR contains(low, 'paid') OR contains(low, 'net amount')), '0.00') AS total, arg_max(x, line_no) FILTER (contains(low, 'gst') OR contains(low, 'tax')) AS tax FROM x WHERE x <> '' GROUP BY 1""")  # fmt: skip
def bill_totals(r):
    return reports.bill_totals(typed(r))


@query("d1_missing_markers", "reports", VALUES + """
SELECT cl.document_id, a.marker FROM cl JOIN (VALUES ('CBC', 'HEMOGLOBIN'), ('CBC', 'WBC'), ('CBC', 'PLATELETS'), ('Lipid Profile', 'Cholesterol Total'), ('Lipid Profile', 'Triglycerides')) a(document_type, marker) USING (document_type)
WHERE NOT EXISTS (SELECT 1 FROM va WHERE va.document_id = cl.document_id AND va.marker = a.marker)""")  # fmt: skip
def missing_markers(r):
    t = reports.checked_types(r)
    return reports.missing_markers(t, reports.marker_values(t))


@query("s1_s2_uploads", "uploads", """
SELECT id, m AS mime_type, sha256(unhex(content_hex)) AS sha256, m IS NOT NULL AND length(content_hex) > 0 AND length(content_hex) <= 2 * 20971520 AS accepted FROM (SELECT *, CASE WHEN starts_with(content_hex, '25504446') THEN 'application/pdf'
WHEN starts_with(content_hex, 'FFD8FF') THEN 'image/jpeg' WHEN starts_with(content_hex, '89504E47') THEN 'image/png' WHEN starts_with(content_hex, '52494646') AND substr(content_hex, 17, 8) = '57454250' THEN 'image/webp' END AS m FROM c_uploads)""")  # fmt: skip
def uploads(u):
    return intake.admitted_uploads(u.withColumn("content", F.unhex("content_hex"))).select("id", "mime_type", "sha256", "accepted")


@query("f7_token_states", "tokens", "SELECT id, CASE WHEN revoked_at IS NOT NULL THEN 'revoked' WHEN expires_at < TIMESTAMP '2024-01-10' THEN 'expired' ELSE 'valid' END AS state FROM c_tokens")
def token_states(t):
    return intake.token_states(t, "2024-01-10").select("id", "state")


@query("f8_disclosure", "patients config", "SELECT p.id, CASE WHEN coalesce(show_full_name, true) THEN full_name ELSE 'Redacted / Hidden' END AS full_name, CASE WHEN coalesce(show_blood_group, true) THEN blood_group ELSE 'Redacted / Hidden' END AS blood_group FROM c_patients p LEFT JOIN c_config c ON p.id = c.patient_id")
def disclosure(p, c):
    return intake.disclosed(p, c, ["full_name", "blood_group"])


BLOCKS = """
, bl AS (SELECT document_id, page, block, string_agg(text, ' ' ORDER BY word_no, text) AS text, min(x) AS x, min(y) AS y, max(x + w) AS "right", max(y + h) AS bottom, round(coalesce(sum(confidence::DECIMAL(20, 6)) FILTER (confidence >= 0) / count(*) FILTER (confidence >= 0), 0.8), 6) AS confidence FROM c_words GROUP BY 1, 2, 3)"""


@query("a9_scan_blocks", "words", BLOCKS + " SELECT * FROM bl")
def scan_blocks(w):
    return intake.blocks(w, 6)


@query("a10_a18_document_texts", "words", BLOCKS + """
, pg AS (SELECT document_id, page, string_agg(text, chr(10) ORDER BY block) AS text, sum(confidence::DECIMAL(20, 6)) AS s, count(*) AS n FROM bl GROUP BY 1, 2)
SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text, floor(sum(s) * 100000 / sum(n) + 0.5) / 100000 AS confidence FROM pg GROUP BY 1""")  # fmt: skip
def document_texts(w):
    return intake.document_texts(intake.blocks(w, 6), 5)


@query("a11_split_states", "regions", "SELECT document_id, count(*) AS n, CASE WHEN min(coalesce(confidence, 1.0)) < 0.85 THEN 'awaiting_split_review' ELSE 'split' END AS state FROM c_regions GROUP BY 1 HAVING count(*) > 1")
def split_states(r):
    return intake.split_states(r)


@query("x14_region_documents", "regions", "SELECT document_id, region_id, k AS document_index, 'region_' || k || '_' || file_name AS file_name FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY y, x, region_id) - 1 AS k FROM c_regions)")
def region_documents(r):
    return intake.region_documents(r).select("document_id", "region_id", "document_index", "file_name")


@query("s4_n1_payload_facts", "payloads", """
, ok AS (SELECT document_id, CASE WHEN json_valid(payload) THEN payload END AS p FROM c_payloads), x AS (SELECT document_id, json_extract_string(p, '$.documentType') AS document_type, unnest(range(json_array_length(p, '$.labResults')::BIGINT)) AS position, p FROM ok WHERE json_extract_string(p, '$.documentType') IS NOT NULL)
SELECT document_id, document_type, position, json_extract_string(p, '$.labResults[' || position || '].testName') AS test_name, json_extract_string(p, '$.labResults[' || position || '].value') AS value, sha256(document_id || '|lab|' || position) AS record_id FROM x""")  # fmt: skip
def payload_facts(p):
    return intake.payload_facts(p)[0]


@query("s4_payload_rejects", "payloads", "SELECT document_id, CASE WHEN NOT json_valid(payload) THEN 'malformed' ELSE 'documentType is missing' END AS reasons FROM c_payloads WHERE CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.documentType') END IS NULL")
def payload_rejects(p):
    return schemas.loaded(p, ["documentType", "labResults.testName", "labResults.value"])[1].select("document_id", F.array_join("reasons", "; ").alias("reasons"))


def _reasons_sql() -> str:
    def lacks(path: str) -> str:
        array, _, field = path.rpartition(".")
        return f"len(list_filter(from_json(json_extract(p, '$.{array}[*]'), '[\"JSON\"]'), lambda x: coalesce(json_extract_string(x, '$.{field}'), '') = '')) > 0" if array else f"json_extract(p, '$.{path}') IS NULL"

    checks = ", ".join(f"CASE WHEN {lacks(r)} THEN '{r} is missing' END" for r in schemas.REQUIRED)
    kinds = ", ".join(f"'{k}'" for k in schemas.DOCUMENT_TYPES)
    return f"array_to_string(list_filter([{checks}, CASE WHEN json_extract_string(p, '$.documentType') NOT IN ({kinds}) THEN 'documentType is unknown' END], lambda r: r IS NOT NULL), '; ')"


@query("s4_section_rejects", "full_payloads", f"""
, ok AS (SELECT document_id, CASE WHEN json_valid(payload) THEN payload END AS p FROM c_full_payloads)
SELECT document_id, reasons FROM (SELECT document_id, CASE WHEN p IS NULL THEN 'malformed' ELSE {_reasons_sql()} END AS reasons FROM ok) WHERE reasons <> ''""")  # fmt: skip
def section_rejects(p):
    return schemas.loaded(p)[1].select("document_id", F.array_join("reasons", "; ").alias("reasons"))


@query("a8_coverage", "payloads chunks", """
, s AS (SELECT document_id, CASE WHEN json_valid(payload) THEN list_distinct(list_transform(from_json(json_extract(payload, '$.labResults[*].sourceText'), '["VARCHAR"]'), lambda v: lower(trim(v)))) ELSE [] END AS sources FROM c_payloads)
, b AS (SELECT document_id, list_filter(list_transform(string_split(chunk_text, chr(10)), lambda v: lower(trim(v))), lambda v: length(v) > 5) AS blocks FROM c_chunks)
, m AS (SELECT document_id, len(blocks) AS total, len(list_filter(blocks, lambda k: len(list_filter(coalesce(sources, []), lambda v: contains(v, k) OR contains(k, v))) > 0)) AS mapped FROM b JOIN s USING (document_id))
SELECT document_id, total, mapped, total - mapped AS unmapped FROM m""")  # fmt: skip
def coverage(p, c):
    return intake.coverage(p, c.select("document_id", F.col("chunk_text").alias("text")))


def _tree(name: str, column: str) -> str:
    return f"{name} AS (SELECT document_id, substr(t.fullkey, 3) AS path, t.type AS type, t.value::VARCHAR AS value FROM fx, json_tree(fx.{column}) t WHERE t.fullkey <> '$' AND NOT contains(t.fullkey, '['))"


@query("n3_corrections", "full_payloads", rf"""
, fx AS (SELECT document_id, payload AS old, replace(replace(replace(payload, '"value": null', '"value": {{"day": 3}}'), '"Gout"', '"Gouty arthritis"'), '"procedures": []', '"notes": {{"by": "x", "seen": [1, 2.50]}}') AS new
   FROM c_full_payloads WHERE json_valid(payload) AND json_extract_string(payload, '$.documentType') IS NOT NULL)
, {_tree("a", "old")}, {_tree("b", "new")}
, d AS (SELECT document_id, path, a.value AS v, b.value AS w FROM a FULL JOIN b USING (document_id, path) WHERE a.value IS DISTINCT FROM b.value AND NOT (coalesce(a.type, '') = 'OBJECT' AND coalesce(b.type, '') = 'OBJECT'))
SELECT document_id, path, CASE WHEN v NOT LIKE '[%' THEN v END AS from_value, CASE WHEN w NOT LIKE '[%' THEN w END AS to_value, length(v) AS n_from, length(w) AS n_to FROM d
  WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.document_id = d.document_id AND starts_with(d.path, e.path || '.'))""")  # fmt: skip
def corrections(p):
    new = F.replace(F.replace(F.replace("payload", F.lit('"value": null'), F.lit('"value": {"day": 3}')), F.lit('"Gout"'), F.lit('"Gouty arthritis"')), F.lit('"procedures": []'), F.lit('"notes": {"by": "x", "seen": [1, 2.50]}'))
    found = intake.corrections(p.where(F.get_json_object("payload", "$.documentType").isNotNull()).select("document_id", F.col("payload").alias("old"), new.alias("new")))
    shown = lambda c: F.when(~F.col(c).startswith("["), F.col(c))  # noqa: E731  the order of keys within arrays is each engine's own
    return found.select("document_id", "path", shown("from_value").alias("from_value"), shown("to_value").alias("to_value"), F.length("from_value").cast("long").alias("n_from"), F.length("to_value").cast("long").alias("n_to"))


@query("q2_question_intents", "asked", "SELECT question_id, " + ", ".join(f"{like_any('lower(question)', ws)} AS is_{k}" for k, ws in rules.INTENTS.items()) + " FROM c_asked")
def question_intents(q):
    return intake.question_intents(q, {f"is_{k}": ws for k, ws in rules.INTENTS.items()})


@query("x10_query_terms", "questions", r"SELECT question_id, array_to_string(list_filter(string_split_regex(regexp_replace(lower(question), '[^a-z0-9_\s]', '', 'g'), '\s+'), lambda t: length(t) > 3), ' ') AS terms FROM c_questions")
def terms(q):
    from ..functions.norm import query_terms

    return q.select("question_id", F.array_join(query_terms(F.col("question")), " ").alias("terms"))


@query("j11_citations", "diagnoses documents", "SELECT x.id, coalesce(d.file_name, 'Medical Document') AS title FROM c_diagnoses x LEFT JOIN (SELECT * FROM c_documents WHERE NOT is_deleted) d ON d.id = x.source_document_id")
def citations(x, d):
    return summaries.cited(x, d.where("not is_deleted")).select("id", "title")


@query("j1_dated_facts", "labs records", "SELECT id, event_date FROM c_labs LEFT JOIN c_records USING (record_id)")
def dated_facts(l, r):
    return summaries.dated(l, r).select("id", "event_date")


@query("j2_titled_timeline", TIMELINE_TABLES, TIMELINE + " SELECT t.id, coalesce(d.file_name, 'Medical Document') AS document_name FROM t LEFT JOIN c_documents d ON d.id = t.source_document_id")
def titled_timeline(r, d, *kinds):
    return summaries.cited(timeline.events(r, d, *kinds), d).select("id", F.col("title").alias("document_name"))


@query("f17_review_queue", "documents", "SELECT patient_id, count(*) AS waiting, min(created_on) AS oldest FROM c_documents WHERE processing_status = 'awaiting_review' AND NOT is_deleted GROUP BY 1")
def review_queue(d):
    return summaries.review_queue(d)


_dash = lambda col: f"coalesce('- ' || {col}, 'None')"


@query("a14_memory_texts", "patients diagnoses medications", f"""
, dx AS (SELECT patient_id, string_agg(n, chr(10) || '- ' ORDER BY n) AS s FROM (SELECT DISTINCT patient_id, {canonical_sql("name", "diagnosis")} AS n FROM c_diagnoses WHERE {SURE} AND is_chronic) GROUP BY 1)
, rx AS (SELECT patient_id, string_agg(n, chr(10) || '- ' ORDER BY n) AS s FROM (SELECT DISTINCT patient_id, {canonical_sql("medicine_name", "medication")} || ' (' || coalesce(strength, 'N/A') || ')' AS n FROM c_medications WHERE {SURE} AND (end_date IS NULL OR contains(lower(duration), 'ongoing') OR contains(lower(duration), 'chronic'))) GROUP BY 1)
, al AS (SELECT id, string_agg(a, chr(10) || '- ' ORDER BY k) AS s FROM (SELECT id, trim(unnest(string_split(allergies, '|'))) AS a, generate_subscripts(string_split(allergies, '|'), 1) AS k FROM c_patients) WHERE a <> '' GROUP BY 1)
SELECT p.id AS patient_id, '[PATIENT COMPACT CLINICAL MEMORY]' || chr(10) || 'Patient Name: ' || full_name || chr(10) || 'Blood Group: ' || coalesce(blood_group, 'N/A') || chr(10) || chr(10) || 'Active Chronic Conditions:' || chr(10) || {_dash("dx.s")} || chr(10) || chr(10)
 || 'Active Long-term Medications:' || chr(10) || {_dash("rx.s")} || chr(10) || chr(10) || 'Known Allergies:' || chr(10) || {_dash("al.s")} AS memory FROM c_patients p LEFT JOIN dx ON dx.patient_id = p.id LEFT JOIN rx ON rx.patient_id = p.id LEFT JOIN al ON al.id = p.id""")  # fmt: skip
def memory_texts(p, d, m):
    return summaries.memories(p, facts.verified(d), facts.verified(m))


EMERGENCY_CONDITIONS = """
SELECT id AS patient_id, manual_condition AS name, 'patient-entered' AS provenance FROM c_patients WHERE manual_condition IS NOT NULL UNION ALL
SELECT patient_id, name, 'document-verified' FROM (SELECT DISTINCT patient_id, name FROM c_diagnoses WHERE is_chronic AND verification_status = 'verified') x WHERE NOT EXISTS (SELECT 1 FROM c_patients p WHERE p.id = x.patient_id AND lower(p.manual_condition) = lower(x.name))"""


@query("j12_emergency_conditions", "patients diagnoses", EMERGENCY_CONDITIONS)
def emergency_conditions(p, d):
    return summaries.emergency_conditions(p, d)


@query("w7_version_ends", "versions", "SELECT document_id, arg_min(event_id, ts) AS first_id, arg_max(event_id, ts) AS latest_id, count(*) AS n FROM c_versions GROUP BY 1")
def version_ends(v):
    return summaries.version_ends(v)


@query("j20_session_context", "requests sessions", """
SELECT 's' || event_id AS session_id, coalesce(reason_category, 'General Consultation') AS reason, coalesce(problem_location, 'Not specified') AS place, coalesce(description, '') AS description FROM c_requests r LEFT JOIN c_sessions s ON s.session_id = 's' || r.event_id""")  # fmt: skip
def session_context(r, s):
    return summaries.session_context(r.select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("session_id")), s)


@query("d3_lab_errors", "labs records", r"""
SELECT id, 'value' AS field, 'warning' AS severity FROM c_labs WHERE NOT regexp_matches(value, '\d') UNION ALL SELECT id, 'test_date', 'error' FROM c_labs JOIN c_records USING (record_id) WHERE test_date > event_date""")  # fmt: skip
def lab_errors(l, r):
    return summaries.lab_errors(summaries.dated(l, r))


TERMS_SQL = r", q AS (SELECT question_id, patient_id, list_filter(string_split_regex(regexp_replace(lower(question), '[^a-z0-9_\s]', '', 'g'), '\s+'), lambda t: length(t) > 3) AS terms FROM c_questions)"


@query("t5_first_mentions", "questions chunks", TERMS_SQL + " SELECT question_id, min(document_id) AS document_id FROM q JOIN c_chunks USING (patient_id) WHERE len(list_filter(terms, lambda t: contains(lower(chunk_text), t))) > 0 GROUP BY 1")
def first_mentions(q, c):
    return questions.first_mentions(q, c)


@query("j15_feedback_rows", "chunks payloads", """
SELECT document_id, chunk_text AS original_ocr, payload AS original, replace(payload, '"value": "1"', '"value": "2"') AS corrected, 1 AS version, 1.0::DOUBLE AS confidence FROM c_chunks JOIN c_payloads USING (document_id) WHERE contains(payload, '"value": "1"')""")  # fmt: skip
def feedback_rows(c, p):
    fixed = p.withColumn("payload", F.replace("payload", F.lit('"value": "1"'), F.lit('"value": "2"')))
    return summaries.feedback(c, p, fixed)


@query("t4_newest_sessions", "requests", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM c_requests")
def newest_sessions(r):
    return summaries.newest(r, "user_id", "ts", "event_id").select("user_id", "event_id", "place")


@query("x6_same_identity", "patients", "SELECT a.id, contains(x, y) OR contains(y, x) AS same FROM (SELECT id, regexp_replace(lower(full_name), '[^a-z0-9]', '', 'g') AS x, regexp_replace(lower('customer ' || id), '[^a-z0-9]', '', 'g') AS y FROM c_patients) a")
def same_identity(p):
    from ..functions import norm

    return p.select("id", norm.same_identity(F.col("full_name"), F.concat(F.lit("Customer "), "id")).alias("same"))


@query("x8_shown_dates", "documents", "SELECT id, strftime(created_on, '%b %-d, %Y') AS shown FROM c_documents")
def shown_dates(d):
    from ..functions import norm

    return d.select("id", norm.shown_date(F.col("created_on").cast("string")).alias("shown"))


@query("f14_hospital_documents", "documents", "SELECT id FROM c_documents WHERE processing_status IN ('completed', 'awaiting_review') AND (lower(category) = 'discharge summary' OR contains(lower(file_name), 'discharge'))")
def hospital_documents(d):
    stay = (F.lower("category") == "discharge summary") | F.lower("file_name").contains("discharge")
    return d.where(F.col("processing_status").isin("completed", "awaiting_review") & stay).select("id")


@query("f6_document_vault", "documents", "SELECT id FROM c_documents WHERE contains(lower(file_name), 'rx') AND category = 'op_bill_receipt' AND processing_status NOT IN ('completed', 'awaiting_review', 'failed') AND NOT is_deleted")
def document_vault(d):
    open_ = ~F.col("processing_status").isin("completed", "awaiting_review", "failed")
    return d.where(F.lower("file_name").contains("rx") & (F.col("category") == "op_bill_receipt") & open_ & ~F.col("is_deleted")).select("id")


@query("f15_restricted_texts", "asked", f"SELECT question_id, {like_any('lower(question)', intake.RESTRICTED)} AS is_restricted FROM c_asked")
def restricted_texts(q):
    return q.select("question_id", intake.restricted(F.col("question")).alias("is_restricted"))


@query("a15_memory_lists", "diagnoses medications", f"""
SELECT patient_id, 'condition' AS kind, {canonical_sql("name", "diagnosis")} AS name FROM c_diagnoses WHERE {SURE} AND is_chronic GROUP BY ALL UNION ALL
SELECT patient_id, 'medication', {canonical_sql("medicine_name", "medication")} FROM c_medications WHERE {SURE} AND (end_date IS NULL OR contains(lower(coalesce(duration, '')), 'ongoing') OR contains(lower(coalesce(duration, '')), 'chronic')) GROUP BY ALL""")  # fmt: skip
def memory_lists(d, m):
    dx = facts.verified(d).where("is_chronic").select("patient_id", F.lit("condition").alias("kind"), canonical(F.col("name"), "diagnosis").alias("name")).distinct()
    duration = F.lower(F.coalesce("duration", F.lit("")))
    lasting = F.col("end_date").isNull() | duration.contains("ongoing") | duration.contains("chronic")
    rx = facts.verified(m).where(lasting).select("patient_id", F.lit("medication").alias("kind"), canonical(F.col("medicine_name"), "medication").alias("name")).distinct()
    return dx.unionByName(rx)


@query("a17_document_summaries", "payloads", """
, ok AS (SELECT document_id, CASE WHEN json_valid(payload) THEN payload END AS p FROM c_payloads)
SELECT document_id, json_extract_string(p, '$.documentType') AS event_type, 'Contains ' || coalesce(json_array_length(p, '$.labResults'), 0) || ' lab results.' AS summary FROM ok WHERE json_extract_string(p, '$.documentType') IS NOT NULL""")  # fmt: skip
def document_summaries(p):
    read = p.withColumn("p", F.from_json("payload", intake.PAYLOAD)).where("p.documentType is not null")
    n = F.coalesce(F.size("p.labResults"), F.lit(0))
    return read.select("document_id", F.col("p.documentType").alias("event_type"), F.concat(F.lit("Contains "), n.cast("string"), F.lit(" lab results.")).alias("summary"))


@query("j18_question_records", "asked diagnoses", """
, q AS (SELECT question_id, patient_id, lower(question) AS q FROM c_asked)
SELECT DISTINCT question_id, name FROM q JOIN c_diagnoses d USING (patient_id) WHERE contains(q, lower(name)) OR len(list_filter(string_split_regex(lower(name), '\\s+'), lambda w: length(w) > 3 AND contains(q, w))) > 0""")  # fmt: skip
def question_records(q, d):
    return intake.question_records(q, d)


@query("e8_lab_values", "reports")
def lab_values(r):
    return reports.lab_values(r)


NOTE_LINES = """, ln AS (SELECT *, lower(line) AS low FROM (SELECT document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM c_notes))"""


def _vital_sql(kind: str, words: list[str], pattern: str, unit: str) -> str:
    shown = "regexp_extract(line, '(" + pattern + ")', 1)"
    tail = "CASE WHEN contains(low, 'c') THEN ' °C' ELSE ' °F' END" if kind == "temp" else f"'{unit}'"
    return f"SELECT document_id, '{kind}' AS vital, line_no, {shown} || {tail} AS value FROM ln WHERE ({' OR '.join(f'contains(low, {chr(39)}{w}{chr(39)})' for w in words)}) AND {shown} <> ''"


@query("e11_vitals", "notes", NOTE_LINES + " SELECT document_id, vital, arg_max(value, line_no) AS value FROM (" + " UNION ALL ".join(_vital_sql(*v) for v in reports.VITALS) + ") GROUP BY 1, 2")
def vitals(n):
    return reports.vitals(n)


_prefixes = " ".join(f"WHEN starts_with(low, '{p}') THEN trim(substr(line, {len(p) + 1}))" for p in reports.DIAGNOSIS_PREFIXES)


@query("e12_stated_diagnoses", "notes", NOTE_LINES + f" SELECT document_id, line_no, name FROM (SELECT *, CASE {_prefixes} END AS name FROM ln) WHERE length(name) > 2")
def stated_diagnoses(n):
    return reports.stated_diagnoses(n)


@query("e7_invoiced_medicines", "notes", NOTE_LINES + r"""
, w AS (SELECT *, array_to_string(list_filter(string_split_regex(trim(line), '\s+'), lambda x: regexp_matches(x, '^[a-zA-Z]{4,}$') AND lower(x) NOT IN ('batch', 'expiry', 'quantity', 'tablet', 'capsule', 'price')), ' ') AS medicine_name FROM ln
 WHERE regexp_matches(low, 'batch|exp') OR ((regexp_matches(low, '\bqty\b') OR contains(low, ' quantity ') OR contains(low, ' x ')) AND regexp_matches(line, '\d')))
SELECT document_id, line_no, medicine_name, coalesce(nullif(regexp_extract(line, '(?:batch|b\.?no|lot)\s*:?\s*([a-zA-Z0-9]+)', 1, 'i'), ''), 'N/A') AS batch, coalesce(nullif(regexp_extract(line, '(?:exp|expiry|exp\.?dt)\s*:?\s*(\d{2}/\d{2,4})', 1, 'i'), ''), 'N/A') AS expiry FROM w WHERE length(medicine_name) >= 3""")  # fmt: skip
def invoiced_medicines(n):
    return reports.invoiced(n)
