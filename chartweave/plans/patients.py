"""Queries over a patient's record as a whole: switches, encounters, the graph, insights, briefs, lifecycle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import norm
from ..functions.norm import canonical_sql, like_any
from ..operators import briefs, facts, meds, payloads, ranges, retrieval, summaries, timeline, variants
from .queries import ACTIVE, AS_OF, BLOOD_GROUP_SQL, EMERGENCY_CONDITIONS, NUMBER, SURE, _history_sql, query, shown_json

_anti = "lower({}) IN (" + ", ".join(f"'{d}'" for d in rules.ANTIHYPERTENSIVES) + ")"
_drug = "STRUCT(name VARCHAR, strength VARCHAR, dosage VARCHAR, doc VARCHAR)"


SWITCH_SQL = f"""
, hp AS (SELECT DISTINCT patient_id FROM c_labs WHERE (contains(lower(test_name), 'bp') OR contains(lower(test_name), 'blood pressure')) AND {NUMBER} > 140)
, md AS (SELECT patient_id, {canonical_sql("medicine_name", "medication")} AS name, strength, dosage, source_document_id AS doc, coalesce(start_date, created_on) AS date, patient_id IN (SELECT patient_id FROM hp) AS pressure,
    row_number() OVER (PARTITION BY patient_id ORDER BY coalesce(start_date, created_on), id) AS k FROM c_medications WHERE {SURE})
, st AS (SELECT patient_id, 0::BIGINT AS k, []::{_drug}[] AS taken, NULL::VARCHAR AS name, NULL::VARCHAR AS strength, NULL::VARCHAR AS dosage, NULL::VARCHAR AS doc, NULL::DATE AS date, false AS pressure, NULL::{_drug} AS old, NULL::VARCHAR AS gone, NULL::VARCHAR AS gone_doc FROM (SELECT DISTINCT patient_id FROM md)
  UNION ALL SELECT patient_id, k, CASE WHEN old IS NOT NULL THEN list_transform(taken, lambda t: CASE WHEN t.name = name THEN struct_pack(name := name, strength := strength, dosage := dosage, doc := doc) ELSE t END)
    ELSE list_append(list_filter(taken, lambda t: t.name IS DISTINCT FROM gone.name), struct_pack(name := name, strength := strength, dosage := dosage, doc := doc)) END, name, strength, dosage, doc, date, pressure, old, gone.name, gone.doc
  FROM (SELECT st.patient_id, md.k, st.taken, md.name, md.strength, md.dosage, md.doc, md.date, md.pressure, list_filter(st.taken, lambda t: t.name = md.name)[1] AS old,
    CASE WHEN {_anti.format("md.name")} AND len(list_filter(st.taken, lambda t: t.name = md.name)) = 0 THEN list_filter(st.taken, lambda t: {_anti.format("t.name")})[1] END AS gone FROM st JOIN md ON md.patient_id = st.patient_id AND md.k = st.k + 1))
, ev AS (SELECT patient_id, k, 1 AS o, 'Dose changed' AS type, name AS medicine, coalesce(nullif(old.strength, ''), nullif(old.dosage, ''), 'Previous Dose') AS from_value, coalesce(nullif(strength, ''), nullif(dosage, ''), 'New Dose') AS to_value, date, NULL AS reason, 'Dosing altered from ' || coalesce(nullif(old.strength, ''), old.dosage, 'null') || ' to ' || coalesce(nullif(strength, ''), dosage, 'null') AS evidence, [old.doc, doc] AS citations FROM st WHERE old IS NOT NULL AND (old.strength IS DISTINCT FROM strength OR old.dosage IS DISTINCT FROM dosage)
  UNION ALL SELECT patient_id, k, 1, 'Replacement', name, gone, name, date, CASE WHEN pressure THEN 'Blood pressure uncontrolled' ELSE 'Treatment optimization' END, name || ' substituted for ' || gone || '. Reason: ' || CASE WHEN pressure THEN 'Blood pressure uncontrolled' ELSE 'Treatment optimization' END || '.', [gone_doc, doc] FROM st WHERE gone IS NOT NULL UNION ALL SELECT patient_id, k, 2, 'Started', name, NULL, NULL, date, NULL, name || ' initiated daily.', [doc] FROM st WHERE k > 0 AND old IS NULL)
SELECT patient_id, row_number() OVER (PARTITION BY patient_id ORDER BY k, o) AS seq, type, medicine, from_value, to_value, date, reason, evidence, to_json(citations)::VARCHAR AS citations FROM ev"""


@query("u1_medication_switches", "medications labs", SWITCH_SQL)
def medication_switches(m, l):
    return meds.switches(facts.verified(m), l).withColumn("citations", F.to_json("citations"))


@query("w5_dose_changes", "medications", f"""
, m AS (SELECT patient_id, id, {canonical_sql("medicine_name", "medication")} AS name, strength, dosage, coalesce(start_date, created_on) AS date FROM c_medications WHERE {SURE})
, l AS (SELECT *, lag(strength) OVER w AS s, lag(dosage) OVER w AS d, lag(id) OVER w AS before FROM m WINDOW w AS (PARTITION BY patient_id, name ORDER BY date, id))
SELECT patient_id, id, name, coalesce(s, d) AS from_value, coalesce(strength, dosage) AS to_value FROM l WHERE before IS NOT NULL AND (s IS DISTINCT FROM strength OR d IS DISTINCT FROM dosage)""")  # fmt: skip
def dose_changes(m):
    return meds.dose_changes(facts.verified(m))


_enc = "STRUCT(day DATE, h VARCHAR, d VARCHAR, title VARCHAR)"
_fits = "abs(date_diff('day', e.day, dc.day)) <= 3 AND (coalesce(lower(trim(e.h)) = lower(trim(dc.h)), false) OR coalesce(lower(trim(e.d)) = lower(trim(dc.d)), false) OR (e.h IS NULL AND dc.h IS NULL AND e.d IS NULL AND dc.d IS NULL))"
ENCOUNTERS = f"""
, dc AS (SELECT id, patient_id, created_on AS day, nullif(hospital, '') AS h, nullif(doctor, '') AS d, row_number() OVER (PARTITION BY patient_id ORDER BY created_on, id) AS k FROM c_documents)
, es AS (SELECT patient_id, 0::BIGINT AS k, NULL::VARCHAR AS id, []::{_enc}[] AS encs, 0::BIGINT AS pos FROM (SELECT DISTINCT patient_id FROM dc)
  UNION ALL SELECT patient_id, k, id, CASE WHEN hit > 0 THEN list_transform(encs, lambda e, i: CASE WHEN i = hit THEN struct_pack(day := e.day, h := coalesce(e.h, h), d := coalesce(e.d, d), title := e.title) ELSE e END)
    ELSE list_append(encs, struct_pack(day := day, h := h, d := d, title := CASE WHEN h IS NULL THEN 'Doctor Visit on ' || strftime(day, '%b %-d, %Y') ELSE 'Admission at ' || h END)) END, CASE WHEN hit > 0 THEN hit ELSE len(encs) + 1 END
  FROM (SELECT es.patient_id, dc.k, dc.id, es.encs, dc.day, dc.h, dc.d, coalesce(list_position(list_transform(es.encs, lambda e: {_fits}), true), 0) AS hit FROM es JOIN dc ON dc.patient_id = es.patient_id AND dc.k = es.k + 1))
, el AS (SELECT patient_id, arg_max(encs, k) AS encs FROM es GROUP BY 1)
, en AS (SELECT es.id AS document_id, es.patient_id, es.pos AS encounter, el.encs[es.pos].title AS title, el.encs[es.pos].h AS hospital, el.encs[es.pos].d AS doctor, el.encs[es.pos].day AS date,
   (row_number() OVER (PARTITION BY es.patient_id, es.pos ORDER BY es.k) - 1)::INT AS place, (count(*) OVER (PARTITION BY es.patient_id, es.pos))::INT AS documents FROM es JOIN el ON el.patient_id = es.patient_id WHERE es.k > 0)"""


@query("u2_encounters", "documents", ENCOUNTERS + " SELECT * FROM en")
def encounters(d):
    return timeline.encounters(d)


def _json(**values: str) -> str:
    return "json_object(" + ", ".join(f"'{k}', ({values[k]})::VARCHAR" for k in sorted(values)) + ")::VARCHAR" if values else "'{}'"


_same = lambda names: {n: n for n in names.split()}
_none = "NULL"
FACTS = f"""
, fb AS (SELECT patient_id, id, source_document_id, 2 AS stage, 0 AS step, 'Diagnosis' AS entity_type, {canonical_sql("name", "diagnosis")} AS canonical_name, created_on AS day,
    {_json(**_same("is_chronic notes verification_status"), confidence=_none)} AS props, {_json(confidence=_none, evidence_text=_none)} AS met, {_json(is_chronic="is_chronic")} AS had FROM c_diagnoses WHERE {SURE}
  UNION ALL SELECT patient_id, id, source_document_id, 3, 0, 'Medication', {canonical_sql("medicine_name", "medication")}, created_on,
    {_json(**_same("strength frequency duration start_date end_date verification_status"), generic_name=_none, route=_none, instructions=_none, reason=_none, confidence=_none)}, {_json(**_same("dosage duration"), instructions=_none)}, {_json(**_same("start_date end_date"))} FROM c_medications WHERE {SURE}
  UNION ALL SELECT patient_id, id, source_document_id, 4, 0, 'Lab Test', test_name, test_date, {_json(unit="unit")}, '{{}}', '{{}}' FROM c_labs WHERE {SURE}
  UNION ALL SELECT patient_id, id, source_document_id, 4, 1, 'Lab Result', test_name || ': ' || value || ' ' || coalesce(unit, ''), test_date, {_json(**_same("value unit abnormal_flag test_date"), reference_range=_none, confidence=_none)}, {_json(date="test_date")}, '{{}}' FROM c_labs WHERE {SURE}
  UNION ALL SELECT patient_id, id, source_document_id, 5, 0, 'Procedure', name, done_on, {_json(date="done_on", notes="notes", surgeon_name=_none, confidence=_none)}, {_json(date="done_on")}, '{{}}' FROM c_procedures WHERE {SURE})
, fe AS (SELECT fb.*, coalesce(en.title, 'Encounter on ' || strftime(day, '%b %-d, %Y')) AS encounter_title FROM fb LEFT JOIN en ON en.document_id = fb.source_document_id)"""
LIVE = ENCOUNTERS.replace("FROM c_documents)", "FROM c_documents WHERE NOT is_deleted)")
_node = lambda kind, name: f"sha256(patient_id || '|{kind}|' || {name})"
_own = "sha256(patient_id || '|' || entity_type || '|' || canonical_name)"
GRAPH = LIVE + FACTS + f"""
, nr AS (SELECT id AS patient_id, id, 'Patient' AS entity_type, 'Patient Profile' AS canonical_name, 0 AS stage, 0 AS number, '' AS o, 0 AS step, '{{}}' AS props, NULL AS doc FROM c_patients
  UNION ALL SELECT patient_id, document_id, 'Encounter', title, 1, encounter, '', 3 * place, {_json(date="date", hospital_name="hospital", doctor_name="doctor", documents_count="documents")}, document_id FROM en
  UNION ALL SELECT patient_id, document_id, 'Hospital', hospital, 1, encounter, '', 3 * place + 1, '{{}}', document_id FROM en WHERE hospital IS NOT NULL UNION ALL SELECT patient_id, document_id, 'Doctor', doctor, 1, encounter, '', 3 * place + 2, '{{}}', document_id FROM en WHERE doctor IS NOT NULL
  UNION ALL SELECT patient_id, id, entity_type, canonical_name, stage, 0, id, step, props, source_document_id FROM fe UNION ALL SELECT patient_id, id, 'Encounter', encounter_title, stage, 0, id, 9, {_json(date="day")}, source_document_id FROM fe WHERE entity_type <> 'Lab Test')
, nd AS (SELECT patient_id, entity_type, canonical_name, id AS first_id, {_own} AS node_id, props AS properties, 1 AS evidence_count, coalesce(doc, '') AS source_documents FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, entity_type, canonical_name ORDER BY stage, number, o, step) AS k FROM nr) WHERE k = 1)
, ed AS (SELECT patient_id, {_node("Patient", "'Patient Profile'")} AS source, {_node("Encounter", "title")} AS target, 'belongs_to_encounter' AS relationship_type, {_json(date="date")} AS properties FROM en UNION ALL SELECT patient_id, {_node("Encounter", "title")}, {_node("Hospital", "hospital")}, 'performed_at', {_json(date="date")} FROM en WHERE hospital IS NOT NULL
  UNION ALL SELECT patient_id, {_node("Encounter", "title")}, {_node("Doctor", "doctor")}, 'ordered_by', {_json(date="date")} FROM en WHERE doctor IS NOT NULL
  UNION ALL SELECT patient_id, {_node("Encounter", "encounter_title")}, {_own}, CASE entity_type WHEN 'Diagnosis' THEN 'diagnosed_with' WHEN 'Medication' THEN 'prescribed' WHEN 'Lab Result' THEN 'ordered_by' ELSE 'belongs_to_encounter' END, met FROM fe WHERE entity_type <> 'Lab Test'
  UNION ALL SELECT patient_id, {_node("Patient", "'Patient Profile'")}, {_own}, CASE entity_type WHEN 'Diagnosis' THEN 'diagnosed_with' ELSE 'prescribed' END, had FROM fe WHERE entity_type IN ('Diagnosis', 'Medication')
  UNION ALL SELECT patient_id, {_node("Lab Test", "split_part(canonical_name, ': ', 1)")}, {_own}, 'caused', {_json(date="day")} FROM fe WHERE entity_type = 'Lab Result')"""
GRAPH_TABLES = "patients documents diagnoses medications labs procedures"


def graph_rows(d, *kinds):
    found = ranges.cut(timeline.encounters(d.where("not is_deleted")))
    return found, timeline.fact_nodes(*(facts.verified(k) for k in kinds), found)


def graph(p, d, *kinds):
    found, rows = graph_rows(d, *kinds)
    return timeline.graph_nodes(p, found, rows), timeline.graph_edges(found, rows)


@query("g3_graph_nodes", GRAPH_TABLES, GRAPH + " SELECT * FROM nd")
def graph_nodes(*tables):
    return graph(*tables)[0].withColumns({"properties": F.to_json("properties"), "source_documents": F.array_join("source_documents", ",")})


@query("g4_graph_edges", GRAPH_TABLES, GRAPH + " SELECT * FROM ed")
def graph_edges(*tables):
    return graph(*tables)[1].withColumn("properties", F.to_json("properties"))


@query("a5_graph_sizes", GRAPH_TABLES, GRAPH + " SELECT coalesce(a.patient_id, b.patient_id) AS patient_id, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_edges, 0) AS n_edges FROM (SELECT patient_id, count(*) AS n_nodes FROM nd GROUP BY 1) a FULL JOIN (SELECT patient_id, count(*) AS n_edges FROM ed GROUP BY 1) b ON a.patient_id = b.patient_id")
def graph_sizes(p, *tables):
    return timeline.graph_counts(p, *graph_rows(*tables))


@query("j17_fact_encounters", "documents procedures", LIVE + f" SELECT p.id, coalesce(en.title, 'Encounter on ' || strftime(done_on, '%b %-d, %Y')) AS encounter_title FROM c_procedures p LEFT JOIN en ON en.document_id = p.source_document_id WHERE {SURE}")
def fact_encounters(d, p):
    return timeline.with_encounters(facts.verified(p), timeline.encounters(d.where("not is_deleted")), F.col("done_on")).select("id", "encounter_title")


_num = lambda x: f"regexp_replace({x}::VARCHAR, '\\.0$', '')"
_day = lambda x: f"strftime({x}, '%b %-d, %Y')"


def _pair_sql(test: str, unit: str, risen: str, title: str, said: tuple[str, str, str, str, str], critical: str) -> str:
    text = f"'{said[0]}' || {_num('ax')} || '{said[1]}' || {_day('ad')} || '{said[2]}' || {_num('zx')} || '{said[3]}' || {_day('zd')} || '{said[4]}'"
    return f"""SELECT patient_id, '{title}' AS title, {text} AS description, CASE WHEN {critical} THEN 'critical' ELSE 'warning' END AS severity, c AS citations FROM (SELECT patient_id, max(CASE WHEN up = 1 THEN x END) AS ax, min(test_date) AS ad, max(CASE WHEN down = 1 THEN x END) AS zx, max(test_date) AS zd, count(*) AS n,
      string_agg(source_document_id || ' ' || title || ' ' || test_date::VARCHAR || ' ' || test_name || ': ' || value || '{unit}', '; ' ORDER BY test_date, id) AS c FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY test_date, id) AS up, row_number() OVER (PARTITION BY patient_id ORDER BY test_date DESC, id DESC) AS down FROM lx WHERE {test}) GROUP BY 1) WHERE n >= 2 AND {risen}"""


@query("g5_insights", "labs medications documents", f"""
, lx AS (SELECT l.*, {NUMBER} AS x, coalesce(file_name, 'Medical Document') AS title FROM c_labs l LEFT JOIN c_documents d ON d.id = l.source_document_id WHERE {SURE})
, mx AS (SELECT m.*, coalesce(start_date, m.created_on) AS day, coalesce(file_name, 'Medical Document') AS title FROM c_medications m LEFT JOIN c_documents d ON d.id = m.source_document_id WHERE {SURE} AND {like_any("lower(medicine_name)", rules.ANTIBIOTICS)})
, dx AS (SELECT * FROM c_documents WHERE processing_status IN ('completed', 'awaiting_review') AND (lower(category) = 'discharge summary' OR contains(lower(file_name), 'discharge')))
""" + _pair_sql("contains(lower(test_name), 'hba1c')", "%", "zx > ax", "Diabetes Progression Risk (Rising HbA1c)", ("Your HbA1c has increased from ", "% on ", " to ", "% on ", ", indicating worsening glycemic control and potential diabetes progression risk."), "zx >= 6.5")
+ " UNION ALL " + _pair_sql("lower(test_name) IN ('hemoglobin', 'hb')", " g/dL", "zx < ax AND zx < 12", "Anemia Alert (Falling Hemoglobin)", ("Your Hemoglobin level has fallen from ", " g/dL on ", " to ", " g/dL on ", ", indicating potential development or worsening of anemia."), "zx < 10") + """
UNION ALL SELECT patient_id, 'Frequent Antibiotic Use Warning', 'You have been prescribed antibiotic courses ' || count(*) || ' times recently. Frequent antibiotic usage can increase the risk of gut microbiome disruption and antibiotic resistance.', 'warning',
  string_agg(source_document_id || ' ' || title || ' ' || day::VARCHAR || ' Prescribed: ' || medicine_name || ' (' || coalesce(duration, 'Short course') || ')', '; ' ORDER BY day, id) FROM mx GROUP BY 1 HAVING count(*) >= 3
UNION ALL SELECT patient_id, 'Frequent Hospitalizations / Readmission Alert', 'The medical timeline records ' || count(*) || ' hospital discharge events, suggesting a high rate of hospitalization. Closer physician monitoring is recommended to prevent readmission.', 'critical',
  string_agg(id || ' ' || file_name || ' ' || created_on::VARCHAR || ' Hospitalization Record: ' || file_name, '; ' ORDER BY created_on, id) FROM dx GROUP BY 1 HAVING count(*) >= 2""")  # fmt: skip
def insights(l, m, d):
    out = timeline.insights(facts.verified(l), facts.verified(m), d)
    shown = F.transform("citations", lambda c: F.concat_ws(" ", c["document_id"], c["document_title"], c["date"].cast("string"), c["snippet"]))
    return out.withColumn("citations", F.array_join(shown, "; "))



@query("f18_triage_sessions", "triage", """
SELECT session_id, patient_id, reason_category, onset, severity, coalesce(symptoms, '') AS symptoms, coalesce(language, 'en') AS language, coalesce(reason_category, '') <> '' AND coalesce(onset, '') <> '' AND coalesce(severity, '') <> '' AS is_valid FROM c_triage""")  # fmt: skip
def triage_sessions(t):
    return briefs.triage_rows(t)


@query("f19_shown_facts", "documents diagnoses medications labs", """
, k AS (SELECT id, upper(regexp_replace(coalesce(nullif(category, ''), document_type, ''), '\\s+', '_', 'g')) AS t FROM c_documents)
SELECT x.id, 'diagnosis' AS kind FROM c_diagnoses x JOIN k ON k.id = x.source_document_id WHERE t IN (""" + ", ".join(f"'{x}'" for x in rules.SHOWN_KINDS["diagnosis"]) + """)
UNION ALL SELECT x.id, 'medication' FROM c_medications x JOIN k ON k.id = x.source_document_id WHERE t IN (""" + ", ".join(f"'{x}'" for x in rules.SHOWN_KINDS["medication"]) + """)
UNION ALL SELECT x.id, 'lab' FROM c_labs x JOIN k ON k.id = x.source_document_id WHERE t IN (""" + ", ".join(f"'{x}'" for x in rules.SHOWN_KINDS["lab"]) + ")")  # fmt: skip
def shown_facts(d, x, m, l):
    return briefs.shown_facts(facts.fact_union(diagnosis=x, medication=m, lab=l), d).select("id", "kind")


@query("t1_newest_first", "records documents diagnoses medications labs procedures", """
, e AS (SELECT id, patient_id, record_id, source_document_id FROM c_diagnoses WHERE verification_status = 'verified' UNION ALL SELECT id, patient_id, record_id, source_document_id FROM c_medications WHERE verification_status = 'verified'
  UNION ALL SELECT id, patient_id, record_id, source_document_id FROM c_labs WHERE verification_status = 'verified' UNION ALL SELECT id, patient_id, record_id, source_document_id FROM c_procedures WHERE verification_status = 'verified')
SELECT e.patient_id, e.id, row_number() OVER (PARTITION BY e.patient_id ORDER BY event_date DESC, e.id DESC) AS place FROM e JOIN c_records r USING (record_id) JOIN c_documents d ON d.id = e.source_document_id WHERE upper(coalesce(document_type, category)) NOT IN ('PHARMACY_INVOICE', 'OP_BILL_RECEIPT')""")  # fmt: skip
def newest_first(*tables):
    return summaries.newest(timeline.events(*tables), "patient_id", "event_date", "id").select("patient_id", "id", "place")


@query("o4_events_of_rejected", "diagnoses records", "SELECT id FROM c_diagnoses WHERE verification_status = 'pending_review' AND source_document_id NOT IN (SELECT source_document_id FROM c_diagnoses WHERE verification_status = 'rejected')")
def events_of_rejected(d, r):
    gone = d.where("verification_status = 'rejected'").select("source_document_id")
    return facts.without(d.where("verification_status = 'pending_review'"), gone, "source_document_id").select("id")


@query("x7_ages", "documents", f"SELECT id, date_diff('year', created_on, DATE '{AS_OF}') - CASE WHEN strftime(created_on, '%m%d') > strftime(DATE '{AS_OF}', '%m%d') THEN 1 ELSE 0 END AS age FROM c_documents WHERE created_on <= DATE '{AS_OF}'")
def ages(d):
    as_of = F.lit(AS_OF).cast("date")
    return d.where(F.col("created_on") <= as_of).select("id", norm.age(F.col("created_on"), as_of).alias("age"))


@query("w10_first_results", "labs", "SELECT id, lower(test_name) AS name FROM (SELECT *, row_number() OVER (PARTITION BY source_document_id, lower(test_name) ORDER BY test_date, id) AS k FROM c_labs) WHERE k = 1")
def first_results(l):
    return briefs.first_results(l).select("id", "name")


@query("x5_clean_units", "labs", "SELECT id, coalesce(unit IN (" + ", ".join(f"'{u}'" for u in rules.PLAIN_UNITS) + r") OR regexp_matches(unit, '^(x|10\^)?10\^\d+/(ul|cumm)$', 'i'), false) AS is_clean FROM c_labs")
def clean_units(l):
    return l.select("id", briefs.is_clean_unit(F.col("unit")).alias("is_clean"))


LEFT = ["labs", "medications", "diagnoses", "procedures", "records", "regions", "words", "versions", "jobs"]


@query("j9_document_cascade", "documents " + " ".join(LEFT), """
, gone AS (SELECT id FROM c_documents WHERE is_deleted)
""" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM c_{t} WHERE {k} NOT IN (SELECT id FROM gone)" for t, k in [(t, {"records": "'d' || substr(record_id, 2)"}.get(t, "document_id" if t in ("regions", "words", "versions", "jobs") else "source_document_id")) for t in LEFT]))
def document_cascade(d, *tables):
    key = {"records": F.concat(F.lit("d"), F.expr("substring(record_id, 2)"))}
    named = [(t, df.withColumn("document_id", key.get(t, F.col("document_id" if "document_id" in df.columns else "source_document_id") if t != "records" else None))) for t, df in zip(LEFT, tables, strict=True)]
    left = facts.cascade(named, d.where("is_deleted").select(F.col("id").alias("document_id")), "document_id")
    return reduce(DataFrame.unionByName, (df.agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n")) for t, df in left))


OWNED = ["documents", "labs", "medications", "diagnoses", "procedures"]


@query("j10_account_cascade", "patients " + " ".join(OWNED), """
, gone AS (SELECT id FROM c_patients WHERE user_id = 'u7')
""" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM c_{t} WHERE patient_id NOT IN (SELECT id FROM gone)" for t in OWNED))
def account_cascade(p, *tables):
    left = facts.cascade(list(zip(OWNED, tables, strict=True)), p.where("user_id = 'u7'").select(F.col("id").alias("patient_id")), "patient_id")
    return reduce(DataFrame.unionByName, (df.agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n")) for t, df in left))


EMERGENCY_MEDICATIONS = f"""
, a AS (SELECT DISTINCT patient_id, medicine_name, strength FROM c_medications WHERE verification_status = 'verified' AND {ACTIVE})
SELECT id AS patient_id, 'Metformin 500mg' AS name, 'patient-entered' AS provenance FROM c_patients WHERE manual_condition IS NOT NULL UNION ALL
SELECT a.patient_id, a.medicine_name || CASE WHEN strength IS NULL THEN '' ELSE ' ' || strength END, 'document-verified' FROM a WHERE NOT EXISTS (SELECT 1 FROM c_patients p WHERE p.id = a.patient_id AND p.manual_condition IS NOT NULL AND lower('Metformin 500mg') IN (lower(a.medicine_name), lower(a.medicine_name || ' ' || coalesce(strength, ''))))"""


@query("j12_emergency_medications", "patients medications", EMERGENCY_MEDICATIONS)
def emergency_medications(p, m):
    manual = p.where("manual_condition is not null").select(F.col("id").alias("patient_id"), F.lit("Metformin 500mg").alias("name"))
    return briefs.emergency_medications(manual, facts.active(m.where("verification_status = 'verified'"), AS_OF))


_items = lambda name, table: f"{name} AS (SELECT patient_id, list(struct_pack(value := name, provenance := provenance) ORDER BY provenance <> 'patient-entered', name) AS x FROM {table} GROUP BY 1)"
_list = lambda x: f"to_json(coalesce({x}, []))::VARCHAR"


@query("j12_emergency_profiles", "patients config labs diagnoses medications", f"""
, gr AS (WITH {BLOOD_GROUP_SQL[3:]}), e1 AS ({EMERGENCY_CONDITIONS}), e2 AS (WITH {EMERGENCY_MEDICATIONS[3:]})
, {_items("co", "e1")}, {_items("me", "e2")}
SELECT p.id AS patient_id, CASE WHEN coalesce(show_full_name, true) THEN full_name ELSE '{rules.HIDDEN}' END AS full_name,
  to_json(CASE WHEN NOT coalesce(show_blood_group, true) THEN struct_pack(value := '{rules.HIDDEN}', provenance := 'redacted', message := NULL::VARCHAR)
    WHEN gr.provenance = 'conflict' THEN struct_pack(value := gr.blood_group || ' (Manual) / ' || lab_value || ' (Lab)', provenance := gr.provenance, message := '{rules.GROUP_CONFLICT}')
    ELSE struct_pack(value := coalesce(lab_value, gr.blood_group, 'Unknown'), provenance := gr.provenance, message := NULL::VARCHAR) END)::VARCHAR AS blood_group,
  {_list("list_transform(list_filter(list_transform(string_split(coalesce(allergies, ''), '|'), lambda a: trim(a)), lambda a: a <> ''), lambda a: struct_pack(value := a, provenance := 'patient-entered'))")} AS allergies, {_list("co.x")} AS conditions, {_list("me.x")} AS medications
FROM c_patients p LEFT JOIN c_config c ON c.patient_id = p.id LEFT JOIN gr ON gr.patient_id = p.id LEFT JOIN co ON co.patient_id = p.id LEFT JOIN me ON me.patient_id = p.id""")  # fmt: skip
def emergency_profiles(p, c, l, d, m):
    out = briefs.emergency_profiles(p, c, facts.blood_groups(p, l), summaries.emergency_conditions(p, d), emergency_medications(p, m))
    return out.withColumns({n: shown_json(n) for n in ("blood_group", "allergies", "conditions", "medications")})


@query("n1_payload_rows", "full_payloads", """
, ok AS (SELECT document_id, patient_id, CASE WHEN json_valid(payload) THEN payload END AS p FROM c_full_payloads)
, g AS (SELECT * FROM ok WHERE json_extract_string(p, '$.documentType') IS NOT NULL)
, it AS (""" + " UNION ALL ".join(f"SELECT document_id, patient_id, '{kind}' AS record_type, unnest(range(json_array_length(p, '$.{arr}')::BIGINT)) AS position, '$.{arr}' AS path, '{title}' AS title, '{date}' AS date, p FROM g" for kind, arr, title, date in payloads.KINDS) + f""")
SELECT document_id, patient_id, record_type, position, sha256(document_id || '|' || record_type || '|' || position) AS record_id, json_extract_string(p, path || '[' || position || '].' || title) AS title,
  coalesce(CASE WHEN date <> '' THEN json_extract_string(p, path || '[' || position || '].' || date) END, json_extract_string(p, '$.documentDate.value'), '{AS_OF}')::DATE AS event_date, coalesce(json_extract_string(p, path || '[' || position || '].page')::INT, 1) AS source_page, 'pending_review' AS verification_status FROM it""")  # fmt: skip
def payload_rows(p):
    return payloads.records(p, AS_OF).select("document_id", "patient_id", "record_type", "position", "record_id", "title", "event_date", "source_page", "verification_status")


@query("n2_source_texts", "full_payloads", r"""
, t AS (SELECT document_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(payload, '"sourceText": "([^"]*)"', 1), lambda x: lower(trim(x))), lambda x: x <> ''))) AS source_text FROM c_full_payloads WHERE json_valid(payload)) SELECT * FROM t""")  # fmt: skip
def source_texts(p):
    return variants.source_texts(p)


@query("a17_event_summaries", "full_payloads", """
, ok AS (SELECT document_id, CASE WHEN json_valid(payload) THEN payload END AS p FROM c_full_payloads)
SELECT document_id, CASE json_extract_string(p, '$.documentType') WHEN 'DISCHARGE_SUMMARY' THEN 'Hospital Admission' WHEN 'PRESCRIPTION' THEN 'Prescription' WHEN 'LAB_REPORT' THEN 'Lab Test' ELSE 'Doctor Visit' END AS event_type,
  'Document processed. Contains ' || coalesce(json_array_length(p, '$.diagnoses'), 0) || ' diagnoses, ' || coalesce(json_array_length(p, '$.medications'), 0) || ' medications, and ' || coalesce(json_array_length(p, '$.labResults'), 0) || ' lab results.' AS summary FROM ok WHERE json_extract_string(p, '$.documentType') IS NOT NULL""")  # fmt: skip
def event_summaries(p):
    return payloads.event_summaries(p)


@query("j21_raw_medications", "full_payloads", """
, ok AS (SELECT document_id, payload AS p FROM c_full_payloads WHERE json_valid(payload) AND json_extract_string(payload, '$.documentType') IS NOT NULL)
, f AS (SELECT document_id, p, x.name FROM ok, (VALUES ('metformin'), ('Aspirin 81 mg'), ('Unknown')) x(name))
, k AS (SELECT document_id, name, p, unnest(range(json_array_length(p, '$.medications')::BIGINT)) AS i FROM f)
, h AS (SELECT *, lower(json_extract_string(p, '$.medications[' || i || '].medicineName')) AS r FROM k)
, m AS (SELECT document_id, name, min(i) AS i FROM h WHERE contains(r, lower(name)) OR contains(lower(name), r) GROUP BY 1, 2)
SELECT f.document_id, f.name AS medicine_name, json_extract_string(p, '$.medications[' || i || '].batch') AS batch, json_extract_string(p, '$.medications[' || i || '].expiry') AS expiry, json_extract_string(p, '$.medications[' || i || '].quantity') AS quantity FROM f LEFT JOIN m USING (document_id, name)""")  # fmt: skip
def raw_medications(p):
    named = p.where(F.get_json_object("payload", "$.documentType").isNotNull()).select("document_id", F.explode(F.array(*map(F.lit, ("metformin", "Aspirin 81 mg", "Unknown")))).alias("medicine_name"))
    return payloads.raw_medications(named, p)


@query("s8_training_rows", "chunks full_payloads", """
, c AS (SELECT document_id, patient_id, payload AS old, replace(payload, '"Gout"', '"Gouty arthritis"') AS new FROM c_full_payloads WHERE json_valid(payload))
SELECT document_id, c.patient_id, chunk_text AS original_ocr, old AS original_extraction, new AS corrected_extraction, 1.0::DOUBLE AS confidence, 'User Correction' AS reason, 1 AS version FROM c JOIN c_chunks USING (document_id) WHERE old <> new""")  # fmt: skip
def training_rows(c, p):
    new = p.withColumn("payload", F.replace("payload", F.lit('"Gout"'), F.lit('"Gouty arthritis"')))
    return payloads.training_rows(c, p, new)


@query("a8_unreadable", "full_payloads", "SELECT document_id, json_array_length(payload, '$.diagnoses')::BIGINT AS unreadable FROM c_full_payloads WHERE json_valid(payload) AND json_array_length(payload, '$.diagnoses') IS NOT NULL")
def unreadable(p):
    return payloads.unreadable(p, "$.diagnoses")


_flags, _found = _history_sql().split("FROM c_sessions) ", 1)


@query("a16_doctor_briefs", "sessions triage diagnoses medications labs procedures patients records", _flags + f"""FROM c_sessions)
, hi AS ({_found})
, t AS (SELECT 's' || session_id AS session_id, patient_id, reason_category, onset, severity, symptoms FROM c_triage WHERE coalesce(reason_category, '') <> '' AND coalesce(onset, '') <> '' AND coalesce(severity, '') <> '')
, f AS (SELECT 'diagnosis' AS type, id, name FROM c_diagnoses WHERE {SURE} UNION ALL SELECT 'procedure', id, name FROM c_procedures WHERE {SURE} UNION ALL SELECT 'medication', id, medicine_name FROM c_medications WHERE {SURE} UNION ALL SELECT 'lab_result', id, test_name || ': ' || value || ' ' || coalesce(unit, '') FROM c_labs WHERE {SURE})
, l AS (SELECT session_id, string_agg(name, '; ' ORDER BY type, id) FILTER (type IN ('diagnosis', 'procedure')) AS h, string_agg(name, '; ' ORDER BY id) FILTER (type = 'medication') AS m, string_agg(name, '; ' ORDER BY id) FILTER (type = 'lab_result') AS i FROM hi JOIN f USING (type, id) GROUP BY 1)
, sn AS (SELECT session_id, to_json(list(struct_pack(type := type, id := id, title := title, "date" := "date", details := details, relevance := reason, document_id := source_document_id) ORDER BY type, id))::VARCHAR AS sources FROM hi GROUP BY 1)
SELECT session_id, to_json(struct_pack(category := reason_category, onset := onset, severity := severity, symptoms := list_filter(string_split(coalesce(symptoms, ''), '|'), lambda x: x <> '')))::VARCHAR AS current_reason, coalesce(sources, '[]') AS sources, 'Patient presents with self-reported ' || reason_category || ' starting ' || onset || ' (' || coalesce(replace(symptoms, '|', ', '), 'no associated symptoms selected') || ').' AS patient_summary, severity, coalesce(h, '') AS relevant_history, coalesce(m, '') AS current_medications,
  coalesce(i, '') AS relevant_investigations, coalesce(p.allergies, '') AS allergies, '{rules.BRIEF_LIMITATIONS}' AS limitations FROM t LEFT JOIN l USING (session_id) LEFT JOIN sn USING (session_id) LEFT JOIN c_patients p ON p.id = t.patient_id""")  # fmt: skip
def doctor_briefs(s, t, d, m, l, p, people, records):
    d, m, l, p = (facts.verified(x) for x in (d, m, l, p))
    context = t.withColumn("session_id", F.concat(F.lit("s"), F.col("session_id").cast("string")))
    out = briefs.doctor_briefs(context, retrieval.relevant_history(s, d, m, l, p, AS_OF, records), None, people)
    return out.withColumns({c: shown_json(c) for c in ("current_reason", "sources")})


def _memory_sql() -> str:
    dash = lambda col: f"coalesce('- ' || {col}, 'None')"
    nl = " || chr(10) || "
    parts = ["'[PATIENT COMPACT CLINICAL MEMORY]'", "'Patient Name: ' || full_name", "'Age/DOB: N/A'", "'Blood Group: ' || coalesce(blood_group, 'N/A')", "''", "'Active Chronic Conditions:'", dash("dx.s"), "''", "'Resolved Conditions:'", "'None'", "''", "'Active Long-term Medications:'", dash("rx.s"), "''", "'Known Allergies:'", dash("al.s")]
    return nl.join(parts)


@query("a14_compressed_memories", "patients diagnoses medications", f"""
, dx AS (SELECT patient_id, string_agg(n, chr(10) || '- ' ORDER BY n) AS s FROM (SELECT DISTINCT patient_id, {canonical_sql("name", "diagnosis")} AS n FROM c_diagnoses WHERE {SURE} AND is_chronic) GROUP BY 1)
, rx AS (SELECT patient_id, string_agg(n, chr(10) || '- ' ORDER BY n) AS s FROM (SELECT DISTINCT patient_id, {canonical_sql("medicine_name", "medication")} || ' (' || coalesce(strength, 'N/A') || ')' AS n FROM c_medications WHERE {SURE} AND (end_date IS NULL OR contains(lower(duration), 'ongoing') OR contains(lower(duration), 'chronic'))) GROUP BY 1)
, al AS (SELECT id, string_agg(a, chr(10) || '- ' ORDER BY k) AS s FROM (SELECT id, trim(unnest(string_split(allergies, '|'))) AS a, generate_subscripts(string_split(allergies, '|'), 1) AS k FROM c_patients) WHERE a <> '' GROUP BY 1)
SELECT p.id AS patient_id, {_memory_sql()} AS memory FROM c_patients p LEFT JOIN dx ON dx.patient_id = p.id LEFT JOIN rx ON rx.patient_id = p.id LEFT JOIN al ON al.id = p.id""")  # fmt: skip
def compressed_memories(p, d, m):
    return briefs.memories(p, facts.verified(d), facts.verified(m))
