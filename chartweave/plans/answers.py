"""Queries that answer questions over records and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions.norm import like_any
from ..operators import briefs, facts, labs, meds, questions, timeline
from .patients import SWITCH_SQL, _memory_sql
from .queries import JOURNEY_SQL, PANEL_SQL, SURE, TERMS_SQL, query, shown_json
from ..functions.norm import canonical_sql

RECORD_TABLES = "diagnoses medications labs procedures"
_na = lambda c: f"coalesce(nullif({c}::VARCHAR, ''), 'N/A')"
_drug = f"medicine_name || ' ' || coalesce('(' || nullif(strength, '') || ')', '') || ' - Dosage: ' || {_na('dosage')} || ', Frequency: ' || {_na('frequency')} || ', Instructions: N/A '"
RECORDS = f"""
, rc AS (SELECT patient_id, 0 AS kind_no, 'diagnosis' AS kind, id, name, source_document_id AS document_id, '- Diagnosis: ' || name || ' - Chronic: ' || CASE WHEN is_chronic THEN 'Yes' ELSE 'No' END || ', Notes: ' || {_na("notes")} || ' (Status: ' || verification_status || ')' AS found_line,
    '- ' || name || ' ' || CASE WHEN is_chronic THEN '(Chronic)' ELSE '' END || ' - Notes: ' || coalesce(nullif(notes, ''), 'None') || ' [Status: ' || verification_status || ']' AS list_line, NULL::VARCHAR AS day FROM c_diagnoses WHERE {SURE}
  UNION ALL SELECT patient_id, 1, 'medication', id, medicine_name, source_document_id, '- Medication: ' || {_drug} || '(Status: ' || verification_status || ')', '- ' || {_drug} || '[Status: ' || verification_status || ']', NULL FROM c_medications WHERE {SURE}
  UNION ALL SELECT patient_id, 2, 'lab_result', id, test_name, source_document_id, '- Lab Result: ' || test_name || ' = ' || value || ' ' || coalesce(unit, '') || ' (Reference Range: N/A, Date: ' || {_na("test_date")} || ', Status: ' || verification_status || ')',
    '- ' || test_name || ': ' || value || ' ' || coalesce(unit, '') || ' (Date: ' || {_na("test_date")} || ', Ref Range: N/A) [Status: ' || verification_status || ']', test_date::VARCHAR FROM c_labs WHERE {SURE}
  UNION ALL SELECT patient_id, 3, 'procedure', id, name, source_document_id, '- Procedure: ' || name || ' - Date: ' || {_na("done_on")} || ', Notes: ' || {_na("notes")} || ' (Status: ' || verification_status || ')',
    '- ' || name || ' (Date: ' || {_na("done_on")} || ', Notes: ' || coalesce(nullif(notes, ''), 'None') || ') [Status: ' || verification_status || ']', done_on::VARCHAR FROM c_procedures WHERE {SURE})"""
_generic = ", ".join(f"'{w}'" for w in rules.GENERIC_WORDS)
_fold = lambda x: f"CASE WHEN contains({x}, 'hemo') OR contains({x}, 'haemo') THEN 'hemoglob' ELSE {x} END"
_meet = lambda t: f"contains({_fold(t)}, {_fold('w')}) OR contains({_fold('w')}, {_fold(t)}) OR contains({t}, w)"
ABSENT = rf"""
, qw AS (SELECT DISTINCT question_id, patient_id, unnest(list_filter(string_split_regex(regexp_replace(lower(trim(question)), '[?:!.,;()]', '', 'g'), '\s+'), lambda w: length(w) >= 3 AND w NOT IN ({_generic}))) AS w FROM c_asked)
, dw AS (SELECT DISTINCT patient_id, w FROM qw)
, hw AS (SELECT DISTINCT patient_id, w FROM dw JOIN (SELECT DISTINCT patient_id, lower(name) AS n FROM rc) USING (patient_id) WHERE {_meet("n")} UNION SELECT DISTINCT patient_id, w FROM dw JOIN (SELECT patient_id, lower(text) AS t FROM c_pages) USING (patient_id) WHERE {_meet("t")})
, ab AS (SELECT question_id, count(qw.w) > 0 AND count(hw.w) = 0 AS is_absent FROM (SELECT DISTINCT question_id FROM c_asked) LEFT JOIN qw USING (question_id) LEFT JOIN hw ON hw.patient_id = qw.patient_id AND hw.w = qw.w GROUP BY 1)"""


def recorded(*kinds):
    return questions.record_lines(*(facts.verified(k) for k in kinds))


def page_chunks(p):
    return p.select("patient_id", "document_id", F.col("text").alias("chunk_text"), F.col("file_name").alias("title"), "page_number")


@query("q1_absent_topics", "asked pages " + RECORD_TABLES, RECORDS + ABSENT + " SELECT * FROM ab")
def absent_topics(q, p, *kinds):
    return questions.absent(q, recorded(*kinds), page_chunks(p))


_low = "lower(line)"
FACILITIES = f"""
, fl AS (SELECT patient_id, unnest(string_split(text, chr(10))) AS line FROM c_pages WHERE contains(lower(text), 'hospital') OR contains(lower(text), 'clinic'))
, fc AS (SELECT DISTINCT patient_id, 'visit' AS kind, trim(line) AS line FROM fl WHERE {like_any(_low, ["hospital", "clinic", "medical center"])} AND length(line) < 60 UNION SELECT DISTINCT patient_id, 'doctor', trim(line) FROM fl WHERE {like_any(_low, ["dr.", "doctor"])} AND length(line) < 50)"""


@query("q4_facility_lines", "letters", FACILITIES.replace("c_pages", "c_letters") + " SELECT * FROM fc")
def facility_lines(l):
    return questions.facility_lines(l.select("patient_id", F.col("text").alias("chunk_text")))


TERMS = TERMS_SQL.replace("c_questions", "c_asked")
MENTIONS = TERMS + """
, m0 AS (SELECT question_id, min(document_id) AS text_document FROM q JOIN c_pages USING (patient_id) WHERE len(list_filter(terms, lambda t: contains(lower(text), t))) > 0 GROUP BY 1)
, m1 AS (SELECT question_id, text_document, terms, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 10) AS ps FROM m0 JOIN q USING (question_id) JOIN c_pages ON document_id = text_document)
, mn AS (SELECT question_id, text_document, coalesce(list_filter(ps, lambda x: len(list_filter(terms, lambda t: contains(lower(x), t))) > 0)[1], ps[1], '') AS snippet FROM m1)"""


@query("t5_first_paragraphs", "asked pages", MENTIONS + " SELECT question_id, text_document AS document_id, snippet FROM mn")
def first_paragraphs(q, p):
    return questions.mentioned_paragraphs(q, page_chunks(p))


_kinds = " ".join(f"WHEN {like_any('q', ws)} THEN '{k}'" for k, ws in rules.INTENTS.items())
_quote = lambda s: "'" + s.replace("'", "''") + "'"
_lists = " ".join(f"WHEN '{k}' THEN coalesce({_quote(a)} || chr(10) || list, {_quote(b)})" for k, (a, b) in rules.LISTS.items())


@query("q3_answers", "asked pages " + RECORD_TABLES, RECORDS + ABSENT + FACILITIES + MENTIONS + f"""
, pg AS (SELECT document_id, arg_min(file_name, page_number) AS title, min(page_number) AS page FROM c_pages GROUP BY 1)
, rq AS (SELECT rc.*, struct_pack(document_id := rc.document_id, document_title := coalesce(title, 'Medical Document'), page_number := coalesce(page, 1)::INT, "date" := coalesce(day, ''), snippet := name) AS ct FROM rc LEFT JOIN pg ON pg.document_id = rc.document_id)
, bs AS (SELECT question_id, patient_id, q, CASE {_kinds} ELSE 'text' END AS intent FROM (SELECT *, lower(trim(question)) AS q FROM c_asked))
, nm AS (SELECT question_id, {_quote(rules.MATCHING_HEAD)} || chr(10) || string_agg(found_line, chr(10) ORDER BY kind_no, id) AS by_name, string_agg(document_id || ': ' || name, '; ' ORDER BY kind_no, id) AS nc, list(ct ORDER BY kind_no, id) AS ncs FROM bs JOIN rq USING (patient_id)
   WHERE name <> '' AND (contains(q, lower(name)) OR len(list_filter(string_split_regex(lower(name), '\\s+'), lambda w: length(w) > 3 AND contains(q, w))) > 0) GROUP BY 1)
, ls AS (SELECT patient_id, kind AS intent, string_agg(list_line, chr(10) ORDER BY kind_no, id) AS list, string_agg(document_id || ': ' || name, '; ' ORDER BY kind_no, id) AS lc, list(ct ORDER BY kind_no, id) AS lcs FROM rq GROUP BY 1, 2)
, pl AS (SELECT patient_id, string_agg('- ' || line, chr(10) ORDER BY '- ' || line) FILTER (kind = 'visit') AS v, string_agg('- ' || line, chr(10) ORDER BY '- ' || line) FILTER (kind = 'doctor') AS d FROM fc GROUP BY 1)
, gn AS (SELECT patient_id, min(document_id) AS first_document FROM c_pages GROUP BY 1)
, al AS (SELECT bs.question_id, bs.patient_id, ncs, lcs, CASE WHEN is_absent THEN 'absent' WHEN by_name IS NOT NULL THEN 'records' ELSE bs.intent END AS route, by_name, nc, list, lc, v, d, pl.patient_id AS placed, first_document, text_document, snippet
   FROM bs JOIN ab USING (question_id) LEFT JOIN nm USING (question_id) LEFT JOIN ls ON ls.patient_id = bs.patient_id AND ls.intent = bs.intent LEFT JOIN pl ON pl.patient_id = bs.patient_id LEFT JOIN gn ON gn.patient_id = bs.patient_id LEFT JOIN mn USING (question_id))
SELECT question_id, al.patient_id, route, CASE route WHEN 'absent' THEN {_quote(rules.NOT_FOUND)} WHEN 'records' THEN by_name {_lists}
    WHEN 'facility' THEN CASE WHEN placed IS NULL THEN {_quote(rules.NO_FACILITY)} ELSE {_quote(rules.FACILITY_HEAD)} || CASE WHEN v <> '' THEN chr(10) || chr(10) || 'Hospitals/Clinics:' || chr(10) || v ELSE '' END || CASE WHEN d <> '' THEN chr(10) || chr(10) || 'Practitioners:' || chr(10) || d ELSE '' END END
    ELSE coalesce('I found a mention in your document:' || chr(10) || chr(10) || '"' || snippet || '"', {_quote(rules.NOT_FOUND)}) END AS answer,
  coalesce(CASE route WHEN 'records' THEN nc WHEN 'absent' THEN NULL WHEN 'facility' THEN CASE WHEN placed IS NOT NULL THEN first_document || ': Encounter metadata headers' END WHEN 'text' THEN text_document || ': ' || snippet ELSE lc END, '') AS citations,
  to_json(coalesce(CASE WHEN route = 'records' THEN ncs WHEN route IN ('absent') THEN NULL WHEN route IN ('facility', 'text') THEN CASE WHEN pg.document_id IS NOT NULL THEN [struct_pack(document_id := pg.document_id, document_title := coalesce(title, 'Medical Document'), page_number := page::INT, "date" := '', snippet := CASE route WHEN 'text' THEN snippet ELSE 'Encounter metadata headers' END)] END ELSE lcs END, []))::VARCHAR AS cited
  FROM al LEFT JOIN pg ON pg.document_id = CASE WHEN route = 'facility' AND placed IS NOT NULL THEN first_document WHEN route = 'text' THEN text_document END""")  # fmt: skip
def answers(q, p, *kinds):
    # records and pages of a document have one patient, so those of patients without a question are in no answer
    asked = questions.asking(q)
    p, *kinds = (x.join(asked, "patient_id", "left_semi") for x in (p, *kinds))
    return questions.answers(q, recorded(*kinds), page_chunks(p)).withColumn("cited", shown_json("cited"))


@query("j3_context_pages", "pages documents", "SELECT p.patient_id, document_id, coalesce(d.file_name, 'Medical Record') AS title, page_number, text FROM c_pages p JOIN c_documents d ON d.id = p.document_id")
def context_pages(p, d):
    return questions.context_pages(p.drop("patient_id"), d)


@query("j19_cited_records", "pages documents " + RECORD_TABLES, RECORDS + """
SELECT rc.id, coalesce(c.title, 'Medical Document') AS title, coalesce(page_number, 1) AS page_number FROM rc LEFT JOIN (SELECT document_id, arg_min(coalesce(file_name, 'Medical Record'), page_number) AS title, min(page_number) AS page_number FROM c_pages WHERE document_id IN (SELECT id FROM c_documents WHERE NOT is_deleted) GROUP BY 1) c ON c.document_id = rc.document_id""")  # fmt: skip
def cited_records(p, d, *kinds):
    live = p.join(d.where("not is_deleted").select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return questions.cited_chunks(recorded(*kinds), live.withColumnRenamed("file_name", "title")).select("id", "title", "page_number")


@query("q5_context_bundles", "asked pages patients " + RECORD_TABLES, RECORDS + TERMS + f"""
, pnl AS (SELECT patient_id, to_json(list(struct_pack(panel := panel, marker := marker, latest := latest, unit := unit, persistent_abnormality := persistent_abnormality, n_points := n_points, points := points) ORDER BY panel, marker))::VARCHAR AS panels FROM (WITH RECURSIVE {PANEL_SQL[3:]}) GROUP BY 1)
, swt AS (SELECT patient_id, to_json(list(struct_pack(seq := seq::INT, type := type, medicine := medicine, from_value := from_value, to_value := to_value, "date" := "date", reason := reason, evidence := evidence) ORDER BY seq))::VARCHAR AS switches FROM (WITH RECURSIVE {SWITCH_SQL[3:]}) GROUP BY 1)
, jrn AS (SELECT patient_id, to_json(list(struct_pack(canonical := canonical, status := status, milestones := milestones::INT, path := path) ORDER BY canonical))::VARCHAR AS journeys FROM (WITH RECURSIVE {JOURNEY_SQL[3:]}) GROUP BY 1)
, sc AS (SELECT question_id, document_id, text, len(list_filter(terms, lambda t: contains(lower(text), t))) AS score FROM q JOIN c_pages USING (patient_id))
, tp AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id) AS place FROM sc)
, cc AS (SELECT question_id, string_agg('[Document Citation ID: ' || (place - 1) || ']' || chr(10) || 'Title: ' || document_id || chr(10) || 'Text Snippet:' || chr(10) || '\"\"\"' || chr(10) || text || chr(10) || '\"\"\"', chr(10) || chr(10) ORDER BY place) AS chunk_context FROM tp WHERE place <= 15 GROUP BY 1)
, rl AS (SELECT patient_id, string_agg(found_line, chr(10) ORDER BY kind_no, id) AS record_context FROM rc GROUP BY 1)
, dx AS (SELECT patient_id, string_agg(n, chr(10) || '- ' ORDER BY n) AS s FROM (SELECT DISTINCT patient_id, {canonical_sql("name", "diagnosis")} AS n FROM c_diagnoses WHERE {SURE} AND is_chronic) GROUP BY 1)
, rx AS (SELECT patient_id, string_agg(n, chr(10) || '- ' ORDER BY n) AS s FROM (SELECT DISTINCT patient_id, {canonical_sql("medicine_name", "medication")} || ' (' || coalesce(strength, 'N/A') || ')' AS n FROM c_medications WHERE {SURE} AND (end_date IS NULL OR contains(lower(duration), 'ongoing') OR contains(lower(duration), 'chronic'))) GROUP BY 1)
, al AS (SELECT id, string_agg(a, chr(10) || '- ' ORDER BY k) AS s FROM (SELECT id, trim(unnest(string_split(allergies, '|'))) AS a, generate_subscripts(string_split(allergies, '|'), 1) AS k FROM c_patients) WHERE a <> '' GROUP BY 1)
, mm AS (SELECT p.id AS patient_id, {_memory_sql()} AS memory FROM c_patients p LEFT JOIN dx ON dx.patient_id = p.id LEFT JOIN rx ON rx.patient_id = p.id LEFT JOIN al ON al.id = p.id)
SELECT question_id, coalesce(chunk_context, '') AS chunk_context, coalesce(record_context, '') AS record_context, coalesce(memory, '') AS memory, coalesce(panels, '[]') AS panels, coalesce(switches, '[]') AS switches, coalesce(journeys, '[]') AS journeys
  FROM c_asked LEFT JOIN cc USING (question_id) LEFT JOIN rl USING (patient_id) LEFT JOIN mm USING (patient_id) LEFT JOIN pnl USING (patient_id) LEFT JOIN swt USING (patient_id) LEFT JOIN jrn USING (patient_id)""")  # fmt: skip
def context_bundles(q, p, people, d, m, l, o):
    # nothing is made for patients who have no question
    asked = questions.asking(q)
    p, d, m, l, o = (x.join(asked, "patient_id", "left_semi") for x in (p, d, m, l, o))
    people = people.join(asked.withColumnRenamed("patient_id", "id"), "id", "left_semi")
    every = l
    d, m, l, o = (facts.verified(x) for x in (d, m, l, o))
    panels = labs.panels(l).select("patient_id", "panel", "marker", "latest", "unit", "persistent_abnormality", F.col("n_points").cast("long").alias("n_points"), shown_json("points").alias("points"))
    switches = meds.switches(m, every).select("patient_id", "seq", "type", "medicine", "from_value", "to_value", "date", "reason", "evidence")
    journeys = timeline.journeys(d).select("patient_id", "canonical", "status", "milestones", "path")
    more = {"panels": questions.listed_json(panels, ["panel", "marker"]), "switches": questions.listed_json(switches, ["seq"]), "journeys": questions.listed_json(journeys, ["canonical"])}
    return questions.context_bundles(q, questions.record_lines(d, m, l, o), page_chunks(p), briefs.memories(people, d, m), more=more)
