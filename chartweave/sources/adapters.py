"""The driver's tables in the shape of clinical tables, as SQL that Spark and DuckDB read alike.

The generated tables are not clinical: names come from vocabularies by modulus, dates and flags from the
columns at hand. Operators see clinical columns only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import conforming


def pick(expr: str, words: list[str | None]) -> str:
    cases = " ".join(f"WHEN {i} THEN " + ("NULL" if w is None else f"'{w}'") for i, w in enumerate(words))
    return f"CASE ({expr}) % {len(words)} {cases} END"


STATUS = "CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_suppkey % 3 = 0 THEN 'corrected' ELSE 'verified' END ELSE CASE WHEN l_partkey % 4 = 0 THEN 'rejected' WHEN l_partkey % 4 = 1 THEN 'verified' ELSE 'pending_review' END END"
ROW = "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)"
FACT = f"{{kind}} || {ROW} AS id, CAST(o_custkey AS STRING) AS patient_id, 'r' || CAST(l_orderkey AS STRING) AS record_id, 'd' || CAST(l_orderkey AS STRING) AS source_document_id, {STATUS} AS verification_status, CAST(l_shipdate AS DATE) AS created_on"
FROM = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"

TESTS = ["HbA1c", "Hemoglobin", "Serum Creatinine", "Total Cholesterol", "Platelet Count", "WBC Count", "Blood Pressure", "AST (SGOT)", "Fasting Blood Sugar", "Blood Group", "Troponin I", "Serum Amylase"]
UNITS = ["%", "g/dL", "mg/dL", "mg/dL", "/uL", "10^3/uL", "mmHg", "U/L", "mg/dL", None, "ng/mL", "U/L"]
DRUGS = ["Metformin 500mg", "Aspirin 81 mg", "Warfarin 5mg", "Lipitor tab", "Amoxicillin 250mg", "Amlodipine 5mg", "Telmisartan 40mg", "Clopidogrel", "Azithromycin", "aspirin 81 mg ", "Losartan 50mg", "Contrast agent", "Cefixime 200mg"]
DISEASES = ["htn", "Type 2 Diabetes Mellitus", "Acute Bronchitis", "acid reflux", "Migraine", "Asthma", "Renal failure 2 mg", "Fracture of wrist", "Chronic gastritis", "Pneumonia", "Gout"]
OPERATIONS = ["Endoscopy", "CT Brain", "Coronary angiography", "Pacemaker implant", "Appendectomy", "Tooth extraction"]

TABLES = {
    "patients": f"""SELECT CAST(c_custkey AS STRING) AS id, 'u' || CAST(c_nationkey AS STRING) AS user_id, c_name AS full_name,
        {pick("c_custkey", ["A+", "O+", None, "B-"])} AS blood_group,
        {pick("c_custkey", ["Aspirin", "Penicillin|Sulfa", None, "Contrast| ", "amoxicillin|Dust"])} AS allergies,
        {pick("c_nationkey", ["htn", "Gout", None])} AS manual_condition FROM customer""",
    "documents": f"""SELECT 'd' || CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS patient_id,
        'h' || CAST(o_orderkey % 7 AS STRING) AS sha256_hash, o_orderkey % 11 = 0 AS is_deleted,
        {pick("o_orderkey", ["scan.pdf", "Discharge note.pdf", "lab report (1).pdf", "rx/2.jpg"])} AS file_name,
        {pick("o_orderkey", ["Prescription", "Discharge Summary", "Lab Report", "op_bill_receipt", "Other"])} AS category,
        {pick("o_orderkey", [None, None, "LAB_REPORT", "PHARMACY_INVOICE", None, None, "DISCHARGE_SUMMARY"])} AS document_type,
        {pick("o_orderkey", ["completed", "awaiting_review", "failed", "queued", "extracting"])} AS processing_status,
        {pick("o_orderkey", ["City Hospital", None, " city hospital", "Lake Clinic", None])} AS hospital,
        {pick("o_orderkey", [None, "Dr. Rao", "Dr. Lee"])} AS doctor,
        CAST(o_orderdate AS DATE) AS created_on FROM orders""",
    "labs": f"""SELECT {FACT.format(kind="'l'")}, {pick("l_partkey", TESTS)} AS test_name,
        CASE WHEN l_suppkey % 17 = 0 THEN 'trace' WHEN l_suppkey % 13 = 0 THEN '< ' || CAST(CAST(l_quantity AS INT) AS STRING)
        ELSE CAST(CAST(l_quantity AS INT) * (CASE WHEN l_partkey % 12 = 6 THEN 4 ELSE 1 END) AS STRING) || '.' || CAST(l_partkey % 10 AS STRING) END AS value,
        {pick("l_partkey", UNITS)} AS unit, l_returnflag = 'R' AS abnormal_flag, CAST(l_shipdate AS DATE) AS test_date {FROM} WHERE l_linenumber <= 4""",
    "medications": f"""SELECT {FACT.format(kind="'m'")}, {pick("l_partkey", DRUGS)} AS medicine_name,
        {pick("l_suppkey", ["5mg", "10mg", None])} AS strength, {pick("l_suppkey", ["1-0-1", "0-0-1"])} AS dosage,
        {pick("l_suppkey", ["Ongoing daily use", "5 days", None, "Lifetime"])} AS duration, {pick("l_suppkey", ["BD", "OD", None])} AS frequency,
        CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS start_date,
        CASE WHEN l_suppkey % 4 = 0 THEN CAST('1999-06-30' AS DATE) WHEN l_suppkey % 4 = 1 THEN CAST('2003-01-01' AS DATE) END AS end_date {FROM} WHERE l_linenumber IN (5, 6)""",
    "diagnoses": f"""SELECT {FACT.format(kind="'x'")}, {pick("l_partkey", DISEASES)} AS name, l_suppkey % 3 = 0 AS is_chronic,
        {pick("l_suppkey", [None, "Worsening control", "Improving on treatment", "stable"])} AS notes {FROM} WHERE l_linenumber = 7 AND l_partkey % 2 = 0""",
    "procedures": f"""SELECT {FACT.format(kind="'p'")}, {pick("l_partkey", OPERATIONS)} AS name, CAST(l_shipdate AS DATE) AS done_on,
        {pick("l_suppkey", [None, "Elective surgery", "of the abdomen"])} AS notes {FROM} WHERE l_linenumber = 7 AND l_partkey % 2 = 1""",
    "records": "SELECT 'r' || CAST(o_orderkey AS STRING) AS record_id, CAST(o_orderdate AS DATE) AS event_date FROM orders",
    "sessions": f"""SELECT 's' || CAST(event_id AS STRING) AS session_id, CAST(user_id AS STRING) AS patient_id,
        {pick("event_id", ["Pain", "Accident / Injury", "Fever", "Other"])} AS reason_category,
        {pick("event_id", ["stomach", "chest", None, "head", "left arm"])} AS problem_location,
        {pick("event_id", ["vomiting and cough", "fell down", None])} AS description FROM events WHERE event_type = 'signup'""",
    "requests": f"""SELECT event_id, CAST(user_id AS STRING) AS user_id, {pick("event_id", ["upload", "ask", "process"])} AS action, ts FROM events""",
    "jobs": f"""SELECT event_id AS id, 'd' || CAST(user_id AS STRING) AS document_id, {pick("event_id", ["queued", "preprocessing", "extracting", "completed", "failed"])} AS status, ts FROM events""",
    "reviews": f"""SELECT event_id AS id, 'k' || CAST(user_id AS STRING) AS record_id, {pick("event_id", ["name", "value"])} AS field_name,
        {pick("event_id", ["confirm", "reject", "unreadable", "edit"])} AS action, ts FROM events""",
    "versions": "SELECT 'd' || CAST(user_id AS STRING) AS document_id, event_id, ts FROM events WHERE event_type <> 'error'",
    "chunks": "SELECT doc_id AS document_id, text AS chunk_text, source AS patient_id FROM documents_",
    "questions": "SELECT conv_id * 1000 + turn AS question_id, 'src' || CAST(conv_id % 20 AS STRING) AS patient_id, text AS question FROM conversations WHERE role = 'user'",
}
#: Lines of invented reports by kind; $ is the quantity.
REPORT_LINES = [
    ["Haemoglobin : $.5 g/dl", "WBC count 1$,500 /cumm", "RBC $.1 millions", "Platelet count $0 10^3/uL", "MCV $ fl", "PCV $ %", "Lymphocytes $"],
    ["Total Cholesterol $0 mg/dL", "Triglycerides $5", "HDL Cholesterol $", "LDL - $9", "Lipid profile, fasting", "VLDL $", "Remarks none"],
    ["Rx Metformin $0 mg twice daily after food", "- Aspirin 81 mg once daily", "Cap Amoxil $5 mg tid after food", "Syrup Cough $ ml thrice", "take rest", "2 tab od", "Tablet Pan 4$ mg bd before food"],
    ["HbA1c $.3 %", "Glycated hemoglobin report", "Estimated average glucose 1$", "", "HbA1c again 9", "", ""],
    ["Bill No 77$", "Consultation fee 2$0", "Receipt charges", "CGST $", "Total amount 7$8.00", "Paid amount 7$8", ""],
    ["Total Bilirubin : $.4 mg/dL", "SGOT (AST) $ U/L", "SGPT (ALT) 3$ U/L", "Alkaline Phosphatase 9$", "Albumin 4.1", "Liver function", "Total protein 7"],
    ["Serum Creatinine $.1 mg/dL", "Blood Urea $ mg/dL", "Uric acid 5", "Sodium 14$", "Potassium 4", "Chloride 10$", "Kidney function"],
    ["City Pharmacy Tax Invoice expiry date", "Batch No AB$ Exp dt 12/26", "Paracetamol tablets qty $", "Rate $.00", "Total amount 4$0", "Expiry 11/25", "Disc amt 0"],
    ["Discharge Summary", "Date of admission 12/03/2021", "Date of discharge 1$/03/2021", "Final diagnosis: Acute Gastritis", "Hospital course stable", "Condition on discharge good", "Treatment given IV fluids"],
]


def report_line(n: int) -> str:
    texts = []
    for kind in REPORT_LINES:
        a, _, b = kind[n - 1].partition("$")
        texts.append(f"'{a}' || CAST(CAST(l_quantity AS INT) AS STRING) || '{b}'" if "$" in kind[n - 1] else f"'{a}'")
    kinds = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts))
    return f"max(CASE WHEN l_linenumber = {n} THEN CASE l_orderkey % {len(REPORT_LINES)} {kinds} END END)"


TABLES["reports"] = f"""SELECT 'd' || CAST(l_orderkey AS STRING) AS document_id, concat_ws(chr(10),
    CASE l_orderkey % 3 WHEN 0 THEN 'Patient Name : Mr. John ' || CAST(l_orderkey AS STRING) || '  Age: 40' WHEN 1 THEN 'name: Jane Roe, F' ELSE 'City Lab' END,
    {", ".join(report_line(n) for n in range(1, 8))}) AS text FROM lineitem GROUP BY l_orderkey"""
HEADS = ["25504446", "FFD8FF", "89504E47", "5249464600000000" + "57454250", "00"]
TABLES |= {
    "uploads": f"SELECT doc_id AS id, {pick('doc_id', HEADS)} || CASE WHEN doc_id % 23 = 0 THEN '' ELSE hex(text) END AS content_hex FROM documents",
    "tokens": "SELECT event_id AS id, ts AS expires_at, CASE WHEN user_id % 6 = 0 THEN ts END AS revoked_at FROM events",
    "config": "SELECT CAST(c_custkey AS STRING) AS patient_id, c_custkey % 2 = 0 AS show_full_name, c_custkey % 3 = 0 AS show_blood_group FROM customer WHERE c_custkey % 5 < 3",
    "words": "SELECT 'd' || CAST(l_orderkey AS STRING) AS document_id, l_suppkey % 3 AS page, l_linenumber % 2 AS block, l_partkey * 1000 + l_suppkey AS word_no, 'w' || CAST(l_partkey AS STRING) AS text, l_partkey % 500 AS x, l_suppkey % 700 AS y, CAST(l_quantity AS INT) AS w, 12 AS h, CASE WHEN l_partkey % 10 = 0 THEN -1.0 ELSE l_discount END AS confidence FROM lineitem",
    "regions": "SELECT 'd' || CAST(l_orderkey AS STRING) AS document_id, 'g' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS region_id, l_partkey % 500 AS x, l_suppkey % 7 AS y, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE 0.8 + l_discount END AS confidence, 'scan.pdf' AS file_name FROM lineitem",
    "payloads": """SELECT doc_id AS document_id, CASE WHEN doc_id % 19 = 0 THEN '{"labResults": [' WHEN doc_id % 17 = 0 THEN '{"labResults": []}' ELSE
        '{"documentType": "LAB_REPORT", "labResults": [{"testName": "T' || CAST(doc_id % 5 AS STRING) || '", "value": "' || CAST(n_chars AS STRING) || '", "sourceText": "the"}, {"testName": "Hb", "value": "1", "sourceText": " ' || lang || 't"}]}' END AS payload FROM documents""",
}
_n = lambda base, mod: f"CAST({base} + o_orderkey % {mod} AS STRING)"
TABLES["notes"] = f"""SELECT 'd' || CAST(o_orderkey AS STRING) AS document_id, concat_ws(chr(10), 'BP: ' || {_n(110, 60)} || '/' || {_n(60, 40)},
    CASE WHEN o_orderkey % 2 = 0 THEN 'Pulse ' || {_n(60, 50)} END, CASE WHEN o_orderkey % 3 = 0 THEN 'Temp ' || {_n(97, 5)} || '.4 F' ELSE 'Temp: ' || {_n(36, 4)} || ' C' END,
    {pick("o_orderkey", ["Diagnosis: Acute Gastritis", "Impression:  Viral fever ", None, "final diagnosis: ok", "Diagnoses: Gout"])},
    'Paracetamol strips batch: AB' || {_n(0, 90)} || ' exp: 12/2' || {_n(0, 9)} || ' price', CASE WHEN o_orderkey % 4 = 0 THEN 'Cough Syrup qty 2' END, 'BP: ' || {_n(90, 9)} || '/70', 'thank you') AS text FROM orders"""
BODIES = ["'Haemoglobin 13.5 g/dl reference range 12-16' || chr(10) || 'Serum Creatinine Level 1.1 mg/dl'", "'Tax Invoice No 5' || chr(10) || 'Total amount 90' || chr(10) || 'Pan tablet, batch no 3'", "'Bill No 7 total 500 consultation fee'", "'Rx Tab Metformin 500 mg twice daily' || chr(10) || 'medication: Cap. Amoxil 250mg once'", "'Discharge summary' || chr(10) || 'Admitted 1/2/2020 left 5/2/2020'", "'Medical certificate, fit to work'", "'Imaging of the brain'", "'vaccination card'", "'plain words'", "'Glucose Fasting 99 mg/dl normal' || chr(10) || 'phone 12345 urea 44'", "'take 1 tab bd'"]
_case = lambda expr, texts: f"CASE ({expr}) % {len(texts)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"
TABLES["letters"] = f"""SELECT 'd' || CAST(o_orderkey AS STRING) AS document_id, CAST(o_custkey AS STRING) AS patient_id,
    {pick("o_custkey", [None, "Auto Detect", "Lab Report", None, "Imaging  Report", None, "Holiday"])} AS category, concat_ws(chr(10),
    {pick("o_orderkey", ["Report Title: Annual check", None, "Title: X: Y", None, "title:"])}, {pick("o_custkey", ["Patient Name: Ann Lee", "Name: customer ", None, "name:"])},
    CASE o_orderkey % 3 WHEN 0 THEN 'Age: ' || CAST(20 + o_orderkey % 110 AS STRING) || ' Years' WHEN 1 THEN 'Age ' || CAST(o_orderkey % 90 AS STRING) END,
    {pick("o_orderkey", ["Sex: F", "Gender: male", "gender: other", None])}, {pick("o_custkey", ["MRN: 77 A", "Patient ID: P9", None, "MRN Number: 5"])},
    {pick("o_orderkey", ["City Hospital", "Lake Clinic Date: 1/2", "  Green Medical Center ", None, "Ward"])},
    {pick("o_custkey", ["Ref By: Dr. Anil Kumar, MD", "Consultant: Jane Roe", "seen by dr.Mehta today", "Doctor: X", None])},
    {pick("o_orderkey", ["Dated 12/03/2021", "On 2021-05-07", "On 07-Jan-2031", "On 45/99/2020", "On 2 weeks", "On 31.12.2019", None])},
    {_case("o_orderkey", BODIES)}) AS text FROM orders"""
#: Questions with words of every intent, of records, and of none.
ASKED = ["What is my HbA1c level?", "Which medicine should be taken", "Do you know any condition of mine", "Show my blood test results", "Any surgery in the past", "Which hospital or clinic was it", "zebra stripes", "haemoglobin?", "Is the gout better", "pulse and temp", "Metformin dose", "paracetamol strips", "is it", "can you recommend, or diagnose, the cause of your pain"]
TABLES |= {
    "asked": f"SELECT event_id AS question_id, CAST(user_id AS STRING) AS patient_id, {pick('event_id', ASKED)} AS question FROM events WHERE event_type <> 'error'",
    "pages": f"""SELECT document_id, patient_id, file_name, 1 AS page_number, text FROM ({TABLES["notes"].replace("SELECT ", "SELECT CAST(o_custkey AS STRING) AS patient_id, " + pick("o_orderkey", ["scan.pdf", None, "rx.jpg"]) + " AS file_name, ", 1)}) n""",
    "triage": f"""SELECT event_id AS session_id, CAST(user_id AS STRING) AS patient_id, {pick("event_id", ["Pain", None, "Fever", ""])} AS reason_category, {pick("event_id", ["today", "2 days", None])} AS onset,
        {pick("event_id", ["mild", "strong", "severe", None, "mild"])} AS severity, {pick("event_id", ["cough|fever", None])} AS symptoms, {pick("event_id", [None, "hi", "en"])} AS language FROM events WHERE event_type = 'signup'""",
    "full_payloads": """SELECT doc_id AS document_id, source AS patient_id, CASE WHEN doc_id % 19 = 0 THEN '{"labResults": [' WHEN doc_id % 17 = 0 THEN '{"diagnoses": []}' ELSE '{"documentType": "' || CASE doc_id % 3 WHEN 0 THEN 'LAB_REPORT' WHEN 1 THEN 'DISCHARGE_SUMMARY' ELSE 'PRESCRIPTION' END ||
        '", "documentDate": {"value": ' || CASE WHEN doc_id % 2 = 0 THEN '"2021-03-0' || CAST(1 + doc_id % 9 AS STRING) || '"' ELSE 'null' END || ', "sourceText": "Dated"}, "diagnoses": [{"name": "Gout", "isChronic": ' || CASE WHEN doc_id % 5 = 0 THEN 'true' ELSE 'false' END || ', "sourceText": " Gout since "}],' ||
        ' "medications": [{"medicineName": "Metformin ' || CAST(doc_id % 7 AS STRING) || '", "strength": "5mg", "batch": "B' || CAST(doc_id % 11 AS STRING) || '", "expiry": "12/26", "quantity": "10", "sourceText": "gout since"}, {"medicineName": "Aspirin", "page": 3}],' ||
        ' "labResults": [{"testName": "Hb", "value": "' || CAST(doc_id % 20 AS STRING) || '", "date": ' || CASE WHEN doc_id % 4 = 0 THEN '"2020-01-01"' ELSE 'null' END || ', "sourceText": "Hb"}], "procedures": [' || CASE WHEN doc_id % 6 = 0 THEN '{"name": "Endoscopy", "sourceText": ""}' ELSE '' END || ']}' END AS payload FROM documents""",
}
TABLES["chunks"] = TABLES["chunks"].replace("documents_", "documents")
BASE = ["customer", "orders", "lineitem", "events", "conversations", "documents"]


def needs(name: str) -> list[str]:
    """The driver's tables that a clinical table reads."""
    return [t for t in BASE if re.search(rf"(FROM|JOIN) {t}\b", TABLES[name])]


#: Rows of lineitem that one task joins with their orders, where there are at least ``MANY`` tasks' rows; fewer are left to Spark, which may broadcast orders.
DEALT, MANY = 1_000_000, 4


def by_document(frames: dict[str, DataFrame], text: str) -> tuple[dict[str, DataFrame], str]:
    """Lineitem and orders of a table of facts, dealt to as many tasks as their rows need, and the text that joins them so.

    They meet by the document's id in place of the order's number, so that rows stay where a join or a grouping by ``source_document_id`` wants them.
    """
    n = frames["lineitem"].count() // DEALT
    if n < MANY:
        return frames, text
    key = lambda column: f"'d' || CAST({column} AS STRING)"
    lineitem, orders = (frames[t].repartition(n, F.expr(key(c))) for t, c in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")))
    # a task's share of the orders is bounded, so it need not be sorted
    return {"lineitem": lineitem, "orders": orders.hint("shuffle_hash")}, text.replace("ON l_orderkey = o_orderkey", f"ON {key('l_orderkey')} = {key('o_orderkey')}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A clinical table over the files of ``sf_dir``."""
    text, frames = TABLES[name].replace("{", "{{").replace("}", "}}"), {}
    for t in needs(name):
        frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if FROM in text:
        frames, text = by_document(frames, text)
    for t in frames:
        text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return conforming(spark.sql(text, **frames), name)


def with_tables(names: str, sql: str) -> str:
    """``sql`` behind the clinical tables that it names, for a database that has the driver's tables.

    The clinical tables get a ``c_`` before their names, as some share a name with the driver's.
    """
    return "WITH RECURSIVE " + ",\n".join(f"c_{n} AS ({TABLES[n]})" for n in names.split()) + "\n" + sql
