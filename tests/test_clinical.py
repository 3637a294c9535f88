"""Single operators on small literal inputs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chartweave.functions import norm
from chartweave.operators import facts, labs, meds, reports, retrieval, timeline
from chartweave.streaming import admission

D = dt.date


def names(spark, rows, kind):
    df = spark.createDataFrame([(r,) for r in rows], "name string")
    return [r[0] for r in df.select(norm.canonical(F.col("name"), kind)).collect()]


def test_canonical_names(spark):
    assert names(spark, ["type ii dm", "HTN", "acid reflux"], "diagnosis") == ["Type 2 Diabetes Mellitus", "Hypertension", "Gastroesophageal Reflux Disease (GERD)"]
    assert names(spark, ["Glycomet 500mg", "aspirin 81 mg", "Lipitor tab", "Cough syrup 10 ml  sweet"], "medication") == ["Metformin", "Aspirin", "Atorvastatin", "Cough syrup sweet"]


def test_numbers_and_dates(spark):
    df = spark.createDataFrame([("5-10", "2026-07-05"), (" 6.5%", ""), ("trace", "soon"), (None, None)], "v string, d string")
    got = df.select(norm.leading_number(F.col("v")), norm.digits_number(F.col("v")), norm.shown_date(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(5.0, 510.0, "Jul 5, 2026"), (6.5, 6.5, "N/A"), (None, None, "soon"), (None, None, "N/A")]


def test_units(spark):
    df = spark.createDataFrame([("WBC", "15.74", "/cumm"), ("wbc count", "6.8", "10^3/uL"), ("RBC", "4.8", "millions"), ("Platelets", "250", "10*3"), ("Glucose", "90", "mg%")], "t string, v string, u string")
    got = [tuple(r[0]) for r in df.select(norm.clean_unit(F.col("t"), F.col("v"), F.col("u"))).collect()]
    assert got == [(None, None, "needs_review"), ("6.8", "10^3/uL", "normalized"), ("4.8", "10^6/uL", "normalized"), (None, None, "needs_review"), ("90", "mg%", "normalized")]


def test_safe_file_name(spark):
    df = spark.createDataFrame([("../../etc/passwd prescription.jpg",)], "n string")
    assert df.select(norm.safe_file_name(F.col("n"))).first()[0] == ".._.._etc_passwd_prescription.jpg"


LAB = "patient_id string, id string, test_name string, value string, unit string, test_date date, abnormal_flag boolean"


def test_panels_and_trends(spark):
    df = spark.createDataFrame([("p", "1", "HbA1c", "5.8", "%", D(2026, 1, 10), True), ("p", "2", "HbA1c", "6.4", "%", D(2026, 7, 10), True), ("p", "3", "HbA1c", "trace", "%", D(2026, 7, 11), False)], LAB)
    (row,) = labs.panels(df.where("id <> '3'")).where("marker = 'HBA1C'").collect()
    assert (row.panel, row.latest, row.highest, row.lowest, row.persistent_abnormality, row.n_points) == ("Diabetes Profile", "6.4", 6.4, 5.8, True, 2)
    (row,) = labs.trends(df, ["HbA1c"]).collect()
    assert (row.latest_value, row.trend_direction, row.n_points) == (6.4, "UPWARD", 2)
    (alert,) = labs.progressions(df.where("id <> '3'")).collect()
    assert alert.severity == "warning" and alert.last == 6.4


MED = "patient_id string, id string, medicine_name string, strength string, dosage string, start_date date, created_on date, end_date date, duration string"


def medicine(i, name, start=D(2026, 1, 1), end=None, strength=None, dosage=None, duration=None):
    return ("p", i, name, strength, dosage, start, D(2026, 1, 1), end, duration)


def test_safety(spark):
    rx = spark.createDataFrame([medicine("1", "Aspirin 81mg"), medicine("2", "Warfarin 5mg"), medicine("3", "Metformin 500mg"), medicine("4", "Metformin 1000mg"), medicine("5", "Amoxicillin", end=D(2023, 1, 1))], MED)
    patients = spark.createDataFrame([("p", "Aspirin| ")], "id string, allergies string")
    active = facts.active(rx, "2026-02-01")
    assert active.count() == 4
    assert meds.duplicates(active).count() == 0 and meds.duplicates(active, "canonical").first().n == 2
    got = {(r.type, r["items"]) for r in meds.safety_alerts(active, patients).collect()}
    assert got == {("allergy_conflict", "Aspirin 81mg + Aspirin"), ("drug_interaction", "Aspirin 81mg + Warfarin 5mg")}


def test_switches(spark):
    rx = spark.createDataFrame(
        [medicine("1", "Amlodipine", D(2026, 1, 10), strength="5mg"), medicine("2", "Amlodipine", D(2026, 3, 1), strength="10mg"), medicine("3", "Telmisartan", D(2026, 7, 12)), medicine("4", "Amlodipine", D(2026, 8, 1))], MED
    )
    pressure = spark.createDataFrame([("p", "1", "Blood Pressure", "155/90", "mmHg", D(2026, 7, 1), True)], LAB)
    got = [(r.seq, r.type, r.medicine, r.from_value, r.reason) for r in meds.switches(rx, pressure).orderBy("seq").collect()]
    assert got == [
        (1, "Started", "Amlodipine", None, None), (2, "Dose changed", "Amlodipine", "5mg", None), (3, "Replacement", "Telmisartan", "Amlodipine", "Blood pressure uncontrolled"),
        (4, "Started", "Telmisartan", None, None), (5, "Replacement", "Amlodipine", "Telmisartan", "Blood pressure uncontrolled"), (6, "Started", "Amlodipine", None, None),
    ]


def test_encounters(spark):
    docs = spark.createDataFrame(
        [("a", "p", D(2026, 7, 10), "City", None), ("b", "p", D(2026, 7, 11), " city ", "Dr X"), ("c", "p", D(2026, 7, 13), None, "dr x"), ("d", "p", D(2026, 7, 14), "City", None), ("e", "p", D(2026, 7, 14), None, None)],
        "id string, patient_id string, created_on date, hospital string, doctor string",
    )
    got = {r.document_id: (r.encounter, r.title) for r in timeline.encounters(docs).collect()}
    assert got == {"a": (1, "Admission at City"), "b": (1, "Admission at City"), "c": (1, "Admission at City"), "d": (2, "Admission at City"), "e": (3, "Doctor Visit on Jul 14, 2026")}


def test_journey(spark):
    dx = spark.createDataFrame(
        [("p", "1", "Diabetes", False, None, "verified", D(2026, 1, 10)), ("p", "2", "Type 2 Diabetes Mellitus", True, "Worsening control", "corrected", D(2026, 7, 18))],
        "patient_id string, id string, name string, is_chronic boolean, notes string, verification_status string, created_on date",
    )
    (row,) = timeline.journeys(dx).collect()
    assert (row.canonical, row.status, row.milestones, row.path) == ("Type 2 Diabetes Mellitus", "Progressing", 2, "Confirmed > Progressing")


def test_profile(spark):
    patients = spark.createDataFrame([("p", "Penicillin|Sulfa"), ("q", None)], "id string, allergies string")
    dx = spark.createDataFrame([("p", "Type 2 Diabetes Mellitus", True), ("p", "Acute Bronchitis", False)], "patient_id string, name string, is_chronic boolean")
    rx = spark.createDataFrame([medicine("1", "Metformin 500mg", duration="Ongoing daily use"), medicine("2", "Amoxicillin 250mg", duration="5 days")], MED)
    got = {r.patient_id: r for r in facts.profiles(patients, dx, rx).collect()}
    assert got["p"].conditions == ["Type 2 Diabetes Mellitus"] and got["p"].medications == ["Metformin 500mg"] and got["p"].allergies == ["Penicillin", "Sulfa"]
    assert got["q"].conditions == got["q"].medications == got["q"].allergies == []


REPORTS = {
    "cbc": "Apollo Health Diagnostics\nPatient Name: John Doe\nComplete blood count\nHemoglobin : 14.5 g/dL\nWBC : 6.8 10^3/uL\nRBC : 4.8 millions\nPlatelets : 250 10^3/uL\nMCV 90 fl, MCH 30 pg",
    "lipid": "Lipid profile\nTotal Cholesterol 220 mg/dL\nTriglycerides 165\nHDL 35\nLDL 130\nVLDL 30",
    "sugar": "HbA1c 6.8 %\nGlycated hemoglobin\nEstimated average glucose 148",
    "rx": "Rx\n1. x\n- Metformin 500mg twice daily after food\nAtorva 10 mg tablet once daily hs",
    "none": "nothing of the kind",
}


def test_reports(spark):
    df = spark.createDataFrame(list(REPORTS.items()), "document_id string, text string")
    got = {r.document_id: (r.document_type, r.confidence) for r in reports.classified(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {"cbc": "CBC", "lipid": "Lipid Profile", "sugar": "HbA1c", "rx": "Prescription", "none": "Other"}
    assert all(v[1] >= 0.85 for k, v in got.items() if k != "none")
    typed = df.join(reports.classified(df), "document_id")
    values = {(r.document_id, r.marker): (r.value, r.abnormal_flag) for r in reports.marker_values(typed).collect()}
    assert values["cbc", "HEMOGLOBIN"] == ("14.5", False) and values["cbc", "PLATELETS"] == ("250", False)
    assert values["lipid", "Cholesterol Total"] == ("220", True) and values["lipid", "HDL Cholesterol"] == ("35", True)
    assert [tuple(r) for r in reports.long_term_sugar(typed).collect()] == [("sugar", "6.8", True)]
    rx = {r.medicine_name: (r.dosage, r.frequency) for r in reports.prescribed(typed).collect()}
    assert rx["Metformin"] == ("500mg", "Twice Daily")
    assert {r.document_id: r.patient_name for r in reports.patient_names(df).collect()}["cbc"] == "John Doe"
    assert reports.missing_markers(typed, reports.marker_values(typed)).count() == 0


def test_lifecycle(spark):
    docs = spark.createDataFrame([("a", "p", "h", False, D(2026, 1, 1)), ("b", "p", "h", False, D(2026, 1, 2)), ("c", "q", "h", False, D(2026, 1, 2)), ("d", "p", "h", True, D(2025, 1, 1))], "id string, patient_id string, sha256_hash string, is_deleted boolean, created_on date")
    assert {r.id: r.existing_id for r in facts.unduplicated(docs).collect()} == {"a": None, "b": "a", "c": None}
    groups = facts.blood_groups(
        spark.createDataFrame([("p", "A+"), ("q", "b+ "), ("r", "O+"), ("s", None)], "id string, blood_group string"),
        spark.createDataFrame([("p", "1", "Blood Group", "B+", "verified"), ("q", "2", "ABO type", "B+", "verified"), ("r", "3", "Blood Group", "A", "rejected")], "patient_id string, id string, test_name string, value string, verification_status string"),
    )
    assert {r.patient_id: r.provenance for r in groups.collect()} == {"p": "conflict", "q": "document-verified", "r": "patient-entered", "s": "unknown"}


@pytest.mark.parametrize("seed", range(5))
def test_packed_lines_rejoin(seed):
    rng = random.Random(seed)
    lines = ["x" * rng.randint(0, 60) for _ in range(80)]
    chunks = retrieval.packed_lines("\n".join(lines), 100)
    assert all(len(c) <= 100 and c == c.strip() for c in chunks)
    assert [x for c in chunks for x in c.split("\n") if x] == [x for x in lines if x]


def test_admission_batches_equal_stream(spark, tmp_path):
    rng = random.Random(1)
    start = dt.datetime(2026, 1, 1)
    rows = [(i, "u1", "process", start + dt.timedelta(seconds=60 * i + rng.randint(0, 30))) for i in range(30)]
    schema = "event_id long, user_id string, action string, ts timestamp"
    batch = {r.event_id: (r.allowed, r.retry_after) for r in admission.admissions(spark.createDataFrame(rows, schema)).collect()}
    assert batch[0] == (True, 0) and not all(a for a, _ in batch.values()) and all(w >= 1 for a, w in batch.values() if not a)
    for k in range(3):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = (
            admission.admission_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
    got = {r.event_id: (r.allowed, r.retry_after) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == batch


def test_registered_queries_have_unique_columns(spark):
    from chartweave.plans.queries import ORACLE_SQL, QUERIES

    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) >= 50
    for name in ["a3_lab_panels", "g6_safety_alerts", "j14_relevant_history"]:
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_review_stream_rebuilds_touched_buckets(spark, tmp_path):
    from chartweave.operators import summaries
    from chartweave.streaming import refresh

    path, reviews = str(tmp_path / "t"), str(tmp_path / "reviews")
    people = spark.createDataFrame([(str(i), f"k{i}") for i in range(40)], "patient_id string, record_id string")
    summaries.rebuild(people.select("patient_id").withColumn("v", F.lit("old")), path)
    spark.createDataFrame([("k7",), (None,)], "record_id string").write.parquet(reviews)
    stream = spark.readStream.schema("record_id string").parquet(reviews)
    writer = refresh.refreshed(stream, people, lambda p: p.withColumn("v", F.lit("new")), path)
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 40
    new = {r.patient_id for r in rows if r.v == "new"}
    assert "7" in new and len({r.patient_bucket for r in rows if r.v == "new"}) == 1
    assert all(r.v == "old" for r in rows if r.patient_id not in new)


def test_document_stream_keeps_first_of_each_content(spark, tmp_path):
    from chartweave.streaming import refresh

    source, table = str(tmp_path / "in"), str(tmp_path / "documents")
    schema = "id string, patient_id string, sha256_hash string, created_at timestamp"
    t = dt.datetime(2026, 1, 1)
    for rows in ([("a", "p", "h", t), ("b", "p", "h", t), ("c", "q", "h", t)], [("d", "p", "h", t + dt.timedelta(days=9)), ("e", "p", "i", t + dt.timedelta(days=9))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        writer = refresh.new_documents(spark.readStream.schema(schema).parquet(source), table)
        writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    got = [(r.patient_id, r.sha256_hash) for r in spark.read.parquet(table).collect()]
    assert sorted(got) == [("p", "h"), ("p", "i"), ("q", "h")]


def test_payloads(spark):
    from chartweave.operators import intake

    assert intake.changes({"a": {"b": 1, "c": [1]}, "d": 2}, {"a": {"b": 2, "c": [1]}, "e": "x"}) == [("a.b", "1", "2"), ("d", "2", None), ("e", None, '"x"')]
    df = spark.createDataFrame([("1", '{"documentType": "LAB", "labResults": [{"testName": "Hb", "value": "9"}]}'), ("2", "{"), ("3", None), ("4", '{"labResults": []}')], "document_id string, payload string")
    good, bad = intake.payload_facts(df)
    assert [(r.document_id, r.test_name, r.value) for r in good.collect()] == [("1", "Hb", "9")]
    assert sorted(r.document_id for r in bad.collect()) == ["2", "3", "4"]
    files = spark.createDataFrame([(bytes.fromhex("255044462d"),), (bytes.fromhex("89504e47"),), (b"other",), (b"",)], "content binary")
    assert [(r.mime_type, r.accepted) for r in intake.admitted_uploads(files).collect()] == [("application/pdf", True), ("image/png", True), (None, False), (None, False)]


def test_lab_values_in_free_text():
    text = "Complete report\nHaemoglobin 15.6 gm%\nTotal WBC Count | 7,5 x10^3/uL\nPacked Cell Volume 40.2 %\nSGOT (AST) : 41 U/L; SGPT - 38 W/L\nHaemoglobin 12 gm%\nPlatelets\n250 10^3/uL\n14 %"
    got = {n: (v, u, s) for n, v, u, s in reports.named_values(text)}
    assert got["Haemoglobin"] == ("15.6", "gm%", "normalized")
    assert got["Total WBC Count"] == ("7.5", "x10^3/uL", "normalized")
    assert got["Packed Cell Volume"] == ("40.2", "%", "normalized")
    assert got["SGPT"] == ("38", "W/L", "needs_review")
    assert got["Platelets"] == ("250", "10^3/uL", "normalized")


def test_stated_diagnoses_of_any_length(spark):
    name = "x" * 1_000_005
    notes = spark.createDataFrame([("d1", f"Diagnosis: {name}\nImpression: Gout")], "document_id string, text string")
    got = {r.line_no: r.name for r in reports.stated_diagnoses(notes).collect()}
    assert got == {0: name, 1: "Gout"}
