"""Graph, insights, answers, letters and payloads on fixtures, and state folds against plain loops."""

import datetime as dt
import random

from chartweave.operators import briefs, facts, folds, labs, letters, meds, payloads, questions, reports, timeline


def day(text):
    return dt.date.fromisoformat(text)


def test_term_hits_equal_plain_containment(spark):
    rng = random.Random(1)
    letters_ = "abcde"
    word = lambda: "".join(rng.choice(letters_) for _ in range(rng.randint(1, 9)))
    texts = [(str(i % 3), i, " ".join(word() + rng.choice(["", ",", "-x"]) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [("0", 60, None), ("1", 61, "")]
    terms = [(str(i % 3), "".join(rng.choice(letters_) for _ in range(rng.randint(3, 5)))) for i in range(150)]
    got = questions.term_hits(spark.createDataFrame(terms, "patient_id string, term string"), spark.createDataFrame(texts, "patient_id string, document_id int, text string"))
    want = {(p, d, t) for p, d, x in texts if x for q, t in terms if p == q and t in x}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_ranking_fills_up_with_texts_without_a_term(spark):
    asked = spark.createDataFrame([(1, "p", "Fever fever and chills"), (2, "p", "is it")], "question_id long, patient_id string, question string")
    chunks = spark.createDataFrame([("p", k, t) for k, t in enumerate(["none", "feverish", "chills, fever", "none", ""])], "patient_id string, document_id long, chunk_text string")
    got = {(r.question_id, r.place): (r.document_id, r.score) for r in questions.ranked(asked, chunks, 3).collect()}
    assert got == {(1, 1): (2, 3), (1, 2): (1, 2), (1, 3): (0, 0), (2, 1): (0, 0), (2, 2): (1, 0), (2, 3): (2, 0)}


def test_encounters_equal_the_plain_rule(spark):
    rng = random.Random(2)
    rows = [(f"d{i}", str(i % 4), day("2024-01-01") + dt.timedelta(days=rng.randint(0, 25)), rng.choice([None, "City", " city ", "Lake"]), rng.choice([None, "Dr. A", "Dr. B"])) for i in range(120)]
    want = {}
    for patient in "0123":
        found = []
        for i, _, date, hospital, doctor in sorted((r for r in rows if r[1] == patient), key=lambda r: (r[2], r[0])):
            same = lambda a, b: a and b and a.lower().strip() == b.lower().strip()
            for e in found:
                if abs((date - e[0]).days) <= 3 and (same(hospital, e[1]) or same(doctor, e[2]) or not (hospital or e[1] or doctor or e[2])):
                    e[1], e[2] = e[1] or hospital, e[2] or doctor
                    e[3].append(i)
                    break
            else:
                found.append([date, hospital, doctor, [i]])
        want |= {i: (k, e[1], e[2]) for k, e in enumerate(found, 1) for i in e[3]}
    docs = spark.createDataFrame(rows, "id string, patient_id string, created_on date, hospital string, doctor string")
    assert {r.document_id: (r.encounter, r.hospital, r.doctor) for r in timeline.encounters(docs).collect()} == want


def test_graph_of_one_patient(spark):
    people = spark.createDataFrame([("p", "Ann")], "id string, full_name string")
    docs = spark.createDataFrame([("d1", "p", day("2026-07-01"), "Apollo Hospital", "Dr. Sharma"), ("d2", "p", day("2026-07-03"), "apollo hospital", None)], "id string, patient_id string, created_on date, hospital string, doctor string")
    dx = spark.createDataFrame([("x1", "p", "d1", "DM", day("2026-07-01"))], "id string, patient_id string, source_document_id string, name string, created_on date")
    rx = spark.createDataFrame([("m1", "p", "gone", "Metformin 500mg", day("2026-07-09"))], "id string, patient_id string, source_document_id string, medicine_name string, created_on date")
    lab = spark.createDataFrame([("l1", "p", "d2", "HbA1c", "6.7", "%", day("2026-07-03")), ("l2", "p", "d2", "HbA1c", "5.9", "%", day("2026-06-01"))], "id string, patient_id string, source_document_id string, test_name string, value string, unit string, test_date date")
    op = spark.createDataFrame([], "id string, patient_id string, source_document_id string, name string, done_on date")
    found = timeline.encounters(docs)
    rows = timeline.fact_nodes(dx, rx, lab, op, found)
    nodes = timeline.graph_nodes(people, found, rows)
    names = {(r.entity_type, r.canonical_name): r.node_id for r in nodes.collect()}
    assert set(names) == {
        ("Patient", "Patient Profile"), ("Encounter", "Admission at Apollo Hospital"), ("Encounter", "Encounter on Jul 9, 2026"), ("Hospital", "Apollo Hospital"), ("Doctor", "Dr. Sharma"),
        ("Diagnosis", "Type 2 Diabetes Mellitus"), ("Medication", "Metformin"), ("Lab Test", "HbA1c"), ("Lab Result", "HbA1c: 6.7 %"), ("Lab Result", "HbA1c: 5.9 %"),
    }
    at = {v: k for k, v in names.items()}
    edges = [(at[r.source][0], r.relationship_type, at[r.target][0]) for r in timeline.graph_edges(found, rows).collect()]
    for edge, n in {
        ("Patient", "belongs_to_encounter", "Encounter"): 2, ("Encounter", "performed_at", "Hospital"): 2, ("Encounter", "ordered_by", "Doctor"): 2, ("Encounter", "diagnosed_with", "Diagnosis"): 1,
        ("Patient", "diagnosed_with", "Diagnosis"): 1, ("Encounter", "prescribed", "Medication"): 1, ("Patient", "prescribed", "Medication"): 1, ("Lab Test", "caused", "Lab Result"): 2, ("Encounter", "ordered_by", "Lab Result"): 2,
    }.items():
        assert edges.count(edge) == n, edge
    assert len(edges) == 14


def test_nodes_keep_what_is_built_first(spark):
    people = spark.createDataFrame([("p", "Ann")], "id string, full_name string")
    docs = spark.createDataFrame([("d2", "p", day("2026-07-01"), "City", None), ("d1", "p", day("2026-07-02"), "city", "Dr. A"), ("d0", "p", day("2026-08-09"), "City", None)], "id string, patient_id string, created_on date, hospital string, doctor string")
    dx = spark.createDataFrame([("x2", "p", "d1", "gout", False, "b", day("2026-07-02")), ("x1", "p", None, "gout", True, "a", day("2026-09-01"))], "id string, patient_id string, source_document_id string, name string, is_chronic boolean, notes string, created_on date")
    none = "id string, patient_id string, source_document_id string, {} string, created_on date, value string, unit string, test_date date, done_on date, name string"
    rx, lab, op = (spark.createDataFrame([], none.format(c)) for c in ("medicine_name", "test_name", "x"))
    found = timeline.encounters(docs)
    rows = timeline.fact_nodes(dx, rx, lab, op, found)
    got = {(r.entity_type, r.canonical_name): r for r in timeline.graph_nodes(people, found, rows).collect()}
    visit = got["Encounter", "Admission at City"]
    assert visit.properties == {"date": "2026-07-01", "doctor_name": "Dr. A", "documents_count": "2", "hospital_name": "City"} and visit.source_documents == ["d2"] and visit.first_id == "d2"
    assert got["Diagnosis", "gout"].properties == {"confidence": None, "is_chronic": "true", "notes": "a", "verification_status": None} and got["Diagnosis", "gout"].source_documents == []
    assert got["Encounter", "Encounter on Sep 1, 2026"].properties == {"date": "2026-09-01"} and got["Patient", "Patient Profile"].properties == {} and {r.evidence_count for r in got.values()} == {1}
    edges = timeline.graph_edges(found, rows).collect()
    assert sorted(r.properties["date"] for r in edges if r.relationship_type == "performed_at") == ["2026-07-01", "2026-07-01", "2026-08-09"]
    assert sorted(r.properties["is_chronic"] for r in edges if "is_chronic" in r.properties) == ["false", "true"]


def test_insight_with_two_citations(spark):
    lab = spark.createDataFrame([("1", "p", "d1", "HbA1c", "5.9", day("2026-01-10")), ("2", "p", "d2", "HbA1c", "6.7", day("2026-06-15"))], "id string, patient_id string, source_document_id string, test_name string, value string, test_date date")
    rx = spark.createDataFrame([], "id string, patient_id string, source_document_id string, medicine_name string, duration string, start_date date, created_on date")
    docs = spark.createDataFrame([("d1", "p", "a.pdf", "Lab Report", "completed", day("2026-01-10"))], "id string, patient_id string, file_name string, category string, processing_status string, created_on date")
    (row,) = timeline.insights(lab, rx, docs).collect()
    assert row.severity == "critical" and "from 5.9% on Jan 10, 2026 to 6.7% on Jun 15, 2026" in row.description
    assert [(c.document_id, c.document_title, c.snippet) for c in row.citations] == [("d1", "a.pdf", "HbA1c: 5.9%"), ("d2", "Medical Document", "HbA1c: 6.7%")]


def test_letters(spark):
    text = "Title: Blood report\nPatient Name: Ann Lee\nAge: 45 Years\nSex: F\nMRN: 77\nCity Hospital\nRef By: Dr. Anil Kumar, MD\nDate 12/03/2021\nHaemoglobin 13.5 g/dl\nTab Metformin 500 mg once"
    df = spark.createDataFrame([("1", text, None), ("2", None, "Lab Report"), ("3", "", None)], "document_id string, text string, category string")
    got = {r.document_id: r for r in letters.headers(df).collect()}
    assert tuple(got["1"])[1:] == ("Blood report", "12/03/2021", "Ann Lee", "45", "Female", "77") and set(got["2"][1:]) == set(got["3"][1:]) == {None}
    assert {r.document_id: (r.hospital, r.doctor) for r in letters.visited(df).collect()}["1"] == ("City Hospital", "Dr. Anil Kumar")
    assert {r.document_id: r.document_type for r in letters.pattern_types(df).collect()} == {"1": "LAB_REPORT", "2": "NEEDS_REVIEW", "3": "NEEDS_REVIEW"}
    assert {r.document_id: (r.document_type, r.confidence) for r in letters.rule_types(df).collect()}["2"] == ("LAB_REPORT", 1.0)
    assert [(r.medicine_name, r.strength) for r in letters.medication_lines(df).collect()] == [("Metformin", "500 mg")]
    found = letters.headers(df).join(letters.pattern_types(df), "document_id").selectExpr("*", "'Bob' AS full_name")
    assert {(r.document_id, r.field) for r in letters.general_errors(found, "2021-01-01").collect()} == {("1", "documentDate"), ("1", "patientName")}
    states = letters.final_status(letters.pattern_types(df), letters.general_errors(found, "2022-01-01"))
    assert {r.document_id: r.status for r in states.collect()} == {"1": "completed", "2": "awaiting_review", "3": "awaiting_review"}


def test_kidney_values_and_type_errors(spark):
    df = spark.createDataFrame([("1", "KFT", "Serum Creatinine 1.9 mg/dL\nBlood Urea 30"), ("2", "HbA1c", "HbA1c 31 %"), ("3", "CBC", "WBC 7")], "document_id string, document_type string, text string")
    assert {(r.marker, r.value, r.abnormal_flag) for r in reports.marker_values(df).collect() if r.document_id == "1"} == {("Creatinine", "1.9", True), ("Urea", "30", False)}
    values = spark.createDataFrame([("2", "HbA1c", "31"), ("3", "WBC", "7")], "document_id string, test_name string, value string")
    none = spark.createDataFrame([], "document_id string, medicine_name string")
    typed = df.selectExpr("document_id", "document_type", "'Ann' AS patient_name")
    got = {(r.document_id, r.field) for r in letters.type_errors(typed, values, none, none).collect()}
    assert got == {("2", "labResults.hba1c.value"), ("3", "labResults.hemoglobin"), ("3", "labResults.platelets")}


def test_texts_of_type_errors_and_replaced_names(spark):
    long = "Paracetamol" * 15
    df = spark.createDataFrame([("1", "Prescription", None), ("2", "Prescription", None), ("3", "HbA1c", None)], "document_id string, document_type string, patient_name string")
    drugs = spark.createDataFrame([("1", long), ("1", "ab"), ("1", None), ("1", "Metformin"), ("3", "x")], "document_id string, medicine_name string")
    values = spark.createDataFrame([("3", "HbA1c", "31")], "document_id string, test_name string, value string")
    errors = letters.type_errors(df, values, drugs, df.limit(0))
    got = {(r.document_id, r.field): r.error for r in errors.collect()}
    assert got == {
        ("1", f"medications.{long[:20]}"): letters.rules.LONG_NAME, ("1", "medications.ab"): "Invalid medicine name", ("1", "medications.item"): "Invalid medicine name",
        ("2", "medications"): "Prescription must contain at least one medication entry", ("3", "labResults.hba1c.value"): "Unreasonable HbA1c value: 31%",
    }
    assert {r.medicine_name for r in letters.valid_names(drugs).collect()} == {"Invalid Medicine", "ab", None, "Metformin", "x"}
    assert {r.document_id: (r.is_valid, r.n_errors) for r in letters.validity(df, errors).collect()} == {"1": (False, 3), "2": (False, 1), "3": (False, 1)}


def test_payload_source_texts_and_raw_entries(spark):
    p = '{"documentType": "PRESCRIPTION", "documentDate": {"value": "2021-05-06", "sourceText": " Dated X"}, "medications": [{"medicineName": "Pan 40", "batch": "B1", "sourceText": "dated x"}, {"medicineName": "Pan 40 tab", "batch": "B2"}], "labResults": null}'
    df = spark.createDataFrame([("1", "p", p), ("2", "p", "{"), ("3", "p", None)], "document_id string, patient_id string, payload string")
    rows = payloads.records(df, "2024-01-01").collect()
    assert [(r.document_id, r.record_type, r.title, str(r.event_date), r.source_page) for r in sorted(rows, key=lambda r: r.position)] == [("1", "medication", "Pan 40", "2021-05-06", 1), ("1", "medication", "Pan 40 tab", "2021-05-06", 1)]
    texts = payloads.parsed(df).select(payloads.source_texts(payloads.F.col("p"), payloads.PAYLOAD).alias("t")).collect()
    assert [r.t for r in texts] == [["dated x"]]
    named = spark.createDataFrame([("1", "pan"), ("1", "Zinc")], "document_id string, medicine_name string")
    assert {r.medicine_name: r.batch for r in payloads.raw_medications(named, df).collect()} == {"pan": "B1", "Zinc": None}


def test_answers_take_the_first_route_that_holds(spark):
    dx = spark.createDataFrame([("x1", "p", "Gout", True, None, "d1", "verified")], "id string, patient_id string, name string, is_chronic boolean, notes string, source_document_id string, verification_status string")
    rx = spark.createDataFrame([("m1", "p", "Metformin", None, "1-0-1", "BD", "d1", "verified")], "id string, patient_id string, medicine_name string, strength string, dosage string, frequency string, source_document_id string, verification_status string")
    lab = spark.createDataFrame([], "id string, patient_id string, test_name string, value string, unit string, test_date date, source_document_id string, verification_status string")
    op = spark.createDataFrame([], "id string, patient_id string, name string, done_on date, notes string, source_document_id string, verification_status string")
    chunks = spark.createDataFrame([("p", "d1", "City Hospital\nseen by Dr. Rao\na walk in the garden")], "patient_id string, document_id string, chunk_text string")
    asked = spark.createDataFrame([(1, "p", "Is the gout better"), (2, "p", "Which pill should one take in the garden"), (3, "p", "Any surgery in the garden"), (4, "p", "Was the hospital in the garden"), (5, "p", "zebra"), (6, "p", "a garden walk")], "question_id long, patient_id string, question string")
    got = {r.question_id: r for r in questions.answers(asked, questions.record_lines(dx, rx, lab, op), chunks).collect()}
    assert {k: r.route for k, r in got.items()} == {1: "records", 2: "medication", 3: "procedure", 4: "facility", 5: "absent", 6: "text"}
    assert "- Diagnosis: Gout - Chronic: Yes, Notes: N/A (Status: verified)" in got[1].answer and got[1].citations == "d1: Gout"
    assert "Metformin  - Dosage: 1-0-1, Frequency: BD" in got[2].answer and got[3].answer.startswith("I couldn't find any medical procedures")
    assert "- City Hospital" in got[4].answer and "- seen by Dr. Rao" in got[4].answer and '"a walk in the garden"' in got[6].answer


def test_emergency_medications_and_cascades(spark):
    manual = spark.createDataFrame([("p", "metformin 500mg")], "patient_id string, name string")
    rx = spark.createDataFrame([("p", "Metformin", "500mg"), ("p", "Aspirin", None)], "patient_id string, medicine_name string, strength string")
    assert {(r.name, r.provenance) for r in briefs.emergency_medications(manual, rx).collect()} == {("metformin 500mg", "patient-entered"), ("Aspirin", "document-verified")}
    rows = spark.createDataFrame([("a", "d1"), ("b", "d2"), ("c", None)], "id string, document_id string")
    left = dict(facts.cascade([("t", rows), ("u", rows)], rows.where("id = 'a'"), "document_id"))
    assert {k: sorted(r.id for r in df.collect()) for k, df in left.items()} == {"t": ["b", "c"], "u": ["b", "c"]}
    assert labs and meds


def gapped(rng, users, n):
    """Requests in bursts with pauses, some shorter and some longer than a bucket takes to fill."""
    rows, at = [], {u: 0 for u in users}
    for i in range(n):
        user = rng.choice(users)
        at[user] += rng.choice([0, 1000, 40_000_000, 300_000_000, 899_999_000, 900_000_000, 900_001_000, 2_000_000_000])
        rows.append((i, user, rng.choice(["upload", "process", "other"]), dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=at[user])))
    return rows


def plain_decisions(rows):
    from chartweave.streaming.admission import next_state, rules

    states, out = {}, {}
    for i, user, action, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        now = (ts - dt.datetime(1970, 1, 1)) / dt.timedelta(milliseconds=1)
        states[user, action], ok, wait = next_state(states.get((user, action)), now, rules.RATE_LIMITS.get(action))
        out[i] = (ok, wait)
    return out


def test_admissions_between_pauses_equal_the_plain_fold(spark):
    from chartweave.streaming import admission

    rows = gapped(random.Random(3), ["a", "b", None], 3000)
    got = admission.admissions(spark.createDataFrame(rows, "event_id long, user_id string, action string, ts timestamp").repartition(5))
    assert {r.event_id: (r.allowed, r.retry_after) for r in got.collect()} == plain_decisions(rows) and got.count() == 3000


def test_one_user_of_a_million_requests(spark):
    import numpy as np
    import pandas as pd
    from chartweave.operators.ranges import segments
    from chartweave.streaming import admission

    rng = np.random.default_rng(4)
    at = np.cumsum(rng.choice([0, 1_000_000, 60_000_000, 1_000_000_000], 1_000_000, p=[0.2, 0.5, 0.29, 0.01])).astype("int64")
    rows = spark.createDataFrame(pd.DataFrame({"event_id": np.arange(1_000_000), "us": at})).selectExpr("event_id", "'hot' user_id", "'ask' action", "timestamp_micros(us) ts")
    keyed = rows.selectExpr("'hot' key", "event_id", "unix_micros(ts) at_us")
    parts = segments(keyed, "key", ["at_us", "event_id"], admission.full_again).groupBy("segment").count().selectExpr("count(*) n", "max(count) most", "max(segment) last").first()
    assert parts.n == parts.last == 1 + int((np.diff(at) >= 900_001_000).sum()) and parts.most < 5000  # so no task folds the user alone
    got = admission.admissions(rows).toPandas().sort_values("event_id")
    bucket, want = admission.Bucket("hot"), []
    for i, us in enumerate(at.tolist()):
        want += [x[3:] for x in bucket.row("hot", i, "hot", "ask", us)]
    assert list(zip(got.allowed, got.retry_after, strict=True)) == want


def test_running_numbers_of_large_and_small_keys(spark):
    from chartweave.operators.ranges import numbered, summed

    rng = random.Random(5)
    rows = [(rng.choice(["x"] * 8 + ["y", "z", None]), rng.randint(0, 50), i, rng.randint(-3, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t int, i int, part__ int").repartition(6)
    places, sums, at, total = {}, {}, {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        total[k] = total.get(k, 0) + v
        sums[i] = total[k]
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2]), reverse=True):
        at[k] = places[i] = at.get(k, 0) + 1
    got = numbered(df, "k", ["t", "i"], "place", descending=True)
    assert {r.i: r.place for r in got.collect()} == places and got.columns == ["k", "t", "i", "part__", "place"]
    assert {r.i: r.s for r in summed(df, "k", ["t", "i"], payloads.F.col("part__"), "s").collect()} == sums
    assert numbered(df.limit(0), "k", ["t"], "place").count() == 0


def test_ranking_by_blocks_equals_scoring_everything(spark, monkeypatch):
    monkeypatch.setattr(questions, "BLOCK", 16)
    rng = random.Random(6)
    words = [f"term{k}" for k in range(8)] + ["plain", "some"]
    chunks = [(rng.choice("pq"), i, " ".join(rng.choices(words, k=rng.randint(0, 6)))) for i in range(400)]
    asked = [(i, rng.choice("pqr"), " ".join(rng.choices(words, [1, 1, 2, 3, 5, 8, 9, 9, 9, 9], k=rng.randint(0, 5)))) for i in range(60)]
    want = {}
    for i, patient, question in asked:
        terms = [t for t in question.split() if len(t) > 3]
        scored = sorted((-sum(t in text for t in terms), d) for p, d, text in chunks if p == patient)[:5]
        want |= {(i, k): (d, -s) for k, (s, d) in enumerate(scored, 1)}
    q = spark.createDataFrame(asked, "question_id long, patient_id string, question string")
    c = spark.createDataFrame(chunks, "patient_id string, document_id long, chunk_text string")
    assert {(r.question_id, r.place): (r.document_id, r.score) for r in questions.ranked(q, c, 5).collect()} == want
    # few rows are scored: not every block of every set
    sets = questions.asked_sets(q).select("patient_id", "asked").distinct()
    hits = questions.term_hits(sets.select("patient_id", payloads.F.explode("asked.term").alias("term")), c.selectExpr("patient_id", "document_id", "chunk_text text"))
    every = sum(any(t in text for t in question.split() if len(t) > 3) for _, p, question in asked for r, _, text in chunks if p == r)
    assert questions.scored_sets(sets, hits, 5).count() < every / 2


def test_folds_hold_a_key_whole_behind_a_join_that_becomes_a_broadcast(spark):
    class Counted:
        """Says how many rows a key had."""

        def __init__(self, key):
            self.key, self.n = key, 0

        def row(self, *values):
            self.n += 1
            return []

        def end(self):
            return [(self.key, self.n)]

    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 4000, 1, 4).selectExpr("cast(id % 10 as string) as k", "id")
        joined = rows.join(spark.createDataFrame([("1", True)], "k string, x boolean"), "k", "left").select("k", "id")
        got = folds.folded(joined, "k", ["id"], Counted, "k string, n int").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert sorted(map(tuple, got)) == [(str(k), 400) for k in range(10)]


def test_every_block_of_texts_meets_every_part_of_sets(spark, monkeypatch):
    monkeypatch.setattr(questions, "BLOCK", 16)
    monkeypatch.setattr(questions, "SETS", 4)
    rng = random.Random(7)
    words = [f"term{k}" for k in range(12)] + ["xterm1y", "longerterm11", "some"]
    chunks = [("p", f"d{i}", " ".join(rng.choices(words, k=rng.randint(0, 6)))) for i in range(100)]
    asked = [(i, "p", " ".join(rng.choices(words, k=rng.randint(0, 5)))) for i in range(40)]
    want, first = {}, {}
    for i, _, question in asked:
        terms = [t for t in question.split() if len(t) > 3]
        scored = sorted((-sum(t in text for t in terms), d) for _, d, text in chunks)
        want |= {(i, k): (d, -s) for k, (s, d) in enumerate(scored[:7], 1)}
        first |= {i: min(d for s, d in scored if s) for _ in "x" if scored[0][0]}
    q = spark.createDataFrame(asked, "question_id long, patient_id string, question string")
    c = spark.createDataFrame(chunks, "patient_id string, document_id string, chunk_text string")
    assert {(r.question_id, r.place): (r.document_id, r.score) for r in questions.ranked(q, c, 7).collect()} == want
    assert dict(map(tuple, questions.first_mentions(q, c).collect())) == first


def test_a_source_is_one_patient_of_ranked_texts(spark):
    from chartweave.plans.queries import ORACLE_SQL
    from chartweave.sources.adapters import table

    sf = "/root/testdata/sf0.001"
    texts, asked = table(spark, sf, "chunks"), table(spark, sf, "questions")
    assert {r.patient_id for r in texts.select("patient_id").distinct().collect()} == {r.source for r in spark.read.parquet(f"{sf}/documents.parquet").select("source").distinct().collect()}
    assert asked.join(texts.select("patient_id").distinct(), "patient_id", "left_anti").count() == 0
    assert all("source AS patient_id FROM documents" in ORACLE_SQL[n] for n in ("t3_ranked_chunks", "t5_first_mentions"))


def test_reports_are_classified_once(spark):
    import __spark_entry__

    for name in ("d1_missing_markers", "d1_type_errors", "d1_valid_documents"):
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "classification(" not in plan  # it stands behind a checkpoint


def test_counts_of_a_graph_are_those_of_its_nodes_and_edges(spark):
    from chartweave.plans import patients
    from chartweave.sources.adapters import table

    p, *rest = (table(spark, "/root/testdata/sf0.001", n) for n in patients.GRAPH_TABLES.split())
    found, rows = patients.graph_rows(*rest)
    want = timeline.graph_sizes(timeline.graph_nodes(p, found, rows), timeline.graph_edges(found, rows))
    assert sorted(map(tuple, timeline.graph_counts(p, found, rows).collect())) == sorted(map(tuple, want.collect()))


def test_answers_meet_pages_by_no_null_key(spark):
    from chartweave.plans import answers
    from chartweave.sources.adapters import table

    names = f"asked pages {answers.RECORD_TABLES}".split()
    plan = answers.answers(*(table(spark, "/root/testdata/sf0.001", n) for n in names))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join LeftOuter" in line and "cited_id" in line]


def test_encounters_of_a_busy_patient_are_those_of_one_fold(spark):
    rng = random.Random(8)
    rows = [(f"d{i}", None if i % 9 == 0 else str(i % 5 // 3), day("2024-01-01") + dt.timedelta(days=rng.randint(0, 60)), rng.choice([None, "", "City", "Lake"]), rng.choice([None, "Dr. A"])) for i in range(120)]
    docs = spark.createDataFrame(rows, "id string, patient_id string, created_on date, hospital string, doctor string")
    want = sorted(map(str, timeline.encounters(docs).collect()))
    assert len(want) == 120 and sorted(map(str, timeline.encounters(docs, busy=30).collect())) == want


def test_nodes_are_grouped_without_maps_and_without_encounters_that_stand_already(spark):
    from chartweave.plans import patients
    from chartweave.sources.adapters import table

    p, *rest = (table(spark, "/root/testdata/sf0.001", n) for n in patients.GRAPH_TABLES.split())
    found, rows = patients.graph_rows(*rest)
    assert not [f.name for f in rows.schema if f.dataType.typeName() == "map"]
    plan = timeline.graph_nodes(p, found, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "map" not in plan[plan.index("Aggregate") :]
    own = rows.where("is_own").join(found.select("document_id", "patient_id", "title"), ["document_id", "patient_id"])
    assert own.count() == rows.where("is_own").count() > 0 and own.where("title <> encounter_title").count() == 0


def scans(frame):
    """How many files a plan reads."""
    return sum(1 for line in frame._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation [" in line)


def test_letters_are_read_once(spark):
    import __spark_entry__
    from chartweave import rules
    from pyspark.sql import functions as F

    queries = __spark_entry__.queries()
    # letters alone, and letters with patients
    assert scans(queries["e13_plain_facts"](spark, "/root/testdata/sf0.001")) == 1
    assert scans(queries["d2_d3_general_errors"](spark, "/root/testdata/sf0.001")) == 2
    # a match parted by itself has the groups that it has in its text
    rng = random.Random(5)
    bits = ["ref", "refs", "normal", "to", " ", " ", "\n", "12", "3.5", ".", "-", "/", "%", "g/dl", "mg", "_", ":", "Serum Urea", "WBC (total)", "x", "9^3/uL"]
    texts = spark.createDataFrame([("".join(rng.choice(bits) for _ in range(rng.randint(1, 25))),) for _ in range(1500)], "text string")
    every = lambda group: F.regexp_extract_all("text", F.lit(rules.PLAIN_LAB), F.lit(group))
    for group in (1, 2, 3):
        parted = F.transform(every(0), lambda m: F.regexp_extract(m, rules.PLAIN_LAB, group))
        assert texts.where(parted != every(group)).count() == 0


def test_briefs_read_facts_once(spark):
    import __spark_entry__

    # triage and patients, and each of four kinds of facts once: lines, orders, sessions and records
    assert scans(__spark_entry__.queries()["a16_doctor_briefs"](spark, "/root/testdata/sf0.001")) == 18


def test_bundles_are_made_for_patients_with_questions_only(spark, monkeypatch):
    from chartweave.plans import answers
    from chartweave.sources.adapters import table

    given = {}
    monkeypatch.setattr(answers.questions, "context_bundles", lambda q, records, chunks, memories, more: given.update(q=q, records=records, chunks=chunks, memories=memories))
    q, *rest = (table(spark, "/root/testdata/sf0.001", n) for n in f"asked pages patients {answers.RECORD_TABLES}".split())
    answers.context_bundles(q.where("patient_id = '7'"), *rest)
    assert {r.patient_id for n in ("records", "chunks", "memories") for r in given[n].select("patient_id").distinct().collect()} <= {"7"}


def test_texts_carry_numbers_of_terms(spark, monkeypatch):
    seen, blocks = {}, questions.block_bests
    monkeypatch.setattr(questions, "block_bests", lambda sets, texts, *more: seen.update(sets=sets, texts=texts) or blocks(sets, texts, *more))
    asked = spark.createDataFrame([(i, "p", "alpha beta beta") for i in range(3)] + [(9, "p", "it is")], "question_id long, patient_id string, question string")
    chunks = spark.createDataFrame([("p", 1, "nothing"), ("p", 2, "alphabeta"), ("p", 3, "beta"), ("q", 4, "alpha")], "patient_id string, document_id long, chunk_text string")
    got = sorted(map(tuple, questions.ranked(asked, chunks, 3).collect()))
    assert got == sorted([(i, d, s, k) for i in range(3) for k, (d, s) in enumerate([(2, 3), (3, 2), (1, 0)], 1)] + [(9, k, 0, k) for k in (1, 2, 3)])
    assert seen["texts"].schema["terms"].dataType.simpleString() == "array<int>" and "string" not in seen["sets"].schema["asked"].simpleString()
    words = spark.range(0, 1000, 1, 7).selectExpr("'t' || (id % 300) as term")
    assert sorted(r.code for r in questions.term_codes(words).collect()) == list(range(300))


def test_contexts_are_put_together_once_for_equal_questions(spark, monkeypatch):
    seen, ranks = {}, questions.ranked_sets
    monkeypatch.setattr(questions, "ranked_sets", lambda *a: seen.setdefault("x", ranks(*a)))
    asked = spark.createDataFrame([(i, "p", "Alpha beta?") for i in range(50)] + [(50, "q", "alpha"), (51, None, "alpha"), (52, "p", None)], "question_id long, patient_id string, question string")
    chunks = spark.createDataFrame([("p", "d1", "none"), ("p", "d2", "alpha"), ("p", "d3", "beta alpha")], "patient_id string, document_id string, chunk_text string")
    records = spark.createDataFrame([("p", 0, "x1", "line")], "patient_id string, kind_no int, id string, found_line string")
    memories = spark.createDataFrame([("q", "well")], "patient_id string, memory string")
    rows = {r.question_id: r for r in questions.context_bundles(asked, records, chunks, memories, 2).collect()}
    assert len(rows) == 53 and seen["x"][1].count() == 4  # two texts for each of the two sets of p
    text = lambda k, d, t: f'[Document Citation ID: {k}]\nTitle: {d}\nText Snippet:\n"""\n{t}\n"""'
    assert {rows[i].chunk_context for i in range(50)} == {text(0, "d3", "beta alpha") + "\n\n" + text(1, "d2", "alpha")}
    assert tuple(rows[50])[1:] == ("", "", "well") and tuple(rows[51])[1:] == ("", "", "")
    assert rows[52].chunk_context == text(0, "d1", "none") + "\n\n" + text(1, "d2", "alpha") and rows[52].record_context == "line"


def test_patients_with_questions_are_sent_to_all_tasks_while_they_are_few(spark, monkeypatch):
    asked = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "question_id long, patient_id string")
    rows = spark.createDataFrame([("p", 1), ("r", 2)], "patient_id string, x int")
    plan = lambda: rows.hint("merge").join(questions.asking(asked), "patient_id", "left_semi")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan()
    monkeypatch.setattr(questions, "FEW", 1)
    assert "broadcast" not in plan() and questions.asking(asked).count() == 2


def test_equal_questions_are_answered_once(spark, monkeypatch):
    seen, one = {}, questions.answered
    monkeypatch.setattr(questions, "answered", lambda q, *more: seen.update(q=q) or one(q, *more))
    asked = spark.createDataFrame([(i, "p", "Is the gout better") for i in range(40)] + [(40, None, "zebra"), (41, "p", None), (42, "q", "Is the gout better")], "question_id long, patient_id string, question string")
    fact = "source_document_id string, verification_status string, patient_id string, id string"
    dx = spark.createDataFrame([("d1", "verified", "p", "x1", "Gout", True, None)], f"{fact}, name string, is_chronic boolean, notes string")
    none = spark.createDataFrame([], f"{fact}, name string, notes string, done_on date, medicine_name string, strength string, test_name string, value string, unit string")
    chunks = spark.createDataFrame([("p", "d1", "the gout is better")], "patient_id string, document_id string, chunk_text string")
    rows = {r.question_id: r for r in questions.answers(asked, questions.record_lines(dx, none, none, none), chunks).collect()}
    assert len(rows) == 43 and seen["q"].count() == 4
    assert {(rows[i].route, rows[i].citations, rows[i].patient_id) for i in range(40)} == {("records", "d1: Gout", "p")}
    assert rows[42].route == "absent" and rows[40].patient_id is None and rows[41].patient_id == "p"


def test_answers_read_records_of_patients_with_questions_only(spark, monkeypatch):
    from chartweave.plans import answers
    from chartweave.sources.adapters import table

    given = {}
    monkeypatch.setattr(answers.questions, "answers", lambda q, records, chunks: given.update(records=records, chunks=chunks) or q.withColumn("cited", payloads.F.array("question")))
    q, *rest = (table(spark, "/root/testdata/sf0.001", n) for n in f"asked pages {answers.RECORD_TABLES}".split())
    answers.answers(q.where("patient_id = '7'"), *rest)
    assert {r.patient_id for x in given.values() for r in x.select("patient_id").distinct().collect()} == {"7"}
