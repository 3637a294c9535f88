"""Declared schemas, payloads with rejects, files of a folder."""

import hashlib
import json

import pytest
from chartweave.sources import adapters, schemas, uploads


def test_tables_have_their_declared_schemas(spark, tmp_path):
    assert set(adapters.TABLES) == set(schemas.TABLES)
    for name in adapters.TABLES:
        df = adapters.table(spark, "/root/testdata/sf0.001", name)
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schemas.schema_of(name)], name
    rows = adapters.table(spark, "/root/testdata/sf0.001", "records").limit(3)
    rows.drop("event_date").selectExpr("*", "1 AS more").write.parquet(str(tmp_path / "records"))
    back = schemas.read_table(spark, str(tmp_path / "records"), "records")
    assert back.columns == ["record_id", "event_date"] and {r.event_date for r in back.collect()} == {None} and back.count() == 3
    with pytest.raises(Exception, match="event_date"):
        schemas.conforming(rows.drop("event_date"), "records")


def test_payload_sections_and_rejects(spark):
    value = {"value": "x", "sourceText": "x"}
    whole = {
        "documentType": "LAB_REPORT", "documentTitle": value, "documentDate": value, "examination": {"vitals": {"bp": {"value": "120/80", "sourceText": None, "page": 2}}},
        "clinicalInformation": {"chiefComplaints": [value]}, "treatment": {"surgeries": [value]}, "labResults": [{"testName": "Hb", "value": "9", "confidence": 0.5, "sourceText": None}], "later": {"a": 1},
    }
    broken = [
        {**whole, "documentType": "Letter"}, {**whole, "documentType": None}, {**whole, "labResults": [{"testName": "Hb", "confidence": 1}]}, {**whole, "labResults": {"testName": 1}},
        {**whole, "diagnoses": [{"name": "Gout", "confidence": 1}, {"confidence": "high"}]}, {k: v for k, v in whole.items() if k != "documentTitle"},
    ]
    rows = [(0, json.dumps(whole)), *((i, json.dumps(b)) for i, b in enumerate(broken, 1)), (10, "{"), (11, None), (12, ""), (13, "[]")]
    good, rejects = schemas.loaded(spark.createDataFrame(rows, "document_id int, payload string"))
    (row,) = good.collect()
    assert row.document_id == 0 and row.p.examination.vitals.bp.value == "120/80" and row.p.examination.vitals.bp.page == 2 and row.p.clinicalInformation.chiefComplaints[0].value == "x"
    assert row.p.labResults[0].confidence == 0.5 and "corrupt_record__" not in row.p
    got = {r.document_id: r.reasons for r in rejects.collect()}
    assert got[1] == ["documentType is unknown"] and got[2] == ["documentType is missing"] and got[3] == ["labResults.value is missing"] and got[4] == got[5] == ["malformed"]
    assert got[6] == ["documentTitle is missing"] and all(got[i] == ["malformed"] for i in (10, 11, 12))
    assert set(got) == {1, 2, 3, 4, 5, 6, 10, 11, 12, 13}
    assert schemas.loaded(good.drop("p"), required=[], types=["X"])[1].count() == 1


def test_folder_of_uploads(spark, tmp_path):
    files = {
        "a b+c%.pdf": bytes.fromhex("255044462d"), "x.png": bytes.fromhex("89504e470d"), "deep/er/y.jpg": bytes.fromhex("ffd8ffe0"), "w.webp": b"RIFF\0\0\0\0WEBP", "em%20p+t y.pdf": b"", "t.pdf": b"plain",
        "long.pdf": bytes.fromhex("25504446") + b"x" * 5000,
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, "100")  # so reading the long one's content would fail
    try:
        got = {r.file_name: r for r in uploads.uploaded_files(spark, str(tmp_path), most=100).collect()}
    finally:
        spark.conf.unset(limit)
    assert {n: (r.mime_type, r.accepted, r.error) for n, r in got.items()} == {
        "a_b_c_.pdf": ("application/pdf", True, None), "x.png": ("image/png", True, None), "y.jpg": ("image/jpeg", True, None), "w.webp": ("image/webp", True, None),
        "em_20p_t_y.pdf": (None, False, uploads.EMPTY), "t.pdf": (None, False, uploads.UNKNOWN_TYPE), "long.pdf": (None, False, uploads.TOO_LONG),
    }
    assert got["long.pdf"].content is None and got["long.pdf"].length == 5004 and got["x.png"].sha256 == hashlib.sha256(files["x.png"]).hexdigest()
    assert {r.file_name for r in uploads.uploaded_files(spark, str(tmp_path), "*.jpg").collect()} == {"y.jpg"}
    plan = uploads.uploaded_files(spark, str(tmp_path), most=100)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,100)" in plan and "GreaterThan(length,100)" in plan


def test_facts_are_dealt_by_document_to_as_many_tasks_as_their_rows_need(spark, monkeypatch, capsys):
    from chartweave.plans.queries import QUERIES

    path, names = "/root/testdata/sf0.01", ["labs", "medications", "diagnoses", "procedures"]
    plain = {t: adapters.table(spark, path, t) for t in names}
    means = QUERIES["a7_mean_confidence"](spark, path)
    n = spark.read.parquet(f"{path}/lineitem.parquet").count()
    monkeypatch.setattr(adapters, "DEALT", n // 10)
    for t in names:
        dealt = adapters.table(spark, path, t)
        assert dealt.rdd.getNumPartitions() == 10 and dealt.columns == plain[t].columns
        assert dealt.exceptAll(plain[t]).isEmpty() and plain[t].exceptAll(dealt).isEmpty()
    dealt = QUERIES["a7_mean_confidence"](spark, path)
    assert dealt.exceptAll(means).isEmpty() and means.exceptAll(dealt).isEmpty()
    capsys.readouterr()
    dealt.explain()
    assert "hashpartitioning(source_document_id" not in capsys.readouterr().out  # facts are grouped where they were joined
    monkeypatch.setattr(adapters, "DEALT", n // 3)
    assert "REPARTITION_BY_NUM" not in (adapters.table(spark, path, "labs").explain() or capsys.readouterr().out)


def test_bills_are_joined_once_and_facts_meet_them_where_they_are(spark, monkeypatch, capsys):
    from chartweave.operators.facts import not_billing
    from chartweave.plans.queries import QUERIES

    path, threshold = "/root/testdata/sf0.01", "spark.sql.autoBroadcastJoinThreshold"
    plain = QUERIES["g1_timeline_events"](spark, path)
    before = spark.conf.get(threshold)
    monkeypatch.setattr(adapters, "DEALT", 10_000)
    spark.conf.set(threshold, "-1")
    try:
        dealt = QUERIES["g1_timeline_events"](spark, path)
        capsys.readouterr()
        dealt.explain()
        plan = capsys.readouterr().out
        assert plan.count("hashpartitioning(source_document_id") == 1  # that of the bills
        assert plan.count("SortMergeJoin [source_document_id") == 1
        assert dealt.count() == plain.count() and dealt.exceptAll(plain).isEmpty() and plain.exceptAll(dealt).isEmpty()
    finally:
        spark.conf.set(threshold, before)
    kinds = [("a", "PHARMACY_INVOICE", None), ("a", "OP_BILL_RECEIPT", None), ("b", None, "op_bill_receipt"), ("c", "LAB_REPORT", "op_bill_receipt"), ("c", "LAB_REPORT", None), ("d", None, None), (None, "PHARMACY_INVOICE", None)]
    documents = spark.createDataFrame(kinds, "id string, document_type string, category string")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c"), (4, "d"), (5, None), (6, "unknown")], "id int, source_document_id string")
    left = not_billing(rows, documents)
    assert sorted(left.columns) == ["id", "source_document_id"] and sorted(r.id for r in left.collect()) == [3, 3, 4, 5, 6]
