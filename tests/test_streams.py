"""Streams with late, repeated, disordered and stalled batches, against the batch jobs."""

import datetime as dt
import random

import pytest
from chartweave.streaming import admission, refresh
from chartweave.streaming.buckets import BucketTable

REQUESTS = "event_id long, user_id string, action string, ts timestamp"
START = dt.datetime(2026, 1, 1)


def replay(spark, tmp_path, schema, batches, start):
    """Each batch is a run of its own from one checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        start(stream).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(180)


def test_stalled_admission_stream_equals_the_batch_job(spark, tmp_path):
    rng = random.Random(1)
    rows, at = [], START
    for i in range(120):  # bursts; between batches of 30 the clock of the events stands nearly still or jumps
        at += dt.timedelta(seconds=rng.choice([1, 5, 20]) if i != 60 else 3600)
        rows.append((i, rng.choice("ab"), rng.choice(["process", "upload", "other"]), at))
    batches = [rows[k : k + 30] for k in range(0, 120, 30)]
    replay(
        spark, tmp_path, REQUESTS, batches,
        lambda s: admission.admission_stream(s, "1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append"),
    )
    want = {r.event_id: (r.allowed, r.retry_after) for r in admission.admissions(spark.createDataFrame(rows, REQUESTS)).collect()}
    got = {r.event_id: (r.allowed, r.retry_after) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want and any(not ok for ok, _ in got.values())


def test_bucket_is_kept_while_the_stream_waits(spark, tmp_path):
    # a timer by the clock of the machine would forget it; events stand within a minute of each other
    rows = [(i, "u", "process", START + dt.timedelta(seconds=i)) for i in range(12)]
    replay(
        spark, tmp_path, REQUESTS, [rows[:6], rows[6:]],
        lambda s: admission.admission_stream(s, "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append"),
    )
    got = {r.event_id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [got[i] for i in range(12)] == [True] * 5 + [False] * 7


DOCUMENTS = "id string, patient_id string, sha256_hash string, created_at timestamp"


def test_late_document_arrives_and_repeated_batch_adds_nothing(spark, tmp_path):
    day = lambda n: START + dt.timedelta(days=n)
    batches = [[("a", "p", "h", day(9)), ("b", "p", "h", day(10))], [("c", "p", "i", day(10)), ("z", None, "h", day(1))], [("d", "q", "h", day(1)), ("e", "p", "h", day(0)), ("y", None, "h", day(0))]]
    path = str(tmp_path / "table")
    replay(spark, tmp_path, DOCUMENTS, batches, lambda s: refresh.new_documents(s, path, 8))
    rows = lambda: sorted((r.id, r.patient_id or "", r.sha256_hash) for r in spark.read.parquet(path).collect())
    want = [("a", "p", "h"), ("c", "p", "i"), ("d", "q", "h"), ("z", "", "h")]
    assert rows() == want
    again = spark.createDataFrame(batches[2], DOCUMENTS)
    refresh.add_new(again, path, 8)
    assert rows() == want
    # of a batch that stopped half-way, the rest
    part = str(tmp_path / "part")
    refresh.add_new(again.where("id = 'e'"), part, 8)
    refresh.add_new(again, part, 8)
    assert sorted(r.id for r in spark.read.parquet(part).collect()) == ["d", "e", "y"]


@pytest.mark.parametrize("seed", [1, 2])
def test_statuses_of_disordered_and_repeated_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    schema, path = "id long, document_id string, status string, ts timestamp", str(tmp_path / "table")
    rows = [(i, rng.choice(["d1", "d2", "d3", None]), rng.choice(["queued", "failed", "completed", None]), START + dt.timedelta(minutes=rng.randint(0, 20))) for i in range(60)]
    replay(spark, tmp_path, schema, [rows[k : k + 20] for k in range(0, 60, 20)], lambda s: refresh.upserted_statuses(s, path, 4))
    plain = lambda df: sorted((r.document_id or "", r.status or "", r.n_events) for r in df.collect())
    want = plain(admission.latest_status(spark.createDataFrame(rows, schema)))
    assert plain(refresh.statuses_at(spark, path)) == want
    table, again = BucketTable(spark, path, refresh.STATUSES, ["document_id"], 4), spark.createDataFrame(rows[20:40], schema)
    assert table.batches() == {0, 1, 2} and not table.merge(1, again, refresh.merged_statuses) and plain(refresh.statuses_at(spark, path)) == want
    # a last batch whose ledger entry was lost is not seen, and comes in once
    last = spark.createDataFrame(rows[40:], schema)
    table.fs.delete(table.at("ledger/2"), True)
    assert plain(refresh.statuses_at(spark, path)) == plain(admission.latest_status(spark.createDataFrame(rows[:40], schema)))
    assert table.merge(2, last, refresh.merged_statuses) and plain(refresh.statuses_at(spark, path)) == want
    table.forget(keep=1)
    assert plain(refresh.statuses_at(spark, path)) == want and all(len(v) == 1 for v in table.versions().values())
    assert refresh.statuses_at(spark, str(tmp_path / "none")).count() == 0
