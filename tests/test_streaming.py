"""Streams put out what the same job puts out for a table."""

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from listingloom.streaming import jobs as S

T0 = datetime(2025, 1, 1)
SCHEMA = "batch_id STRING, job_id STRING, event STRING, progress INT, failed_reason STRING, event_ts TIMESTAMP"
EVENTS = [
    ("b1", "j1", "waiting", 0), ("b1", "j1", "active", 5), ("b2", "k1", "active", 6), ("b1", "j1", "progress", 8),
    ("b1", "j1", "completed", 10), ("b1", "j1", "completed", 11),  # sent twice
    ("b1", "j2", "completed", 12), ("b1", "j2", "active", 20),  # late news of a finished job
    ("b1", "j3", "failed", 25), ("b2", "k2", "completed", 26), ("b2", "k1", "progress", 200), ("b3", "z", "waiting", 4000),
]


def rows(events):
    return [(b, j, e, 10 if e == "progress" else None, "why" if e == "failed" else None, T0 + timedelta(seconds=s)) for b, j, e, s in events]


@pytest.fixture
def streamed(spark, tmp_path):
    """Run a job over the events, one file and micro-batch after the other."""

    def run(job, mode, parts=3):
        for key, value in S.STATE_STORE_CONF.items():
            spark.conf.set(key, value)
        folder = tmp_path / uuid.uuid4().hex
        step = -(-len(EVENTS) // parts)
        for i in range(0, len(EVENTS), step):
            spark.createDataFrame(rows(EVENTS[i : i + step]), SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
        out = []
        query = (
            job(source).writeStream.outputMode(mode)
            .foreachBatch(lambda df, _: out.extend(df.collect()))
            .option("checkpointLocation", str(folder / "checkpoint"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return out

    return run


@pytest.fixture
def table(spark):
    return spark.createDataFrame(rows(EVENTS), SCHEMA)


def test_states(streamed, table):
    want = {r.job_id: r.state for r in S.job_states(table).collect()}
    assert want == {"j1": "completed", "j2": "completed", "j3": "failed", "k1": "active", "k2": "completed", "z": "waiting"}
    last = {r.job_id: r.state for r in streamed(S.job_states, "update")}
    assert last == want


def test_each_result_once(streamed, table):
    assert S.finished_once(table).count() == 4
    sent = streamed(S.result_events, "append")
    assert len(sent) == 4 and {r.event for r in sent} == {"result"}
    limited = streamed(lambda e: S.result_events(e, late="10 minutes"), "append")
    assert sorted(r.payload_json for r in limited) == sorted(r.payload_json for r in sent)


def test_progress_and_one_completion(streamed, table, spark):
    totals = spark.createDataFrame([("b1", 3), ("b2", 2), ("b3", 1)], "batch_id STRING, total BIGINT")
    seen = streamed(lambda e: S.progress(e, totals), "update")
    final = {r.batch_id: r for r in seen}
    want = {r.batch_id: r for r in S.progress(table, totals).collect()}
    assert final == want and want["b1"].percentage == 100 and want["b2"].percentage == 50
    assert (want["b3"].completed, want["b3"].percentage, want["b3"].done) == (0, 0, False)
    assert [r.batch_id for r in seen if r.done] == ["b1"]
    events = S.progress_events(S.progress(table, totals), F.lit(T0)).collect()
    assert sorted((r.event, r.batch_id) for r in events) == [("complete", "b1"), ("progress", "b1"), ("progress", "b2"), ("progress", "b3")]


def test_stalled(streamed, table):
    want = {(r.job_id, r.stalled_at) for r in S.stalled_spells(table).collect()}
    # k1 fell silent after its start and again after its report; the others are done
    assert {j for j, _ in want} == {"k1"} and len(want) == 2
    assert {(r.job_id, r.stalled_at) for r in streamed(S.stalled_spells, "append")} == want
    as_of = F.lit(T0 + timedelta(seconds=229))
    assert S.stalled_jobs(table, as_of).count() == 0
    assert [r.job_id for r in S.stalled_jobs(table, F.lit(T0 + timedelta(seconds=231))).collect()] == ["k1"]


def test_late_news_of_an_ended_job_is_no_stall(spark):
    late = rows([("b", "x", "completed", 0), ("b", "x", "active", 600), ("b", "y", "active", 0), ("b", "y", "completed", 600)])
    stalls = S.stalled_spells(spark.createDataFrame(late, SCHEMA)).collect()
    assert [(r.job_id, r.stalled_at) for r in stalls] == [("y", T0 + timedelta(seconds=30))]


def test_recent_activity(streamed, table):
    want = {(r.window_start, r.completed) for r in S.recent_activity(table).collect()}
    assert want == {(T0, 4)}
    assert {(r.window_start, r.completed) for r in streamed(S.recent_activity, "append")} == want


def test_listing_files_become_jobs_as_they_arrive(spark, tmp_path):
    inbox, jobs = tmp_path / "in", str(tmp_path / "jobs")
    inbox.mkdir()
    (inbox / "a.csv").write_text("name,city\nx,Bern\ny,Basel\n")
    for more in (None, "b.CSV"):
        if more:
            (inbox / more).write_bytes("Name\nZürich\n".encode("latin-1"))
        S.stream_listing_jobs(spark, str(inbox), jobs, str(tmp_path / "checkpoint")).awaitTermination()
    rows = spark.read.parquet(jobs).collect()
    assert sorted(r.name for r in rows) == ["Zürich", "x", "y"] and len({r.batch_id for r in rows}) == 2
