"""Batch documents with their results, written in pieces."""

import json
from datetime import datetime, timedelta

import pytest

from listingloom.operators import batches as B
from listingloom.sources import sinks

T0 = datetime(2025, 1, 1)


@pytest.fixture
def jobs(spark):
    rows = []
    for i in range(300):  # batch b0 holds most of them
        batch = "b0" if i % 10 else f"b{i % 3}"
        state = ["completed", "completed", "failed", "waiting"][i % 4]
        rows.append((f"j{i:03}", batch, state, T0 + timedelta(seconds=i % 7), T0 + timedelta(minutes=i), f'Café "{i}"\n', "", "Bern", None))
    return spark.createDataFrame(
        rows,
        "job_id STRING, batch_id STRING, state STRING, created_at TIMESTAMP, processed_at TIMESTAMP, "
        "name STRING, address STRING, city STRING, postal_code STRING",
    ).repartition(5)


@pytest.fixture
def results(spark):
    rows = [
        (f"j{i:03}", "success" if i % 3 else None, 10 * i, T0 + timedelta(minutes=i), None if i % 3 else "gone", "w1",
         (f"Café {i}", "4.5") if i % 3 else None)
        for i in range(300) if i % 20 != 1
    ]
    return spark.createDataFrame(
        rows,
        "job_id STRING, scraped_status STRING, processing_ms BIGINT, processed_at TIMESTAMP, error STRING, "
        "worker STRING, scraped STRUCT<fullName: STRING, rating: STRING>",
    )


def expected(jobs, results):
    found = {r.job_id: r for r in results.collect()}
    lists = {}
    for job in sorted(jobs.collect(), key=lambda j: (j.state, j.created_at, j.job_id)):
        if job.state == "failed" or (job.state == "completed" and job.job_id in found):
            lists.setdefault(job.batch_id, []).append((job, found.get(job.job_id)))
    return lists


def test_documents_are_whole_json(spark, tmp_path, jobs, results):
    path = tmp_path / "docs"
    sinks.write_document_lines(B.document_lines(jobs, results), str(path))
    want = expected(jobs, results)
    flat = {r.batch_id: r for r in B.batch_documents(jobs, results).collect()}
    assert {p.name for p in path.glob("batch_id=*")} == {f"batch_id={b}" for b in flat}
    for batch, row in flat.items():
        pieces = sorted((path / f"batch_id={batch}").glob("part-*"))
        document = json.loads("".join(p.read_text(encoding="utf-8") for p in pieces))
        assert list(document) == ["batchId", "status", "progress", "timing", "results", "summary"]
        assert (document["batchId"], document["status"]) == (batch, row.status)
        assert document["progress"] == row.progress.asDict() and document["summary"] == row.summary.asDict()
        assert [r["index"] for r in document["results"]] == list(range(len(want[batch])))
        for entry, (job, result) in zip(document["results"], want[batch]):
            assert entry["jobId"] == job.job_id
            assert entry["originalData"] == {"name": job.name, "address": "", "city": "Bern", "postal_code": None}
            if job.state == "failed":
                assert entry["scrapedData"] is None and entry["error"]
            else:
                assert entry["scrapedData"] == (result.scraped and result.scraped.asDict())
                assert entry["processingTime"] == result.processing_ms


def test_a_large_batch_is_written_by_many_tasks(spark, tmp_path, jobs, results):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_document_lines(B.document_lines(jobs, results), str(tmp_path / "docs"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "docs" / "batch_id=b0").glob("part-*"))) > 3


def test_batches_without_results(spark, tmp_path, jobs, results):
    waiting = jobs.where("state = 'waiting'")
    sinks.write_document_lines(B.document_lines(waiting, results), str(tmp_path / "docs"))
    pieces = sorted((tmp_path / "docs" / "batch_id=b0").glob("part-*"))
    document = json.loads("".join(p.read_text() for p in pieces))
    assert document["results"] == [] and document["status"] == "queued"
    assert B.result_payloads(waiting, results).count() == 0
