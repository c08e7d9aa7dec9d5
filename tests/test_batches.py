"""Roll-ups of hand-made batches, and positions in large groups."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from listingloom.operators import batches as B
from listingloom.operators import quality as Q
from listingloom.operators.ordering import position_in_group

T0 = datetime(2025, 1, 1)


@pytest.fixture
def jobs(spark):
    def make(**batches):
        rows = [
            (f"{batch}-{i}", batch, state, T0 + timedelta(seconds=i), None if state == "waiting" else T0 + timedelta(seconds=60 * (i + 1)))
            for batch, states in batches.items()
            for i, state in enumerate(states)
        ]
        return spark.createDataFrame(rows, "job_id STRING, batch_id STRING, state STRING, created_at TIMESTAMP, processed_at TIMESTAMP")

    return make


def by_batch(df):
    return {r.batch_id: r for r in df.collect()}


def test_status_and_progress(jobs):
    df = jobs(
        a=["completed"] * 2, b=["completed", "failed"], c=["waiting"] * 3,
        d=["completed", "active", "waiting"], e=["waiting", "completed"], f=["delayed", "completed"],
    )
    assert {k: r.status for k, r in by_batch(B.batch_status(df)).items()} == {
        "a": "completed", "b": "completed_with_errors", "c": "queued", "d": "processing", "e": "processing", "f": "completed",
    }
    progress = by_batch(B.batch_progress(df))
    assert progress["d"].percentage == 33 and progress["c"].percentage == 0 and progress["f"].total == 1
    for r in progress.values():
        assert r.completed + r.failed + r.processing + r.waiting == r.total


def test_eta(spark, jobs):
    timing = by_batch(B.batch_timing(jobs(a=["completed", "completed", "waiting"], b=["waiting"], c=["completed"])))
    assert timing["a"].estimated_time_remaining == "1m 0s"
    assert timing["b"].estimated_time_remaining is None and timing["c"].estimated_time_remaining is None
    assert timing["a"].created_at == "2025-01-01T00:00:00.000Z"
    values = spark.createDataFrame([(7_505_000.0,), (63_000.0,), (2_999.0,), (None,)], "ms DOUBLE")
    assert [r[0] for r in values.select(B.duration_text(F.col("ms"))).collect()] == ["2h 5m", "1m 3s", "2s", None]


def test_summary_counts_swallowed_errors_as_failed(spark, jobs):
    df = jobs(a=["completed"] * 5 + ["failed"])
    results = spark.createDataFrame(
        [("a-0", "success", None), ("a-1", "partial", None), ("a-2", "failed", None), ("a-3", None, "timeout")],
        "job_id STRING, scraped_status STRING, error STRING",
    ).select("*", F.lit(1).cast("bigint").alias("processing_ms"), F.lit(T0).alias("processed_at"), F.lit("w").alias("worker"))
    r = B.batch_summary(df, results).first()
    assert (r.total_businesses, r.successful_scrapes, r.partial_scrapes, r.failed_scrapes, r.not_found) == (6, 1, 1, 2, 1)
    errors = {x.job_id: x.error for x in B.job_result_rows(df, results).where("is_result").collect()}
    assert errors["a-5"] == "Unknown error" and "a-4" not in errors


def test_health(jobs):
    at = F.lit(T0 + timedelta(minutes=10))

    def verdict(df, as_of=at):
        r = B.worker_health(df, as_of).first()
        return r.status, r.completed_last_5min

    assert verdict(jobs(a=["completed", "waiting"])) == ("degraded", 0)
    assert verdict(jobs(a=["completed", "waiting"]), F.lit(T0 + timedelta(minutes=5))) == ("healthy", 1)
    assert verdict(jobs(a=["failed"] * 11 + ["completed"]))[0] == "degraded"
    assert verdict(jobs(a=["active", "waiting"]))[0] == "healthy"


def test_retention_keeps_the_newest(jobs):
    df = jobs(a=["completed"] * 5 + ["failed"] * 3 + ["waiting"] * 2)
    kept = {r.job_id for r in B.keep_latest(df, {"completed": 2, "failed": 1}).collect()}
    assert kept == {"a-3", "a-4", "a-7", "a-8", "a-9"}


def test_positions_equal_row_numbers_in_a_skewed_table(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 > 0, F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        (F.col("id") % 11).alias("tie"), F.col("id"),
    )
    got = position_in_group(rows, ["g"], [F.col("tie"), F.col("id")], "p")
    want = rows.selectExpr("g", "tie", "id", "row_number() OVER (PARTITION BY g ORDER BY tie, id) - 1 AS p")
    assert got.select("g", "id", "p").exceptAll(want.select("g", "id", "p")).count() == 0 and got.count() == 20000


COLUMNS = ["Name", "Rating", "Reviews Count", "Phone", "Address", "Website", "Latitude", "Longitude", "Monday Hours", "Tuesday Hours", "Status"]


def export(spark, rows):
    schema = ", ".join(f"`{c}` STRING" for c in COLUMNS)
    return spark.createDataFrame([tuple(r.get(c, "") for c in COLUMNS) for r in rows], schema)


def row(given, reviews="43", hours="", **more):
    return {"Name": "n", "Reviews Count": reviews, "Latitude": "47.1", "Longitude": "8.5", "Monday Hours": hours, "Status": "success"} | {k: "x" for k in given.split()} | more


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        (
            [row("Phone Website"), row(""), row("Phone Website")] + [row("Phone Website", hours="09:00 - 20:00")] * 2
            + [row("Phone Website"), row("Website", hours="08:00 - 20:00")],
            (7, 7, 0, 1, 3, 0, 7, 5, 6),
        ),
        (
            [{"Status": "failed"}, row("", hours="08:00 - 19:00"), row("Website", hours="09:00 - 20:00"), row("Website")],
            (4, 3, 1, 1, 2, 0, 3, 0, 2),
        ),
    ],
)
def test_quality_profile(spark, rows, expected):
    r = Q.quality_profile(export(spark, rows)).first()
    assert (r.total, r.success, r.failed, r.partial, r.with_hours, r.with_rating, r.with_reviews, r.with_phone, r.with_website) == expected


def test_hours_issues_regions_and_grade(spark):
    hours = ["09:00 - 20:00", "9 am", "Closed", "Open 24 hours", "09:00 - 12:00 pm", "10:00-1221:00"]
    df = export(spark, [row("", hours=h, Address=a) for h, a in zip(hours, ["Schweiz", "Spain", "Germany, Spain", "", "Switzerland", "Colombia"])])
    assert {r["Monday Hours"]: r.reason for r in Q.hours_format_issues(df).collect()} == {
        "9 am": Q.NOT_24H, "09:00 - 12:00 pm": Q.AM_PM, "10:00-1221:00": Q.NOT_24H,
    }
    assert {r.region: r.total for r in Q.region_completeness(df).collect()} == {"Switzerland": 2, "Spain": 2, "Colombia": 1, "Unknown": 1}
    assert Q.success_grade(df).first().grade == "Good"
    assert Q.success_grade(df.limit(0)).first().grade is None
    assert [r.rule_no for r in Q.recommendations(df).orderBy("rule_no").collect()] == [2, 3]
    assert Q.quality_profile(export(spark, [{"Status": "failed"}])).first().with_hours_pct is None


def test_census_of_special_letters(spark):
    df = spark.createDataFrame([("Äpfel für Zoë",), ("plain",), ("ß",)], "t STRING")
    assert Q.special_letter_census(df, "t").first() == (4, 4, "Ä, ß, ë, ü")
