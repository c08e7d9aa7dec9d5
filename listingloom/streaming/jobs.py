"""Job events as a stream.

``job_events``: ``job_id, batch_id, event, progress, failed_reason, event_ts`` with
event one of waiting, active, progress, completed, failed. The jobs work on batch
and streaming frames alike, so a stream's outcome can be checked against a table.

No operator is keyed by batch before its rows are counted: state is kept per job,
and a batch's counters are combined map-side, so one large batch is many small pieces
of state and not one large one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from listingloom.functions.text import percent
from listingloom.session import prepare_session
from listingloom.sources.listings import create_batch, file_lines, listings_of, stored_lines
from listingloom.sources.sinks import write_jobs

# Events that end a job, and how long a job may be silent.
TERMINAL = ["completed", "failed"]
STALLED_AFTER = "30 seconds"

STATE_STORE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
}


def is_terminal() -> Column:
    return F.col("event").isin(TERMINAL)


# Events in the order that decides between events of one moment, and
# the state each leaves a job in. A progress report means that the job is active.
EVENT_STATES = {
    "active": "active", "completed": "completed", "failed": "failed", "progress": "active",
    "waiting": "waiting",
}
_TERMINAL_BIT = 1 << 60


def _standing() -> Column:
    """Number that is largest for the event that decides a job's state: terminal events
    first, then the latest moment. One number keeps the aggregate in hash tables and a
    job's state in eight bytes."""
    event_no = F.array_position(F.lit(list(EVENT_STATES)), F.col("event"))
    ended = F.when(is_terminal(), F.lit(_TERMINAL_BIT)).otherwise(F.lit(0))
    return F.shiftleft(F.unix_micros("event_ts"), 3) + event_no + ended


def _state(standing: Column) -> Column:
    states = F.lit(list(EVENT_STATES.values()))
    return F.get(states, standing.bitwiseAND(7).cast("int") - 1)


def job_states(events: DataFrame) -> DataFrame:
    """Current state per job. A terminal state is not undone by a late event."""
    return (
        events.groupBy("batch_id", "job_id")
        .agg(F.max(_standing()).alias("_standing"), F.max("event_ts").alias("last_event_at"))
        .select("batch_id", "job_id", _state(F.col("_standing")).alias("state"), "last_event_at")
    )


def finished_once(events: DataFrame, late: str | None = None) -> DataFrame:
    """The first terminal event of each job, so every result is sent once.

    Without ``late`` nothing is ever dropped or repeated, and a key per finished job
    stays in the state store. With ``late`` keys are forgotten that long after their
    event, and an event later than that is dropped as late.
    """
    ended = events.where(is_terminal())
    if not events.isStreaming:
        first = F.struct("event_ts", "event")
        return ended.groupBy("batch_id", "job_id").agg(
            *(
                F.min_by(c, first).alias(c)
                for c in ended.columns
                if c not in ("batch_id", "job_id")
            )
        )
    if late is None:
        return ended.dropDuplicates(["batch_id", "job_id"])
    return ended.withWatermark("event_ts", late).dropDuplicatesWithinWatermark(
        ["batch_id", "job_id"]
    )


def result_events(events: DataFrame, late: str | None = None) -> DataFrame:
    """One ``result`` event per finished job."""
    return finished_once(events, late).select(
        F.lit("result").alias("event"),
        "batch_id",
        F.to_json(
            F.struct(
                F.col("batch_id").alias("batchId"),
                F.col("job_id").alias("jobId"),
                F.col("event").alias("status"),
                F.col("failed_reason").alias("error"),
            )
        ).alias("payload_json"),
        F.col("event_ts").alias("ts"),
    )


def batch_totals(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total"))


def progress(events: DataFrame, totals: DataFrame, late: str | None = None) -> DataFrame:
    """``batch_id, completed, total, percentage, done`` of every batch.

    ``completed`` counts failed jobs as well, or a batch with a failure would never be
    done. A batch without a finished job has 0 of its total. As a stream (update mode) a
    batch comes out with its first event and whenever its count has risen. It is done
    once, unless the first news that ends no job arrives after all of its results: then
    the last row comes again, so take completions by batch.
    """
    if events.isStreaming:
        # one key per finished job, and one without a job for the batch itself
        seen = events.withColumn("_job", F.when(is_terminal(), F.col("job_id")))
        if late is None:
            seen = seen.dropDuplicates(["batch_id", "_job"])
        else:
            seen = seen.withWatermark("event_ts", late).dropDuplicatesWithinWatermark(
                ["batch_id", "_job"]
            )
        counts = seen.groupBy("batch_id").agg(F.count("_job").alias("completed"))
        of_batches = counts.join(totals, "batch_id")
    else:
        counts = finished_once(events).groupBy("batch_id").agg(
            F.count(F.lit(1)).alias("completed")
        )
        of_batches = totals.join(counts, "batch_id", "left")
    return of_batches.withColumn("completed", F.coalesce("completed", F.lit(0))).select(
        "batch_id",
        "completed",
        "total",
        percent(F.col("completed"), F.col("total")).alias("percentage"),
        (F.col("completed") >= F.col("total")).alias("done"),
    )


def progress_events(progress_rows: DataFrame, at: Column) -> DataFrame:
    """``progress`` events, and a ``complete`` event for each batch that is done."""
    body = [
        F.col("batch_id").alias("batchId"),
        F.col("completed"),
        F.col("total"),
    ]
    progress_payload = F.to_json(F.struct(*body, F.col("percentage")))
    complete_payload = F.to_json(
        F.struct(*body, F.lit("All jobs completed").alias("message"))
    )
    events = F.array(
        F.struct(F.lit("progress").alias("event"), progress_payload.alias("payload_json")),
        F.when(
            F.col("done"),
            F.struct(F.lit("complete").alias("event"), complete_payload.alias("payload_json")),
        ),
    )
    return progress_rows.select(
        "batch_id", F.explode(F.array_compact(events)).alias("_e"), at.alias("ts")
    ).select("_e.event", "batch_id", "_e.payload_json", "ts")


def recent_activity(
    events: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes"
) -> DataFrame:
    """Completions per time window, overall; windows without any are left out.

    All events are counted through, not only completions, so that every event moves the
    watermark and closes windows.
    """
    if events.isStreaming:
        events = events.withWatermark("event_ts", late)
    span = F.window("event_ts", window, slide) if slide else F.window("event_ts", window)
    counts = events.groupBy(span.alias("_w")).agg(
        F.count_if(F.col("event") == "completed").alias("completed")
    )
    return counts.where("completed > 0").select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "completed"
    )


def stalled_spells(
    events: DataFrame, silence: str = STALLED_AFTER, late: str = "10 minutes"
) -> DataFrame:
    """Spells of a job that ended in silence while it was active.

    A job's events are cut into sessions by gaps of ``silence``; a session whose last
    event leaves the job active is a stall. Late news of a job that has ended is none. As
    a stream (append mode) a stall comes out once the watermark has passed the end of the
    session, and only the session itself tells whether its job has ended.
    """
    if events.isStreaming:
        events = events.withWatermark("event_ts", late)
    spells = events.groupBy(
        "batch_id", "job_id", F.session_window("event_ts", silence).alias("_s")
    ).agg(F.max(_standing()).alias("_standing"))
    silent = spells.where(_state(F.col("_standing")) == "active").select(
        "batch_id", "job_id", F.col("_s.end").alias("stalled_at")
    )
    if events.isStreaming:
        return silent
    ended = events.where(is_terminal()).groupBy("batch_id", "job_id").agg(
        F.min("event_ts").alias("_ended_at")
    )
    return (
        silent.join(ended, ["batch_id", "job_id"], "left")
        .where("_ended_at IS NULL OR _ended_at > stalled_at")
        .drop("_ended_at")
    )


def stalled_jobs(events: DataFrame, as_of: Column, silence: str = STALLED_AFTER) -> DataFrame:
    """Active jobs without an event for longer than ``silence`` before ``as_of``."""
    quiet = F.col("last_event_at") < as_of - F.expr(f"INTERVAL {silence}")
    return job_states(events).where((F.col("state") == "active") & quiet)


def stream_listing_jobs(
    spark, folder: str, jobs_path: str, checkpoint: str, files_per_batch: int = 1000,
    done_folder: str | None = None, **options,
) -> StreamingQuery:
    """Turn listing CSVs into jobs as files arrive.

    The stream reads lines with the name and place of their file; each micro-batch holds
    whole files and takes them like a table, so encodings, headers and quoted line breaks
    are treated as in ``read_listings``, and no file name goes through the driver. Job ids
    follow from file and row: a repeated micro-batch overwrites the same batches. A
    micro-batch takes at most ``files_per_batch`` files; the next ones take the rest. Files
    that are through are moved to ``done_folder``, if one is given.
    """
    reader = prepare_session(spark).readStream.option("maxFilesPerTrigger", files_per_batch)
    if done_folder:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", done_folder)
    arrivals = file_lines(reader, folder)

    def load(lines: DataFrame, _batch_no: int) -> None:
        kept = stored_lines(lines)
        if not kept.isEmpty():
            write_jobs(create_batch(listings_of(kept), F.current_timestamp()), jobs_path, mode="overwrite")

    return (
        arrivals.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**(options or {"availableNow": True}))
        .start()
    )
