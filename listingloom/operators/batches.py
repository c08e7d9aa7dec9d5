"""Jobs rolled up into batches and queue reports.

``jobs``: ``job_id, batch_id, state, created_at, processed_at`` with state one of
waiting, active, completed, failed. ``job_results``: ``job_id, scraped_status,
processing_ms, processed_at, error, worker``; ``scraped_status`` is null when the
job ended without a record. Batches differ in size, so every roll-up aggregates
before it shuffles and no batch is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingloom.functions.text import iso_utc, percent
from listingloom.operators.ordering import position_in_group

# Job states in list order, and how many finished jobs are kept.
STATES = ["waiting", "active", "completed", "failed"]
QUEUE_KEEP = {"completed": 100, "failed": 50}
WORKER_KEEP = {"completed": 50, "failed": 25}
# Health verdicts.
HEALTHY = ("healthy", "Workers are processing jobs normally")
OFFLINE = ("degraded", "No active jobs and no recent completions - workers may be offline")
FAILING = ("degraded", "High failure rate detected")


def _count(state: str) -> Column:
    return F.count_if(F.col("state") == state)


def jobs_of_batch(jobs: DataFrame, batch_id: str) -> DataFrame:
    """The jobs of one batch; no rows means that the batch does not exist."""
    return jobs.where(F.col("batch_id") == batch_id)


def jobs_in_states(jobs: DataFrame, states: list[str] = STATES) -> DataFrame:
    """The jobs that are in one of the states, in one scan."""
    return jobs.where(F.col("state").isin(states))


def union_of_states(*lists: DataFrame) -> DataFrame:
    """One jobs table from the lists of waiting, active, completed and failed jobs."""
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def queue_stats(jobs: DataFrame) -> DataFrame:
    counts = {state: _count(state) for state in STATES}
    total = F.count_if(F.col("state").isin(STATES))
    return jobs.agg(*(c.alias(n) for n, c in counts.items()), total.alias("total"))


def _state_counts(jobs: DataFrame, *more: Column) -> DataFrame:
    listed = jobs.where(F.col("state").isin(STATES))
    return listed.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"),
        _count("completed").alias("completed"),
        _count("failed").alias("failed"),
        _count("active").alias("processing"),
        _count("waiting").alias("waiting"),
        *more,
    )


def _percentage() -> Column:
    return F.coalesce(percent(F.col("completed") + F.col("failed"), F.col("total")), F.lit(0))


def batch_progress(jobs: DataFrame) -> DataFrame:
    """Counts per batch and the percentage that is through; delayed jobs do not count."""
    return _state_counts(jobs).withColumn("percentage", _percentage())


def status_of() -> Column:
    done = F.col("completed") + F.col("failed") == F.col("total")
    return (
        F.when(done & (F.col("failed") == 0), "completed")
        .when(done, "completed_with_errors")
        .when((F.col("processing") == 0) & (F.col("waiting") == F.col("total")), "queued")
        .otherwise("processing")
    )


def batch_status(jobs: DataFrame) -> DataFrame:
    return _state_counts(jobs).select("batch_id", status_of().alias("status"))


def eta_ms(remaining: Column, completed: Column, first: Column, last: Column) -> Column:
    """Milliseconds left at the pace so far; null when there is no pace."""
    elapsed = F.unix_millis(last) - F.unix_millis(first)
    known = (remaining != 0) & (completed != 0) & (elapsed > 0)
    return F.when(known, elapsed / completed * remaining)


def duration_text(ms: Column) -> Column:
    """``2h 5m``, ``5m 3s`` or ``3s``."""
    hours = F.floor(ms / 3_600_000)
    minutes = F.floor(ms % 3_600_000 / 60_000)
    seconds = F.floor(ms % 60_000 / 1000)
    return (
        F.when(hours > 0, F.format_string("%dh %dm", hours, minutes))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, seconds))
        .when(ms.isNotNull(), F.format_string("%ds", seconds))
    )


_SPAN = (
    lambda: F.min("created_at").alias("first_created"),
    lambda: F.max("processed_at").alias("last_processed"),
)


def _eta_text() -> Column:
    remaining = F.col("processing") + F.col("waiting")
    ms = eta_ms(remaining, F.col("completed"), F.col("first_created"), F.col("last_processed"))
    return duration_text(ms)


def batch_timing(jobs: DataFrame) -> DataFrame:
    return _state_counts(jobs, *(make() for make in _SPAN)).select(
        "batch_id",
        iso_utc(F.col("first_created")).alias("created_at"),
        iso_utc(F.col("last_processed")).alias("last_processed_at"),
        _eta_text().alias("estimated_time_remaining"),
    )


def job_result_rows(jobs: DataFrame, job_results: DataFrame) -> DataFrame:
    """Every listed job with its result: scraped status, error and processing data.

    A completed job carries what its run returned; a failed job carries an error
    and no record. ``is_result`` marks the rows that are in a batch's result list.
    """
    r = job_results.select(
        "job_id",
        F.col("scraped_status").alias("_scraped_status"),
        F.col("processing_ms").alias("_processing_ms"),
        F.col("processed_at").alias("_result_at"),
        F.col("error").alias("_error"),
        F.col("worker").alias("_worker"),
        F.lit(True).alias("_has_result"),
    )
    completed, failed = F.col("state") == "completed", F.col("state") == "failed"
    joined = jobs.where(F.col("state").isin(STATES)).join(r, "job_id", "left")
    return joined.select(
        *jobs.columns,
        (completed & F.col("_has_result").isNotNull() | failed).alias("is_result"),
        F.when(completed, F.col("_scraped_status")).alias("scraped_status"),
        F.when(completed, F.col("_processing_ms")).alias("processing_ms"),
        F.when(completed, F.col("_result_at")).when(failed, F.col("processed_at")).alias("result_at"),
        F.when(failed, F.coalesce(F.nullif(F.col("_error"), F.lit("")), F.lit("Unknown error")))
        .when(completed, F.col("_error"))
        .alias("error"),
        F.when(completed, F.col("_worker")).alias("worker"),
    )


_SUMMARY = {
    "successful_scrapes": lambda: F.count_if(
        F.col("is_result") & (F.col("scraped_status") == "success")
    ),
    "partial_scrapes": lambda: F.count_if(
        F.col("is_result") & (F.col("scraped_status") == "partial")
    ),
    # an error counts for failed jobs only: a completed job's outer error is seen
    # through its missing record
    "failed_scrapes": lambda: F.count_if(
        F.col("is_result") & (F.col("scraped_status").isNull() | (F.col("state") == "failed"))
    ),
    "not_found": lambda: F.count_if(F.col("is_result") & (F.col("scraped_status") == "failed")),
}


def batch_summary(jobs: DataFrame, job_results: DataFrame) -> DataFrame:
    """Scrape outcomes per batch. Records that say ``failed`` themselves are in none of
    the first three counts; ``not_found`` counts them."""
    return (
        job_result_rows(jobs, job_results)
        .groupBy("batch_id")
        .agg(
            F.count(F.lit(1)).alias("total_businesses"),
            *(make().alias(name) for name, make in _SUMMARY.items()),
        )
    )


def batch_documents(jobs: DataFrame, job_results: DataFrame) -> DataFrame:
    """The batch document without its result list: one row per batch, nested."""
    rows = job_result_rows(jobs, job_results)
    flat = _state_counts(
        rows,
        *(make() for make in _SPAN),
        *(make().alias(name) for name, make in _SUMMARY.items()),
    )
    return flat.select(
        "batch_id",
        status_of().alias("status"),
        F.struct(
            "total", "completed", "failed", "processing", "waiting",
            _percentage().alias("percentage"),
        ).alias("progress"),
        F.struct(
            iso_utc(F.col("first_created")).alias("createdAt"),
            iso_utc(F.col("last_processed")).alias("lastProcessedAt"),
            _eta_text().alias("estimatedTimeRemaining"),
        ).alias("timing"),
        F.struct(
            F.col("total").alias("totalBusinesses"),
            F.col("successful_scrapes").alias("successfulScrapes"),
            F.col("partial_scrapes").alias("partialScrapes"),
            F.col("failed_scrapes").alias("failedScrapes"),
        ).alias("summary"),
    )


def result_envelopes(jobs: DataFrame, job_results: DataFrame) -> DataFrame:
    """One row per result, ready for the result list of its batch document."""
    rows = job_result_rows(jobs, job_results).where("is_result")
    return rows.select(
        "batch_id",
        "job_id",
        "scraped_status",
        "error",
        "processing_ms",
        iso_utc(F.col("result_at")).alias("processed_at"),
        "worker",
    )


# Fields of a result and of the record in it, as they are called in documents.
ORIGINAL_FIELDS = ["name", "address", "city", "postal_code"]


def result_payloads(jobs: DataFrame, job_results: DataFrame) -> DataFrame:
    """``batch_id, index, job_id, result``: every entry of every batch's result list.

    ``jobs`` has the listing's columns, ``job_results`` a struct ``scraped``, null where a
    run left no record. A result holds the listing (``originalData``), the record
    (``scrapedData``, null for failed jobs) and how it came about. Completed jobs stand
    before failed ones, oldest first; positions are numbered in slices.
    """
    scraped = job_results.select("job_id", "scraped")
    rows = job_result_rows(jobs, job_results).where("is_result").join(scraped, "job_id", "left")
    completed = F.col("state") == "completed"
    result = F.struct(
        F.col("job_id").alias("jobId"),
        F.struct(*ORIGINAL_FIELDS).alias("originalData"),
        F.when(completed, F.col("scraped")).alias("scrapedData"),
        F.col("processing_ms").alias("processingTime"),
        iso_utc(F.col("result_at")).alias("processedAt"),
        F.col("worker").alias("worker"),
        F.col("error").alias("error"),
    )
    listed = rows.select("batch_id", "job_id", (~completed).alias("_failed"), "created_at", result.alias("result"))
    order = [F.col("_failed"), F.col("created_at"), F.col("job_id")]
    return position_in_group(listed, ["batch_id"], order, "index").select(
        "batch_id", F.col("index").cast("long").alias("index"), "job_id", "result"
    )


def document_lines(jobs: DataFrame, job_results: DataFrame) -> DataFrame:
    """``batch_id, seq, value``: the lines of every batch's JSON document, in order of ``seq``.

    A document's head and foot are a line each, every result is a line of its own, so that
    no document is ever in one place.
    """
    head = F.struct(F.col("batch_id").alias("batchId"), "status", "progress", "timing")
    foot = F.concat(F.lit('],"summary":'), F.to_json("summary"), F.lit("}"))
    ends = F.array(
        F.struct(
            F.lit(-1).cast("long").alias("seq"),
            F.concat(F.regexp_replace(F.to_json(head), r"\}$", ""), F.lit(',"results":[')).alias("value"),
        ),
        F.struct(F.lit((1 << 63) - 1).alias("seq"), foot.alias("value")),
    )
    documents = batch_documents(jobs, job_results).select("batch_id", F.inline(ends))
    entry = F.struct("index", "result.*")
    entries = result_payloads(jobs, job_results).select(
        "batch_id",
        F.col("index").alias("seq"),
        F.concat(
            F.when(F.col("index") > 0, ",").otherwise(""), F.to_json(entry, {"ignoreNullFields": "false"})
        ).alias("value"),
    )
    return documents.unionByName(entries)


def envelope_of_run(attempts: DataFrame) -> DataFrame:
    """Result of one run: ``started_at`` and ``ended_at`` give the processing time."""
    return attempts.select(
        "job_id",
        "batch_id",
        "scraped_status",
        (F.unix_millis("ended_at") - F.unix_millis("started_at")).alias("processing_ms"),
        iso_utc(F.col("ended_at")).alias("processed_at"),
        "error",
        "worker",
    )


# slices of a state that are cut down on their own
RETENTION_SLICES = 1024


def keep_latest(jobs: DataFrame, keep: dict[str, int] | None = None) -> DataFrame:
    """Finished jobs beyond the newest N of their state are dropped, others stay.

    A state is cut to its newest N in slices first, and what is left is then numbered in
    ranges, so no task holds a whole state, whatever N is.
    """
    keep = QUEUE_KEEP if keep is None else keep
    finished = F.coalesce(F.col("state").isin(list(keep)), F.lit(False))
    order = [F.col("processed_at").desc(), F.col("job_id")]
    in_slice = Window.partitionBy("state", "_part").orderBy(*order)
    limit = F.lit(None).cast("int")
    for state, count in keep.items():
        limit = F.when(F.col("state") == state, count).otherwise(limit)
    part = F.pmod(F.xxhash64("job_id"), F.lit(RETENTION_SLICES))
    sliced = jobs.where(finished).withColumn("_part", part)
    sliced = sliced.withColumn("_n", F.row_number().over(in_slice))
    newest = sliced.where(F.col("_n") <= limit).drop("_part", "_n")
    ranked = position_in_group(newest, ["state"], order, "_n", start=1)
    kept = ranked.where(F.col("_n") <= limit).drop("_n")
    return jobs.where(~finished).unionByName(kept)


def recent_jobs(jobs: DataFrame, state: str, limit: int = 10) -> DataFrame:
    """The newest jobs of a state, newest first."""
    return (
        jobs.where(F.col("state") == state)
        .orderBy(F.col("processed_at").desc(), F.col("job_id"))
        .limit(limit)
    )


def recent_completions(jobs: DataFrame, job_results: DataFrame, limit: int = 10) -> DataFrame:
    """The newest completed jobs with their processing time, ``unknown`` without a result."""
    rows = job_result_rows(recent_jobs(jobs, "completed", limit), job_results)
    return rows.select(
        "job_id",
        iso_utc(F.col("processed_at")).alias("completed_at"),
        F.coalesce(F.col("processing_ms").cast("string"), F.lit("unknown")).alias("processing_time"),
    )


def recent_failures(jobs: DataFrame, job_results: DataFrame, limit: int = 10) -> DataFrame:
    """The newest failed jobs with the reason, ``unknown`` if none was given."""
    reasons = job_results.select("job_id", F.nullif("error", F.lit("")).alias("_reason"))
    return recent_jobs(jobs, "failed", limit).join(reasons, "job_id", "left").select(
        "job_id",
        iso_utc(F.col("processed_at")).alias("failed_at"),
        F.coalesce("_reason", F.lit("unknown")).alias("error"),
    )


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Active jobs with start time and progress."""
    return jobs.where(F.col("state") == "active").select(
        "job_id",
        "job_name",
        iso_utc(F.col("processed_at")).alias("started_at"),
        F.coalesce("progress", F.lit(0)).alias("progress"),
    )


def result_index(jobs: DataFrame) -> DataFrame:
    """Position of each result in its batch's list: completed before failed, oldest first."""
    results = jobs.where(F.col("state").isin("completed", "failed")).select(
        "batch_id",
        "job_id",
        F.when(F.col("state") == "completed", 2).otherwise(3).alias("state_no"),
        "created_at",
    )
    order = [F.col("state_no"), F.col("created_at"), F.col("job_id")]
    return position_in_group(results, ["batch_id"], order, "index").select(
        "batch_id", "job_id", "index"
    )


def worker_health(jobs: DataFrame, as_of: Column) -> DataFrame:
    """One row: verdict, reason, counts and recent activity as of a moment.

    Recent completions are looked for among the ten newest completed jobs.
    """
    recent = F.col("processed_at") > as_of - F.expr("INTERVAL 5 MINUTES")
    # of the ten newest, as many are recent as there are recent ones at all, up to ten
    recent_completed = F.least(
        F.count_if((F.col("state") == "completed") & recent), F.lit(10)
    )

    def newest(state: str, value: Column) -> Column:
        of_state = F.col("state") == state
        order = F.struct(F.unix_micros("processed_at"), F.col("job_id"))
        return F.max_by(F.when(of_state, value), F.when(of_state, order))

    flat = jobs.agg(
        *(_count(state).alias(state) for state in [*STATES, "delayed"]),
        recent_completed.alias("completed_last_5min"),
        newest("completed", F.col("job_id")).alias("last_completed_id"),
        newest("completed", iso_utc(F.col("processed_at"))).alias("last_completed_at"),
        newest("failed", F.col("job_id")).alias("last_failed_id"),
        newest("failed", iso_utc(F.col("processed_at"))).alias("last_failed_at"),
    )
    idle = (F.col("active") == 0) & (F.col("waiting") > 0)
    verdict = (
        F.when(idle & (F.col("completed_last_5min") == 0), F.lit(1))
        .when(~idle & (F.col("failed") > F.col("completed")) & (F.col("failed") > 10), F.lit(2))
        .otherwise(0)
    )
    verdicts = [HEALTHY, OFFLINE, FAILING]

    def word(part: int) -> Column:
        return F.get(F.array(*(F.lit(v[part]) for v in verdicts)), verdict)

    return flat.select(word(0).alias("status"), word(1).alias("reason"), *flat.columns)
