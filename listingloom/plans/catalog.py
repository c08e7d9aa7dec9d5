"""The query catalogue: every query takes a session and a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from listingloom.functions import contact as C
from listingloom.functions import hours as O
from listingloom.functions import html as H
from listingloom.functions import text as T
from listingloom.operators import attempts as A
from listingloom.operators import batches as B
from listingloom.operators import extract as E
from listingloom.operators import places as P
from listingloom.operators import quality as Q
from listingloom.plans.views import EVENT_RESULTS, JOB_EVENTS, table, view
from listingloom.session import prepare_session, scratch_folder
from listingloom.operators.ordering import position_in_group
from listingloom.sources import captures, sinks, stores
from listingloom.sources import listings as L
from listingloom.streaming import jobs as S
from listingloom.streaming import tracker as K

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

AS_OF = "2001-08-01 01:00:00"
EVENTS_AS_OF = "2024-01-30 23:59:00"
# candidates for a page's name on pages that are no business pages
PAGE_SELECTORS = {"name": ["nav a", "div.ad", "h1", "title", "article p"]}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare_session(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    CATALOG[fn.__name__] = run
    return fn


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


# --- listings -------------------------------------------------------------------


@query
def country_cascade(spark: SparkSession, d: str) -> DataFrame:
    return A.detect_country(view(spark, d, "listings")).select("job_id", "country")


@query
def locale_join(spark: SparkSession, d: str) -> DataFrame:
    located = A.with_locale(A.detect_country(view(spark, d, "listings")))
    return located.select(
        "job_id", "country", "language", "region", "timezone", "user_agent", "currency",
        "phone_prefix",
    )


@query
def city_geo_join(spark: SparkSession, d: str) -> DataFrame:
    return A.with_city_geo(view(spark, d, "listings"), query="address").select(
        "job_id", "lat", "lng"
    )


@query
def attempts(spark: SparkSession, d: str) -> DataFrame:
    return A.build_attempts(view(spark, d, "listings")).select(
        "job_id", "rank", "strategy", "query"
    )


@query
def maps_url(spark: SparkSession, d: str) -> DataFrame:
    return P.plan_searches(view(spark, d, "listings")).select("job_id", "rank", "url")


@query
def plain_query(spark: SparkSession, d: str) -> DataFrame:
    return A.with_plain_query(view(spark, d, "listings")).select("job_id", "plain_query")


@query
def search_variations(spark: SparkSession, d: str) -> DataFrame:
    return A.search_variations(view(spark, d, "listings").select("job_id", "name")).select(
        "job_id", "variation_no", "variation"
    )


@query
def ingest_listings(spark: SparkSession, d: str) -> DataFrame:
    """Listings written as CSV files and read back as an upload."""
    folder = scratch_folder(spark, "listings")
    rows = view(spark, d, "listings").select(*L.LISTING_COLUMNS, "job_id")
    (
        rows.withColumnRenamed("name", " Name ")
        .write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(folder)
    )
    read = L.read_listings(spark, folder)
    return read.select(*L.LISTING_COLUMNS, F.element_at("extra", F.lit("job_id")).alias("job_id"))


# Folders of an upload: Spark's name of the encoding, what its rows hold that tells it from
# the others, and the mark at the head of its files.
UPLOAD_FOLDERS = {
    "marked": ("UTF-8", "\u20ac \u0142", "\ufeff"),
    "plain": ("UTF-8", "\u20ac \u0142", ""),
    "western": ("ISO-8859-1", "\u00e9", ""),
    "windows": ("windows-1252", "\u20ac", ""),
}


def _upload_folder(spark: SparkSession, d: str) -> str:
    """The listings written as CSV files in four encodings, and a file that is no CSV."""
    folder = scratch_folder(spark, "uploads")
    rows = view(spark, d, "listings").select(*L.LISTING_COLUMNS, "job_id", "k")
    # each folder takes the listings whose number has its remainder
    for no, (name, (encoding, sign, mark)) in enumerate(UPLOAD_FOLDERS.items()):
        kept = rows.where(F.col("k") % len(UPLOAD_FOLDERS) == no).drop("k")
        signed = kept.select(F.lit(sign).alias(f"{mark}{sign}"), *kept.columns)
        (
            signed.write.option("header", True)
            .option("encoding", encoding)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(f"{folder}/{name}")
        )
    rows.select(F.col("name").alias("value")).write.text(f"{folder}/notes")
    return folder


def _folder_of(column: str) -> Column:
    return F.element_at(F.split(column, "/"), -2)


@query
def encoding_census(spark: SparkSession, d: str) -> DataFrame:
    """What the census says of the files of each folder; the file that is no CSV has no row."""
    files = L.profile_files(spark, _upload_folder(spark, d))
    return files.groupBy(_folder_of("path").alias("folder")).agg(
        F.min("encoding").alias("encoding"),
        F.count_distinct("encoding").alias("encodings"),
        F.every("bom").alias("bom"),
        F.min(F.substring("first_bytes", 1, 4)).alias("first_bytes"),
    )


@query
def ingest_mixed_encodings(spark: SparkSession, d: str) -> DataFrame:
    read = L.read_listings(spark, _upload_folder(spark, d))
    job_id = F.element_at("extra", F.lit("job_id")).alias("job_id")
    sign = [F.element_at("extra", F.lit(s)) for s in {s for _, s, _ in UPLOAD_FOLDERS.values()}]
    return read.select(
        *L.LISTING_COLUMNS, job_id, _folder_of("source_file").alias("folder"), F.coalesce(*sign).alias("sign")
    )


@query
def upload_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies to the upload of all files, added up by folder, as files may be split."""
    folder = _upload_folder(spark, d)
    lines = L.stored_lines(L.file_lines(spark.read, folder))
    replies, written = L.upload_lines(lines, scratch_folder(spark, "uploaded-jobs"), _at("2024-01-01"))
    names = lines.groupBy("source_file").agg(F.lit(1)).select(
        L.batch_id_of(F.col("source_file")).alias("batch_id"), _folder_of("source_file").alias("folder")
    )
    return replies.join(names, "batch_id").groupBy("folder", "message", "encoding", "bom_removed").agg(
        F.sum("jobs_created").alias("jobs_created"), F.lit(written).cast("long").alias("jobs_written")
    )


@query
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The same files taken one by one as they arrive."""
    folder, jobs = _upload_folder(spark, d), scratch_folder(spark, "arrived-jobs")
    state = scratch_folder(spark, "arrivals")
    S.stream_listing_jobs(spark, folder, jobs, state, files_per_batch=3).awaitTermination()
    return spark.read.parquet(jobs).select(*L.LISTING_COLUMNS, "job_name", "state")


@query
def create_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "listings").withColumn("row_no", F.col("k"))
    made = L.create_batch(rows, _at("2024-01-01"), batch_id=F.col("batch_id"), priority=2)
    return made.select(
        "job_id", "job_name", "batch_id", "row_no", *L.LISTING_COLUMNS, "state",
        T.iso_utc(F.col("created_at")).alias("created_at"), "priority", "delay_ms",
    )


# --- text rules -----------------------------------------------------------------


@query
def fold_full(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.fold_full(F.col("text")).alias("folded"))


@query
def fold_light(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", T.fold_light(F.col("text")).alias("folded")
    )


@query
def special_chars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", T.has_special(F.col("text")).alias("has_special")
    )


@query
def char_census(spark: SparkSession, d: str) -> DataFrame:
    return Q.special_letter_census(table(spark, d, "documents"), "text")


@query
def char_counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.special_letter_counts(table(spark, d, "documents"), "text")


@query
def phone_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.scan_phone(F.col("text")).alias("phone"))


@query
def combined_terms(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words per source over all languages, with where they come first."""
    words = table(spark, d, "documents").select(
        F.col("source").alias("field"),
        F.array_position(F.lit(["de", "en", "es", "fr"]), F.col("lang")).alias("lang_no"),
        F.posexplode(F.split(F.lower("text"), "[^a-zäöüßéèêçñáíóú]+")).alias("pos", "term"),
    )
    return Q.combined_terms(words)


@query
def csv_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id",
        T.csv_text(F.col("text")).alias("cell"),
        T.csv_cell_doubled(F.col("text")).alias("doubled_cell"),
    )


@query
def phone_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = A.detect_country(view(spark, d, "listings"))
    return A.normalise_phones(rows).select("job_id", "country", "phone", "phone_normalised")


@query
def phone_normalise_known_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = A.detect_country(view(spark, d, "listings"))
    return A.normalise_phones(rows, known_codes=True).select("job_id", "phone_normalised")


@query
def export_formats(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "listings").select(
        "job_id",
        C.format_phone(F.col("phone")).alias("phone"),
        C.format_rating(F.col("rating_text")).alias("rating"),
        C.format_reviews(F.col("reviews_text")).alias("reviews"),
        C.format_website(F.col("website_text")).alias("website"),
    )


@query
def field_validators(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "listings").select(
        "job_id",
        C.valid_name(F.col("name")).alias("name"),
        C.valid_phone(F.col("phone")).alias("phone"),
        C.valid_rating(F.col("rating_text")).alias("rating"),
        C.valid_reviews(F.col("reviews_text")).alias("reviews"),
        C.valid_category(F.col("category_text")).alias("category"),
    )


@query
def day_words(spark: SparkSession, d: str) -> DataFrame:
    hours = F.col("hours_text")
    return view(spark, d, "listings").select(
        "job_id",
        O.translate_day_words(hours).alias("translated"),
        O.detect_day(hours).alias("day"),
    )


@query
def hours_normalise(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "listings").select(
        "job_id", O.normalise_hours(F.col("hours_text")).alias("hours")
    )


@query
def hours_rows(spark: SparkSession, d: str) -> DataFrame:
    row = F.concat(F.lit("Samstag : "), F.col("hours_text"))
    return view(spark, d, "listings").select(
        "job_id", O.hours_of_row(F.col("hours_text")).alias("bare"), O.hours_of_row(row).alias("named")
    )


@query
def hours_export(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "listings").select(
        "job_id", O.format_hours(F.col("hours_text")).alias("hours")
    )


@query
def hours_export_all_ranges(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "listings").select(
        "job_id", O.format_hours(F.col("hours_text"), keep_all_ranges=True).alias("hours")
    )


# --- captures -------------------------------------------------------------------


@query
def page_class(spark: SparkSession, d: str) -> DataFrame:
    return E.classify_pages(view(spark, d, "captures")).select("job_id", "rank", "page_class")


@query
def page_candidates(spark: SparkSession, d: str) -> DataFrame:
    return E.extract_candidates(table(spark, d, "pages"), ["page_id"], PAGE_SELECTORS)


@query
def first_valid(spark: SparkSession, d: str) -> DataFrame:
    found = E.extract_candidates(table(spark, d, "pages"), ["page_id"], PAGE_SELECTORS)
    return E.first_valid(found, ["page_id"])


@query
def capture_first_valid(spark: SparkSession, d: str) -> DataFrame:
    """All fields of all captures through the long table of candidates."""
    found = E.extract_candidates(view(spark, d, "captures"), ["job_id", "rank"])
    return E.first_valid(found, ["job_id", "rank"], wide=True)


@query
def page_phone(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(
        "page_id", C.scan_phone(H.page_text(H.readable(F.col("html")))).alias("phone")
    )


@query
def coordinates(spark: SparkSession, d: str) -> DataFrame:
    found = E.with_tokens(view(spark, d, "captures")).select(
        "job_id", "rank", E.coordinates_of(F.col("url"), F.col("html"), page=F.col("_page")).alias("c")
    )
    return found.select("job_id", "rank", "c.latitude", "c.longitude")


@query
def website_pick(spark: SparkSession, d: str) -> DataFrame:
    return E.with_tokens(view(spark, d, "captures")).select(
        "job_id", "rank", E.website_of(F.col("_page")).alias("website")
    )


@query
def social_links(spark: SparkSession, d: str) -> DataFrame:
    found = E.with_tokens(view(spark, d, "captures")).select(
        "job_id", "rank", E.social_of_page(F.col("_page")).alias("m")
    )
    return found.select(
        "job_id", "rank", *(F.element_at("m", F.lit(p)).alias(p) for p in E.PLATFORMS)
    )


@query
def hours_map(spark: SparkSession, d: str) -> DataFrame:
    found = E.with_tokens(view(spark, d, "captures")).select(
        "job_id", "rank", E.hours_of_page(F.col("_page")).alias("m")
    )
    return found.select(
        "job_id", "rank",
        *(F.coalesce(F.element_at("m", F.lit(day)), F.lit("")).alias(day.lower()) for day in O.DAYS),
    )


@query
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    pages = view(spark, d, "captures").select("job_id", "rank", "url", "html")
    return E.extract_fields(pages).select(
        "job_id", "rank", "found_name", "full_address", "found_phone", "rating", "reviews_count",
        "website", "category", "coordinates.latitude", "coordinates.longitude",
    )


# --- places ---------------------------------------------------------------------


def _jobs_and_captures(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    jobs = view(spark, d, "listings").select("job_id", "batch_id", *L.LISTING_COLUMNS)
    captures = view(spark, d, "captures").select("job_id", "rank", "url", "html")
    return jobs, captures


@query
def shared_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates of business pages that were shared by address."""
    shared = F.concat_ws("", F.lit("https://maps.example.org/s/@"), "lat_text", F.lit(","), "lng_text", F.lit(",15z"))
    captures = view(spark, d, "captures").withColumn("share_url", shared)
    found = E.business_records(captures).where("record IS NOT NULL")
    return found.select("job_id", "rank", "record.coordinates.latitude", "record.coordinates.longitude")


@query
def capture_store(spark: SparkSession, d: str) -> DataFrame:
    """Captures kept as Parquet, read back."""
    folder = scratch_folder(spark, "captures")
    view(spark, d, "captures").select("job_id", "rank", "url", "html").write.parquet(folder)
    return captures.load_captures(spark, folder).select(
        "job_id", "rank", "url", F.length("html").cast("long").alias("characters")
    )


@query
def first_success(spark: SparkSession, d: str) -> DataFrame:
    jobs, captures = _jobs_and_captures(spark, d)
    return P.first_success(A.build_attempts(jobs), captures)


@query
def missing_places(spark: SparkSession, d: str) -> DataFrame:
    jobs, captures = _jobs_and_captures(spark, d)
    found = P.first_success(A.build_attempts(jobs), captures)
    missing = jobs.join(found.select("job_id"), "job_id", "left_anti")
    empty = P.empty_results(missing, P.NOT_FOUND, F.lit(None).cast("timestamp"))
    return empty.drop("socialMedia", "openingHours", "scrapedAt")


@query
def enrich(spark: SparkSession, d: str) -> DataFrame:
    places = P.enrich(*_jobs_and_captures(spark, d))
    return places.select(
        "job_id", "batch_id", *P.SCRAPED_COLUMNS[:13],
        F.element_at("socialMedia", F.lit("facebook")).alias("facebook"),
        F.element_at("openingHours", F.lit("Monday")).alias("monday"),
        F.element_at("openingHours", F.lit("Friday")).alias("friday"),
        "status", "error",
    )


@query
def result_list_guard(spark: SparkSession, d: str) -> DataFrame:
    """Names taken from every capture, lists of results included."""
    jobs, captures = _jobs_and_captures(spark, d)
    title = H.first_text(F.col("html"), "h1")
    fields = E.extract_fields(captures.withColumn("_title", title))
    found = fields.select("job_id", "rank", "_title", F.col("website").alias("_website"))
    rows = P.empty_results(jobs, "", F.lit(None).cast("timestamp")).join(found, "job_id")
    shown = rows.withColumns(
        {"fullName": F.col("_title"), "website": F.col("_website"), "status": F.lit("success")}
    )
    return P.guard_result_list(shown).select("job_id", "rank", "fullName", "website", "status", "error")


@query
def coordinate_range(spark: SparkSession, d: str) -> DataFrame:
    # one listing in four gets a latitude beyond the poles
    lat = F.when(F.col("k") % 4 == 0, F.concat(F.lit("107"), F.col("lat_text"))).otherwise(
        F.col("lat_text")
    )
    rows = view(spark, d, "listings").select(
        "job_id",
        F.col("rating_text").alias("rating"),
        F.regexp_replace("reviews_text", "[^0-9]", "").alias("reviewsCount"),
        lat.alias("latitude"),
        F.col("lng_text").alias("longitude"),
    )
    return P.typed_places(rows).select(
        "job_id", "rating_num", "reviews_num", "lat", "lng", "coordinates_ok"
    )


@query
def export17(spark: SparkSession, d: str) -> DataFrame:
    """From listings and captures to the export: the whole pipeline."""
    return P.export17(P.enrich(*_jobs_and_captures(spark, d)), keys=["job_id"])


@query
def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.export_lines(view(spark, d, "export").select(*P.EXPORT_COLUMNS))


@query
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The export written with its byte order mark and read back."""
    folder = scratch_folder(spark, "export")
    rows = view(spark, d, "export")
    sinks.write_export(rows.select(*(T.csv_text(F.col(f"`{c}`")).alias(c) for c in P.EXPORT_COLUMNS)), folder)
    read = spark.read.option("header", True).option("escape", '"').csv(folder)
    return read.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in P.EXPORT_COLUMNS))


# --- batches --------------------------------------------------------------------


@query
def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    return B.queue_stats(view(spark, d, "jobs"))


@query
def jobs_of_batch(spark: SparkSession, d: str) -> DataFrame:
    return B.jobs_of_batch(view(spark, d, "jobs"), "b7").select("job_id", "state")


@query
def union_of_states(spark: SparkSession, d: str) -> DataFrame:
    return B.jobs_in_states(view(spark, d, "jobs")).select("job_id", "batch_id", "state")


@query
def batch_progress(spark: SparkSession, d: str) -> DataFrame:
    return B.batch_progress(view(spark, d, "jobs"))


@query
def batch_status(spark: SparkSession, d: str) -> DataFrame:
    return B.batch_status(view(spark, d, "jobs"))


@query
def batch_timing(spark: SparkSession, d: str) -> DataFrame:
    return B.batch_timing(view(spark, d, "jobs"))


@query
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return B.batch_summary(view(spark, d, "jobs"), view(spark, d, "job_results"))


@query
def jobs_with_results(spark: SparkSession, d: str) -> DataFrame:
    rows = B.job_result_rows(view(spark, d, "jobs"), view(spark, d, "job_results"))
    return rows.select(
        "job_id", "state", "is_result", "scraped_status", "processing_ms",
        T.iso_utc(F.col("result_at")).alias("result_at"), "error", "worker",
    )


def _stored_jobs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    name = uuid.uuid4().hex
    return (
        stores.store_jobs(view(spark, d, "jobs"), f"jobs_{name}", buckets=8),
        stores.store_results(view(spark, d, "job_results"), f"results_{name}", buckets=8),
    )


@query
def stored_jobs_of_batch(spark: SparkSession, d: str) -> DataFrame:
    """One batch of a stored table, from its folder alone."""
    jobs, _ = _stored_jobs(spark, d)
    return B.jobs_of_batch(jobs, "b7").select("job_id", "state")


@query
def stored_jobs_with_results(spark: SparkSession, d: str) -> DataFrame:
    """Stored jobs with their results, joined bucket by bucket."""
    return B.job_result_rows(*_stored_jobs(spark, d)).select(
        "job_id", "state", "is_result", "scraped_status", "processing_ms",
        T.iso_utc(F.col("result_at")).alias("result_at"), "error", "worker",
    )


@query
def batch_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = B.batch_documents(view(spark, d, "jobs"), view(spark, d, "job_results"))
    return docs.select(
        "batch_id", "status",
        "progress.total", "progress.completed", "progress.failed", "progress.percentage",
        "timing.createdAt", "timing.lastProcessedAt", "timing.estimatedTimeRemaining",
        "summary.successfulScrapes", "summary.failedScrapes",
    )


@query
def result_envelopes(spark: SparkSession, d: str) -> DataFrame:
    return B.result_envelopes(view(spark, d, "jobs"), view(spark, d, "job_results"))


def _jobs_and_records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Jobs with their listing, and results with the record of the run."""
    data = view(spark, d, "job_data")
    jobs = view(spark, d, "jobs").join(data.select("job_id", *B.ORIGINAL_FIELDS), "job_id")
    scraped = F.struct(
        F.col("full_name").alias("fullName"), "rating", F.col("reviews_count").alias("reviewsCount"), "website"
    )
    records = data.where("has_record").select("job_id", scraped.alias("scraped"))
    return jobs, view(spark, d, "job_results").join(records, "job_id", "left")


def _flat_result(row: str) -> list[Column]:
    return [
        F.col(f"{row}originalData.name").alias("name"), F.col(f"{row}originalData.city").alias("city"),
        F.col(f"{row}originalData.postal_code").alias("postal_code"),
        F.col(f"{row}scrapedData.fullName").alias("full_name"), F.col(f"{row}scrapedData.website").alias("website"),
        F.col(f"{row}processingTime").alias("processing_ms"), F.col(f"{row}processedAt").alias("processed_at"),
        F.col(f"{row}worker").alias("worker"), F.col(f"{row}error").alias("error"),
    ]


@query
def result_payloads(spark: SparkSession, d: str) -> DataFrame:
    rows = B.result_payloads(*_jobs_and_records(spark, d))
    return rows.select("batch_id", "index", "job_id", *_flat_result("result."))


@query
def batch_document_results(spark: SparkSession, d: str) -> DataFrame:
    """The result lists of the batch documents, read back from their files."""
    folder = scratch_folder(spark, "documents")
    lines = B.document_lines(*_jobs_and_records(spark, d))
    sinks.write_document_lines(lines, folder)
    entry = (
        "index LONG, jobId STRING, originalData STRUCT<name STRING, city STRING, postal_code STRING>, "
        "scrapedData STRUCT<fullName STRING, website STRING>, processingTime LONG, processedAt STRING, "
        "worker STRING, error STRING"
    )
    read = spark.read.schema("value STRING, batch_id STRING").text(folder)
    entries = read.where(F.ltrim(F.col("value"), F.lit(",")).startswith('{"index":'))
    parsed = entries.select("batch_id", F.from_json(F.ltrim(F.col("value"), F.lit(",")), entry).alias("r"))
    return parsed.select("batch_id", "r.index", F.col("r.jobId").alias("job_id"), *_flat_result("r."))


@query
def run_envelopes(spark: SparkSession, d: str) -> DataFrame:
    return B.envelope_of_run(view(spark, d, "runs"))


@query
def retention(spark: SparkSession, d: str) -> DataFrame:
    return B.keep_latest(view(spark, d, "jobs")).select("job_id", "state")


@query
def worker_retention(spark: SparkSession, d: str) -> DataFrame:
    return B.keep_latest(view(spark, d, "jobs"), B.WORKER_KEEP).select("job_id", "state")


@query
def recent_completed(spark: SparkSession, d: str) -> DataFrame:
    jobs = view(spark, d, "jobs").where("processed_at IS NOT NULL")
    return B.recent_completions(jobs, view(spark, d, "job_results"))


@query
def recent_failed(spark: SparkSession, d: str) -> DataFrame:
    jobs = view(spark, d, "jobs").where("processed_at IS NOT NULL")
    return B.recent_failures(jobs, view(spark, d, "job_results"))


@query
def active_jobs(spark: SparkSession, d: str) -> DataFrame:
    return B.active_jobs(view(spark, d, "jobs"))


@query
def result_index(spark: SparkSession, d: str) -> DataFrame:
    return B.result_index(view(spark, d, "jobs"))


@query
def worker_health(spark: SparkSession, d: str) -> DataFrame:
    return B.worker_health(view(spark, d, "jobs"), _at(AS_OF))


@query
def worker_health_cases(spark: SparkSession, d: str) -> DataFrame:
    """Health of all jobs, of jobs that only wait, and of jobs of which most have failed."""
    jobs = view(spark, d, "jobs")
    cases = {
        "all": jobs,
        "idle": jobs.where("state = 'waiting'"),
        "failing": jobs.where("state IN ('active', 'failed')"),
    }
    found = [
        B.worker_health(part, _at(AS_OF)).select(
            F.lit(name).alias("of"), "status", "reason", "waiting", "active", "completed", "failed"
        )
        for name, part in cases.items()
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


# --- quality --------------------------------------------------------------------


@query
def quality_profile(spark: SparkSession, d: str) -> DataFrame:
    return Q.quality_profile(view(spark, d, "export"))


@query
def hours_issues(spark: SparkSession, d: str) -> DataFrame:
    return Q.hours_format_issues(view(spark, d, "export")).select(
        "job_id", F.col("Name").alias("name"), F.col("`Monday Hours`").alias("hours"), "reason"
    )


@query
def hours_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.hours_issue_counts(view(spark, d, "export"))


@query
def region_completeness(spark: SparkSession, d: str) -> DataFrame:
    return Q.region_completeness(view(spark, d, "export"))


@query
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    return Q.recommendations(view(spark, d, "export"))


@query
def recommendation_lines(spark: SparkSession, d: str) -> DataFrame:
    return Q.recommendation_lines(view(spark, d, "export"))


@query
def success_grade(spark: SparkSession, d: str) -> DataFrame:
    return Q.success_grade(view(spark, d, "export"))


@query
def failed_list(spark: SparkSession, d: str) -> DataFrame:
    return Q.problem_list(view(spark, d, "export"), "failed", ["job_id"])


@query
def partial_list(spark: SparkSession, d: str) -> DataFrame:
    return Q.problem_list(view(spark, d, "export"), "partial", ["job_id"])


# --- job events -----------------------------------------------------------------


def _event_totals(spark: SparkSession, d: str) -> DataFrame:
    jobs = view(spark, d, "job_events").select("batch_id", "job_id").distinct()
    return S.batch_totals(jobs)


def _iso(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: T.iso_utc(F.col(c)) for c in columns})


@query
def job_states(spark: SparkSession, d: str) -> DataFrame:
    return _iso(S.job_states(view(spark, d, "job_events")), "last_event_at")


@query
def finished_once(spark: SparkSession, d: str) -> DataFrame:
    return _iso(S.finished_once(view(spark, d, "job_events")), "event_ts")


@query
def progress(spark: SparkSession, d: str) -> DataFrame:
    return S.progress(view(spark, d, "job_events"), _event_totals(spark, d))


@query
def progress_payloads(spark: SparkSession, d: str) -> DataFrame:
    rows = S.progress(view(spark, d, "job_events"), _event_totals(spark, d))
    return _iso(S.progress_events(rows, _at(EVENTS_AS_OF)), "ts")


@query
def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    return _iso(S.recent_activity(view(spark, d, "job_events")), "window_start", "window_end")


@query
def stalled_jobs(spark: SparkSession, d: str) -> DataFrame:
    stalled = S.stalled_jobs(view(spark, d, "job_events"), _at(EVENTS_AS_OF))
    return _iso(stalled, "last_event_at")


@query
def stalled_spells(spark: SparkSession, d: str) -> DataFrame:
    spells = S.stalled_spells(view(spark, d, "job_events"), silence="6 hours")
    return _iso(spells, "stalled_at")


def _event_stream(spark: SparkSession, d: str, sql: str = JOB_EVENTS) -> DataFrame:
    """The events file as a file stream, through a view over it."""
    for key, value in S.STATE_STORE_CONF.items():
        spark.conf.set(key, value)
    raw = table(spark, d, "events")
    # as a pattern, for the stream to take the table as one file or as a folder of them
    stream = spark.readStream.schema(raw.schema).parquet(f"{d}/[e]vents.parquet")
    # the same projection as the view, over the stream
    name = f"events_{uuid.uuid4().hex}"
    stream.createOrReplaceTempView(name)
    return spark.sql(sql.format(events=name))


def _run_stream(spark: SparkSession, df: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over what is there and return all it has put out, with ``epoch``."""
    folder = scratch_folder(spark, name)

    def write(rows: DataFrame, epoch: int) -> None:
        rows.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(
            f"{folder}/out/part={epoch}"
        )

    run = (
        df.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    schema = T_.StructType([*df.schema.fields, T_.StructField("epoch", T_.LongType())])
    return spark.read.schema(schema).parquet(f"{folder}/out").drop("part")


def _latest(rows: DataFrame, key: list[str]) -> DataFrame:
    """Last state put out for each key by a stream in update mode."""
    values = [c for c in rows.columns if c not in (*key, "epoch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), "epoch").alias("_v")).select(
        *key, "_v.*"
    )


@query
def stream_job_states(spark: SparkSession, d: str) -> DataFrame:
    out = _run_stream(spark, S.job_states(_event_stream(spark, d)), "states", "update")
    return _iso(_latest(out, ["batch_id", "job_id"]), "last_event_at")


@query
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    rows = S.progress(_event_stream(spark, d), _event_totals(spark, d))
    return _latest(_run_stream(spark, rows, "progress", "update"), ["batch_id"])


@query
def stream_complete(spark: SparkSession, d: str) -> DataFrame:
    """The event that ends each finished batch, as the stream puts it out."""
    rows = S.progress(_event_stream(spark, d), _event_totals(spark, d))
    events = S.progress_events(rows, _at(EVENTS_AS_OF)).where("event = 'complete'")
    out = _run_stream(spark, events, "complete", "update")
    return out.select("event", "batch_id", "payload_json").distinct()


@query
def stream_results(spark: SparkSession, d: str) -> DataFrame:
    out = _run_stream(spark, S.finished_once(_event_stream(spark, d)), "results", "append")
    return out.select("batch_id", "job_id")


@query
def stream_recent_activity(spark: SparkSession, d: str) -> DataFrame:
    out = _run_stream(spark, S.recent_activity(_event_stream(spark, d)), "recent", "update")
    return _iso(_latest(out, ["window_start", "window_end"]), "window_start", "window_end")


@query
def stream_completions(spark: SparkSession, d: str) -> DataFrame:
    """Batches as they are completed; each comes out of the stream once."""
    rows = K.completions(_event_stream(spark, d), _event_totals(spark, d))
    return _run_stream(spark, rows, "completions", "update").drop("epoch")


def _tracked(spark: SparkSession, d: str, kind: str) -> DataFrame:
    six_hours, for_ever = 6 * 3_600_000, 10**12
    rows = K.track_jobs(_event_stream(spark, d), six_hours, for_ever).where(F.col("kind") == kind)
    return _iso(_run_stream(spark, rows, kind, "update").drop("epoch", "kind"), "at")


@query
def stream_stalls(spark: SparkSession, d: str) -> DataFrame:
    """Stalls by timers: those of the table whose moment the last watermark has passed."""
    return _tracked(spark, d, "stall").select("batch_id", "job_id", F.col("at").alias("stalled_at"))


@query
def stream_first_ends(spark: SparkSession, d: str) -> DataFrame:
    """The first end of each job by event time, once, from the tracker."""
    ends = _tracked(spark, d, "result")
    return ends.select("batch_id", "job_id", F.col("state").alias("event"), F.col("at").alias("event_ts"))


@query
def stream_result_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Ends of runs with listing and record, numbered inside their batch."""
    results = _event_stream(spark, d, EVENT_RESULTS)
    rows = K.result_payload_events(_event_stream(spark, d), results)
    out = _run_stream(spark, rows, "payloads", "append")
    listed = position_in_group(out, ["batch_id"], [F.col("event_ts"), F.col("job_id")], "index")
    return _iso(listed, "event_ts").select(
        "batch_id", F.col("index").cast("long").alias("index"), "job_id", "event", "event_ts", "has_result",
        "name", "city", "full_name", "rating", "processing_ms",
    )


@query
def stream_stalled_spells(spark: SparkSession, d: str) -> DataFrame:
    """Only spells that ended before the final watermark come out of the stream."""
    spells = S.stalled_spells(_event_stream(spark, d), silence="6 hours")
    out = _run_stream(spark, spells, "stalled", "append")
    return _iso(out.drop("epoch"), "stalled_at")
