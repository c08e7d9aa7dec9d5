"""Place records: first successful capture per job, failed rows, assembly, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.functions import contact as C
from listingloom.functions import text as T
from listingloom.functions.hours import DAYS, format_hours
from listingloom.operators.attempts import (
    build_attempts,
    detect_country,
    with_locale,
    with_maps_url,
    with_phone_prefix,
)
from listingloom.operators.extract import business_records, classify_pages

# Error texts of failed records.
NOT_FOUND = "Business not found with any search strategy"
ON_RESULT_LIST = "Landing on search results page instead of business page"
NAMELESS_RESULT_LIST = "Search Results Page"

# The export's columns, in order.
EXPORT_COLUMNS = [
    "Name", "Rating", "Reviews Count", "Phone", "Address", "Website", "Category",
    "Latitude", "Longitude",
    "Monday Hours", "Tuesday Hours", "Wednesday Hours", "Thursday Hours", "Friday Hours",
    "Saturday Hours", "Sunday Hours", "Status",
]
SCRAPED_COLUMNS = [
    "originalName", "originalAddress", "originalCity", "originalPostalCode",
    "fullName", "fullAddress", "phone", "rating", "reviewsCount", "website", "category",
    "latitude", "longitude", "socialMedia", "openingHours", "scrapedAt", "status", "error",
]
_EMPTY_MAP = "map<string,string>"


def first_success(attempts: DataFrame, captures: DataFrame) -> DataFrame:
    """Per job the lowest-ranked attempt whose capture is a business page.

    ``captures`` holds ``job_id, rank`` and either ``page_class`` or ``html``, for ranks
    that are among the attempts. Only job and rank are shuffled, not the pages.
    """
    if "page_class" not in captures.columns:
        captures = classify_pages(captures)
    business = F.when(F.col("page_class") == "business_page", F.col("rank"))
    first = captures.groupBy("job_id").agg(F.min(business).alias("rank"))
    tried = attempts.select("job_id", "rank", "strategy", "query")
    return tried.join(first, ["job_id", "rank"])


def _originals() -> list[Column]:
    return [
        T.or_empty(F.col(source)).alias(name)
        for name, source in zip(
            SCRAPED_COLUMNS[:4], ("name", "address", "city", "postal_code")
        )
    ]


def empty_results(jobs: DataFrame, error: str, scraped_at: Column) -> DataFrame:
    """Failed place records for jobs that found nothing."""
    blank = {c: F.lit("") for c in SCRAPED_COLUMNS[4:13]}
    return jobs.select(
        "job_id",
        "batch_id",
        *_originals(),
        *(value.alias(name) for name, value in blank.items()),
        F.create_map().cast(_EMPTY_MAP).alias("socialMedia"),
        F.create_map().cast(_EMPTY_MAP).alias("openingHours"),
        scraped_at.alias("scrapedAt"),
        F.lit("failed").alias("status"),
        F.lit(error).alias("error"),
    )


def with_missing(jobs: DataFrame, found: DataFrame, error: str, scraped_at: Column) -> DataFrame:
    """Place records of the found jobs plus failed records of all the others."""
    missing = jobs.join(found.select("job_id"), "job_id", "left_anti")
    return found.unionByName(empty_results(missing, error, scraped_at))


def guard_result_list(places: DataFrame) -> DataFrame:
    """Fail records whose name shows that the page was a list of results."""
    on_list = C.contains_any(F.col("fullName"), C.RESULT_WORDS)
    fallback = F.when(T.is_blank(F.col("originalName")), NAMELESS_RESULT_LIST).otherwise(
        F.col("originalName")
    )
    guarded = {
        "fullName": F.when(on_list, fallback).otherwise(F.col("fullName")),
        "status": F.when(on_list, "failed").otherwise(F.col("status")),
        "error": F.when(on_list, ON_RESULT_LIST).otherwise(F.col("error")),
    }
    # nothing behind the name is read from such a page
    for column in SCRAPED_COLUMNS[5:13]:
        guarded[column] = F.when(on_list, "").otherwise(F.col(column))
    for column in SCRAPED_COLUMNS[13:15]:
        guarded[column] = F.when(on_list, F.create_map().cast(_EMPTY_MAP)).otherwise(F.col(column))
    return places.withColumns(guarded)


def enrich(jobs: DataFrame, captures: DataFrame, scraped_at: Column | None = None) -> DataFrame:
    """Place record of every job, from its stored captures.

    ``jobs``: ``job_id, batch_id, name, address, city, postal_code``. ``captures``:
    ``job_id, rank, url, html``, one row per attempt that was made. Pages are
    classified and read where they are scanned; what is shuffled is the short record.
    """
    scraped_at = F.lit(None).cast("timestamp") if scraped_at is None else scraped_at
    first = business_records(captures).groupBy("job_id").agg(
        F.min_by("record", F.when(F.col("record").isNotNull(), F.col("rank"))).alias("_p")
    )
    # one join serves both: jobs without a capture come out with a null record
    joined = with_phone_prefix(detect_country(jobs)).join(first, "job_id", "left")
    p, got = F.col("_p"), F.col("_p").isNotNull()
    raw_phone = p["found_phone"]
    phone = F.when(
        T.strip(raw_phone) != "",
        C.normalise_phone(raw_phone, F.col("country"), F.col("prefix")),
    )

    def scraped(value: Column) -> Column:
        return F.coalesce(F.when(got, value), F.lit(""))

    name = F.when(p["found_name"] != "", p["found_name"]).otherwise(T.or_empty(F.col("name")))
    empty_map = F.create_map().cast(_EMPTY_MAP)
    places = joined.select(
        "job_id",
        "batch_id",
        *_originals(),
        scraped(name).alias("fullName"),
        scraped(p["full_address"]).alias("fullAddress"),
        scraped(phone).alias("phone"),
        scraped(p["rating"]).alias("rating"),
        scraped(p["reviews_count"]).alias("reviewsCount"),
        scraped(p["website"]).alias("website"),
        scraped(p["category"]).alias("category"),
        scraped(p["coordinates"]["latitude"]).alias("latitude"),
        scraped(p["coordinates"]["longitude"]).alias("longitude"),
        F.coalesce(p["social_media"], empty_map).alias("socialMedia"),
        F.coalesce(p["opening_hours"], empty_map).alias("openingHours"),
        scraped_at.alias("scrapedAt"),
        F.when(got, "success").otherwise("failed").alias("status"),
        F.when(~got, NOT_FOUND).alias("error"),
    )
    return guard_result_list(places)


def typed_places(places: DataFrame) -> DataFrame:
    """Add number columns for analytics and the coordinate-range flag."""
    lat, lng = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    return places.withColumns(
        {
            "rating_num": F.col("rating").try_cast("double"),
            "reviews_num": F.col("reviewsCount").try_cast("bigint"),
            "lat": lat,
            "lng": lng,
            "coordinates_ok": (F.abs(lat) <= 90) & (F.abs(lng) <= 180),
        }
    )


def plan_searches(jobs: DataFrame) -> DataFrame:
    """Ranked search attempts of every job with country, locale and address."""
    return with_maps_url(build_attempts(with_locale(detect_country(jobs))))


def with_hours_columns(
    df: DataFrame, hours: str = "openingHours", keep_all_ranges: bool = False
) -> DataFrame:
    """Add the seven export columns of a day map."""
    of_days = F.array(*(F.element_at(hours, F.lit(day)) for day in DAYS))
    shown = df.withColumn(
        "_hours", F.transform(of_days, lambda h: format_hours(h, keep_all_ranges))
    )
    columns = {f"{day} Hours": F.get("_hours", F.lit(i)) for i, day in enumerate(DAYS)}
    return shown.withColumns(columns).drop("_hours")


def export17(places: DataFrame, keys: list[str] | None = None, keep_all_ranges: bool = False) -> DataFrame:
    """The 17 export columns. Records without a scrape keep nothing but their status."""
    failed = T.is_blank(F.col("status")) & F.col("fullName").isNull() | (F.col("status") == "failed")
    failed = F.coalesce(failed, F.lit(False))
    cells = {
        "Name": F.col("fullName"),
        "Rating": C.format_rating(F.col("rating")),
        "Reviews Count": C.format_reviews(F.col("reviewsCount")),
        "Phone": C.format_phone(F.col("phone")),
        "Address": F.col("fullAddress"),
        "Website": C.format_website(F.col("website")),
        "Category": F.col("category"),
        "Latitude": F.col("latitude"),
        "Longitude": F.col("longitude"),
        **{f"{day} Hours": F.col(f"`{day} Hours`") for day in DAYS},
    }
    status = F.when(failed, "failed").otherwise(
        F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("unknown"))
    )
    return with_hours_columns(places, "openingHours", keep_all_ranges).select(
        *(keys or []),
        *(F.when(failed, "").otherwise(T.csv_text(c)).alias(n) for n, c in cells.items()),
        status.alias("Status"),
    )
