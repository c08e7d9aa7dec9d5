"""Profiles of exported results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.functions.text import is_blank, or_empty, percent, special_letters
from listingloom.operators.ordering import position_in_group

# Address parts that name a region, in the order they are tested.
REGIONS = {
    "Switzerland": ["Switzerland", "Schweiz"],
    "Colombia": ["Colombia"],
    "Spain": ["Spain"],
    "Germany": ["Germany"],
}
# Reasons an hours text is reported for.
NOT_24H, AM_PM, GLUED = "Not 24h format", "Contains am/pm", "Bad format (concatenated)"


def _has(column: str) -> Column:
    return ~is_blank(F.col(column))


def _success() -> Column:
    return F.col("Status") == "success"


def _partial() -> Column:
    """Success with coordinates but without rating, phone and Monday hours."""
    data = _has("Rating") | _has("Phone") | _has("Monday Hours")
    return _success() & ~data & _has("Latitude") & _has("Longitude")


def hours_issue() -> Column:
    """Why a success row's Monday hours are not in export form; null if they are."""
    hours = F.col("Monday Hours")
    in_form = hours.rlike(r"^[0-9]{2}:[0-9]{2}\s*-\s*[0-9]{2}:[0-9]{2}")
    reason = (
        F.when(~in_form & ~hours.isin("Closed", "Open 24 hours"), NOT_24H)
        .when(hours.rlike("(?i)am|pm"), AM_PM)
        .when(hours.rlike("[0-9]{4}:[0-9]{2}"), GLUED)
    )
    return F.when(_success() & _has("Monday Hours"), reason)


def quality_profile(export: DataFrame) -> DataFrame:
    """One row: totals, completeness of successful rows, and whole percents."""
    counts = {
        "total": F.count(F.lit(1)),
        "success": F.count_if(_success()),
        "failed": F.count_if(F.col("Status") == "failed"),
        "partial": F.count_if(_partial()),
        "with_hours": F.count_if(_success() & (_has("Monday Hours") | _has("Tuesday Hours"))),
        "with_rating": F.count_if(_success() & _has("Rating")),
        "with_reviews": F.count_if(_success() & _has("Reviews Count")),
        "with_phone": F.count_if(_success() & _has("Phone")),
        "with_website": F.count_if(_success() & _has("Website")),
        "hours_issues": F.count_if(hours_issue().isNotNull()),
    }
    flat = export.agg(*(c.alias(n) for n, c in counts.items()))
    of_total, of_success = F.col("total"), F.col("success")
    percents = {n: of_total for n in ("success", "failed", "partial")} | {
        f"with_{n}": of_success for n in ("hours", "rating", "reviews", "phone", "website")
    }
    return flat.select(
        *counts,
        *(percent(F.col(n), whole).alias(f"{n}_pct") for n, whole in percents.items()),
    )


def hours_format_issues(export: DataFrame) -> DataFrame:
    """Rows whose Monday hours are not in export form, with the reason."""
    return export.withColumn("reason", hours_issue()).where(F.col("reason").isNotNull())


def hours_issue_counts(export: DataFrame) -> DataFrame:
    return hours_format_issues(export).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def region_of(address: Column) -> Column:
    text, out = or_empty(address), None
    for region, words in REGIONS.items():
        hit = text.rlike("|".join(words))
        out = F.when(hit, region) if out is None else out.when(hit, region)
    return out.otherwise("Unknown")


def region_completeness(export: DataFrame) -> DataFrame:
    """Successful rows per region and the share that has rating, phone and hours."""
    complete = _has("Rating") & _has("Phone") & _has("Monday Hours")
    return (
        export.where(_success())
        .groupBy(region_of(F.col("Address")).alias("region"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(complete).alias("with_all_data"))
        .withColumn("completeness_pct", percent(F.col("with_all_data"), F.col("total")))
    )


def recommendations(export: DataFrame) -> DataFrame:
    """One row per rule that fires: ``rule_no, recommendation``."""
    profile = quality_profile(export)
    # The rules and their texts.
    rules = [
        (F.col("failed") > 20, "High failure rate! Consider:"),
        (
            F.col("with_rating") < F.col("success") * 0.5,
            "Low rating extraction rate. This is normal if:",
        ),
        (F.col("hours_issues") > 0, "Hours format issues detected!"),
        (F.col("partial") > 5, "Many partial successes (coordinates only)"),
    ]
    rows = [
        F.when(
            fires, F.struct(F.lit(no).alias("rule_no"), F.lit(text).alias("recommendation"))
        )
        for no, (fires, text) in enumerate(rules, start=1)
    ]
    return profile.select(F.inline(F.array_compact(F.array(*rows))))


# The lines under each piece of advice.
ADVICE = [
    [
        "1. Adding full addresses to CSV",
        "2. Verifying business names match Google Maps exactly",
        "3. Adding postal codes for better geolocation",
    ],
    [
        "- Businesses are new",
        "- Businesses don't have Google reviews",
        "Consider: Manual verification of a few cases",
    ],
    ["Action: Check normalizeDayNames() function"],
    [
        "Possible causes:",
        "- Google Maps page structure changed",
        "- Selectors need updating",
        "Action: Check Docker logs for specific errors",
    ],
]


def recommendation_lines(export: DataFrame) -> DataFrame:
    """The advice of each rule that fires with its lines: ``rule_no, line_no, line``; the
    headline is line 0."""
    lines = F.get(F.lit(ADVICE), F.col("rule_no") - 1)
    return recommendations(export).select(
        "rule_no",
        F.posexplode(F.concat(F.array("recommendation"), lines)).alias("line_no", "line"),
    )


def success_grade(export: DataFrame) -> DataFrame:
    """Success rate in percent and its grade."""
    rate = F.try_divide(F.count_if(_success()), F.count(F.lit(1))) * 100
    return export.agg(rate.alias("success_rate")).select(
        "success_rate",
        F.when(F.col("success_rate") >= 70, "Good")
        .when(F.col("success_rate") >= 60, "Acceptable")
        .when(F.col("success_rate") < 60, "Poor")
        .alias("grade"),
    )


def problem_list(export: DataFrame, kind: str, order: list[str]) -> DataFrame:
    """Numbered list of failed or partial businesses; ``order`` fixes the numbering."""
    chosen = {"failed": F.col("Status") == "failed", "partial": _partial()}[kind]

    def named(column: str, default: str) -> Column:
        return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))

    rows = export.where(chosen).select(
        *order,
        F.lit(kind).alias("problem"),
        named("Name", "(no name)").alias("name"),
        named("Address", "N/A").alias("address"),
        F.concat_ws(", ", "Latitude", "Longitude").alias("coordinates"),
    )
    return position_in_group(rows, ["problem"], [F.col(c) for c in order], "no", start=1)


def special_letter_counts(texts: DataFrame, column: str) -> DataFrame:
    """Occurrences of each special letter over all texts."""
    return (
        texts.select(F.explode(special_letters(F.col(column))).alias("letter"))
        .groupBy("letter")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def special_letter_census(texts: DataFrame, column: str) -> DataFrame:
    """One row: occurrences, distinct letters and the letters in order."""
    # the letters are a closed set, so what is gathered here has at most 57 rows
    return special_letter_counts(texts, column).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count(F.lit(1)).alias("distinct_letters"),
        F.array_join(F.array_sort(F.collect_list("letter")), ", ").alias("letters"),
    )


def combined_terms(terms: DataFrame) -> DataFrame:
    """Distinct terms per field over all languages: ``field, term, lang_no, pos``.

    ``lang_no`` and ``pos`` tell where a term comes first, which is its order in the
    combined list. The list stays in rows, so a field may have any number of terms.
    """
    # one number per occurrence keeps the aggregate in hash tables
    place = F.shiftleft(F.col("lang_no").cast("bigint"), 32) + F.col("pos")
    first = terms.groupBy("field", "term").agg(F.min(place).alias("_first"))
    return first.select(
        "field",
        "term",
        F.shiftright("_first", 32).alias("lang_no"),
        F.col("_first").bitwiseAND(0xFFFFFFFF).alias("pos"),
    )
