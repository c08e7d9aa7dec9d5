"""From stored page captures to field values.

Each field has an ordered list of selectors; the first candidate its rule accepts
wins. The candidates of a page are looked at inside that page's row, in order and
only until one is accepted, so extraction is one narrow pass without a shuffle.
``extract_candidates`` and ``first_valid`` offer the same work as a long table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.functions import contact as C
from listingloom.functions import hours as O
from listingloom.functions import html as H
from listingloom.functions import text as T

# Ordered selectors per field.
SELECTORS = {
    "name": ["h1.DUwDvf", "h1.fontHeadlineLarge", "h1"],
    "address": [
        'button[data-item-id="address"] .Io6YTe',
        '[data-item-id="address"] .fontBodyMedium',
        'button[aria-label*="ddress"] .Io6YTe',
    ],
    "phone": [
        'button[data-item-id="phone:tel"] .Io6YTe',
        'button[data-item-id="phone:tel"]',
        '[data-item-id*="phone"] button',
        '[data-item-id*="phone"] .fontBodyMedium',
        '[data-item-id*="phone"] div[class*="fontBody"]',
        'a[href^="tel:"]',
        'button[aria-label*="Call"]',
        'button[aria-label*="Anrufen"]',
        'button[aria-label*="Llamar"]',
        'button[aria-label*="Appeler"]',
        'button[aria-label*="phone"] .Io6YTe',
        'button[aria-label*="telefon"]',
        'button[aria-label*="téléphone"]',
        '[data-tooltip*="phone"]',
        '[data-tooltip*="Call"]',
        'button[jsaction*="phone"]',
    ],
    "rating": [
        ".F7nice .ceNzKf",
        "span.ceNzKf",
        'div[jsaction*="pane.rating"] span',
        'div[role="img"][aria-label*="star"] + span',
        'div[role="img"][aria-label*="stern"] + span',
        'div[role="img"][aria-label*="estrell"] + span',
        ".fontDisplayLarge",
        'button[aria-label*="stars"] span',
        '[aria-label*="rating"] span',
    ],
    "reviews": [
        ".F7nice .MW4etd",
        'button[aria-label*="eview"] .MW4etd',
        'button[aria-label*="ewertung"] .MW4etd',
        'button[aria-label*="eseña"] .MW4etd',
        'button[aria-label*="ecensio"] .MW4etd',
        'button[jsaction*="pane.rating"] .MW4etd',
        ".fontBodyMedium.MW4etd",
        "span.MW4etd",
        '[aria-label*="reviews"] span',
    ],
    "category": [
        ".DkEaL",
        'button[jsaction*="pane.category"]',
        ".fontBodyMedium:not(.MW4etd):not(.ceNzKf)",
    ],
}
# Ordered selectors for the website link.
WEBSITE_SELECTORS = [
    'a[data-item-id="authority"]',
    'button[data-item-id="authority"]',
    'a[href^="http"]:not([href*="google"]):not([href*="maps"])',
]
# Ordered selectors for the rows of the hours table.
HOURS_SELECTORS = [
    ".t39EBf .y0skZc",
    '[data-item-id="oh"] .y0skZc',
    ".section-open-hours-container .y0skZc",
    ".section-info-hours .y0skZc",
    '[aria-label*="hours"] .y0skZc',
    ".opening-hours .y0skZc",
    '.t39EBf div[class*="fontBody"]',
    '[data-item-id="oh"] div[role="row"]',
    '.section-open-hours div[class*="fontBody"]',
]
# Elements that give a list of results away, and the words they hold.
RESULT_SELECTORS = [
    'div[role="main"] h1:has-text("Ergebnisse")',
    'div[role="main"] h1:has-text("Results")',
    'div[role="main"] h1:has-text("Resultados")',
    'div[role="main"] h1:has-text("Résultats")',
    'h1:has-text("Ergebnisse für")',
    'h1:has-text("Results for")',
    '.section-hero-header-title:has-text("Ergebnisse")',
    '[data-attrid="title"]:has-text("Ergebnisse")',
    'div[aria-label*="results"]',
    'div[aria-label*="Ergebnisse"]',
    ".section-result-content",
    ".section-scrollable-list .section-result",
]
RESULT_PAGE_WORDS = ["Ergebnisse", "Results", "Resultados", "Résultats"]
# Elements only a business page has, and words they must not hold.
BUSINESS_SELECTORS = [
    'h1[data-attrid="title"]:not(:has-text("Ergebnisse")):not(:has-text("Results"))',
    'h1.DUwDvf:not(:has-text("Ergebnisse")):not(:has-text("Results"))',
    '[data-item-id="address"]',
    ".MW4etd",
    ".F7nice",
    'button[data-item-id="address"]',
    '[data-attrid="kc:/collection/knowledge_panels/local_entity:title"]',
    '.section-hero-header-title-title:not(:has-text("Ergebnisse"))',
    ".place-name",
]
BUSINESS_PAGE_NOT = ["Ergebnisse", "Results for", "Resultados para"]
# Platforms, in the order they are tested for.
PLATFORMS = ["facebook", "instagram", "twitter", "linkedin", "youtube"]

RULES: dict[str, Callable[[Column], Column]] = {
    "name": C.valid_name,
    "address": C.valid_text,
    "phone": C.valid_phone,
    "rating": C.valid_rating,
    "reviews": C.valid_reviews,
    "category": C.valid_category,
}
FIELDS = list(RULES)


def page_class(page: Column) -> Column:
    """``results_page``, ``business_page`` or ``unknown``, for the tokens of a page."""

    def shows(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
        def accept(element: Column) -> Column:
            return T.let(H.text_in(page, element), lambda t: F.when(test(t), t))

        return accept

    results = H.first_accepted(
        page, RESULT_SELECTORS, shows(lambda t: C.contains_any(t, RESULT_PAGE_WORDS))
    )
    business = H.first_accepted(
        page,
        BUSINESS_SELECTORS,
        shows(lambda t: (t != "") & ~C.contains_any(t, BUSINESS_PAGE_NOT)),
    )
    return (
        F.when(results.isNotNull(), "results_page")
        .when(business.isNotNull(), "business_page")
        .otherwise("unknown")
    )


def with_tokens(captures: DataFrame) -> DataFrame:
    """Add ``_body``, the page without scripts, and ``_page``, its tokens."""
    body = captures.withColumn("_body", H.readable(F.col("html")))
    return body.select("*", _computed_once(H.tokens(F.col("_body")), "_page"))


def _computed_once(value: Column, name: str) -> Column:
    """A column that filters and projections behind it read but never compute again: the
    optimizer moves neither of them over the rows of a generator."""
    return F.explode(F.array(value)).alias(name)


def classify_pages(captures: DataFrame) -> DataFrame:
    classified = with_tokens(captures).withColumn("page_class", page_class(F.col("_page")))
    return classified.drop("_body", "_page")


def extract_candidates(
    captures: DataFrame, keys: list[str], selectors: dict[str, list[str]] | None = None
) -> DataFrame:
    """Long table ``keys, field, selector_rank, selector, raw`` of all candidates found."""
    page = F.col("_page")
    rows = [
        F.struct(
            F.lit(field).alias("field"),
            F.lit(rank).alias("selector_rank"),
            F.lit(css).alias("selector"),
            H.find(page, css).alias("element"),
        )
        for field, css_list in (selectors or SELECTORS).items()
        for rank, css in enumerate(css_list, start=1)
    ]
    found = F.filter(F.array(*rows), lambda c: c["element"].isNotNull())
    named = ("field", "selector_rank", "selector")
    texts = F.transform(
        found,
        lambda c: F.struct(
            *(c[n].alias(n) for n in named), H.text_in(page, c["element"]).alias("raw")
        ),
    )
    found_on_page = with_tokens(captures).select(*keys, F.explode(texts).alias("_c"))
    return found_on_page.select(*keys, "_c.*")


def validate_candidates(candidates: DataFrame) -> DataFrame:
    """Add ``value``: the accepted form of ``raw`` under its field's rule, or null."""

    def value_of(raw: Column) -> Column:
        value = None
        for field, rule in RULES.items():
            hit = F.col("field") == field
            value = F.when(hit, rule(raw)) if value is None else value.when(hit, rule(raw))
        return value.otherwise(C.valid_text(raw))

    return candidates.withColumn("value", T.let(F.col("raw"), value_of))


def first_valid(candidates: DataFrame, keys: list[str], wide: bool = False) -> DataFrame:
    """Best-ranked accepted value per key and field; ``wide`` gives a column per field."""
    accepted = validate_candidates(candidates).where(F.col("value").isNotNull())
    # filtered first, then combined before the shuffle: at most one row per page and field
    if not wide:
        return accepted.groupBy(*keys, "field").agg(
            F.min_by("value", "selector_rank").alias("value")
        )
    return accepted.groupBy(*keys).agg(
        *(
            F.coalesce(
                F.min_by(
                    F.when(F.col("field") == field, F.col("value")),
                    F.when(F.col("field") == field, F.col("selector_rank")),
                ),
                F.lit(""),
            ).alias(field)
            for field in FIELDS
        )
    )


def field_value(page: Column, field: str) -> Column:
    """First accepted candidate of a field on a page, or the empty string."""
    found = H.first_accepted(
        page, SELECTORS[field], lambda e: T.let(H.text_in(page, e), RULES[field])
    )
    return F.coalesce(found, F.lit(""))


def website_of(page: Column) -> Column:
    """Website link: per selector ``href``, then ``data-href``, then a web address as text."""

    def pick(element: Column) -> Column:
        href, data = (H.element_attribute(element, name) for name in ("href", "data-href"))
        text = H.text_in(page, element)
        return (
            F.when(href.startswith("http") & ~href.contains("google.com"), href)
            .when(data.startswith("http"), data)
            .when(text.startswith("http"), T.strip(text))
        )

    return F.coalesce(H.first_accepted(page, WEBSITE_SELECTORS, pick), F.lit(""))


def coordinates_of(
    url: Column, html: Column, share_url: Column | None = None, page: Column | None = None
) -> Column:
    """``struct(latitude, longitude)`` as text from the page address, page data, geo
    meta tag or share address, in that order; empty texts if there are none. ``page`` are
    the page's tokens, where they are at hand."""
    at = r"@(-?[0-9]+\.[0-9]+),(-?[0-9]+\.[0-9]+),[0-9]+\.?[0-9]*z"
    bang = r"!3d(-?[0-9]+\.[0-9]+)!4d(-?[0-9]+\.[0-9]+)"
    # a pair of long decimals counts only inside the page's own start-up data, which
    # ends with its script
    start = F.instr(html, "APP_INITIALIZATION_STATE")
    script = F.substring_index(F.substr(html, F.greatest(start, F.lit(1))), "</script", 1)
    state = r"(-?[0-9]+\.[0-9]{6,}),(-?[0-9]+\.[0-9]{6,})"
    pairs = [
        (url, at, None),
        (url, bang, None),
        (script, state, "APP_INITIALIZATION_STATE"),
    ]

    def pair(text: Column, pattern: str, literal: str | None) -> Column:
        lat, lng = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
        found = lat != ""
        if literal:
            found = text.contains(literal) & found
        return F.when(found, F.struct(lat.alias("lat"), lng.alias("lng")))

    page = H.tokens(html) if page is None else page

    def names_geo(element: Column) -> Column:
        named = (H.element_attribute(element, name).contains("geo") for name in ("property", "name"))
        return (element["name"] == "meta") & (next(named) | next(named))

    def meta_pair(tag: Column) -> Column:
        parts = F.split(H.element_attribute(tag, "content"), ",")
        number = rf"^{T.WS}*([+-]?[0-9]+(?:\.[0-9]*)?|[+-]?\.[0-9]+)"
        return F.struct(
            F.regexp_extract(F.get(parts, F.lit(0)), number, 1).alias("lat"),
            F.regexp_extract(F.get(parts, F.lit(1)), number, 1).alias("lng"),
        )

    usable = F.filter(
        F.transform(F.filter(page["elements"], names_geo), meta_pair), lambda p: (p["lat"] != "") & (p["lng"] != "")
    )
    options = [pair(*p) for p in pairs]
    first_meta = F.when(html.contains("geo"), F.get(usable, F.lit(0)))
    # page data with a zero in it counts as not found
    nonzero = T.let(
        F.coalesce(options[2], first_meta),
        lambda p: F.when((p["lat"].cast("double") != 0) & (p["lng"].cast("double") != 0), p),
    )
    options = [options[0], options[1], nonzero]
    if share_url is not None:
        options.append(pair(share_url, at, None))

    def as_text(p: Column) -> Column:
        return F.struct(
            *(
                F.coalesce(T.number_text(p[part].cast("double")), F.lit("")).alias(name)
                for part, name in (("lat", "latitude"), ("lng", "longitude"))
            )
        )

    return T.let(F.coalesce(*options), as_text)


def hours_of_page(page: Column) -> Column:
    """Map from English day to hours; the last row of a day wins."""
    # the first selector with a row that names a day decides
    usable = F.filter(
        H.all_texts(page, HOURS_SELECTORS), lambda rows: F.exists(rows, O.names_a_day)
    )
    texts = F.filter(F.get(usable, F.lit(0)), O.names_a_day)
    found = T.let(F.transform(texts, O.row_of), hours_map)
    return F.coalesce(found, F.create_map().cast("map<string,string>"))


def hours_map(rows: Column) -> Column:
    """Map from ``array<struct<day, hours>>``; of a repeated day the last row is kept."""
    latest_first = F.reverse(rows)
    days = F.array_distinct(F.transform(latest_first, lambda r: r["day"]))
    # array_position finds the first row of a day, which is the last of the page
    row_days = F.transform(latest_first, lambda r: r["day"])
    return F.map_from_arrays(
        days,
        F.transform(
            days,
            lambda d: F.element_at(latest_first, F.array_position(row_days, d).cast("int"))["hours"],
        ),
    )


def social_of_page(page: Column) -> Column:
    """Map from platform to link; the last link of a platform wins."""

    def platform_map(links: Column) -> Column:
        def platform_of(link: Column) -> Column:
            out = None
            for platform in PLATFORMS:
                hit = link.contains(platform)
                out = F.when(hit, platform) if out is None else out.when(hit, platform)
            return out

        def last(platform: str) -> Column:
            return T.let(
                F.filter(links, lambda link: platform_of(link) == platform),
                lambda found: F.when(
                    F.size(found) > 0,
                    F.struct(F.lit(platform).alias("key"), F.element_at(found, -1).alias("value")),
                ),
            )

        return F.map_from_entries(F.array_compact(F.array(*(last(p) for p in PLATFORMS))))

    return T.let(H.link_targets(page), platform_map)


def page_record(
    url: Column, html: Column, body: Column, page: Column, share_url: Column | None = None
) -> Column:
    """``struct`` of the values found on a page. ``phone`` is the first accepted candidate
    or else the first number in the page text; it is not yet in international form,
    which needs the listing's country."""
    phone = T.let(
        field_value(page, "phone"),
        lambda p: F.when(p != "", p).otherwise(C.scan_phone(H.page_text(body))),
    )
    values = {
        "found_name": field_value(page, "name"),
        "full_address": field_value(page, "address"),
        "found_phone": phone,
        "rating": field_value(page, "rating"),
        "reviews_count": field_value(page, "reviews"),
        "website": website_of(page),
        "category": field_value(page, "category"),
        "coordinates": coordinates_of(url, html, share_url, page),
        "social_media": social_of_page(page),
        "opening_hours": hours_of_page(page),
    }
    return F.struct(*(value.alias(name) for name, value in values.items()))


def _record(share_url: str | None) -> Column:
    columns = (F.col(c) for c in ("url", "html", "_body", "_page"))
    return page_record(*columns, F.col(share_url) if share_url else None)


def extract_fields(captures: DataFrame, share_url: str | None = None) -> DataFrame:
    """Replace ``html`` by the values found on the page."""
    kept = [c for c in captures.columns if c != "html"]
    read = with_tokens(captures).select(*kept, _record(share_url).alias("_r"))
    return read.select(*kept, "_r.*")


def business_records(captures: DataFrame) -> DataFrame:
    """``job_id, rank, record`` of every capture; the record is null unless the capture is
    a business page, and only then is the page read. A ``share_url`` column, where there is
    one, is the last place coordinates are looked for."""
    share = [c for c in ("share_url",) if c in captures.columns]
    business = page_class(F.col("_page")) == "business_page"
    record = F.when(business, _record(*share or [None]))
    return with_tokens(captures.select("job_id", "rank", "url", "html", *share)).select(
        "job_id", "rank", _computed_once(record, "record")
    )
