"""From listings to ranked search attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.functions import text as T
from listingloom.functions.contact import normalise_phone
from listingloom.operators import dims

# City names that decide the country.
CITY_PATTERNS = {
    "CH": rf"zurich|geneva|basel|bern|lausanne|winterthur|lucerne|st\.?{T.WS}*gallen|lugano|biel",
    "DE": "berlin|hamburg|munich|münchen|cologne|köln|frankfurt|stuttgart|düsseldorf|dortmund"
    "|essen|leipzig|bremen|dresden|hannover|nüremberg|duisburg",
    "FR": "paris|lyon|marseille|toulouse|nice|nantes|strasbourg|montpellier|bordeaux|lille|rennes"
    "|reims|le havre|saint-étienne|toulon|grenoble|dijon|angers|nîmes|villeurbanne",
    "IT": "roma|milano|napoli|torino|palermo|genova|bologna|firenze|bari|catania|venezia|verona"
    "|messina|padova|trieste|brescia|parma|taranto|prato|modena",
}
_EDGE_L, _EDGE_R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_ZIP5 = rf"{_EDGE_L}[0-9]{{5}}{T.WS}+[a-z]+.*"
# Address words that decide the country.
ADDRESS_PATTERNS = {
    "CH": rf"{_EDGE_L}ch-[0-9]{{4}}{_EDGE_R}|schweiz|suisse|svizzera|switzerland|strasse|gasse"
    "|platz.*[0-9]{4}",
    "DE": rf"{_ZIP5}deutschland|straße|platz.*[0-9]{{5}}|germany",
    "FR": rf"{_ZIP5}france|rue|avenue.*[0-9]{{5}}|france",
    "IT": rf"{_ZIP5}italia|via|corso.*[0-9]{{5}}|italy",
}
# Names of the five search strategies, in order.
STRATEGIES = [
    "Strategy 1: Full Match (Name + Address + City)",
    "Strategy 2: Name + City",
    "Strategy 3: Name + Address",
    "Strategy 4: Address + City",
    "Strategy 5: Quoted Name + City",
]
MAPS_SEARCH = "https://www.google.com/maps/search/"


def country_of(postal_code: Column, city: Column, address: Column) -> Column:
    """Country by postal code, then city, then address; Switzerland if nothing tells."""
    out = F.when(postal_code.rlike(r"^[0-9]{4}\z"), "CH").when(
        postal_code.rlike(r"^[0-9]{5}\z"), "DE"
    )
    for patterns, text in ((CITY_PATTERNS, F.lower(city)), (ADDRESS_PATTERNS, F.lower(address))):
        for country, pattern in patterns.items():
            out = out.when(text.rlike(pattern), country)
    return out.otherwise(dims.DEFAULT_COUNTRY)


def detect_country(listings: DataFrame) -> DataFrame:
    return listings.withColumn(
        "country", country_of(F.col("postal_code"), F.col("city"), F.col("address"))
    )


def with_locale(df: DataFrame) -> DataFrame:
    """Add language, region, time zone, browser, currency and prefix of ``country``."""
    locale = dims.country_locale(df.sparkSession)
    default = dict(
        zip(locale.columns, next(r for r in dims.COUNTRY_LOCALES if r[0] == dims.DEFAULT_COUNTRY))
    )
    joined = df.join(F.broadcast(locale), "country", "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(default[c])) for c in locale.columns if c != "country"}
    )


def with_city_geo(df: DataFrame, query: str | None = None) -> DataFrame:
    """Add ``lat`` and ``lng`` of the city, or of the last word of ``query`` without one."""
    place = F.nullif(F.col("city"), F.lit(""))
    if query:
        words = F.split(T.strip(F.col(query)), " ")
        place = F.coalesce(place, F.element_at(words, -1))
    geo = dims.city_geo(df.sparkSession)
    keyed = df.withColumn("_city_key", T.strip(F.lower(place)))
    joined = keyed.join(F.broadcast(geo), keyed["_city_key"] == geo["city_key"], "left")
    return joined.drop("_city_key", "city_key")


def with_phone_prefix(df: DataFrame) -> DataFrame:
    """Add ``prefix`` for ``country``."""
    joined = df.join(F.broadcast(dims.phone_prefix(df.sparkSession)), "country", "left")
    return joined.withColumn(
        "prefix", F.coalesce("prefix", F.lit(dims.DEFAULT_PHONE_PREFIX))
    )


def normalise_phones(
    df: DataFrame, phone: str = "phone", out: str = "phone_normalised", known_codes: bool = False
) -> DataFrame:
    """Add the international form of ``phone``, read as a number of ``country``."""
    value = normalise_phone(F.col(phone), F.col("country"), F.col("prefix"), known_codes)
    return with_phone_prefix(df).withColumn(out, value).drop("prefix")


def strategies(name: Column, address: Column, city: Column) -> Column:
    """Ordered ``array<struct<name, query>>`` of the queries a listing supports."""
    has = {key: ~T.is_blank(c) for key, c in (("n", name), ("a", address), ("c", city))}
    comma, space, quote = F.lit(", "), F.lit(" "), F.lit('"')
    queries = [
        (has["n"] & has["a"] & has["c"], F.concat(name, comma, address, comma, city)),
        (has["n"] & has["c"], F.concat(name, space, city)),
        (has["n"] & has["a"], F.concat(name, space, address)),
        (has["a"] & has["c"], F.concat(address, comma, city)),
        (has["n"] & has["c"], F.concat(quote, name, quote, space, city)),
    ]
    rows = [
        F.when(ok, F.struct(F.lit(label).alias("name"), T.strip(query).alias("query")))
        for label, (ok, query) in zip(STRATEGIES, queries)
    ]
    return F.array_compact(F.array(*rows))


def build_attempts(listings: DataFrame) -> DataFrame:
    """One row per search attempt: the listing's columns, ``rank``, ``strategy``, ``query``."""
    found = strategies(F.col("name"), F.col("address"), F.col("city"))
    return listings.select("*", F.posexplode(found).alias("_pos", "_attempt")).select(
        *listings.columns,
        (F.col("_pos") + 1).alias("rank"),
        F.col("_attempt.name").alias("strategy"),
        F.col("_attempt.query").alias("query"),
    )


def maps_url(query: Column, region: Column, lat: Column, lng: Column) -> Column:
    """Search address. The query is encoded twice: as a component, then as form data."""
    head = F.concat(
        F.lit(f"{MAPS_SEARCH}?api=1&query="),
        F.url_encode(T.uri_component(query)),
        F.lit("&hl=en&gl="),
        F.url_encode(region),
    )
    center = F.concat(
        F.lit("&center="), T.number_text(lat), F.lit("%2C"), T.number_text(lng), F.lit("&zoom=13")
    )
    return F.concat(head, F.coalesce(center, F.lit("")))


def with_maps_url(attempts: DataFrame) -> DataFrame:
    """Add ``url`` to attempts that carry ``region``."""
    url = maps_url(F.col("query"), F.col("region"), F.col("lat"), F.col("lng"))
    return with_city_geo(attempts, query="query").withColumn("url", url).drop("lat", "lng")


def search_variations(listings: DataFrame) -> DataFrame:
    """One row per spelling of ``name``, in order."""
    found = F.posexplode(T.search_variations(F.col("name"))).alias("_pos", "variation")
    return listings.select("*", found).select(
        *listings.columns, (F.col("_pos") + 1).alias("variation_no"), "variation"
    )


def with_plain_query(listings: DataFrame) -> DataFrame:
    """Add ``plain_query``: the listing's parts that are present, joined by spaces."""
    parts = [
        F.nullif(F.col(c), F.lit("")) for c in ("name", "address", "city", "postal_code")
    ]
    return listings.withColumn("plain_query", T.strip(F.concat_ws(" ", *parts)))
