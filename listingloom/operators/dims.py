"""Fixed lookup tables. All of them are constants of the program, so the jobs may
broadcast them: their size does not depend on the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BROWSER = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 "
    "(KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36"
)
# Country, language, region, time zone, browser, currency, phone prefix.
COUNTRY_LOCALES = [
    ("CH", "de", "CH", "Europe/Zurich", _BROWSER, "CHF", "+41"),
    ("DE", "de", "DE", "Europe/Berlin", _BROWSER, "EUR", "+49"),
    ("FR", "fr", "FR", "Europe/Paris", _BROWSER, "EUR", "+33"),
    ("IT", "it", "IT", "Europe/Rome", _BROWSER, "EUR", "+39"),
    ("ES", "es", "ES", "Europe/Madrid", _BROWSER, "EUR", "+34"),
    ("AT", "de", "AT", "Europe/Vienna", _BROWSER, "EUR", "+43"),
]
DEFAULT_COUNTRY = "CH"

# Phone prefixes for national numbers.
PHONE_PREFIXES = [
    ("CH", "+41"), ("AT", "+43"), ("DE", "+49"), ("FR", "+33"), ("IT", "+39"), ("LI", "+423"),
]
DEFAULT_PHONE_PREFIX = "+41"

# City spellings with latitude and longitude.
CITY_GEO = [
    ("zürich", 47.3769, 8.5417), ("zurich", 47.3769, 8.5417),
    ("genève", 46.2044, 6.1432), ("geneve", 46.2044, 6.1432), ("geneva", 46.2044, 6.1432),
    ("basel", 47.5596, 7.5886),
    ("bern", 46.9480, 7.4474), ("berne", 46.9480, 7.4474),
    ("lausanne", 46.5197, 6.6323),
    ("luzern", 47.0502, 8.3093), ("lucerne", 47.0502, 8.3093),
    ("lugano", 46.0037, 8.9511),
    ("st. gallen", 47.4239, 9.3745), ("st.gallen", 47.4239, 9.3745),
    ("st gallen", 47.4239, 9.3745),
    ("winterthur", 47.5000, 8.7500),
    ("thun", 46.7578, 7.6280),
    ("biel", 47.1368, 7.2463), ("bienne", 47.1368, 7.2463),
    ("wallisellen", 47.4133, 8.5961),
    ("uster", 47.3510, 8.7206),
    ("emmen", 47.0790, 8.3010),
    ("dietikon", 47.4024, 8.4008),
    ("kriens", 47.0360, 8.2789),
    ("baar", 47.1979, 8.5293),
    ("zug", 47.1724, 8.5153),
    ("cartagena", 10.3910, -75.4794),
    ("bogotá", 4.7110, -74.0721), ("bogota", 4.7110, -74.0721),
    ("medellín", 6.2442, -75.5812), ("medellin", 6.2442, -75.5812),
    ("cali", 3.4516, -76.5320),
    ("barranquilla", 10.9639, -74.7964),
    ("bucaramanga", 7.1254, -73.1198),
    ("berlin", 52.5200, 13.4050),
    ("münchen", 48.1351, 11.5820), ("munich", 48.1351, 11.5820),
    ("hamburg", 53.5511, 9.9937),
    ("frankfurt", 50.1109, 8.6821),
    ("köln", 50.9375, 6.9603), ("cologne", 50.9375, 6.9603),
    ("paris", 48.8566, 2.3522),
    ("lyon", 45.7640, 4.8357),
    ("marseille", 43.2965, 5.3698),
    ("nice", 43.7102, 7.2620),
    ("roma", 41.9028, 12.4964), ("rome", 41.9028, 12.4964),
    ("milano", 45.4642, 9.1900), ("milan", 45.4642, 9.1900),
    ("napoli", 40.8518, 14.2681), ("naples", 40.8518, 14.2681),
    ("madrid", 40.4168, -3.7038),
    ("barcelona", 41.3851, 2.1734),
    ("valencia", 39.4699, -0.3763),
    ("sevilla", 37.3891, -5.9845),
]

# Words for each field in four interface languages.
FIELD_TERMS = {
    "german": {
        "rating": ["bewertung", "sterne", "rating"],
        "reviews": ["bewertungen", "rezensionen", "reviews"],
        "address": ["adresse", "address"],
        "phone": ["telefon", "phone"],
        "website": ["website", "webseite"],
        "hours": ["öffnungszeiten", "hours"],
        "category": ["kategorie", "category"],
    },
    "swedish": {
        "rating": ["betyg", "stjärnor", "rating"],
        "reviews": ["recensioner", "omdömen", "reviews"],
        "address": ["adress", "address"],
        "phone": ["telefon", "phone"],
        "website": ["webbplats", "website"],
        "hours": ["öppettider", "hours"],
        "category": ["kategori", "category"],
    },
    "norwegian": {
        "rating": ["vurdering", "stjerner", "rating"],
        "reviews": ["anmeldelser", "reviews"],
        "address": ["adresse", "address"],
        "phone": ["telefon", "phone"],
        "website": ["nettsted", "website"],
        "hours": ["åpningstider", "hours"],
        "category": ["kategori", "category"],
    },
    "danish": {
        "rating": ["bedømmelse", "stjerner", "rating"],
        "reviews": ["anmeldelser", "reviews"],
        "address": ["adresse", "address"],
        "phone": ["telefon", "phone"],
        "website": ["hjemmeside", "website"],
        "hours": ["åbningstider", "hours"],
        "category": ["kategori", "category"],
    },
}


def _literal(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}D" if isinstance(value, float) else str(value)


def values_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A constant table as a local relation, which the optimizer knows the size of."""
    body = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def country_locale(spark: SparkSession) -> DataFrame:
    columns = ["country", "language", "region", "timezone", "user_agent", "currency", "phone_prefix"]
    return values_table(spark, columns, COUNTRY_LOCALES)


def phone_prefix(spark: SparkSession) -> DataFrame:
    return values_table(spark, ["country", "prefix"], PHONE_PREFIXES)


def city_geo(spark: SparkSession) -> DataFrame:
    return values_table(spark, ["city_key", "lat", "lng"], CITY_GEO)


def field_terms(spark: SparkSession) -> DataFrame:
    rows = [
        (lang_no, lang, field, pos, term)
        for lang_no, (lang, fields) in enumerate(FIELD_TERMS.items())
        for field, terms in fields.items()
        for pos, term in enumerate(terms)
    ]
    return values_table(spark, ["lang_no", "lang", "field", "pos", "term"], rows)
