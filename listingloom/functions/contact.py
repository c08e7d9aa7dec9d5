"""Rules for phones, ratings, review counts, categories and web addresses.

``valid_*`` return the cleaned candidate, or null when the candidate is not
acceptable, so that ordered candidates can be combined with ``coalesce``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listingloom.functions.text import WS, WS_RANGE, one_decimal_text, or_empty, strip

# Words that show a heading belongs to a result list.
RESULT_WORDS = ["Ergebnisse", "Results", "Resultados", "Résultats", "Results for", "Ergebnisse für"]
# Generic words no business name may contain.
GENERIC_WORDS = [
    "resultados", "results", "resultado", "result",
    "búsqueda", "search", "buscar", "suchen",
    "filtros", "filters", "filtrar", "filter",
]
# Marks and words that rule a phone candidate out.
NOT_PHONE = ["★", "·", "$", "€", "CHF", "review", "bewertung", "rating", "stern"]
# Country codes that admit a phone candidate of 10 to 20 characters.
PHONE_CODES = ["+41", "+49", "+33", "+39", "+34", "+46"]
# Accepted phone shapes.
PHONE_SHAPES = [
    rf"^\+[0-9]{{1,3}}[{WS_RANGE}\-]?[0-9]+",
    rf"^0[0-9]{{2}}[{WS_RANGE}\-]?[0-9]+",
    rf"^\([0-9]+\)[{WS_RANGE}\-]?[0-9]+",
    r"^[0-9]{7,15}\z",
    rf"^[0-9]{{2,3}}[{WS_RANGE}\-]?[0-9]{{3}}[{WS_RANGE}\-]?[0-9]{{2,4}}\z",
]
# Phone shapes looked for in running text, in order.
PHONE_SCANS = [
    rf"\+[0-9]{{1,3}}{WS}?[0-9]{{1,4}}{WS}?[0-9]{{1,4}}{WS}?[0-9]{{1,4}}{WS}?[0-9]{{0,4}}",
    rf"[0-9]{{3}}{WS}?[0-9]{{3}}{WS}?[0-9]{{2}}{WS}?[0-9]{{2}}",
    rf"\([0-9]{{3}}\){WS}?[0-9]{{3}}[{WS_RANGE}-]?[0-9]{{2}}[{WS_RANGE}-]?[0-9]{{2}}",
]
# Review-count shapes, in order.
REVIEW_SHAPES = [
    r"\(([0-9,.]+)\)",
    rf"(?i)([0-9,.]+){WS}+review",
    rf"(?i)([0-9,.]+){WS}+bewertung",
    rf"(?i)([0-9,.]+){WS}+recensione",
    rf"(?i)([0-9,.]+){WS}+anmeldelse",
    r"^([0-9,.]+)\z",
]
# Parts that show a phone text is really an address.
ADDRESS_PARTS = [",", "Strasse", "strasse", "gasse", "platz", "weg"]
# Calling codes for the corrected splitting of international numbers.
CALLING_CODES = ["423", "41", "43", "49", "33", "39"]

_PURE_NUMBER = r"^[0-9]+(\.[0-9]+)?\z"


def contains_any(c: Column, words: list[str]) -> Column:
    hit = c.contains(words[0])
    for word in words[1:]:
        hit = hit | c.contains(word)
    return hit


def cleaned_phone(phone: Column) -> Column:
    return F.regexp_replace(phone, rf"[{WS_RANGE}\-().]", "")


def normalise_phone(
    phone: Column, country: Column, prefix: Column, known_codes: bool = False
) -> Column:
    """International form of a phone number.

    The country code of a ``+`` number is up to three digits, as many as there
    are. ``known_codes=True`` splits after a known calling code instead.
    """
    bare = cleaned_phone(phone)
    known = f"{'|'.join(CALLING_CODES)}|" if known_codes else ""
    code = rf"(?>\+(?:{known}[0-9]{{1,3}}))"
    spaced = F.regexp_replace(
        bare, rf"^({code})(.{{2}})(.{{3}})(.{{2}})(.{{2,}})\z", "$1 $2 $3 $4 $5"
    )
    spaced = F.regexp_replace(spaced, rf"^({code})([^ ].*)\z", "$1 $2")
    # a plus sign without digits after it is no country code
    spaced = F.regexp_replace(spaced, r"^(\+[^0-9 ])(.{3})(.{2})(.{2,})\z", "$1 $2 $3 $4")

    without_zero = F.regexp_replace(bare, "^0", "")
    national = (
        F.when(
            country == "CH",
            F.regexp_replace(without_zero, r"^(.{2})(.{3})(.{2})(.{2,})\z", "$1 $2 $3 $4"),
        )
        .when(country == "AT", F.regexp_replace(without_zero, r"^(.{4})(.{5,})\z", "$1 $2"))
        .when(country == "DE", F.regexp_replace(without_zero, r"^(.{3})(.{7,})\z", "$1 $2"))
        .otherwise(bare)
    )
    return (
        F.when(F.coalesce(strip(phone), F.lit("")) == "", F.lit(""))
        .when(bare.startswith("+"), spaced)
        .otherwise(F.concat(prefix, F.lit(" "), national))
    )


def format_phone(phone: Column) -> Column:
    """Phone for the export; empty when an address got mixed in."""
    text = or_empty(phone)
    return F.when(contains_any(text, ADDRESS_PARTS), F.lit("")).otherwise(strip(text))


def scan_phone(text: Column) -> Column:
    """First plausible phone number in running text, or the empty string."""
    found = []
    for shape in PHONE_SCANS:
        first = strip(F.regexp_extract(text, shape, 0))
        found.append(F.when(F.length(first).between(9, 20), first))
    return F.coalesce(*found, F.lit(""))


def format_rating(rating: Column) -> Column:
    text = or_empty(rating)
    number = F.regexp_extract(text, "([0-9]+[.,][0-9]+|[0-9]+)", 1)
    return F.when(number != "", F.replace(number, F.lit(","), F.lit("."))).otherwise(strip(text))


def format_reviews(reviews: Column) -> Column:
    text = or_empty(reviews)
    number = F.regexp_extract(text, "[0-9.,]+", 0)
    return F.when(number != "", number).otherwise(strip(text))


def format_website(website: Column) -> Column:
    text = or_empty(website)
    has_scheme = text.startswith("http://") | text.startswith("https://")
    bare_domain = text.contains(".") & ~text.contains(" ")
    return F.when(~has_scheme & bare_domain, F.concat(F.lit("https://"), strip(text))).otherwise(
        strip(text)
    )


def _nonempty(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def valid_text(raw: Column) -> Column:
    return _nonempty(raw)


def valid_name(raw: Column) -> Column:
    text = strip(raw)
    bad = F.lower(text).rlike("|".join(GENERIC_WORDS)) | text.rlike(_PURE_NUMBER)
    return F.when(~bad, F.nullif(text, F.lit("")))


def valid_rating(raw: Column) -> Column:
    found = F.regexp_extract(strip(raw), "([0-9]+(?:[,.][0-9]+)?)", 1)
    number = F.replace(F.nullif(found, F.lit("")), F.lit(","), F.lit(".")).cast("double")
    return F.when(number.between(0, 5), one_decimal_text(number))


def valid_category(raw: Column) -> Column:
    text = strip(raw)
    bad = text.rlike(_PURE_NUMBER) | text.contains("★") | text.contains("star") | text.rlike(
        r"[0-9]+\.[0-9]+"
    )
    return F.when(~bad, F.nullif(text, F.lit("")))


def valid_reviews(raw: Column) -> Column:
    text = strip(raw)
    options = []
    for shape in REVIEW_SHAPES:
        found = F.regexp_extract(text, shape, 1)
        long = F.length(found) > 4
        digits = (
            F.when(long & found.contains("."), F.replace(found, F.lit("."), F.lit("")))
            .when(long & found.contains(","), F.replace(found, F.lit(","), F.lit("")))
            .otherwise(found)
        )
        options.append(F.when(digits.rlike(r"^[0-9]+\z"), digits))
    only_digits = F.regexp_replace(F.regexp_extract(text, r"^[0-9,.]+\z", 0), "[.,]", "")
    return F.coalesce(*options, F.nullif(only_digits, F.lit("")))


def valid_phone(raw: Column) -> Column:
    text = strip(raw)
    rejected = (
        contains_any(text, NOT_PHONE)
        | text.rlike(r"[0-9][.,][0-9].*\(")
        | (F.length(text) > 50)
    )
    coded = contains_any(text, PHONE_CODES) & F.length(text).between(10, 20)
    return F.when(~rejected & (text.rlike("|".join(PHONE_SHAPES)) | coded), text)
