"""Text rules: whitespace, character folding, CSV values, encoded URLs.

All rules are built-in column expressions. Whitespace is spelled out because the
engine's own notion of it leaves out the no-break and typographic spaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace.
WS_RANGE = "\t\n\x0b\f\r    -     　﻿"
WS = f"[{WS_RANGE}]"
WS_CHARS = (
    "\t\n\x0b\f\r   "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　﻿"
)

# Accented letters that fold to one plain letter.
FOLD_ONE = {
    "ä": "a", "Ä": "A", "ö": "o", "Ö": "O", "ü": "u", "Ü": "U",
    "à": "a", "á": "a", "â": "a", "ã": "a",
    "À": "A", "Á": "A", "Â": "A", "Ã": "A",
    "è": "e", "é": "e", "ê": "e", "ë": "e",
    "È": "E", "É": "E", "Ê": "E", "Ë": "E",
    "ì": "i", "í": "i", "î": "i", "ï": "i",
    "Ì": "I", "Í": "I", "Î": "I", "Ï": "I",
    "ò": "o", "ó": "o", "ô": "o", "õ": "o",
    "Ò": "O", "Ó": "O", "Ô": "O", "Õ": "O",
    "ù": "u", "ú": "u", "û": "u",
    "Ù": "U", "Ú": "U", "Û": "U",
    "ç": "c", "Ç": "C", "ñ": "n", "Ñ": "N",
}
# Letters that fold to two.
FOLD_TWO = {
    "ß": "ss", "å": "aa", "Å": "Aa", "æ": "ae", "Æ": "Ae", "ø": "oe", "Ø": "Oe",
}
# The light fold.
LIGHT_ONE = {
    "ä": "a", "Ä": "A", "ö": "o", "Ö": "O", "ü": "u", "Ü": "U",
    "å": "a", "Å": "A", "ø": "o", "Ø": "O",
}
LIGHT_TWO = {"ß": "ss", "æ": "ae", "Æ": "AE"}
# The letters that count as special.
SPECIAL_LETTERS = "äöüßåæøàáâãèéêëìíîïòóôõùúûüçñ"
# both cases listed, so no case flag is needed (ß has no single upper-case letter)
SPECIAL_CLASS = "[" + "".join(
    dict.fromkeys(SPECIAL_LETTERS + SPECIAL_LETTERS.replace("ß", "").upper())
) + "]"
# Company endings dropped for search variations.
COMPANY_ENDINGS = [
    "GmbH", "AG", "AB", "AS", "ApS", "A/S", "Oy", "Ltd", "LLC", "Inc",
    "Co.", "Company", "Företag", "Selskab", "Gesellschaft",
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_blank(c: Column) -> Column:
    """True for null and for the empty string: both mean "missing"."""
    return c.isNull() | (c == "")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


_WS_BUT_SPACE = WS_CHARS.replace(" ", "")


def squash(c: Column) -> Column:
    """Every run of whitespace to one space. Mapping the rare kinds to spaces first
    leaves a pattern that is several times faster than the whole class."""
    return F.regexp_replace(F.translate(c, _WS_BUT_SPACE, " " * len(_WS_BUT_SPACE)), "  +", " ")


def _map_letters(c: Column, one: dict[str, str], two: dict[str, str]) -> Column:
    out = F.translate(c, "".join(one), "".join(one.values()))
    for letter, plain in two.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def fold_full(c: Column) -> Column:
    """Plain-letter form for searching; a removed last character leaves a space."""
    out = strip(_map_letters(c, FOLD_ONE, FOLD_TWO))
    # runs of spaces and removed characters become one space; single spaces, the bulk
    # of all that is not kept, are left alone
    other, rest = r"[^A-Za-z0-9_ \-.]", r"[^A-Za-z0-9_\-.]*"
    return F.regexp_replace(out, f" ?{other}{rest}|  {rest}", " ")


def fold_light(c: Column) -> Column:
    return strip(_map_letters(c, LIGHT_ONE, LIGHT_TWO))


def has_special(c: Column) -> Column:
    return F.coalesce(c.rlike(SPECIAL_CLASS), F.lit(False))


def special_letters(c: Column) -> Column:
    """Every special letter of the text, in order."""
    return F.regexp_extract_all(c, F.lit(SPECIAL_CLASS), F.lit(0))


def without_company_ending(c: Column) -> Column:
    endings = "|".join(COMPANY_ENDINGS)
    return strip(F.regexp_replace(c, rf"(?iu){WS}+(?:{endings}){WS}*\z", ""))


def search_variations(name: Column) -> Column:
    """Ordered distinct spellings of a name worth searching for."""
    full, light = fold_full(name), fold_light(name)
    short = without_company_ending(name)
    shortened = (short != name) & (F.length(short) > 2)
    spellings = F.array(
        strip(name),
        F.when(full != name, full),
        F.when((light != name) & (light != full), light),
        F.when(shortened, short),
        F.when(shortened, fold_full(short)),
    )
    kept = F.filter(F.array_distinct(spellings), lambda v: F.length(v) > 1)
    return F.when(is_blank(name), F.array(name)).otherwise(kept)


def csv_text(c: Column) -> Column:
    """Value as it goes into an exported cell, before quoting: one trimmed line."""
    return squash(strip(or_empty(c)))


def csv_cell_doubled(c: Column) -> Column:
    """Cell text with quotes doubled twice, for consumers used to that form."""
    text = squash(F.replace(strip(or_empty(c)), F.lit('"'), F.lit('""')))
    return F.when(
        text.rlike('[,"\n]'),
        F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')),
    ).otherwise(text)


def uri_component(c: Column) -> Column:
    """Percent-encoding that leaves letters, digits and -_.!~*'() alone."""
    out = F.url_encode(c)
    # Where form encoding and component encoding differ.
    for encoded, plain in {
        "+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~",
    }.items():
        out = F.replace(out, F.lit(encoded), F.lit(plain))
    return out


def number_text(c: Column) -> Column:
    """Shortest plain text of a double: no exponent, no trailing ``.0``."""
    plain = F.when(
        (F.abs(c) >= 1e-3) & (F.abs(c) < 1e7), c.cast("string")
    ).otherwise(F.regexp_replace(c.try_cast("decimal(38,18)").cast("string"), r"0+$", ""))
    return F.regexp_replace(plain, r"\.0?$", "")


def one_decimal_text(c: Column) -> Column:
    """Like ``number_text`` but whole numbers keep one decimal: ``4.0``."""
    return F.when(c == F.floor(c), F.format_string("%d.0", c.cast("bigint"))).otherwise(
        number_text(c)
    )


def iso_utc(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves rounded up; null for an empty denominator."""
    return F.when(whole > 0, F.floor(part / whole * 100 + 0.5))
