"""Opening-hours rules in five languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listingloom.functions.text import WS, let, or_empty, squash, strip

DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Words translated to English inside hours texts.
TRANSLATIONS = {
    "Monday": ["Montag", "Lundi", "Lunedì", "Lunes"],
    "Tuesday": ["Dienstag", "Mardi", "Martedì", "Martes"],
    "Wednesday": ["Mittwoch", "Mercredi", "Mercoledì", "Miércoles"],
    "Thursday": ["Donnerstag", "Jeudi", "Giovedì", "Jueves"],
    "Friday": ["Freitag", "Vendredi", "Venerdì", "Viernes"],
    "Saturday": ["Samstag", "Samedi", "Sabato", "Sábado"],
    "Sunday": ["Sonntag", "Dimanche", "Domenica", "Domingo"],
    "Closed": ["Geschlossen", "Fermé", "Chiuso", "Cerrado"],
}
# Words that reveal the day of an hours row, in lower case.
DAY_WORDS = {
    "Monday": ["monday", "lunes", "lundi", "montag", "lunedì", "segunda"],
    "Tuesday": ["tuesday", "martes", "mardi", "dienstag", "martedì", "terça"],
    "Wednesday": ["wednesday", "miércoles", "mercredi", "mittwoch", "mercoledì", "quarta"],
    "Thursday": ["thursday", "jueves", "jeudi", "donnerstag", "giovedì", "quinta"],
    "Friday": ["friday", "viernes", "vendredi", "freitag", "venerdì", "sexta"],
    "Saturday": ["saturday", "sábado", "samedi", "samstag", "sabato"],
    "Sunday": ["sunday", "domingo", "dimanche", "sonntag", "domenica"],
}
# Foreign day words removed from the head of an hours row, in order.
HEAD_WORDS = [
    "Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag", "Sonntag",
    "Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche",
    "Lunedì", "Martedì", "Mercoledì", "Giovedì", "Venerdì", "Sabato", "Domenica",
    "Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo",
]
# Closed words the export looks for.
CLOSED_WORDS = ["closed", "geschlossen", "fermé", "chiuso", "cerrado"]

# plain-letter word edges, so that words ending in an accented letter count too
_EDGE_L, _EDGE_R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def translate_day_words(text: Column) -> Column:
    """Foreign day and closed words to English, whole words only, any case."""
    every_word = "|".join(w for words in TRANSLATIONS.values() for w in words)
    out = text
    for english, words in TRANSLATIONS.items():
        out = F.regexp_replace(out, f"(?iu){_EDGE_L}(?:{'|'.join(words)}){_EDGE_R}", english)
    # most texts hold no such word: one test spares them the eight replacements
    return F.when(text.rlike(f"(?iu){every_word}"), out).otherwise(text)


def detect_day(text: Column) -> Column:
    """English name of the first weekday, Monday first, named in the text; null if none."""
    low = F.lower(text)
    out = None
    for day, words in DAY_WORDS.items():
        hit = low.rlike("|".join(words))
        out = F.when(hit, day) if out is None else out.when(hit, day)
    return out


def _time_to_24h(token: Column) -> Column:
    """``7:30 pm`` to ``19:30``; hours outside 1 to 12 leave the token as it is."""
    hour = F.regexp_extract(token, "^([0-9]+)", 1).try_cast("int")
    minute = F.regexp_extract(token, ":([0-9]+)", 1)
    minute = F.when(F.length(minute) < 2, F.lpad(minute, 2, "0")).otherwise(minute)
    hour24 = hour % 12 + F.when(F.lower(token).endswith("pm"), 12).otherwise(0)
    return F.when(
        hour.between(1, 12),
        F.concat(F.lpad(hour24.cast("string"), 2, "0"), F.lit(":"), minute),
    ).otherwise(token)


def am_pm_to_24h(text: Column) -> Column:
    """Rewrite every am/pm time inside a text whose only whitespace is spaces.

    The text is cut into times, digit runs and the rest, the times are rewritten
    and the pieces joined again.
    """
    time = "[0-9]+(?::[0-9]+)? *(?:am|pm)"
    pieces = F.regexp_extract_all(text, F.lit(f"(?i)(?:{time}|[0-9]+|[^0-9]+)"), F.lit(0))
    rewritten = F.transform(
        pieces, lambda p: F.when(p.rlike(f"(?i)^{time}\\z"), _time_to_24h(p)).otherwise(p)
    )
    return F.array_join(rewritten, "")


def _single_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "  +", " "))


def _clock_form(english: Column) -> Column:
    # behind this line spaces are the only whitespace
    spaced = strip(squash(english))
    out = let(spaced, lambda t: F.when(t.rlike("(?i)[ap]m"), _am_pm_form(t)).otherwise(t))
    out = F.regexp_replace(out, " *[-–—] *", " - ")
    out = F.regexp_replace(out, "(?i) +to +", " - ")
    out = F.regexp_replace(out, " *, *", " & ")
    out = F.regexp_replace(out, "(?i) +and +", " & ")
    return _single_spaces(out)


def _am_pm_form(text: Column) -> Column:
    out = F.regexp_replace(text, "(?i)([0-9]+)(am|pm)", "$1 $2")
    out = F.regexp_replace(out, f"{_EDGE_L}AM{_EDGE_R}", "am")
    out = F.regexp_replace(out, f"{_EDGE_L}PM{_EDGE_R}", "pm")
    out = F.regexp_replace(out, "(?i)([0-9]+ *(?:am|pm))([0-9]+)", "$1 $2")
    return am_pm_to_24h(_single_spaces(out))


def normalise_hours(text: Column) -> Column:
    """Hours text in English, 24-hour times, `` - `` in ranges, `` & `` between them."""
    return let(
        translate_day_words(text),
        lambda english: F.when(english.rlike("(?i)open 24 hours?"), "Open 24 hours")
        .when(english.rlike("(?i)closed"), "Closed")
        .otherwise(_clock_form(english)),
    )


def names_a_day(text: Column) -> Column:
    return F.lower(text).rlike("|".join(word for words in DAY_WORDS.values() for word in words))


def _without_day(text: Column, day: Column) -> Column:
    tail = F.regexp_replace(F.substr(text, F.length(day) + 1), f"^{WS}*:?{WS}*", "")
    body = F.when(F.lower(text).startswith(F.lower(day)), tail).otherwise(text)
    head = "".join(f"(?:{word}{WS}*:?{WS}*)?" for word in HEAD_WORDS)
    return strip(F.regexp_replace(body, f"(?iu)^{head}", ""))


def row_of(row_text: Column) -> Column:
    """``struct(day, hours)`` of one row such as ``Montag: 9:00 – 18:00``."""

    def finished(row: Column) -> Column:
        hours = F.regexp_replace(normalise_hours(row["body"]), f"{WS}+\\z", "")
        hours = strip(F.regexp_replace(hours, r"[^\x20-\x7EÀ-ſ]+\z", ""))
        return F.struct(row["day"].alias("day"), hours.alias("hours"))

    def split(row: Column) -> Column:
        body = _without_day(row["text"], row["day"])
        return let(F.struct(row["day"].alias("day"), body.alias("body")), finished)

    def detected(text: Column) -> Column:
        return let(F.struct(text.alias("text"), detect_day(text).alias("day")), split)

    return let(strip(row_text), detected)


def hours_of_row(row_text: Column) -> Column:
    """Hours of one row, without its day word."""
    return row_of(row_text)["hours"]


def _dotted_clock(hour: Column, minute: Column, period: Column) -> Column:
    afternoon = F.lower(period) == "p.m."
    shift = F.when(afternoon & (hour != 12), 12).when(~afternoon & (hour == 12), -12).otherwise(0)
    return F.concat(F.format_string("%02d:", hour + shift), F.lpad(minute, 2, "0"))


def format_hours(hours: Column, keep_all_ranges: bool = False) -> Column:
    """Hours for the export: ``HH:MM - HH:MM``, ``Closed`` or the cleaned text.

    Only the first range of a text is kept; ``keep_all_ranges=True`` keeps all
    24-hour ranges, joined with `` & ``.
    """
    return let(
        translate_day_words(or_empty(hours)), lambda english: _format(english, keep_all_ranges)
    )


def _format(english: Column, keep_all_ranges: bool) -> Column:
    clock = r"([0-9]{1,2}):?([0-9]{0,2})" + WS + r"*(a\.m\.|p\.m\.)"
    dotted = f"(?i){clock}.*?{clock}"

    def dotted_range(found: Column) -> Column:
        def part(i: int) -> Column:
            return F.regexp_extract(found, dotted, i)

        parts = F.struct(
            *(
                (part(i).cast("int") if i in (1, 4) else part(i)).alias(name)
                for i, name in enumerate(("h1", "m1", "p1", "h2", "m2", "p2"), start=1)
            )
        )
        return let(
            parts,
            lambda p: F.concat(
                _dotted_clock(p["h1"], p["m1"], p["p1"]),
                F.lit(" - "),
                _dotted_clock(p["h2"], p["m2"], p["p2"]),
            ),
        )

    plain = rf"([0-9]{{1,2}}):([0-9]{{2}}){WS}*[-–—]{WS}*([0-9]{{1,2}}):([0-9]{{2}})"

    def range_of(c: Column) -> Column:
        found = F.regexp_extract(c, plain, 0)
        bare = F.regexp_replace(found, plain, "0$1:$2 - 0$3:$4")
        # of three digits the last two make the hour
        return F.regexp_replace(bare, "0([0-9]{2}:)", "$1")

    if keep_all_ranges:
        every = F.regexp_extract_all(english, F.lit(plain), F.lit(0))
        ranges = F.array_join(F.transform(every, range_of), " & ")
    else:
        ranges = range_of(english)

    cleaned = F.regexp_replace(english, f"(?i){_EDGE_L}(?:{'|'.join(DAYS)}){_EDGE_R}", "")
    # the kept class is ASCII word characters, whitespace, colon and hyphen
    cleaned = strip(F.regexp_replace(cleaned, f"[^A-Za-z0-9_{WS[1:-1]}:\\-]", ""))
    return (
        F.when(strip(english) == "", "")
        .when(F.lower(english).rlike("|".join(CLOSED_WORDS)), "Closed")
        .when(english.rlike(dotted), dotted_range(F.regexp_extract(english, dotted, 0)))
        .when(english.rlike(plain), ranges)
        .otherwise(F.when(cleaned != "", cleaned).otherwise(strip(english)))
    )
