"""SQL counterparts of the catalogue's queries, for an independent engine.

The rules are written again from their description in RE2-style SQL; only the views
and the constant tables are shared with the Spark side.
"""

from __future__ import annotations

from listingloom.functions import contact as C
from listingloom.functions import hours as O
from listingloom.functions import text as T
from listingloom.operators import attempts as A
from listingloom.operators import batches as B
from listingloom.operators import dims
from listingloom.operators import places as P
from listingloom.plans.catalog import AS_OF, EVENTS_AS_OF, PAGE_SELECTORS
from listingloom.plans.views import view_sql

WS = T.WS
LISTINGS, CAPTURES, EXPORT = view_sql("listings"), view_sql("captures"), view_sql("export")
JOBS, RESULTS, RUNS, EVENTS = (
    view_sql("jobs"), view_sql("job_results"), view_sql("runs"), view_sql("job_events"),
)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {q(T.WS_CHARS)})"


def sub(x: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, {q(flags)})"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def ext(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def squash(x: str) -> str:
    return sub(x, f"{WS}+", " ")


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def values(rows: list[tuple], columns: list[str]) -> str:
    body = ", ".join(
        "(" + ", ".join(q(v) if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else f"{v!r}" for v in row) + ")" for row in rows
    )
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(columns)}))"


def pct(part: str, whole: str) -> str:
    return (
        f"CASE WHEN ({whole}) > 0 THEN CAST(floor(({part}) / ({whole}) * 100 + 0.5) AS BIGINT) END"
    )


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


# --- text rules -----------------------------------------------------------------


def letters(x: str, one: dict, two: dict) -> str:
    out = f"translate({x}, {q(''.join(one))}, {q(''.join(one.values()))})"
    for letter, plain in two.items():
        out = f"replace({out}, {q(letter)}, {q(plain)})"
    return out


def fold(x: str) -> str:
    base = squash(strip(letters(x, T.FOLD_ONE, T.FOLD_TWO)))
    return squash(sub(base, "[^A-Za-z0-9_ .-]", " "))


def light(x: str) -> str:
    return strip(letters(x, T.LIGHT_ONE, T.LIGHT_TWO))


def component(x: str) -> str:
    out = f"url_encode({x})"
    for encoded, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        out = f"replace({out}, {q(encoded)}, {q(plain)})"
    return out


def form(component_text: str) -> str:
    """Second encoding of a component: per-cent signs and the marks forms encode."""
    out = f"replace({component_text}, '%', '%25')"
    for plain, encoded in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        out = f"replace({out}, {q(plain)}, {q(encoded)})"
    return out


def one_decimal(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS INT) AS VARCHAR) || '.0' ELSE CAST({x} AS VARCHAR) END"


def country(r: str = "") -> str:
    code, city, addr = f"{r}postal_code", f"lower({r}city)", f"lower({r}address)"
    whens = [(has(code, "^[0-9]{4}$"), "CH"), (has(code, "^[0-9]{5}$"), "DE")]
    whens += [(has(city, p), c) for c, p in A.CITY_PATTERNS.items()]
    z5 = rf"\b[0-9]{{5}}{WS}+[a-z]+.*"
    whens += [
        (has(addr, rf"\bch-[0-9]{{4}}\b|schweiz|suisse|svizzera|switzerland|strasse|gasse|platz.*[0-9]{{4}}"), "CH"),
        (has(addr, rf"{z5}deutschland|straße|platz.*[0-9]{{5}}|germany"), "DE"),
        (has(addr, rf"{z5}france|rue|avenue.*[0-9]{{5}}|france"), "FR"),
        (has(addr, rf"{z5}italia|via|corso.*[0-9]{{5}}|italy"), "IT"),
    ]
    return "CASE " + " ".join(f"WHEN {t} THEN '{c}'" for t, c in whens) + " ELSE 'CH' END"


def phone_intl(phone: str, ctry: str, prefix: str, known: bool = False) -> str:
    c = sub(phone, rf"[{T.WS_RANGE}().-]", "")
    digits = ext(c, r"^\+[0-9]{1,3}")
    code = f"CASE WHEN {has(c, r'^\+(?:423|41|43|49|33|39)')} THEN {ext(c, r'^\+(?:423|41|43|49|33|39)')} ELSE {digits} END" if known else digits
    rest = f"substr({c}, length({code}) + 1)"
    z = sub(c, "^0", "", "")

    def grouped(x: str, cuts: list[int]) -> str:
        parts, start = [], 1
        for cut in cuts:
            parts.append(f"substr({x}, {start}, {cut})")
            start += cut
        return " || ' ' || ".join([*parts, f"substr({x}, {start})"])

    return f"""CASE WHEN {strip(phone)} = '' THEN ''
      WHEN starts_with({c}, '+') THEN trim(CASE WHEN length({rest}) >= 9 THEN {code} || ' ' || {grouped(rest, [2, 3, 2])}
        ELSE {code} || ' ' || {rest} END)
      WHEN {ctry} = 'CH' THEN {prefix} || ' ' || CASE WHEN length({z}) >= 9 THEN {grouped(z, [2, 3, 2])} ELSE {z} END
      WHEN {ctry} = 'AT' THEN {prefix} || ' ' || CASE WHEN length({z}) >= 9 THEN {grouped(z, [4])} ELSE {z} END
      WHEN {ctry} = 'DE' THEN {prefix} || ' ' || CASE WHEN length({z}) >= 10 THEN {grouped(z, [3])} ELSE {z} END
      ELSE {prefix} || ' ' || {c} END"""


def scan(x: str) -> str:
    whens = []
    for shape in C.PHONE_SCANS:
        hit = strip(ext(x, shape))
        whens.append(f"WHEN length({hit}) BETWEEN 9 AND 20 THEN {hit}")
    return f"CASE {' '.join(whens)} ELSE '' END"


def valid_name(x: str) -> str:
    t = strip(x)
    bad = f"{has(f'lower({t})', 'resultado|result|búsqueda|search|buscar|suchen|filtros|filtrar|filter')} OR {has(t, '^[0-9]+([.][0-9]+)?$')}"
    return f"CASE WHEN {t} <> '' AND NOT ({bad}) THEN {t} END"


def valid_rating(x: str) -> str:
    n = f"TRY_CAST(replace({ext(strip(x), '[0-9]+(?:[,.][0-9]+)?')}, ',', '.') AS DOUBLE)"
    return f"CASE WHEN {n} BETWEEN 0 AND 5 THEN {one_decimal(n)} END"


def valid_category(x: str) -> str:
    t = strip(x)
    bad = f"{has(t, '^[0-9]+([.][0-9]+)?$')} OR {any_of(t, ['★', 'star'])} OR {has(t, '[0-9]+[.][0-9]+')}"
    return f"CASE WHEN {t} <> '' AND NOT ({bad}) THEN {t} END"


def valid_reviews(x: str) -> str:
    t, options = strip(x), []
    for shape in (
        "[(]([0-9,.]+)[)]",
        *(rf"(?i)([0-9,.]+){WS}+{w}" for w in ("review", "bewertung", "recensione", "anmeldelse")),
        "^([0-9,.]+)$",
    ):
        m = ext(t, shape, 1)
        d = f"CASE WHEN length({m}) > 4 AND contains({m}, '.') THEN replace({m}, '.', '') WHEN length({m}) > 4 THEN replace({m}, ',', '') ELSE {m} END"
        options.append(f"CASE WHEN {has(d, '^[0-9]+$')} THEN {d} END")
    bare = f"replace(replace({t}, '.', ''), ',', '')"
    options.append(f"CASE WHEN {has(t, '^[0-9,.]+$')} AND {has(bare, '^[0-9]+$')} THEN {bare} END")
    return f"coalesce({', '.join(options)})"


def valid_phone(x: str) -> str:
    t = strip(x)
    shapes = "|".join(s.replace(r"\z", "$") for s in C.PHONE_SHAPES)
    no = f"{any_of(t, C.NOT_PHONE)} OR {has(t, '[0-9][.,][0-9].*[(]')} OR length({t}) > 50"
    yes = f"{has(t, shapes)} OR ({any_of(t, C.PHONE_CODES)} AND length({t}) BETWEEN 10 AND 20)"
    return f"CASE WHEN NOT ({no}) AND ({yes}) THEN {t} END"


def format_phone(x: str) -> str:
    return f"CASE WHEN {any_of(x, C.ADDRESS_PARTS)} THEN '' ELSE {strip(x)} END"


def format_rating(x: str) -> str:
    m = ext(x, "[0-9]+[.,][0-9]+|[0-9]+")
    return f"CASE WHEN {m} <> '' THEN replace({m}, ',', '.') ELSE {strip(x)} END"


def format_reviews(x: str) -> str:
    m = ext(x, "[0-9.,]+")
    return f"CASE WHEN {m} <> '' THEN {m} ELSE {strip(x)} END"


def format_website(x: str) -> str:
    scheme = f"(starts_with({x}, 'http://') OR starts_with({x}, 'https://'))"
    return f"CASE WHEN NOT {scheme} AND contains({x}, '.') AND NOT contains({x}, ' ') THEN 'https://' || {strip(x)} ELSE {strip(x)} END"


def translated(x: str) -> str:
    for english, words in O.TRANSLATIONS.items():
        x = sub(x, f"(^|[^A-Za-z0-9_])(?:{'|'.join(words)})($|[^A-Za-z0-9_])", rf"\1{english}\2", "gi")
    return x


def detect_day(x: str) -> str:
    return "CASE " + " ".join(
        f"WHEN {has(f'lower({x})', '|'.join(words))} THEN '{day}'" for day, words in O.DAY_WORDS.items()
    ) + " END"


def normalised(x: str) -> str:
    e = translated(x)
    t = sub(e, "([0-9]+)(am|pm)", r"\1 \2", "gi")
    t = sub(sub(t, r"\bAM\b", "am"), r"\bPM\b", "pm")
    t = sub(t, rf"([0-9]+{WS}*(?:am|pm))([0-9]+)", r"\1 \2", "gi")
    t = strip(squash(t))
    time = f"[0-9]+(?::[0-9]+)?{WS}*(?:am|pm)"
    h = "CAST(regexp_extract(p, '^[0-9]+') AS INT)"
    m = "regexp_extract(p, ':([0-9]+)', 1)"
    h24 = f"({h} % 12 + CASE WHEN ends_with(lower(p), 'pm') THEN 12 ELSE 0 END)"
    clock = f"lpad(CAST({h24} AS VARCHAR), 2, '0') || ':' || CASE WHEN length({m}) < 2 THEN lpad({m}, 2, '0') ELSE {m} END"
    one = f"CASE WHEN {has('p', f'(?i)^{time}$')} THEN CASE WHEN {h} BETWEEN 1 AND 12 THEN {clock} ELSE p END ELSE p END"
    pieces = f"regexp_extract_all({t}, {q(f'(?i)(?:{time}|[0-9]+|[^0-9]+)')})"
    t = f"array_to_string(list_transform({pieces}, lambda p: {one}), '')"
    t = sub(t, f"{WS}*[-–—]{WS}*", " - ")
    t = sub(t, f"{WS}+to{WS}+", " - ", "gi")
    t = sub(t, f"{WS}*,{WS}*", " & ")
    t = strip(squash(sub(t, f"{WS}+and{WS}+", " & ", "gi")))
    return f"CASE WHEN {has(e, '(?i)open 24 hours?')} THEN 'Open 24 hours' WHEN {has(e, '(?i)closed')} THEN 'Closed' ELSE {t} END"


def row_hours(x: str, day: str) -> str:
    """Hours of a row; ``day`` is a column that holds the detected day."""
    t = strip(x)
    tail = sub(f"substr({t}, length({day}) + 1)", f"^{WS}*:?{WS}*", "", "")
    body = f"CASE WHEN starts_with(lower({t}), lower({day})) THEN {tail} ELSE {t} END"
    for word in O.HEAD_WORDS:
        body = sub(body, f"^{word}{WS}*:?{WS}*", "", "i")
    n = normalised(strip(body))
    return strip(sub(sub(n, f"{WS}+$", "", ""), r"[^\x20-\x7EÀ-ſ]+$", "", ""))


def format_hours(x: str, every: bool = False) -> str:
    e = translated(x)
    one = rf"([0-9]{{1,2}}):?([0-9]{{0,2}}){WS}*(a\.m\.|p\.m\.)"
    dotted = f"(?i){one}.*?{one}"

    def half(i: int) -> str:
        h = f"CAST({ext(e, dotted, i)} AS INT)"
        pm = f"lower({ext(e, dotted, i + 2)}) = 'p.m.'"
        h24 = f"CASE WHEN {pm} AND {h} <> 12 THEN {h} + 12 WHEN NOT {pm} AND {h} = 12 THEN 0 ELSE {h} END"
        return f"lpad(CAST({h24} AS VARCHAR), 2, '0') || ':' || lpad({ext(e, dotted, i + 1)}, 2, '0')"

    plain = rf"([0-9]{{1,2}}):([0-9]{{2}}){WS}*[-–—]{WS}*([0-9]{{1,2}}):([0-9]{{2}})"

    def clock(y: str) -> str:
        return f"lpad({ext(y, plain, 1)}, 2, '0') || ':' || {ext(y, plain, 2)} || ' - ' || lpad({ext(y, plain, 3)}, 2, '0') || ':' || {ext(y, plain, 4)}"

    ranges = clock(e)
    if every:
        ranges = f"array_to_string(list_transform(regexp_extract_all({e}, {q(plain)}), lambda y: {clock('y')}), ' & ')"
    days = sub(e, rf"\b(?:{'|'.join(O.DAYS)})\b", "", "gi")
    clean = strip(sub(days, rf"[^A-Za-z0-9_{WS[1:-1]}:-]", ""))
    return f"""CASE WHEN {strip(x)} = '' THEN '' WHEN {has(f'lower({e})', '|'.join(O.CLOSED_WORDS))} THEN 'Closed'
      WHEN {has(e, dotted)} THEN {half(1)} || ' - ' || {half(4)} WHEN {has(e, plain)} THEN {ranges}
      WHEN {clean} <> '' THEN {clean} ELSE {strip(e)} END"""


def csv_text(x: str) -> str:
    return squash(strip(x))


def csv_doubled(x: str) -> str:
    t = squash(f"replace({strip(x)}, '\"', '\"\"')")
    return f"CASE WHEN {has(t, '[,\"\n]')} THEN '\"' || replace({t}, '\"', '\"\"') || '\"' ELSE {t} END"


def page_text(x: str) -> str:
    for tag in ("head", "script", "style", "noscript", "template"):
        x = sub(x, rf"(?s)<{tag}\b.*?</{tag}>", " ")
    x = sub(x, "(?s)<!--.*?-->", " ")
    blocks = "p|div|li|ul|ol|br|tr|table|h[1-6]|nav|article|section|header|footer|main"
    x = sub(sub(x, rf"</?(?:{blocks})\b[^>]*>", "\n"), "(?s)<[^>]*>", "")
    return entities(x)


def entities(x: str) -> str:
    for reference, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {q(reference)}, {q(character)})"
    return x


# --- listings -------------------------------------------------------------------

WITH_COUNTRY = f"(SELECT *, {country()} AS country FROM {LISTINGS} l)"
LOCALES = values(
    dims.COUNTRY_LOCALES,
    ["code", "language", "region", "timezone", "user_agent", "currency", "phone_prefix"],
)
GEO = values(dims.CITY_GEO, ["city_key", "lat", "lng"])
PREFIXES = values(dims.PHONE_PREFIXES, ["code", "prefix"])
WITH_PREFIX = f"(SELECT l.*, coalesce(p.prefix, '+41') AS prefix FROM {WITH_COUNTRY} l LEFT JOIN {PREFIXES} p ON p.code = l.country)"
_STRATEGY_RULES = [
    ("name <> '' AND address <> '' AND city <> ''", "name || ', ' || address || ', ' || city"),
    ("name <> '' AND city <> ''", "name || ' ' || city"),
    ("name <> '' AND address <> ''", "name || ' ' || address"),
    ("address <> '' AND city <> ''", "address || ', ' || city"),
    ("name <> '' AND city <> ''", "'\"' || name || '\" ' || city"),
]
ATTEMPTS = "(SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY s) AS rank FROM (" + " UNION ALL ".join(
    f"SELECT *, {i} AS s, {q(name)} AS strategy, {strip(text)} AS query FROM {WITH_COUNTRY} l WHERE {test}"
    for i, (name, (test, text)) in enumerate(zip(A.STRATEGIES, _STRATEGY_RULES), start=1)
) + ") u)"
_PLACE = f"CASE WHEN city <> '' THEN city ELSE list_last(string_split({strip('query')}, ' ')) END"
_SHORT = strip(sub("name", f"(?i){WS}+(?:{'|'.join(T.COMPANY_ENDINGS)}){WS}*$", "", ""))
_VARIANTS = [
    strip("name"),
    f"CASE WHEN {fold('name')} <> name THEN {fold('name')} END",
    f"CASE WHEN {light('name')} <> name AND {light('name')} <> {fold('name')} THEN {light('name')} END",
    f"CASE WHEN {_SHORT} <> name AND length({_SHORT}) > 2 THEN {_SHORT} END",
    f"CASE WHEN {_SHORT} <> name AND length({_SHORT}) > 2 THEN {fold(_SHORT)} END",
]
_VARIATIONS = " UNION ALL ".join(
    f"SELECT job_id, name, {i} AS i, {v} AS variation FROM {LISTINGS} l" for i, v in enumerate(_VARIANTS)
)
_SPECIAL = "[" + "".join(dict.fromkeys(T.SPECIAL_LETTERS + T.SPECIAL_LETTERS.replace("ß", "").upper())) + "]"
_LETTERS = f"(SELECT unnest(regexp_extract_all(text, {q(_SPECIAL)})) AS letter FROM documents)"

ORACLES: dict[str, str] = {
    "country_cascade": f"SELECT job_id, country FROM {WITH_COUNTRY} l",
    "locale_join": f"SELECT job_id, country, language, region, timezone, user_agent, currency, phone_prefix FROM {WITH_COUNTRY} l JOIN {LOCALES} d ON d.code = l.country",
    "city_geo_join": f"SELECT job_id, lat, lng FROM (SELECT job_id, city, address AS query FROM {LISTINGS} l) x LEFT JOIN {GEO} g ON g.city_key = {strip(f'lower({_PLACE})')}",
    "attempts": f"SELECT job_id, rank, strategy, query FROM {ATTEMPTS} a",
    "maps_url": f"""SELECT job_id, rank, {q(A.MAPS_SEARCH)} || '?api=1&query=' || {form(component('query'))} || '&hl=en&gl=' || region
        || CASE WHEN lat IS NOT NULL THEN '&center=' || CAST(lat AS VARCHAR) || '%2C' || CAST(lng AS VARCHAR) || '&zoom=13' ELSE '' END AS url
        FROM {ATTEMPTS} a JOIN {LOCALES} d ON d.code = a.country LEFT JOIN {GEO} g ON g.city_key = {strip(f'lower({_PLACE})')}""",
    "plain_query": f"SELECT job_id, {strip('''concat_ws(' ', nullif(name, ''), nullif(address, ''), nullif(city, ''), nullif(postal_code, ''))''')} AS plain_query FROM {LISTINGS} l",
    "search_variations": f"""SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY i) AS variation_no, variation FROM (
        SELECT job_id, min(i) AS i, variation FROM ({_VARIATIONS}) v WHERE name <> '' AND length(variation) > 1 GROUP BY job_id, variation
        UNION ALL SELECT job_id, 0, name FROM {LISTINGS} l WHERE name = '') u""",
    "ingest_listings": f"SELECT name, address, city, postal_code, job_id FROM {LISTINGS} l",
    "encoding_census": """SELECT * FROM (VALUES ('marked', 'utf-8', 1::BIGINT, true, 'efbb'), ('plain', 'utf-8', 1, false, 'e282'),
        ('western', 'iso-8859-1', 1, false, 'e92c'), ('windows', 'windows-1252', 1, false, '802c'))
        AS v(folder, encoding, encodings, bom, first_bytes)""",
    "ingest_mixed_encodings": f"""SELECT name, address, city, postal_code, job_id,
        CASE k % 4 WHEN 0 THEN 'marked' WHEN 1 THEN 'plain' WHEN 2 THEN 'western' ELSE 'windows' END AS folder,
        CASE k % 4 WHEN 2 THEN 'é' WHEN 3 THEN '€' ELSE '€ ł' END AS sign FROM {LISTINGS} l""",
    "upload_replies": f"""SELECT CASE k % 4 WHEN 0 THEN 'marked' WHEN 1 THEN 'plain' WHEN 2 THEN 'western' ELSE 'windows' END AS folder,
        'CSV processed successfully, jobs added to queue' AS message,
        CASE k % 4 WHEN 2 THEN 'iso-8859-1' WHEN 3 THEN 'windows-1252' ELSE 'utf-8' END AS encoding, k % 4 = 0 AS bom_removed,
        count(*) AS jobs_created, (SELECT count(*) FROM customer) AS jobs_written FROM {LISTINGS} l GROUP BY k % 4""",
    "stream_ingest": f"SELECT name, address, city, postal_code, 'scrape-data' AS job_name, 'waiting' AS state FROM {LISTINGS} l",
    "create_batches": f"""SELECT sha256(batch_id || ':' || CAST(k AS VARCHAR)) AS job_id, 'scrape-data' AS job_name, batch_id, k AS row_no,
        name, address, city, postal_code, 'waiting' AS state, '2024-01-01T00:00:00.000Z' AS created_at, 2 AS priority, 0 AS delay_ms FROM {LISTINGS} l""",
    "fold_full": f"SELECT doc_id, {fold('text')} AS folded FROM documents",
    "fold_light": f"SELECT doc_id, {light('text')} AS folded FROM documents",
    "special_chars": f"SELECT doc_id, {has('text', _SPECIAL)} AS has_special FROM documents",
    "char_census": f"SELECT count(*) AS total, count(DISTINCT letter) AS distinct_letters, array_to_string(list_sort(list(DISTINCT letter)), ', ') AS letters FROM {_LETTERS} x",
    "char_counts": f"SELECT letter, count(*) AS n FROM {_LETTERS} x GROUP BY letter",
    "phone_scan": f"SELECT doc_id, {scan('text')} AS phone FROM documents",
    "combined_terms": """SELECT field, term, min(p).l AS lang_no, CAST(min(p).p AS BIGINT) AS pos FROM (
        SELECT source AS field, w[i] AS term, {'l': CAST(list_position(['de', 'en', 'es', 'fr'], lang) AS BIGINT), 'p': CAST(i - 1 AS INT)} AS p
        FROM (SELECT source, lang, w, unnest(range(1, len(w) + 1)) AS i FROM (
            SELECT source, lang, string_split_regex(lower(text), '[^a-zäöüßéèêçñáíóú]+') AS w FROM documents) d) e) x GROUP BY field, term""",
    "csv_values": f"SELECT doc_id, {csv_text('text')} AS cell, {csv_doubled('text')} AS doubled_cell FROM documents",
    "phone_normalise": f"SELECT job_id, country, phone, {phone_intl('phone', 'country', 'prefix')} AS phone_normalised FROM {WITH_PREFIX} l",
    "phone_normalise_known_codes": f"SELECT job_id, {phone_intl('phone', 'country', 'prefix', known=True)} AS phone_normalised FROM {WITH_PREFIX} l",
    "export_formats": f"SELECT job_id, {format_phone('phone')} AS phone, {format_rating('rating_text')} AS rating, {format_reviews('reviews_text')} AS reviews, {format_website('website_text')} AS website FROM {LISTINGS} l",
    "field_validators": f"SELECT job_id, {valid_name('name')} AS name, {valid_phone('phone')} AS phone, {valid_rating('rating_text')} AS rating, {valid_reviews('reviews_text')} AS reviews, {valid_category('category_text')} AS category FROM {LISTINGS} l",
    "day_words": f"SELECT job_id, {translated('hours_text')} AS translated, {detect_day('hours_text')} AS day FROM {LISTINGS} l",
    "hours_normalise": f"SELECT job_id, {normalised('hours_text')} AS hours FROM {LISTINGS} l",
    "hours_rows": f"""SELECT job_id, {row_hours('a', 'da')} AS bare, {row_hours('b', 'db')} AS named FROM (
        SELECT *, {detect_day('a')} AS da, {detect_day('b')} AS db FROM (SELECT job_id, hours_text AS a, 'Samstag : ' || hours_text AS b FROM {LISTINGS} l) x) y""",
    "hours_export": f"SELECT job_id, {format_hours('hours_text')} AS hours FROM {LISTINGS} l",
    "hours_export_all_ranges": f"SELECT job_id, {format_hours('hours_text', every=True)} AS hours FROM {LISTINGS} l",
}

# --- captures: what the pages hold follows from the columns they were made of ----

_BUSINESS = "NOT (k % 6 IN (3, 4) AND rank = 1)"
_OR = "coalesce({}, '')".format
_URL_OK = "(starts_with(website_text, 'http') AND NOT contains(website_text, 'google.com'))"
_FIELDS = {
    "found_name": f"CASE WHEN k % 5 <> 4 THEN {_OR(valid_name('name'))} ELSE '' END",
    "full_address": f"CASE WHEN k % 3 <> 2 THEN {strip('address')} ELSE '' END",
    "found_phone": f"CASE WHEN k % 5 <= 2 AND {valid_phone('phone')} IS NOT NULL THEN {strip('phone')} ELSE {scan(page_text('html'))} END",
    "rating": f"CASE WHEN k % 4 <> 3 THEN {_OR(valid_rating('rating_text'))} ELSE '' END",
    "reviews_count": f"CASE WHEN k % 3 <> 2 THEN {_OR(valid_reviews('reviews_text'))} ELSE '' END",
    "website": f"""CASE k % 4 WHEN 0 THEN CASE WHEN {_URL_OK} THEN website_text ELSE '' END
        WHEN 1 THEN CASE WHEN starts_with(website_text, 'http') THEN website_text WHEN k % 8 = 1 THEN 'https://facebook.com/old' ELSE '' END
        WHEN 2 THEN CASE WHEN {_URL_OK} AND NOT contains(website_text, 'maps') THEN website_text ELSE '' END ELSE '' END""",
    "category": f"""CASE k % 3 WHEN 0 THEN {_OR(valid_category('category_text'))}
        WHEN 1 THEN coalesce({valid_category('category_text')}, {valid_category('address')}, '') ELSE '' END""",
}
_ON_PAGE = {
    "latitude": "CASE k % 5 WHEN 2 THEN lat_text WHEN 3 THEN lat_text || '37' ELSE '' END",
    "longitude": "CASE k % 5 WHEN 2 THEN lng_text WHEN 3 THEN lng_text ELSE '' END",
}
for _n, _t in (("latitude", "lat_text"), ("longitude", "lng_text")):
    _FIELDS[_n] = f"CASE WHEN k % 5 <= 1 THEN {_t} WHEN {_BUSINESS} THEN {_ON_PAGE[_n]} ELSE '' END"

# the only name on a list of results is its heading; its texts give no phone
_NAME_ON_LIST = f"CASE WHEN k % 6 = 4 AND rank = 1 THEN {_OR(valid_name(q('Ergebnisse für ') + ' || name'))} ELSE '' END"


def _field(name: str) -> str:
    if name in ("latitude", "longitude"):
        return f"{_FIELDS[name]} AS {name}"
    other = {"found_name": _NAME_ON_LIST, "found_phone": scan(page_text("html"))}.get(name, "''")
    return f"CASE WHEN {_BUSINESS} THEN {_FIELDS[name]} ELSE {other} END AS {name}"


_DAY_ROWS = ", ".join(
    f"{q(day)} || sep || {'hours_text' if i % 2 == 0 else 'hours_text_2'}"
    for i, day in enumerate(["Montag", "Mardi", "Miércoles", "Giovedì", "Friday", "Samedi", "Heute"])
)
_HOURS_ROWS = f"""(SELECT job_id, rank, pos, row_text, {detect_day('row_text')} AS day FROM (
    SELECT job_id, rank, pos, rows[pos] AS row_text FROM (SELECT *, unnest(range(1, 8)) AS pos FROM (
        SELECT *, [{_DAY_ROWS}] AS rows FROM (SELECT *, CASE k % 6 WHEN 0 THEN '' ELSE ': ' END AS sep FROM {CAPTURES} c WHERE k % 6 IN (0, 1)) s) r) p) t)"""
_HOURS_LONG = f"""(SELECT job_id, rank, day, arg_max(hours, pos) AS hours FROM (
    SELECT job_id, rank, day, pos, {row_hours('row_text', 'day')} AS hours FROM {_HOURS_ROWS} h WHERE day IS NOT NULL) x GROUP BY job_id, rank, day)"""


def _hours_wide() -> str:
    cols = ", ".join(
        f"max(CASE WHEN day = '{d}' THEN hours END) AS {d.lower()}" for d in O.DAYS
    )
    return f"(SELECT job_id, rank, {cols} FROM {_HOURS_LONG} h GROUP BY job_id, rank)"


_DAY_COLS = [d.lower() for d in O.DAYS]
_PAGE_FIELDS = f"(SELECT job_id, rank, k, batch_id, {', '.join(_field(f) for f in _FIELDS)} FROM {CAPTURES} c)"
_FIRST_BUSINESS = f"(SELECT job_id, min(rank) AS rank FROM {CAPTURES} c WHERE {_BUSINESS} GROUP BY job_id)"
_PLACES = f"""(SELECT l.job_id, l.batch_id, l.k, l.name AS "originalName", l.address AS "originalAddress", l.city AS "originalCity",
    l.postal_code AS "originalPostalCode", b.rank IS NOT NULL AS got,
    CASE WHEN b.rank IS NULL THEN '' WHEN f.found_name <> '' THEN f.found_name ELSE l.name END AS "fullName",
    coalesce(f.full_address, '') AS "fullAddress",
    CASE WHEN {strip("coalesce(f.found_phone, '')")} <> '' THEN {phone_intl('f.found_phone', 'l.country', 'l.prefix')} ELSE '' END AS phone,
    coalesce(f.rating, '') AS rating, coalesce(f.reviews_count, '') AS "reviewsCount", coalesce(f.website, '') AS website,
    coalesce(f.category, '') AS category, coalesce(f.latitude, '') AS latitude, coalesce(f.longitude, '') AS longitude,
    {', '.join(f"h.{d}" for d in _DAY_COLS)},
    CASE WHEN b.rank IS NULL THEN 'failed' ELSE 'success' END AS status,
    CASE WHEN b.rank IS NULL THEN {q(P.NOT_FOUND)} END AS error
    FROM {WITH_PREFIX} l LEFT JOIN {_FIRST_BUSINESS} b ON b.job_id = l.job_id
    LEFT JOIN {_PAGE_FIELDS} f ON f.job_id = b.job_id AND f.rank = b.rank
    LEFT JOIN {_hours_wide()} h ON h.job_id = b.job_id AND h.rank = b.rank)"""
_FIRST_SUCCESS = f"""(SELECT a.job_id, a.rank, a.strategy, a.query FROM {ATTEMPTS} a JOIN {_FIRST_BUSINESS} b ON b.job_id = a.job_id AND b.rank = a.rank)"""

_PAGE_PATTERNS = {
    "nav a": r"(?s)<nav>.*?<a [^>]*>(.*?)</a>",
    "div.ad": r'(?s)<div class="ad">(.*?)</div>',
    "h1": r"(?s)<h1>(.*?)</h1>",
    "title": r"(?s)<title>(.*?)</title>",
    "article p": r"(?s)<article>.*?<p>(.*?)(?:</p>|<p>)",
}
_PAGE_CANDIDATES = "(" + " UNION ALL ".join(
    f"SELECT page_id, 'name' AS field, {i} AS selector_rank, {q(css)} AS selector, {entities(sub(ext('html', _PAGE_PATTERNS[css], 1), '(?s)<[^>]*>', ''))} AS raw FROM pages WHERE {has('html', _PAGE_PATTERNS[css])}"
    for i, css in enumerate(PAGE_SELECTORS["name"], start=1)
) + ")"

ORACLES |= {
    "page_class": f"SELECT job_id, rank, CASE WHEN {_BUSINESS} THEN 'business_page' WHEN k % 6 = 4 THEN 'results_page' ELSE 'unknown' END AS page_class FROM {CAPTURES} c",
    "page_candidates": f"SELECT * FROM {_PAGE_CANDIDATES} c",
    "first_valid": f"SELECT page_id, field, arg_min(value, selector_rank) AS value FROM (SELECT *, {valid_name('raw')} AS value FROM {_PAGE_CANDIDATES} c) v WHERE value IS NOT NULL GROUP BY page_id, field",
    "page_phone": f"SELECT page_id, {scan(page_text('html'))} AS phone FROM pages",
    "coordinates": f"SELECT job_id, rank, latitude, longitude FROM {_PAGE_FIELDS} f",
    "website_pick": f"SELECT job_id, rank, website FROM {_PAGE_FIELDS} f",
    "social_links": f"""SELECT job_id, rank, CASE WHEN s THEN 'https://facebook.com/p' || job_id END AS facebook,
        CASE WHEN s THEN 'https://instagram.com/i' || job_id END AS instagram, CAST(NULL AS VARCHAR) AS twitter,
        CAST(NULL AS VARCHAR) AS linkedin, CAST(NULL AS VARCHAR) AS youtube FROM (SELECT *, {_BUSINESS} AND k % 8 = 1 AS s FROM {CAPTURES} c) x""",
    "hours_map": f"SELECT c.job_id, c.rank, {', '.join(f'''coalesce(h.{d}, '') AS {d}''' for d in _DAY_COLS)} FROM {CAPTURES} c LEFT JOIN {_hours_wide()} h ON h.job_id = c.job_id AND h.rank = c.rank",
    "page_fields": f"SELECT job_id, rank, {', '.join(_FIELDS)} FROM {_PAGE_FIELDS} f",
    "capture_first_valid": f"""SELECT job_id, rank, found_name AS name, full_address AS address, accepted AS phone, rating, reviews_count AS reviews, category
        FROM (SELECT job_id, rank, {', '.join(_field(f) for f in ('found_name', 'full_address', 'rating', 'reviews_count', 'category'))},
              CASE WHEN {_BUSINESS} AND k % 5 <= 2 THEN {_OR(valid_phone('phone'))} ELSE '' END AS accepted FROM {CAPTURES} c) x
        WHERE concat(found_name, full_address, accepted, rating, reviews_count, category) <> ''""",
    "shared_coordinates": f"""SELECT c.job_id, c.rank, CASE WHEN c.k % 5 = 4 THEN lat_text ELSE latitude END AS latitude,
        CASE WHEN c.k % 5 = 4 THEN lng_text ELSE longitude END AS longitude
        FROM {CAPTURES} c JOIN {_PAGE_FIELDS} f ON f.job_id = c.job_id AND f.rank = c.rank WHERE NOT (c.k % 6 IN (3, 4) AND c.rank = 1)""",
    "capture_store": f"SELECT job_id, rank, url, length(html) AS characters FROM {CAPTURES} c",
    "first_success": f"SELECT * FROM {_FIRST_SUCCESS} s",
    "missing_places": f"""SELECT job_id, batch_id, name AS "originalName", address AS "originalAddress", city AS "originalCity", postal_code AS "originalPostalCode",
        {', '.join(f"'' AS \"{c}\"" for c in P.SCRAPED_COLUMNS[4:13])}, 'failed' AS status, {q(P.NOT_FOUND)} AS error
        FROM {LISTINGS} l WHERE job_id NOT IN (SELECT job_id FROM {_FIRST_SUCCESS} s)""",
    "enrich": f"""SELECT job_id, batch_id, {', '.join(f'"{c}"' for c in P.SCRAPED_COLUMNS[:13])},
        CASE WHEN got AND k % 8 = 1 THEN 'https://facebook.com/p' || job_id END AS facebook,
        monday, friday, status, error FROM {_PLACES} p""",
    "result_list_guard": f"""SELECT c.job_id, c.rank,
        CASE WHEN c.rank = 1 AND k % 6 = 4 THEN CASE WHEN c.name = '' THEN {q(P.NAMELESS_RESULT_LIST)} ELSE c.name END
             WHEN c.rank = 1 AND k % 6 = 3 THEN NULL WHEN k % 5 = 3 THEN 'Search' WHEN k % 5 = 4 THEN '4.5' ELSE c.name END AS "fullName",
        CASE WHEN c.rank = 1 AND k % 6 = 4 THEN '' ELSE f.website END AS website,
        CASE WHEN c.rank = 1 AND k % 6 = 4 THEN 'failed' ELSE 'success' END AS status,
        CASE WHEN c.rank = 1 AND k % 6 = 4 THEN {q(P.ON_RESULT_LIST)} ELSE '' END AS error
        FROM {CAPTURES} c JOIN (SELECT job_id, rank, website FROM {_PAGE_FIELDS} f) f ON f.job_id = c.job_id AND f.rank = c.rank""",
    "coordinate_range": f"""SELECT job_id, TRY_CAST(rating_text AS DOUBLE) AS rating_num, TRY_CAST({sub('reviews_text', '[^0-9]', '')} AS BIGINT) AS reviews_num,
        CAST(CASE WHEN k % 4 = 0 THEN '107' || lat_text ELSE lat_text END AS DOUBLE) AS lat, CAST(lng_text AS DOUBLE) AS lng, k % 4 <> 0 AS coordinates_ok FROM {LISTINGS} l""",
    "export17": f"""SELECT job_id, {csv_text('"fullName"')} AS "Name", {format_rating('rating')} AS "Rating", {format_reviews('"reviewsCount"')} AS "Reviews Count",
        {csv_text(format_phone('phone'))} AS "Phone", {csv_text('"fullAddress"')} AS "Address", {csv_text(format_website('website'))} AS "Website", category AS "Category",
        latitude AS "Latitude", longitude AS "Longitude",
        {', '.join(f'''coalesce({csv_text(format_hours(d))}, '') AS "{d.title()} Hours"''' for d in _DAY_COLS)}, status AS "Status" FROM {_PLACES} p""",
    "csv_lines": "SELECT " + " || ',' || ".join(csv_doubled(f'"{c}"') for c in P.EXPORT_COLUMNS[:-1]) + f" || ',' || \"Status\" AS value FROM {EXPORT} e",
    "csv_round_trip": "SELECT " + ", ".join(f'{csv_text(f"""\"{c}\"""")} AS "{c}"' for c in P.EXPORT_COLUMNS) + f" FROM {EXPORT} e",
}

# --- batches --------------------------------------------------------------------

_LISTED = f"(SELECT * FROM {JOBS} j WHERE state IN ('waiting', 'active', 'completed', 'failed'))"
_COUNTS = """count(*) AS total, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed,
    count(*) FILTER (state = 'active') AS processing, count(*) FILTER (state = 'waiting') AS waiting"""
_ROWS = f"""(SELECT j.*, state = 'failed' OR (state = 'completed' AND r.job_id IS NOT NULL) AS is_result,
    CASE WHEN state = 'completed' THEN r.scraped_status END AS scraped_status,
    CASE WHEN state = 'completed' THEN r.processing_ms END AS processing_ms,
    CASE WHEN state = 'completed' THEN r.processed_at WHEN state = 'failed' THEN j.processed_at END AS result_at,
    CASE WHEN state = 'failed' THEN coalesce(r.error, 'Unknown error') WHEN state = 'completed' THEN r.error END AS error,
    CASE WHEN state = 'completed' THEN r.worker END AS worker
    FROM {_LISTED} j LEFT JOIN {RESULTS} r ON r.job_id = j.job_id)"""
_BATCHES = f"""(SELECT *, CASE WHEN completed + failed = total AND failed = 0 THEN 'completed' WHEN completed + failed = total THEN 'completed_with_errors'
        WHEN waiting = total THEN 'queued' ELSE 'processing' END AS status, {pct('completed + failed', 'total')} AS percentage,
    CASE WHEN processing + waiting > 0 AND completed > 0 AND epoch_ms(last) > epoch_ms(first)
         THEN (epoch_ms(last) - epoch_ms(first)) / completed * (processing + waiting) END AS eta
    FROM (SELECT batch_id, {_COUNTS}, min(created_at) AS first, max(processed_at) AS last,
            count(*) FILTER (is_result AND scraped_status = 'success') AS ok, count(*) FILTER (is_result AND scraped_status = 'partial') AS part,
            count(*) FILTER (is_result AND scraped_status IS NULL) AS bad, count(*) FILTER (is_result AND scraped_status = 'failed') AS lost
          FROM {_ROWS} r GROUP BY batch_id) b)"""
_ETA = """CASE WHEN floor(eta / 3600000) > 0 THEN CAST(CAST(floor(eta / 3600000) AS BIGINT) AS VARCHAR) || 'h ' || CAST(CAST(floor(fmod(eta, 3600000) / 60000) AS BIGINT) AS VARCHAR) || 'm'
    WHEN floor(eta / 60000) > 0 THEN CAST(CAST(floor(eta / 60000) AS BIGINT) AS VARCHAR) || 'm ' || CAST(CAST(floor(fmod(eta, 60000) / 1000) AS BIGINT) AS VARCHAR) || 's'
    WHEN eta IS NOT NULL THEN CAST(CAST(floor(eta / 1000) AS BIGINT) AS VARCHAR) || 's' END"""


def _kept(keep: dict[str, int]) -> str:
    test = " OR ".join(f"(state = '{s}' AND n > {n})" for s, n in keep.items())
    return f"SELECT job_id, state FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY processed_at DESC NULLS LAST, job_id) AS n FROM {JOBS} j) x WHERE NOT ({test})"


def _recent(state: str, name: str, value: str) -> str:
    return f"""SELECT x.job_id, {iso('x.processed_at')} AS {name}, {value}
        FROM (SELECT * FROM {JOBS} j WHERE state = '{state}' AND processed_at IS NOT NULL ORDER BY processed_at DESC, job_id LIMIT 10) x
        LEFT JOIN {RESULTS} r ON r.job_id = x.job_id"""


_ACTIVE_5MIN = f"least(count(*) FILTER (state = 'completed' AND processed_at > TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTE), 10)"


def _newest(value: str, state: str) -> str:
    return f"arg_max({value}, {{'t': processed_at, 'j': job_id}}) FILTER (state = '{state}' AND processed_at IS NOT NULL)"


_STATE_COUNTS = ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in B.STATES)
_PAYLOADS = f"""(SELECT r.batch_id, row_number() OVER (PARTITION BY r.batch_id ORDER BY r.state, r.created_at, r.job_id) - 1 AS index, r.job_id,
    d.name, d.city, d.postal_code, CASE WHEN r.state = 'completed' AND d.has_record THEN d.full_name END AS full_name,
    CASE WHEN r.state = 'completed' AND d.has_record THEN d.website END AS website,
    r.processing_ms, {iso('r.result_at')} AS processed_at, r.worker, r.error
    FROM {_ROWS} r JOIN {view_sql('job_data')} d ON d.job_id = r.job_id WHERE r.is_result)"""

ORACLES |= {
    "queue_stats": "SELECT waiting, active, completed, failed, total FROM (SELECT count(*) AS total, "
    + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in B.STATES) + f" FROM {_LISTED} j) x",
    "jobs_of_batch": f"SELECT job_id, state FROM {JOBS} j WHERE batch_id = 'b7'",
    "union_of_states": f"SELECT job_id, batch_id, state FROM {_LISTED} j",
    "batch_progress": f"SELECT batch_id, total, completed, failed, processing, waiting, percentage FROM {_BATCHES} b",
    "batch_status": f"SELECT batch_id, status FROM {_BATCHES} b",
    "batch_timing": f"SELECT batch_id, {iso('first')} AS created_at, {iso('last')} AS last_processed_at, {_ETA} AS estimated_time_remaining FROM {_BATCHES} b",
    "batch_summary": f"SELECT batch_id, total AS total_businesses, ok AS successful_scrapes, part AS partial_scrapes, bad AS failed_scrapes, lost AS not_found FROM {_BATCHES} b",
    "stored_jobs_of_batch": f"SELECT job_id, state FROM {JOBS} j WHERE batch_id = 'b7'",
    "stored_jobs_with_results": f"SELECT job_id, state, is_result, scraped_status, processing_ms, {iso('result_at')} AS result_at, error, worker FROM {_ROWS} r",
    "jobs_with_results": f"SELECT job_id, state, is_result, scraped_status, processing_ms, {iso('result_at')} AS result_at, error, worker FROM {_ROWS} r",
    "batch_documents": f"""SELECT batch_id, status, total, completed, failed, percentage, {iso('first')} AS "createdAt", {iso('last')} AS "lastProcessedAt",
        {_ETA} AS "estimatedTimeRemaining", ok AS "successfulScrapes", bad AS "failedScrapes" FROM {_BATCHES} b""",
    "result_envelopes": f"SELECT batch_id, job_id, scraped_status, error, processing_ms, {iso('result_at')} AS processed_at, worker FROM {_ROWS} r WHERE is_result",
    "result_payloads": f"SELECT * FROM {_PAYLOADS} p",
    "batch_document_results": f"SELECT * FROM {_PAYLOADS} p",
    "worker_health_cases": " UNION ALL ".join(
        f"""SELECT {q(of)} AS of, {q(verdict[0])} AS status, {q(verdict[1])} AS reason, {_STATE_COUNTS} FROM {JOBS} j WHERE {test}"""
        for of, test, verdict in (("all", "true", B.HEALTHY), ("idle", "state = 'waiting'", B.OFFLINE), ("failing", "state IN ('active', 'failed')", B.FAILING))
    ),
    "run_envelopes": f"SELECT job_id, batch_id, scraped_status, epoch_ms(ended_at) - epoch_ms(started_at) AS processing_ms, {iso('ended_at')} AS processed_at, error, worker FROM {RUNS} r",
    "retention": _kept(B.QUEUE_KEEP),
    "worker_retention": _kept(B.WORKER_KEEP),
    "recent_completed": _recent("completed", "completed_at", "coalesce(CAST(r.processing_ms AS VARCHAR), 'unknown') AS processing_time"),
    "recent_failed": _recent("failed", "failed_at", "coalesce(r.error, 'unknown') AS error"),
    "active_jobs": f"SELECT job_id, job_name, {iso('processed_at')} AS started_at, coalesce(progress, 0) AS progress FROM {JOBS} j WHERE state = 'active'",
    "result_index": f"SELECT batch_id, job_id, row_number() OVER (PARTITION BY batch_id ORDER BY state, created_at, job_id) - 1 AS index FROM {JOBS} j WHERE state IN ('completed', 'failed')",
    "worker_health": f"""SELECT CASE WHEN v > 0 THEN 'degraded' ELSE 'healthy' END AS status,
        CASE v WHEN 1 THEN {q(B.OFFLINE[1])} WHEN 2 THEN {q(B.FAILING[1])} ELSE {q(B.HEALTHY[1])} END AS reason,
        waiting, active, completed, failed, delayed, completed_last_5min, last_completed_id, last_completed_at, last_failed_id, last_failed_at FROM (
        SELECT *, CASE WHEN active = 0 AND waiting > 0 THEN CASE WHEN completed_last_5min = 0 THEN 1 ELSE 0 END
                       WHEN failed > completed AND failed > 10 THEN 2 ELSE 0 END AS v FROM (
        SELECT {', '.join(f"count(*) FILTER (state = '{s}') AS {s}" for s in [*B.STATES, 'delayed'])}, {_ACTIVE_5MIN} AS completed_last_5min,
          {_newest('job_id', 'completed')} AS last_completed_id, {_newest(iso('processed_at'), 'completed')} AS last_completed_at,
          {_newest('job_id', 'failed')} AS last_failed_id, {_newest(iso('processed_at'), 'failed')} AS last_failed_at FROM {JOBS} j) c) d""",
}

# --- quality --------------------------------------------------------------------

_S = "\"Status\" = 'success'"
_PARTIAL = f"""({_S} AND "Rating" = '' AND "Phone" = '' AND "Monday Hours" = '' AND "Latitude" <> '' AND "Longitude" <> '')"""
_M = '"Monday Hours"'
_REASON = f"""CASE WHEN {_S} AND {_M} <> '' THEN CASE
    WHEN NOT {has(_M, '^[0-9]{2}:[0-9]{2}[ ]*-[ ]*[0-9]{2}:[0-9]{2}')} AND {_M} NOT IN ('Closed', 'Open 24 hours') THEN 'Not 24h format'
    WHEN {has(_M, '(?i)am|pm')} THEN 'Contains am/pm' WHEN {has(_M, '[0-9]{4}:[0-9]{2}')} THEN 'Bad format (concatenated)' END END"""
_ISSUES = f"(SELECT *, {_REASON} AS reason FROM {EXPORT} e)"
_PROFILE = f"""(SELECT count(*) AS total, count(*) FILTER ({_S}) AS success, count(*) FILTER ("Status" = 'failed') AS failed, count(*) FILTER ({_PARTIAL}) AS partial,
    count(*) FILTER ({_S} AND ({_M} <> '' OR "Tuesday Hours" <> '')) AS with_hours, count(*) FILTER ({_S} AND "Rating" <> '') AS with_rating,
    count(*) FILTER ({_S} AND "Reviews Count" <> '') AS with_reviews, count(*) FILTER ({_S} AND "Phone" <> '') AS with_phone,
    count(*) FILTER ({_S} AND "Website" <> '') AS with_website, count(*) FILTER (reason IS NOT NULL) AS hours_issues FROM {_ISSUES} i)"""
_REGION = """CASE WHEN contains("Address", 'Switzerland') OR contains("Address", 'Schweiz') THEN 'Switzerland' WHEN contains("Address", 'Colombia') THEN 'Colombia'
    WHEN contains("Address", 'Spain') THEN 'Spain' WHEN contains("Address", 'Germany') THEN 'Germany' ELSE 'Unknown' END"""
_RULES = [
    ("failed > 20", "High failure rate! Consider:"),
    ("with_rating < success * 0.5", "Low rating extraction rate. This is normal if:"),
    ("hours_issues > 0", "Hours format issues detected!"),
    ("partial > 5", "Many partial successes (coordinates only)"),
]

_ADVICE = [
    ["1. Adding full addresses to CSV", "2. Verifying business names match Google Maps exactly", "3. Adding postal codes for better geolocation"],
    ["- Businesses are new", "- Businesses don't have Google reviews", "Consider: Manual verification of a few cases"],
    ["Action: Check normalizeDayNames() function"],
    ["Possible causes:", "- Google Maps page structure changed", "- Selectors need updating", "Action: Check Docker logs for specific errors"],
]


def _list(kind: str, test: str) -> str:
    return f"""SELECT job_id, '{kind}' AS problem, CASE WHEN "Name" = '' THEN '(no name)' ELSE "Name" END AS name,
        CASE WHEN "Address" = '' THEN 'N/A' ELSE "Address" END AS address, "Latitude" || ', ' || "Longitude" AS coordinates,
        row_number() OVER (ORDER BY job_id) AS no FROM {EXPORT} e WHERE {test}"""


ORACLES |= {
    "quality_profile": "SELECT *, " + ", ".join(
        [f"{pct(n, 'total')} AS {n}_pct" for n in ("success", "failed", "partial")]
        + [f"{pct(f'with_{n}', 'success')} AS with_{n}_pct" for n in ("hours", "rating", "reviews", "phone", "website")]
    ) + f" FROM {_PROFILE} p",
    "hours_issues": f'SELECT job_id, "Name" AS name, {_M} AS hours, reason FROM {_ISSUES} i WHERE reason IS NOT NULL',
    "hours_issue_counts": f"SELECT reason, count(*) AS n FROM {_ISSUES} i WHERE reason IS NOT NULL GROUP BY reason",
    "region_completeness": f"""SELECT region, total, with_all_data, {pct('with_all_data', 'total')} AS completeness_pct FROM (
        SELECT {_REGION} AS region, count(*) AS total, count(*) FILTER ("Rating" <> '' AND "Phone" <> '' AND {_M} <> '') AS with_all_data
        FROM {EXPORT} e WHERE {_S} GROUP BY 1) x""",
    "recommendations": " UNION ALL ".join(
        f"SELECT {i} AS rule_no, {q(text)} AS recommendation FROM {_PROFILE} p WHERE {test}" for i, (test, text) in enumerate(_RULES, start=1)
    ),
    "recommendation_lines": " UNION ALL ".join(
        f"SELECT {i} AS rule_no, {n} AS line_no, {q(line)} AS line FROM {_PROFILE} p WHERE {test}"
        for i, ((test, text), more) in enumerate(zip(_RULES, _ADVICE), start=1) for n, line in enumerate([text, *more])
    ),
    "success_grade": f"SELECT success_rate, CASE WHEN success_rate >= 70 THEN 'Good' WHEN success_rate >= 60 THEN 'Acceptable' ELSE 'Poor' END AS grade FROM (SELECT success / total * 100 AS success_rate FROM {_PROFILE} p) x",
    "failed_list": _list("failed", "\"Status\" = 'failed'"),
    "partial_list": _list("partial", _PARTIAL),
}

# --- job events -----------------------------------------------------------------

_TERM = "(event IN ('completed', 'failed'))"
_STATE = "CASE WHEN event = 'progress' THEN 'active' ELSE event END"
_STATES = f"(SELECT batch_id, job_id, arg_max({_STATE}, {{'t': {_TERM}, 'ts': event_ts, 'e': event}}) AS state, max(event_ts) AS last_event_at FROM {EVENTS} e GROUP BY batch_id, job_id)"
_FINISHED = f"""(SELECT batch_id, job_id, arg_min({{'event': event, 'progress': progress, 'failed_reason': failed_reason, 'event_ts': event_ts}}, {{'ts': event_ts, 'e': event}}) AS v
    FROM {EVENTS} e WHERE {_TERM} GROUP BY batch_id, job_id)"""
_PROGRESS = f"""(SELECT batch_id, completed, total, {pct('completed', 'total')} AS percentage, completed >= total AS done FROM (
    SELECT batch_id, count(DISTINCT job_id) FILTER ({_TERM}) AS completed, count(DISTINCT job_id) AS total
    FROM {EVENTS} e GROUP BY batch_id) c)"""
_JSON = "'{\"batchId\":\"' || batch_id || '\",\"completed\":' || CAST(completed AS VARCHAR) || ',\"total\":' || CAST(total AS VARCHAR)"
_EVENTS_TS = f"strftime(TIMESTAMP '{EVENTS_AS_OF}', '%Y-%m-%dT%H:%M:%S.%gZ')"
_SPELLS = f"""(SELECT batch_id, job_id, arg_max({_STATE}, {{'t': {_TERM}, 'ts': event_ts, 'e': event}}) AS state, max(event_ts) + INTERVAL 6 HOUR AS ended FROM (
    SELECT *, sum(new_spell) OVER (PARTITION BY job_id ORDER BY event_ts ROWS UNBOUNDED PRECEDING) AS spell FROM (
        SELECT *, CASE WHEN event_ts >= lag(event_ts) OVER (PARTITION BY job_id ORDER BY event_ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new_spell FROM {EVENTS} e) a) b
    GROUP BY batch_id, job_id, spell)"""
_RECENT = f"""SELECT {iso('w')} AS window_start, {iso('w + INTERVAL 5 MINUTE')} AS window_end, count(*) AS completed FROM (
    SELECT time_bucket(INTERVAL 5 MINUTE, event_ts) AS w FROM {EVENTS} e WHERE event = 'completed') x GROUP BY w"""

ORACLES |= {
    "job_states": f"SELECT batch_id, job_id, state, {iso('last_event_at')} AS last_event_at FROM {_STATES} s",
    "finished_once": f"SELECT batch_id, job_id, v.event AS event, v.progress AS progress, v.failed_reason AS failed_reason, {iso('v.event_ts')} AS event_ts FROM {_FINISHED} f",
    "progress": f"SELECT * FROM {_PROGRESS} p",
    "progress_payloads": f"""SELECT 'progress' AS event, batch_id, {_JSON} || ',"percentage":' || CAST(percentage AS VARCHAR) || '}}' AS payload_json, {_EVENTS_TS} AS ts FROM {_PROGRESS} p
        UNION ALL SELECT 'complete', batch_id, {_JSON} || ',"message":"All jobs completed"}}', {_EVENTS_TS} FROM {_PROGRESS} p WHERE done""",
    "recent_activity": _RECENT,
    "stalled_jobs": f"SELECT batch_id, job_id, state, {iso('last_event_at')} AS last_event_at FROM {_STATES} s WHERE state = 'active' AND last_event_at < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 30 SECOND",
    "stalled_spells": f"""SELECT batch_id, job_id, {iso('ended')} AS stalled_at FROM {_SPELLS} s WHERE state = 'active' AND NOT EXISTS (
        SELECT 1 FROM (SELECT batch_id AS b, job_id AS j, event_ts FROM {EVENTS} e WHERE {_TERM}) t WHERE b = batch_id AND j = job_id AND t.event_ts <= ended)""",
    "stream_job_states": f"SELECT batch_id, job_id, state, {iso('last_event_at')} AS last_event_at FROM {_STATES} s",
    "stream_progress": f"SELECT * FROM {_PROGRESS} p",
    "stream_complete": f"""SELECT 'complete' AS event, batch_id, {_JSON} || ',"message":"All jobs completed"}}' AS payload_json FROM {_PROGRESS} p WHERE done""",
    "stream_completions": f"SELECT batch_id, completed, total FROM {_PROGRESS} p WHERE done",
    "stream_stalls": f"""SELECT batch_id, job_id, {iso('ended')} AS stalled_at FROM {_SPELLS} s WHERE state = 'active'
        AND ended <= (SELECT max(event_ts) FROM {EVENTS} e) - INTERVAL 10 MINUTE
        AND NOT EXISTS (SELECT 1 FROM {EVENTS} e WHERE e.job_id = s.job_id AND {_TERM} AND e.event_ts <= s.ended)""",
    "stream_first_ends": f"SELECT batch_id, job_id, v.event AS event, {iso('v.event_ts')} AS event_ts FROM {_FINISHED} f",
    "stream_result_payloads": f"""SELECT e.batch_id, row_number() OVER (PARTITION BY e.batch_id ORDER BY e.event_ts, e.job_id) - 1 AS index,
        e.job_id, e.event, {iso('e.event_ts')} AS event_ts, r.job_id IS NOT NULL AS has_result, r.name, r.city, r.full_name, r.rating, r.processing_ms
        FROM {EVENTS} e LEFT JOIN {view_sql('event_results')} r ON r.batch_id = e.batch_id AND r.job_id = e.job_id AND r.result_ts = e.event_ts
        WHERE {_TERM} AND (r.job_id IS NOT NULL OR e.event_ts <= (SELECT max(event_ts) FROM {EVENTS} m) - INTERVAL 10 MINUTE)""",
    "stream_results": f"SELECT batch_id, job_id FROM {_FINISHED} f",
    "stream_recent_activity": _RECENT,
    "stream_stalled_spells": f"SELECT batch_id, job_id, {iso('ended')} AS stalled_at FROM {_SPELLS} s WHERE state = 'active' AND ended <= (SELECT max(event_ts) FROM {EVENTS} e) - INTERVAL 10 MINUTE",
}

