"""Listings, captures, jobs, results and events derived from the supplied tables.

The supplied tables hold no listings. Each view is one SELECT over one of them, in
SQL that both engines read alike, so that a query and its counterpart start from the
same rows. ``{table}`` stands for a supplied table and ``{ranks}`` for the engine's way
to make two rows of one. Every row of a table is read; some listings get no capture and
some jobs no result, on purpose.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from listingloom.sources.tables import read_table, spread


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _pick(key: str, values: list[str], raw: bool = False) -> str:
    """CASE that takes value number ``key % n``."""
    whens = " ".join(
        f"WHEN {i} THEN {v if raw else _text(v)}" for i, v in enumerate(values)
    )
    return f"CASE {key} % {len(values)} {whens} END"


NAMES = [
    "Bäckerei Müller GmbH", "Café Zürich AG", "Coop St. Gallen", "Manor Basel",
    "Restaurang Köttbullar AB", "Joe's Pizza", 'Gasthaus "Zum Löwen"', "Smith & Co Legal",
    "Røros Håndverk AS", "Hälsokost Åkersberga", "  Apple Glattzentrum ", "Crème Brûlée Ltd",
    "Señor Ñandú, Tapas", "Straßenküche Süd", "Happy Market", "Migros Company", "X",
]
ADDRESSES = [
    "Hauptstraße 25", "Bahnhofstrasse 15", "Neugasse 51", "Via Roma 7", "Rue de Rivoli 10",
    "Greifengasse 22, 4058 Basel", "12345 musterstadt Deutschland", "Drottninggatan 45",
    "Platz 3, CH-8001", "Kungsgatan 5", "Avenue Foch 75016", "Storgata 15 Germany",
]
CITIES = [
    "Zürich", "München", "St. Gallen", "Basel", "Stockholm", "Paris", "Roma", " Bern ", "Oslo",
    "Saint-Étienne", "KÖLN", "Cartagena", "Göteborg", "Madrid", "Bogotá", "Berlin", "Lugano",
]
POSTAL_CODES = ["8001", "80331", "", "411 19", "0150", "", "", "9000\n", ""]
RATINGS = ["4.5", "4,3", "5", "3.0 stars", "6.1", "n/a", " 4.25 ★", "0", "4.50", ""]
REVIEWS = [
    "(1.309)", "1309 reviews", "2.451 Bewertungen", "43", "1,204", "12 recensioner",
    "7 anmeldelser", "(12,5)", "none", "", "1.2", "(123) 45",
]
WEBSITES = [
    "https://www.example.ch/de/?a=1&b=2", "http://shop.example.org", "example.com",
    "see example com", " https://trim.example.net ", "", "https://maps.google.com/x",
]
CATEGORIES = [
    "Bakery", "Electronics store", "4.5", "5 star hotel", "★ Bistro", " Grocery store ", "12", "",
]
HOURS = [
    "Monday: 12:00 pm - 9:00 pm", "7:30 am - 7 pm", "9 am–5 pm", "12 am - 11:59 pm",
    "8:00am-6:00pm", "9:00 am - 12:00 pm, 2:00 pm - 6:00 pm",
    "7 am - 12 pm and 1 pm - 8 pm", "Open 24 hours", "Closed", "Montag: 9:00 - 18:00",
    "12:30 pm - 12:30 am", "13 PM to 4 PM", "Lunedì: chiuso", "Sábado 9AM—5PM ",
    "9 a.m.–6 p.m.", "9:30 A.M.–12:15 p.m.", "Mardi 08:30-20:00", "8:30 - 20:00",
    "Jueves: 10 am to 2:5 pm", "Domenica 10:00–12:00, 13:00–15:00", "Fermé", "by request!",
    "sexta 9:00 - 12:00", "", "GESCHLOSSEN",
]
_K = "c_custkey"
_D2 = "lpad(CAST({} % 100 AS STRING), 2, '0')"
_A, _B, _C = (_D2.format(x) for x in (_K, f"({_K} * 7 + 3)", f"({_K} * 13 + 5)"))
PHONES = [
    f"'044 8' || {_A} || ' ' || {_B} || ' ' || {_C}",
    f"'0844 8' || {_A} || ' ' || {_B} || '1'",
    f"'+43 664 19' || {_A} || {_B} || '0'",
    f"'+41 44 8' || {_A} || ' ' || {_B} || ' ' || {_C}",
    f"'030 1' || {_A} || {_B} || {_C}",
    f"'(089) 1' || {_A} || {_B} || {_C} || '4'",
    f"'06 12 ' || {_A} || ' ' || {_B} || ' ' || {_C}",
    f"'Bahnhofstrasse ' || {_A}",
    f"'4.5(' || {_A} || ')'",
    "''",
    f"'  +49-30.1' || {_A} || {_B} || '77 '",
]

LISTINGS = f"""
SELECT c_custkey AS k, CAST(c_custkey AS STRING) AS job_id,
       'b' || CAST(c_nationkey % 5 AS STRING) AS batch_id,
       CASE WHEN {_K} % 29 = 7 THEN '' ELSE {_pick(_K, NAMES)} END AS name,
       CASE WHEN {_K} % 7 = 3 THEN '' ELSE {_pick(_K, ADDRESSES)} END AS address,
       CASE WHEN {_K} % 11 = 4 THEN '' ELSE {_pick(_K, CITIES)} END AS city,
       {_pick(f"({_K} * 5 + c_nationkey)", POSTAL_CODES)} AS postal_code,
       {_pick(_K, PHONES, raw=True)} AS phone,
       {_pick(f"({_K} + c_nationkey)", RATINGS)} AS rating_text,
       {_pick(f"({_K} + c_nationkey)", REVIEWS)} AS reviews_text,
       {_pick(f"({_K} * 3 + c_nationkey)", WEBSITES)} AS website_text,
       {_pick(f"({_K} * 3 + c_nationkey)", CATEGORIES)} AS category_text,
       {_pick(f"({_K} * 7 + c_nationkey)", HOURS)} AS hours_text,
       {_pick(f"({_K} * 11 + c_nationkey)", HOURS)} AS hours_text_2,
       '4' || CAST({_K} % 9 AS STRING) || '.' || {_B} || {_A} || '1' AS lat_text,
       '8.' || {_C} || {_B} || '25' AS lng_text
FROM {{customer}}
"""

# as different writers put it: references by name and number, any case, with and without quotes
_NAME_HTML = (
    "replace(replace(replace(replace(name, '&', '&amp;'), 'é', '&eacute;'), 'ü', '&#252;'), 'ö', '&#xF6;')"
)
_DAYS_HTML = ["Montag", "Mardi", "Miércoles", "Giovedì", "Friday", "Samedi", "Heute"]


def _rows_html(before: str, after: str) -> str:
    rows = []
    for i, day in enumerate(_DAYS_HTML):
        hours = "hours_text" if i % 2 == 0 else "hours_text_2"
        rows.append(f"{_text(before)} || '{day}' || {_text(after)} || {hours}")
    return rows


_TABLE_ROWS = " || '</td></tr>' || ".join(_rows_html('<tr class="y0skZc"><td>', "</td><td>"))
_DIV_ROWS = " || '</div>' || ".join(_rows_html('<div role="row">', ": "))

_BUSINESS_HTML = f"""
'<html><head><title>' || {_NAME_HTML} || '</title>'
|| CASE k % 5 WHEN 2 THEN '<meta name="geo.position" content="' || lat_text || ', ' || lng_text || '">'
   WHEN 3 THEN '<script>window.APP_INITIALIZATION_STATE=[[[3.5,' || lat_text || '37,' || lng_text || ']]]</script>'
   ELSE '' END
|| '<style>h1 </style></head><body><div role="main">'
|| CASE k % 5 WHEN 0 THEN '<h1 class="DUwDvf lfPIob">' || {_NAME_HTML} || '</h1>'
   WHEN 1 THEN '<H1 ID=t CLASS=fontHeadlineLarge><SPAN>' || {_NAME_HTML} || '</SPAN></H1>'
   WHEN 2 THEN '<h1>' || {_NAME_HTML} || '</h1>'
   WHEN 3 THEN '<h1 class="DUwDvf">Search</h1><h1 class="fontHeadlineLarge">' || {_NAME_HTML} || '</h1>'
   ELSE '<h1 class="DUwDvf">4.5</h1>' END
|| CASE k % 8 WHEN 4 THEN '<div class="F7nice"><div class="F7nice">·</div><span class="ceNzKf">' || rating_text || '</span></div>'
   ELSE '<div class="F7nice"><span>·'
        || CASE k % 4 WHEN 0 THEN '<span class="ceNzKf" aria-hidden="true">' || rating_text || '</span>' ELSE '' END
        || '</span></div>' END
|| CASE k % 4 WHEN 1 THEN '<div jsaction="pane.rating.moreReviews"><span>' || rating_text || '</span></div>'
   WHEN 2 THEN '<div role="img" aria-label="4 stars"></div><span>' || rating_text || '</span>' ELSE '' END
|| CASE k % 3 WHEN 0 THEN '<button aria-label="12 Reviews"><span class="MW4etd">' || reviews_text || '</span></button>'
   WHEN 1 THEN '<span class="MW4etd">' || reviews_text || '</span>' ELSE '' END
|| CASE k % 3 WHEN 0 THEN '<button class="DkEaL">' || category_text || '</button>'
   WHEN 1 THEN '<button jsaction="pane.category.open">' || category_text || '</button>' ELSE '' END
|| CASE k % 3 WHEN 0 THEN '<button data-item-id="address" aria-label="Address: x"><div class="Io6YTe">' || address || '</div></button>'
   WHEN 1 THEN '<div data-item-id="address"><div class="fontBodyMedium">' || address || '</div></div>' ELSE '' END
|| CASE k % 5 WHEN 0 THEN '<button data-item-id="phone:tel"><div><div class="Io6YTe">' || phone || '</div></div></button>'
   WHEN 1 THEN '<A HREF=tel:1>' || phone || '</A>'
   WHEN 2 THEN '<button aria-label="Anrufen">' || phone || '</button>'
   WHEN 3 THEN '<p>Tel. ' || phone || ' today</p>' ELSE '<p>no number</p>' END
|| CASE k % 4 WHEN 0 THEN '<a data-item-id="authority" href="' || replace(website_text, '&', '&amp;') || '">Website</a>'
   WHEN 1 THEN '<button data-item-id="authority" data-href="' || replace(website_text, '&', '&amp;') || '">Website</button>'
   WHEN 2 THEN '<a href="https://www.google.com/maps/x">g</a><a href="' || replace(website_text, '&', '&amp;') || '">site</a>'
   ELSE '' END
|| CASE WHEN k % 8 = 1 THEN '<a href="https://facebook.com/old">f</a><a href="https://instagram.com/i' || job_id
   || '">i</a><a href="https://facebook.com/p' || job_id || '">f</a>' ELSE '' END
|| CASE k % 6 WHEN 0 THEN '<div class="t39EBf"><div>Hours</div><div><table>' || {_TABLE_ROWS} || '</td></tr></table></div></div>'
   WHEN 1 THEN '<div data-item-id="oh"><div>Hours</div>' || {_DIV_ROWS} || '</div></div>' ELSE '' END
|| '</div><p>Footer</p></body></html>'
"""

# rank 1 is the business page but for one job in three, where it is a list of results
# or a page of no kind, and the business page is rank 2; one job in six has no capture
CAPTURES = f"""
SELECT k, job_id, batch_id, r AS rank,
       CASE k % 5 WHEN 0 THEN 'https://maps.example.org/place/p/@' || lat_text || ',' || lng_text || ',17z'
            WHEN 1 THEN 'https://maps.example.org/place/p/data=!3d' || lat_text || '!4d' || lng_text
            ELSE 'https://maps.example.org/place/p' END AS url,
       CASE WHEN k % 6 = 4 AND r = 1
            THEN '<html><body><div role="main"><h1>Ergebnisse für ' || {_NAME_HTML} || '</h1></div></body></html>'
            WHEN k % 6 = 3 AND r = 1 THEN '<html><body><p>Nothing</p></body></html>'
            ELSE business_html END AS html,
       name, address, city, postal_code, phone, rating_text, reviews_text, website_text,
       category_text, hours_text, hours_text_2, lat_text, lng_text
FROM (SELECT *, {{ranks}} AS r
      FROM (SELECT *, {_BUSINESS_HTML} AS business_html,
                   CASE WHEN name <> '' AND address <> '' AND city <> '' THEN 5
                        WHEN name <> '' AND city <> '' THEN 2
                        WHEN name <> '' AND address <> '' OR address <> '' AND city <> '' THEN 1
                        ELSE 0 END AS n_attempts
            FROM ({LISTINGS}) l0) l1) l2
WHERE r <= n_attempts AND k % 6 <> 5 AND (r = 1 OR k % 6 IN (3, 4))
"""

# batches 0-2 completed, 3-4 done with failures, 5-6 waiting, others under way; batch 7
# holds a third of all rows
_ORDER_BATCH = "CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey % 20 END"
JOBS = f"""
SELECT CAST(o_orderkey AS STRING) AS job_id, 'scrape-data' AS job_name,
       'b' || CAST(b AS STRING) AS batch_id, o_orderkey AS k, state,
       created AS created_at,
       CASE WHEN state IN ('active', 'completed', 'failed') AND NOT (b = 8 AND state <> 'active')
            THEN created + (1 + o_orderkey % 300) * INTERVAL '1' SECOND END AS processed_at,
       CASE WHEN state = 'active' AND o_orderkey % 2 = 0
            THEN CAST(CASE o_orderkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 90 END AS INT) END AS progress
FROM (SELECT *, CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 3600) * INTERVAL '1' SECOND AS created,
        CASE WHEN b IN (0, 1, 2) THEN 'completed'
             WHEN b IN (3, 4) THEN CASE WHEN o_orderkey % 4 = 1 THEN 'failed' ELSE 'completed' END
             WHEN b IN (5, 6) THEN 'waiting'
             WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'failed' ELSE 'completed' END
             WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderpriority = '5-LOW' THEN 'delayed' ELSE 'waiting' END
             ELSE CASE WHEN o_orderpriority = '2-HIGH' THEN 'active' ELSE 'completed' END END AS state
      FROM (SELECT *, {_ORDER_BATCH} AS b FROM {{orders}}) o0) o1
"""

# one completed job in ten ended in an error without a record, one in fifty has no result
JOB_RESULTS = """
SELECT CAST(o_orderkey AS STRING) AS job_id,
       CASE WHEN o_orderkey % 10 < 6 THEN 'success' WHEN o_orderkey % 10 = 6 THEN 'partial'
            WHEN o_orderkey % 10 < 9 THEN 'failed' END AS scraped_status,
       CAST(500 + (o_orderkey % 45) * 100 AS BIGINT) AS processing_ms,
       CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 3600 + o_orderkey % 300 + 9) * INTERVAL '1' SECOND AS processed_at,
       CASE WHEN o_orderkey % 10 = 9 THEN 'Navigation timeout ' || CAST(o_orderkey % 7 AS STRING) END AS error,
       'w' || CAST(o_orderkey % 6 AS STRING) AS worker
FROM {orders}
WHERE o_orderkey % 50 <> 13
"""

RUNS = """
SELECT CAST(o_orderkey AS STRING) AS job_id, 'b' || CAST(o_custkey % 20 AS STRING) AS batch_id,
       CASE WHEN o_orderkey % 10 < 8 THEN 'success' END AS scraped_status,
       CAST(o_orderdate AS TIMESTAMP) AS started_at,
       CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 4000) * INTERVAL '0.001' SECOND AS ended_at,
       CASE WHEN o_orderkey % 10 >= 8 THEN 'Browser closed' END AS error,
       'w' || CAST(o_orderkey % 6 AS STRING) AS worker
FROM {orders}
"""

# what each job was asked for and, where its run left a record, what came out of it
JOB_DATA = f"""
SELECT CAST(o_orderkey AS STRING) AS job_id, {_pick('o_orderkey', NAMES)} AS name,
       {_pick('o_custkey', ADDRESSES)} AS address, {_pick('o_orderkey + o_custkey', CITIES)} AS city,
       {_pick('o_orderkey', POSTAL_CODES)} AS postal_code,
       o_orderkey % 10 <> 9 AS has_record, {_pick('o_orderkey', NAMES)} || ' ' || {_pick('o_orderkey + o_custkey', CITIES)} AS full_name,
       {_pick('o_custkey', RATINGS)} AS rating, {_pick('o_custkey', REVIEWS)} AS reviews_count,
       {_pick('o_orderkey', WEBSITES)} AS website
FROM {{orders}}
"""

# the results of runs; one run in seven leaves none
EVENT_RESULTS = f"""
SELECT 'u' || CAST(user_id AS STRING) AS batch_id,
       'u' || CAST(user_id AS STRING) || '-' || CAST(event_id % 50 AS STRING) AS job_id,
       CAST(ts AS TIMESTAMP) AS result_ts, {_pick('event_id', NAMES)} AS name, {_pick('user_id', CITIES)} AS city,
       {_pick('event_id', NAMES)} || ' ' || {_pick('user_id', CITIES)} AS full_name, {_pick('event_id', RATINGS)} AS rating,
       CAST(500 + event_id % 45 * 100 AS BIGINT) AS processing_ms
FROM {{events}} WHERE event_id % 7 <> 3
"""

JOB_EVENTS = """
SELECT 'u' || CAST(user_id AS STRING) AS batch_id,
       'u' || CAST(user_id AS STRING) || '-' || CAST(event_id % 50 AS STRING) AS job_id,
       CASE WHEN user_id % 10 = 5 AND event_type <> 'error' THEN 'completed'
            WHEN user_id % 10 = 3 AND event_type IN ('purchase', 'error') THEN 'active'
            ELSE CASE event_type WHEN 'signup' THEN 'waiting' WHEN 'click' THEN 'active' WHEN 'view' THEN 'progress'
            WHEN 'purchase' THEN 'completed' ELSE 'failed' END END AS event,
       CAST(CASE WHEN event_type = 'view' THEN 10 + (event_id % 9) * 10 END AS INT) AS progress,
       CASE WHEN event_type = 'error' THEN 'code ' || CAST(event_id % 5 AS STRING) END AS failed_reason,
       CAST(ts AS TIMESTAMP) AS event_ts
FROM {events}
"""

_H = _pick("k", ["09:00 - 20:00", "Closed", "", "9 am", "Open 24 hours", "", "1221:00 - 5 pm", "10:00 - 12:00 pm"])
_WEEK = ",\n       ".join(
    f"CASE WHEN failed OR k % 2 = 1 THEN '' ELSE {_H} END AS \"{day} Hours\""
    for day in ("Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
)
EXPORT = f"""
SELECT job_id, CASE WHEN failed THEN '' ELSE name END AS "Name",
       CASE WHEN failed OR k % 4 = 0 OR k % 10 = 7 THEN '' ELSE rating_text END AS "Rating",
       CASE WHEN failed THEN '' ELSE reviews_text END AS "Reviews Count",
       CASE WHEN failed OR k % 3 = 0 OR k % 10 = 7 THEN '' ELSE phone END AS "Phone",
       CASE WHEN failed THEN '' ELSE address || CASE k % 6 WHEN 0 THEN ', Switzerland' WHEN 1 THEN ', Schweiz'
            WHEN 2 THEN ', Colombia' WHEN 3 THEN ', Spain' WHEN 4 THEN ', Germany' ELSE '' END END AS "Address",
       CASE WHEN failed OR k % 5 = 0 THEN '' ELSE website_text END AS "Website",
       CASE WHEN failed THEN '' ELSE category_text END AS "Category",
       CASE WHEN failed OR k % 7 = 0 THEN '' ELSE lat_text END AS "Latitude",
       CASE WHEN failed OR k % 7 = 0 THEN '' ELSE lng_text END AS "Longitude",
       CASE WHEN failed OR k % 10 = 7 THEN '' ELSE {_H} END AS "Monday Hours",
       CASE WHEN failed OR k % 2 = 0 THEN '' ELSE {_H} END AS "Tuesday Hours",
       {_WEEK},
       CASE WHEN failed THEN 'failed' WHEN k % 13 = 6 THEN 'partial' ELSE 'success' END AS "Status"
FROM (SELECT *, k % 9 = 2 AS failed FROM ({LISTINGS}) l0) l1
"""

VIEWS = {
    "listings": (LISTINGS, ["customer"]),
    "captures": (CAPTURES, ["customer"]),
    "jobs": (JOBS, ["orders"]),
    "job_results": (JOB_RESULTS, ["orders"]),
    "runs": (RUNS, ["orders"]),
    "job_data": (JOB_DATA, ["orders"]),
    "event_results": (EVENT_RESULTS, ["events"]),
    "job_events": (JOB_EVENTS, ["events"]),
    "export": (EXPORT, ["customer"]),
}
# views of which a row takes far longer to work on than to read
LONG_WORK = ["captures"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the Parquet tables in ``sf_dir``."""
    sql, tables = VIEWS[name]
    # double quotes enclose names in standard SQL and backticks do here
    sql = re.sub(r'AS "([^"]+)"', r"AS `\1`", sql)
    sql = sql.replace("{ranks}", "explode(array(1, 2))")
    read = {t: table(spark, sf_dir, t) for t in tables}
    if name in LONG_WORK:
        # before the pages are made, as these are many times as long
        read = {t: spread(rows) for t, rows in read.items()}
    return spark.sql(sql, **read)


def view_sql(name: str) -> str:
    """The view as a subquery over tables of the same names."""
    sql, tables = VIEWS[name]
    return f"({sql.format(ranks='unnest([1, 2])', **{t: t for t in tables})})"
