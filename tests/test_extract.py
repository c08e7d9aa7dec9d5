"""Selectors and extraction on literal pages."""

import pytest
from pyspark.sql import functions as F

from listingloom.functions import html as H
from listingloom.operators import extract as E
from listingloom.operators import places as P
from listingloom.plans.views import view

BUSINESS = """<html><head><title>Apple</title></head><body><div role="main">
<h1 class="DUwDvf lfPIob">Apple &amp; Co</h1>
<div class="F7nice"><span><span class="ceNzKf" aria-hidden="true">4,4</span></span>
<span class="MW4etd">(1.309)</span></div>
<button data-item-id="address"><div class="x"><div class="Io6YTe">Neue Str. 99, 8304 Wallisellen</div></div></button>
<button data-item-id="phone:tel"><div class="Io6YTe">044 832 81 00</div></button>
<a data-item-id="authority" href="https://www.apple.example/?a=1&amp;b=2">Website</a>
<button class="DkEaL">Electronics store</button>
<div class="t39EBf"><div>Hours</div><div><table>
<tr class="y0skZc"><td>Montag</td><td>9 AM–8 PM</td></tr>
<tr class="y0skZc"><td>Mardi :</td><td>Fermé</td></tr>
<tr class="y0skZc"><td>Mercoledì</td><td>9:00–12:00, 13:00–18:00</td></tr>
<tr class="y0skZc"><td>Jueves</td><td>Open 24 hours</td></tr>
<tr class="y0skZc"><td>Montag</td><td>10 AM–8 PM</td></tr>
<tr class="y0skZc"><td>Feiertag</td><td>zu</td></tr></table></div></div>
<a href="https://facebook.com/a">f</a><a href='https://www.instagram.com/i'>i</a><a href="https://facebook.com/b">f</a>
</div></body></html>"""
RESULTS = '<body><div role="main"><h1>Ergebnisse für Apple</h1></div><div class="F7nice">x</div></body>'


@pytest.fixture
def select(apply):
    return lambda page, css: apply(lambda h: H.first_text(h, css), [page])[0]


def test_selectors(select):
    assert select(BUSINESS, "h1.DUwDvf") == "Apple & Co"
    assert select(BUSINESS, "h1.lfPIob") == "Apple & Co"
    assert select(BUSINESS, "h1.DUwD") is None
    assert select(BUSINESS, ".F7nice .ceNzKf") == "4,4"
    assert select(BUSINESS, 'button[data-item-id="phone:tel"] .Io6YTe') == "044 832 81 00"
    # the phone's element is not inside the address button
    assert select(BUSINESS, 'button[data-item-id="address"] .DkEaL') is None
    page = '<div role="img" aria-label="4 stars"> </div> <span>4.1</span><p class="a b">x</p><p class="b">y</p>'
    assert select(page, 'div[role="img"][aria-label*="star"] + span') == "4.1"
    assert select(page, ".b:not(.a)") == "y"
    assert select("<a href='http://google.x'>g</a><a href='http://b'>b</a>", 'a[href^="http"]:not([href*="google"])') == "b"
    assert select('<h1>RESULTS for x</h1>', 'h1:has-text("Results for")') == "RESULTS for x"
    assert select("<h1>a</h1>", 'h1:not(:has-text("A"))') is None


def test_nested_elements_are_cut_at_their_own_close(select):
    page = '<div class="k"><div>1</div><div>2<div>3</div></div></div><div>4</div>'
    assert select(page, ".k") == "123"
    assert select("<p class='k'>one<p>two</p>", ".k") == "one"


def test_signs_in_attributes(apply):
    pages = [
        '<button class="k" aria-label="a > b > c" id="x">in</button>',
        "<button class='k' aria-label='a > b'>in</button>",
        '<a href="https://e.example/?q=YQ==">x</a><button class="k" data-q="x=">in</button>',
        '<p>1 &gt; 0</p><button class="k" title="">in</button>',
    ]
    assert apply(lambda h: H.first_text(H.readable(h), ".k"), pages) == ["in"] * 4
    label = apply(lambda h: H.element_attribute(H.from_element(H.readable(h), ".k"), "aria-label"), pages[:2])
    assert label == ["a > b > c", "a > b"]
    assert apply(H.readable, pages[2:]) == pages[2:]


def test_ancestors_reach_to_their_own_close(select):
    pages = [
        ('<div class="F7nice"><div>x</div><span class="ceNzKf">4.5</span></div>', ".F7nice .ceNzKf", "4.5"),
        ('<div data-item-id="address"><div class="icon"></div><div class="body">Neugasse 5</div></div>', '[data-item-id="address"] .body', "Neugasse 5"),
        ('<div role="img"><div>*</div></div> <span>4.5</span>', 'div[role="img"] + span', "4.5"),
        ('<div class="a"><i>no</i></div><div class="a"><div></div><b>yes</b></div><b>out</b>', ".a b", "yes"),
        ('<div class="a"></div><b>out</b>', ".a b", None),
        ('<b aria-label="FAQ">q</b>', 'b[aria-label*="FAQ"]', "q"),
    ]
    for page, css, want in pages:
        assert select(page, css) == want, css


def test_markup_as_others_write_it(select):
    pages = [
        ('<div class="F7nice"><div class="F7nice">a</div><span class="ceNzKf">4.5</span></div>', ".F7nice .ceNzKf", "4.5"),
        ("<DIV CLASS=F7nice><SPAN Class='x ceNzKf'>4.5</SPAN></DIV>", ".F7nice span.ceNzKf", "4.5"),
        ("<button data-item-id=address aria-label='a'>Caf&eacute; M&#252;ller &#xE4; &bogus; &#0;</button>", '[data-item-id="address"]', "Café Müller ä &bogus; \ufffd"),
        ('<p class="k">&amp;eacute; &#128512;</p>', ".k", "&eacute; \U0001f600"),
        ('<b title="x class=\'k\'">no</b><b class="k">yes</b>', ".k", "yes"),
        ('<img class="k" src=x><b class="k">t</b>', "b.k", "t"),
        ('<ul><li>a<ul><li class="k">b</li></ul></li></ul><li class="k">d</li>', "li.k", "b"),
        ('<div class="o"><div><b>in</b></div></div>', ".o > b", None),
        ('<div class="o"><b>in</b></div>', ".o > b", "in"),
        ('<div class="a"><div class="b"><div class="c">x</div></div></div>', ".a .b .c", "x"),
        ("<p>1 < 2 <b class='k'>a<!-- <i> -->b</b>", ".k", "ab"),
        ('<b class="k" x="' + "y=" * 20_000 + '">long</b>', ".k", "long"),
        ("", ".k", None),
    ]
    for page, css, want in pages:
        assert select(page, css) == want, (page[:80], css)


def test_ranges_of_elements(apply):
    """Elements lie inside each other as a stack of open tags says."""
    page = "<div><p>a<p>b<br><span>c</div><i>d"
    def shown(h):
        elements = H.tokens(h)["elements"]
        return F.array_join(F.transform(elements, lambda e: F.concat_ws(":", e["name"], e["open"], e["close"], e["after"])), " ")

    assert apply(shown, [page]) == ["div:0:5:6 p:1:2:2 br:3:3:4"]


def classes(spark, *pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i INT, html STRING")
    return [r.page_class for r in E.classify_pages(df).orderBy("i").collect()]


def test_page_class(spark):
    pages = [
        BUSINESS, RESULTS, "<body><p>x</p></body>", '<h1 class="DUwDvf">Results near you</h1>',
        '<div aria-label="results list">Results</div><h1 class="DUwDvf">Apple</h1>',
    ]
    assert classes(spark, *pages) == ["business_page", "results_page", "unknown", "unknown", "results_page"]


def test_scripts_and_comments_hold_no_elements(spark):
    page = '<script>"<h1 class=\'DUwDvf\'>x</h1>"</script><!-- <b class="F7nice">y</b> --><p>z</p>'
    assert classes(spark, page) == ["unknown"]


def extracted(spark, html, url="https://m/"):
    df = spark.createDataFrame([(1, url, html)], "id INT, url STRING, html STRING")
    return E.extract_fields(df).first()


def test_extract_business_page(spark):
    r = extracted(spark, BUSINESS, "https://m/place/@47.3765896,8.5389306,17z")
    assert r.found_name == "Apple & Co" and r.rating == "4.4" and r.reviews_count == "1309"
    assert r.full_address == "Neue Str. 99, 8304 Wallisellen" and r.category == "Electronics store"
    assert r.website == "https://www.apple.example/?a=1&b=2" and r.found_phone == "044 832 81 00"
    assert r.coordinates == ("47.3765896", "8.5389306")
    assert r.social_media == {"facebook": "https://facebook.com/b", "instagram": "https://www.instagram.com/i"}
    assert r.opening_hours == {
        "Monday": "10:00 - 20:00", "Tuesday": "Closed",
        "Wednesday": "9:00 - 12:00 & 13:00 - 18:00", "Thursday": "Open 24 hours",
    }


def test_coordinates(spark):
    geo = '<meta name="geo.position" content="46.5197 , 6.6320">'
    state = "<script>window.APP_INITIALIZATION_STATE=[[[1.5,8.596051,47.413309]]]</script>"
    assert extracted(spark, geo, "x!3d-10.5!4d8.250").coordinates == ("-10.5", "8.25")
    assert extracted(spark, geo).coordinates == ("46.5197", "6.632")
    assert extracted(spark, geo + state).coordinates == ("8.596051", "47.413309")
    assert extracted(spark, "<p>47.413309,8.596051</p>").coordinates == ("", "")
    shared = spark.createDataFrame([("u", "<p>", "g/@1.5,2.5,3z")], "url STRING, html STRING, s STRING")
    assert E.extract_fields(shared, "s").first().coordinates == ("1.5", "2.5")


def test_page_data_ends_with_its_script(spark):
    page = (
        "<script>APP_INITIALIZATION_STATE=[1]</script><script>x=[11.123456,22.123456]</script>"
        '<meta property="geo" content="47.5,8.5">'
    )
    row = spark.range(1).select(E.coordinates_of(F.lit("https://m/"), F.lit(page)).alias("c")).first().c
    assert (row.latitude, row.longitude) == ("47.5", "8.5")


def test_phone_from_page_text_only_as_fallback(spark):
    assert extracted(spark, "<p>Tel. +41 44 123 45 67</p>").found_phone == "+41 44 123 45 67"
    page = '<a href="tel:1">4.5(12)</a><script>+41 11 111 11 11</script><p>044 123 45 67</p>'
    assert extracted(spark, page).found_phone == "044 123 45 67"


def test_lazy_and_long_table_agree(spark):
    pages = spark.createDataFrame([(1, BUSINESS), (2, RESULTS)], "id INT, html STRING")
    long = E.first_valid(E.extract_candidates(pages, ["id"]), ["id"], wide=True)
    row = long.where("id = 1").first()
    wide = extracted(spark, BUSINESS)
    assert (row.name, row.address, row.rating, row.reviews, row.category) == (
        wide.found_name, wide.full_address, wide.rating, wide.reviews_count, wide.category,
    )


def test_enrich_keeps_every_job(spark):
    jobs = spark.createDataFrame(
        [("1", "b", "Apple", "Str 1", "Zurich", ""), ("2", "b", "Gone", "", "Bern", ""), ("3", "b", "", "", "", "")],
        "job_id STRING, batch_id STRING, name STRING, address STRING, city STRING, postal_code STRING",
    )
    captures = spark.createDataFrame(
        [("1", 1, "u", RESULTS), ("1", 2, "u", BUSINESS), ("1", 3, "u", BUSINESS.replace("Apple &", "Late &")), ("2", 1, "u", RESULTS)],
        "job_id STRING, rank INT, url STRING, html STRING",
    )
    rows = {r.job_id: r for r in P.enrich(jobs, captures).collect()}
    assert len(rows) == 3
    assert rows["1"].fullName == "Apple & Co" and rows["1"].phone == "+41 44 832 81 00" and rows["1"].status == "success"
    assert rows["2"].status == "failed" and rows["2"].error == P.NOT_FOUND and rows["2"].fullName == ""
    export = {r.job_id: r for r in P.export17(P.enrich(jobs, captures), ["job_id"]).collect()}
    assert export["1"]["Monday Hours"] == "10:00 - 20:00" and export["1"]["Wednesday Hours"] == "09:00 - 12:00"
    assert set(export["2"].asDict().values()) == {"2", "", "failed"}


def test_result_list_guard(spark):
    jobs = spark.createDataFrame([("1", "b", "", "a", "c", "")], "job_id STRING, batch_id STRING, name STRING, address STRING, city STRING, postal_code STRING")
    rows = P.empty_results(jobs, "", F.lit(None).cast("timestamp")).withColumn("fullName", F.lit("Résultats x"))
    r = P.guard_result_list(rows.withColumn("website", F.lit("w"))).first()
    assert (r.fullName, r.status, r.error, r.website) == (P.NAMELESS_RESULT_LIST, "failed", P.ON_RESULT_LIST, "")


def test_pages_are_cut_once_under_a_filter(spark):
    """A filter on the record is not moved to where the page would be cut again."""
    rows = [("1", 1, "u", '<h1 class="DUwDvf">Joe</h1>'), ("2", 1, "u", "<p>none</p>"), ("3", 1, "u", None)]
    captures = spark.createDataFrame(rows, "job_id STRING, rank INT, url STRING, html STRING")
    found = E.business_records(captures).where("record IS NOT NULL")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the tags of a page are cut out in one place of the plan
    assert plan.count("regexp_extract_all(lambda h#") == 1
    assert [r["job_id"] for r in found.select("job_id").collect()] == ["1"]
    assert E.with_tokens(captures).count() == 3


def test_captures_are_dealt_out(spark, tmp_path):
    """Rows that one task could scan are worked on by as many tasks as a shuffle has."""
    customers = spark.createDataFrame([(k, k % 25) for k in range(80)], "c_custkey LONG, c_nationkey INT")
    customers.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    captures = view(spark, str(tmp_path), "captures")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert captures.rdd.getNumPartitions() == tasks
    per_task = captures.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == tasks
