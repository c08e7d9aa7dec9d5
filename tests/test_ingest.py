"""Files in four encodings, headers, batches and sinks."""

import csv
import io
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from listingloom.operators.dims import field_terms
from listingloom.operators.quality import combined_terms
from listingloom.sources import captures, sinks
from listingloom.sources import listings as L

EUROPEAN = (
    "name,address,city,postcode\nBäckerei Müller,Hauptstraße 25,München,80331\n"
    "Café Zürich,Bürgerstraße 10,Zürich,8001\n"
    "Hälsokost Åkersberga,Kungsgatan 5,Göteborg,411 19\nRestaurant Røros,Storgata 15,Oslo,0150"
)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbf" + EUROPEAN.encode())
    (tmp_path / "plain.csv").write_text("name,city\nSüpermarket,München\nCafé,Zürich", encoding="utf-8")
    (tmp_path / "latin.CSV").write_bytes(EUROPEAN.encode("latin-1"))
    (tmp_path / "win.csv").write_bytes(' City ,NAME\n"a, ""b""\nc",5 €\n\n,x,more'.encode("cp1252"))
    (tmp_path / "seven.csv").write_text("name\n" + "".join(f"n{i}\n" for i in range(1, 8)))
    (tmp_path / "notes.txt").write_text("name\nno\n")
    return str(tmp_path)


def file_name(column):
    return F.element_at(F.split(column, "/"), -1)


def test_census(spark, folder):
    rows = L.profile_files(spark, folder).withColumn("f", file_name("path")).collect()
    assert {r.f: (r.bom, r.encoding) for r in rows} == {
        "bom.csv": (True, "utf-8"), "plain.csv": (False, "utf-8"), "latin.CSV": (False, "iso-8859-1"),
        "win.csv": (False, "windows-1252"), "seven.csv": (False, "utf-8"),
    }
    assert {r.f: r.first_bytes for r in rows}["bom.csv"] == "efbbbf6e616d652c6164"


def test_read_listings(spark, folder):
    df = L.read_listings(spark, folder).withColumn("f", file_name("source_file"))
    rows = {(r.f, r.row_no): r for r in df.collect()}
    assert len(rows) == 4 + 2 + 4 + 2 + 7
    for f in ("bom.csv", "latin.CSV"):
        r = rows[f, 3]
        assert (r.name, r.city, r.postal_code, r.extra) == ("Hälsokost Åkersberga", "Göteborg", "", {"postcode": "411 19"})
    assert (rows["win.csv", 1].city, rows["win.csv", 1].name) == ('a, "b"\nc', "5 €")
    assert (rows["win.csv", 2].name, rows["win.csv", 2].extra) == ("x", {"_2": "more"})
    assert [rows["seven.csv", i].name for i in range(1, 8)] == [f"n{i}" for i in range(1, 8)]


def test_header_alias(spark, folder):
    df = L.read_listings(spark, folder, aliases=L.HEADER_ALIASES)
    assert df.where("name = 'Café Zürich'").select("postal_code").distinct().collect()[0][0] == "8001"


def test_rows_of_split_files_keep_their_order(spark, tmp_path):
    (tmp_path / "big.csv").write_text("name,city\n" + "".join(f"k{i},c\n" for i in range(1, 3001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = L.read_listings(spark, str(tmp_path), multi_line=False)
        assert df.where("name <> concat('k', row_no)").count() == 0 and df.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_what_a_line_does_to_quotes(apply):
    """Each line's effect against a reader that goes over its characters."""

    def after(line, inside):
        cell = "quoted" if inside else "start"
        i = 0
        while i < len(line):
            c = line[i]
            if cell == "quoted" and c == '"':
                if line[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    cell = "bare"
            elif cell != "quoted" and c == ",":
                cell = "start"
            elif cell == "start":
                cell = "quoted" if c == '"' else "bare"
            i += 1
        return cell == "quoted"

    rng = random.Random(3)
    lines = ["".join(rng.choice('a,""') for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    lines += ['5" pipe,x', 'a "b",c', "x" * 50_000 + '"', '"' + '""' * 50_000]
    names = {(True, True): "1", (False, False): "0", (True, False): "-1", (False, True): None}
    got = apply(lambda line: L._effect(line).cast("string"), lines)
    want = [names[after(t, False), after(t, True)] for t in lines]
    # without quotes nothing changes, whichever way a bare cell would end
    assert [(g, t) for g, t in zip(got, lines)] == [(w, t) for w, t in zip(want, lines)]


def quoted_file(n):
    rng = random.Random(4)
    cells = ["plain", 'a "b"', "two\nlines", 'x,\n\n"y"\n,z', "5\" pipe", "", "é" * 9]
    rows = [(f"k{i}", rng.choice(cells)) for i in range(n)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([("name", "address"), *rows])
    return rows, out.getvalue()


@pytest.mark.parametrize("size", ["400", "2777", "100000000"])
def test_quoted_breaks_in_split_files(spark, tmp_path, size):
    """Wherever a file is cut, its rows are those of one read."""
    rows, text = quoted_file(800)
    (tmp_path / "one.csv").write_bytes(text.encode())
    (tmp_path / "two.csv").write_bytes(b"name,city\n\na,b\n  \nc,d")
    (tmp_path / "three.csv").write_bytes(text.replace("\n", "\r\n").encode("latin-1"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = L.stored_lines(L.file_lines(spark.read, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    if size != "100000000":
        assert lines.where("source_file LIKE '%one.csv'").select("block").distinct().count() > 4
    found = L.listings_of(lines).collect()
    for name in ("one", "three"):
        got = {r.row_no: (r.name, r.address) for r in found if r.source_file.endswith(f"{name}.csv")}
        assert got == dict(enumerate(rows, 1))
    two = [(r.row_no, r.name, r.city) for r in found if r.source_file.endswith("two.csv")]
    assert sorted(two) == [(1, "a", "b"), (2, "c", "d")]


def test_reading_twice_with_other_splits_makes_the_same_rows(spark, tmp_path):
    lines = [f"k{i},c\n" + "\n" * (i % 97 == 0) for i in range(1, 2001)]
    (tmp_path / "big.csv").write_text("name,city\n" + "".join(lines))
    made = []
    for size in ("1500", "9000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            df = L.read_listings(spark, str(tmp_path))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        made.append(sorted((r.row_no, r.name) for r in df.collect()))
    assert made[0] == made[1] == [(i, f"k{i}") for i in range(1, 2001)]


def test_empty_files(spark, tmp_path):
    (tmp_path / "none.csv").write_bytes(b"")
    (tmp_path / "head.csv").write_bytes(b"\xef\xbb\xbfname")
    assert L.read_listings(spark, str(tmp_path)).collect() == []
    rows = L.profile_files(spark, str(tmp_path)).collect()
    assert [(r.path[-8:], r.bytes, r.bom, r.encoding, r.first_bytes) for r in rows] == [
        ("head.csv", 7, True, "utf-8", "efbbbf6e616d65")
    ]


def test_other_encodings_are_refused(spark, folder):
    with pytest.raises(ValueError):
        L.read_listings(spark, folder, encoding="utf-16")
    assert L.read_listings(spark, folder, encoding="latin-1").where("name = 'BÃ¤ckerei MÃ¼ller'").count() == 1


def test_one_job_per_row_and_the_same_ids_again(spark, folder):
    made = [
        {r.job_id for r in L.create_batch(L.read_listings(spark, folder), F.current_timestamp()).collect()}
        for _ in range(2)
    ]
    assert made[0] == made[1] and len(made[0]) == 19
    jobs = L.create_batch(L.read_listings(spark, folder), F.current_timestamp())
    replies = L.upload_replies(jobs, L.profile_files(spark, folder)).collect()
    assert sorted(r.jobs_created for r in replies) == [2, 2, 4, 4, 7]
    assert sum(r.bom_removed for r in replies) == 1


def test_export_file(spark, tmp_path):
    df = spark.createDataFrame([('Café "Z", x', ""), ("b", "success")], "Name STRING, Status STRING")
    path = str(tmp_path / sinks.export_name(datetime(2025, 1, 2, 3, 4, 5)))
    assert path.endswith("scraping-results-2025-01-02T03-04-05.csv")
    sinks.write_export(df.coalesce(1), path)
    part = next((tmp_path / path).glob("part-*.csv")).read_bytes()
    assert part.startswith("﻿Name,Status\n".encode()) and 'Café ""Z"", x'.encode() in part


def test_documents_and_jobs_by_batch(spark, tmp_path):
    df = spark.createDataFrame([("b1", "j1"), ("b2", "j2")], "batch_id STRING, job_id STRING")
    sinks.write_batch_documents(df, str(tmp_path / "docs"))
    sinks.write_jobs(df, str(tmp_path / "jobs"))
    assert spark.read.parquet(str(tmp_path / "jobs")).where("batch_id = 'b2'").select("job_id").collect() == [("j2",)]
    assert spark.read.json(str(tmp_path / "docs")).count() == 2


def test_capture_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h1>é</h1>", encoding="utf-8")
    (tmp_path / "b.txt").write_text("x")
    rows = captures.load_capture_files(spark, str(tmp_path)).collect()
    assert [r.html for r in rows] == ["<h1>é</h1>"]


def test_combined_terms_of_the_dictionary(spark):
    rows = combined_terms(field_terms(spark)).orderBy("field", "lang_no", "pos").collect()
    found = {}
    for r in rows:
        found.setdefault(r.field, []).append(r.term)
    assert found["rating"] == ["bewertung", "sterne", "rating", "betyg", "stjärnor", "vurdering", "stjerner", "bedømmelse"]
    assert found["phone"] == ["telefon", "phone"] and len(found) == 7


@pytest.mark.parametrize("options", [{}, {"encoding": "utf-8"}, {"encoding": "utf-8", "multi_line": False}])
def test_rows_keep_all_their_cells(spark, tmp_path, options):
    names = ["name", *(f"c{i}" for i in range(80))]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + ",".join(f"v{i}" for i in range(81)) + "\n")
    row = L.read_listings(spark, str(tmp_path), **options).first()
    assert row.name == "v0" and len(row.extra) == 80 and row.extra["c79"] == "v80"


def test_rows_of_several_lines_keep_all_their_cells(spark, tmp_path):
    (tmp_path / "lines.csv").write_text('name\nx,"a\nb","c\nd","e\nf"\n')
    row = L.read_listings(spark, str(tmp_path)).first()
    assert row.name == "x" and dict(row.extra) == {"_1": "a\nb", "_2": "c\nd", "_3": "e\nf"}
