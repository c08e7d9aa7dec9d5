"""Folders of listing CSVs in mixed encodings, read into rows and batches.

Files are read once, as lines of bytes, by as many tasks as they have splits. The lines are
written down with an id each; all that follows comes from them. Every character that CSV
and its line breaks are made of is one byte in the supported encodings, and a line break is
no part of another character, so a file is valid UTF-8 if its lines are, and bytes are
decoded cell by cell at the end.

A quoted value may hold line breaks, also where a file is split. What a line does to a
reader is one of four things: it leaves it inside or outside of quotes as it was, swaps the
two, or ends inside or outside whatever was before. The four can be chained in any
grouping: first over the lines of a block, then over the blocks of a file, which gives
every block the state it begins in. Files without such a line need none of this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from listingloom.session import prepare_session, stored
from listingloom.sources.sinks import write_jobs

# The columns a listing has; other headers go to a map.
LISTING_COLUMNS = ["name", "address", "city", "postal_code"]
# Other spellings of the postal code header, taken only on request.
HEADER_ALIASES = {"postcode": "postal_code"}
# The job name, and the reply to an upload.
JOB_NAME = "scrape-data"
UPLOAD_MESSAGE = "CSV processed successfully, jobs added to queue"
# the byte order mark of UTF-8, as the three characters its bytes are in latin-1
_BOM = "ï»¿"
CSV_FILES = "*.[cC][sS][vV]"
# A line, and its bytes as characters of the same numbers.
LINES = "source_file STRING, file_bytes LONG, block LONG, line STRING"

# A complete cell at the beginning of a line or behind a comma, and an opened one.
_CELL = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^,"][^,]*+|)'
_OPENED = r'"(?:[^"]++|"")*+'


def file_lines(reader, path: str | list[str]) -> DataFrame:
    """Lines of the files whose name ends in ``.csv``, in any case: of a table with
    ``spark.read``, of a stream with ``spark.readStream``."""
    text = reader.format("text").option("lineSep", "\n").option("pathGlobFilter", CSV_FILES)
    return text.option("recursiveFileLookup", True).load(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_size").alias("file_bytes"),
        F.col("_metadata.file_block_start").alias("block"),
        F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line"),
    )


def _effect(line: Column) -> Column:
    """What a line does to being inside quotes: null leaves it, -1 swaps it, 1 and 0 set it."""
    opens = line.rlike(rf"^(?:{_CELL},)*+{_OPENED}$")
    closes_and_opens = line.rlike(rf'^(?:[^"]++|"")*+"[^,]*+(?:,{_CELL}(?=,))*+,{_OPENED}$')
    stays = line.rlike(r'^(?:[^"]++|"")*+$')
    inside = stays | closes_and_opens
    effect = (
        F.when(opens & inside, 1).when(~opens & ~inside, 0).when(opens & ~inside, -1)
    )
    return F.when(line.contains('"'), effect)


def stored_lines(lines: DataFrame, quoted_breaks: bool = True) -> DataFrame:
    """Lines with their id, written once, so that ids stay what they are.

    Ids rise in a block of a file. Returns and line feeds are gone from the ends of lines.
    """
    line = F.regexp_replace("line", "\r$", "")
    kept = lines.select(
        "source_file", "file_bytes", "block", line.alias("line"),
        (F.octet_length(F.encode("line", "ISO-8859-1")) + 1).alias("line_bytes"),
    )
    as_bytes = F.encode("line", "ISO-8859-1")
    effect = _effect(F.col("line")) if quoted_breaks else F.lit(None).cast("int")
    return stored(
        kept.select(
            "*",
            F.monotonically_increasing_id().alias("id"),
            effect.alias("effect"),
            (F.trim("line") == "").alias("blank"),
            F.is_valid_utf8(as_bytes.cast("string")).alias("utf8"),
            F.col("line").rlike("[\\x80-\\x9f]").alias("controls"),
        ),
        "csv-lines",
    )


def _chained(effect: str, inside: Window) -> tuple[Column, Column]:
    """The effect of all rows of a window up to the current one, as ``(set, swapped)``:
    the state it sets, null if it sets none, and whether it swaps that state or the one
    before the window."""
    swaps = F.sum(F.when(F.col(effect) == -1, 1).otherwise(0)).over(inside)
    setting = F.when(F.col(effect) >= 0, F.struct(F.col(effect).alias("to"), swaps.alias("at")))
    last = F.last(setting, ignorenulls=True).over(inside)
    swapped = (swaps - F.coalesce(last["at"], F.lit(0))) % 2 == 1
    return last["to"], swapped


def _after(start: Column, to: Column, swapped: Column) -> Column:
    """Whether a reader is inside quotes after a chain of lines."""
    state = F.coalesce(to == 1, start)
    return F.when(swapped, ~state).otherwise(state)


_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def file_profiles(lines: DataFrame) -> DataFrame:
    """Per file of some stored lines: size, first bytes, BOM, encoding, and whether a
    quoted value may hold line breaks."""
    per_file = lines.groupBy("source_file").agg(
        F.max("file_bytes").alias("bytes"),
        F.sum("line_bytes").alias("_read"),
        F.min("utf8").alias("_utf8"),
        F.max("controls").alias("_controls"),
        F.max(F.coalesce(F.col("effect").isin(1, -1), F.lit(False))).alias("quoted_breaks"),
        F.min(F.when(F.col("block") == 0, F.col("id"))).alias("_first"),
    )
    heads = (
        lines.where("block = 0")
        .join(per_file.select("source_file", "_first"), "source_file")
        .where(F.col("id") < F.col("_first") + 10)  # ten lines have ten bytes
        .groupBy("source_file")
        .agg(F.sort_array(F.collect_list(F.struct("id", "line"))).alias("_head"))
    )
    # the reader of lines leaves the mark out; what is missing of the file's size is it
    bom = F.col("bytes") - F.col("_read") >= 2
    head = F.array_join(F.transform("_head", lambda h: F.substring(h["line"], 1, 10)), "\n")
    # the file's end may stand without a line feed
    size = F.least(F.lit(10), F.col("bytes")).cast("int")
    head = F.substr(F.concat(F.when(bom, _BOM).otherwise(""), head, F.lit("\n")), F.lit(1), size)
    encoding = (
        F.when(F.col("_utf8"), "utf-8").when(F.col("_controls"), "windows-1252").otherwise("iso-8859-1")
    )
    return per_file.join(heads, "source_file", "left").select(
        "source_file",
        "bytes",
        F.lower(F.hex(F.encode(head, "ISO-8859-1"))).alias("first_bytes"),
        bom.alias("bom"),
        encoding.alias("encoding"),
        "quoted_breaks",
    )


def profile_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Encoding census: one row per file with size, first bytes, BOM flag and encoding.

    utf-8 if the bytes are valid UTF-8; else windows-1252 if a byte from 0x80 to 0x9F
    occurs, which latin-1 leaves to control characters; else iso-8859-1. Spark reads no
    empty files, so they have no row.
    """
    found = file_profiles(stored_lines(file_lines(prepare_session(spark).read, path)))
    return found.select(F.col("source_file").alias("path"), *found.columns[1:-1])


def _plain_records(lines: DataFrame) -> DataFrame:
    """Records of files whose every line is one: a line's number follows from the first id
    of its block and the length of the blocks before, without a sort.

    Only blocks with blank lines, which are no records, are numbered by sorting them.
    """
    blocks = lines.groupBy("source_file", "block").agg(
        F.min("id").alias("_first"),
        F.count_if(~F.col("blank")).alias("_records"),
        F.max("blank").alias("_blanks"),
    )
    in_file = Window.partitionBy("source_file").orderBy("block")
    blocks = blocks.withColumn(
        "_earlier", F.coalesce(F.sum("_records").over(in_file.rowsBetween(*_BEFORE)), F.lit(0))
    ).drop("_records")
    placed = lines.join(blocks, ["source_file", "block"]).where("NOT blank")
    in_block = Window.partitionBy("source_file", "block").orderBy("id")
    straight = placed.where("NOT _blanks").withColumn("record", F.col("id") - F.col("_first"))
    counted = placed.where("_blanks").withColumn("record", F.row_number().over(in_block) - 1)
    return straight.unionByName(counted).select(
        "source_file", (F.col("record") + F.col("_earlier")).alias("record"), "line"
    )


def _quoted_records(lines: DataFrame) -> DataFrame:
    """Records of files in which some go over several lines, also from block to block."""
    in_block = Window.partitionBy("source_file", "block").orderBy("id")
    before = in_block.rowsBetween(*_BEFORE)
    to, swapped = _chained("effect", before)
    running = lines.withColumns({"_to": to, "_swapped": F.coalesce(swapped, F.lit(False))})
    # whether a record begins here, if the block begins outside or inside quotes
    for name, start in (("_from_out", False), ("_from_in", True)):
        begins = ~_after(F.lit(start), F.col("_to"), F.col("_swapped")) & ~F.col("blank")
        running = running.withColumn(
            name, F.sum(begins.cast("long")).over(in_block.rowsBetween(*_UP_TO_HERE))
        )
    running = stored(running, "running-quotes")
    last = F.struct("_to", "_swapped", "effect", "_from_out", "_from_in")
    blocks = running.groupBy("source_file", "block").agg(F.max_by(last, "id").alias("_end"))
    # a block's own effect: its last line's on top of that of the lines before it
    ended = F.col("_end")
    out, inside = (_after(F.lit(s), ended["_to"], ended["_swapped"]) for s in (False, True))

    def through(state: Column) -> Column:
        return F.when(ended["effect"] == -1, ~state).otherwise(F.coalesce(ended["effect"] == 1, state))

    out, inside = through(out), through(inside)
    effect = F.when(out & inside, 1).when(~out & ~inside, 0).when(out & ~inside, -1)
    blocks = blocks.select("source_file", "block", "_end", effect.cast("int").alias("_effect"))
    in_file = Window.partitionBy("source_file").orderBy("block")
    to, swapped = _chained("_effect", in_file.rowsBetween(*_BEFORE))
    blocks = blocks.withColumn("_inside", _after(F.lit(False), to, F.coalesce(swapped, F.lit(False))))
    records = F.when(F.col("_inside"), F.col("_end._from_in")).otherwise(F.col("_end._from_out"))
    earlier = F.coalesce(F.sum(records).over(in_file.rowsBetween(*_BEFORE)), F.lit(0))
    blocks = blocks.select("source_file", "block", "_inside", earlier.alias("_earlier"))
    begun = F.when(F.col("_inside"), F.col("_from_in")).otherwise(F.col("_from_out"))
    begins_inside = _after(F.col("_inside"), F.col("_to"), F.col("_swapped"))
    parts = (
        running.join(blocks, ["source_file", "block"])
        .where(begins_inside | ~F.col("blank"))
        .select("source_file", (F.col("_earlier") + begun - 1).alias("record"), "block", "id", "line")
    )
    # the lines of one record
    lines_of = F.sort_array(F.collect_list(F.struct("block", "id", "line")))
    text = F.array_join(F.transform("_lines", lambda part: part["line"]), "\n")
    records = parts.groupBy("source_file", "record").agg(lines_of.alias("_lines"))
    return records.select("source_file", "record", text.alias("line"))


def _split_cells(records: DataFrame, encoding: Column) -> DataFrame:
    """Records with ``_cells``, decoded."""
    line = F.col("line")
    commas = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))
    width = (records.agg(F.max(commas)).first()[0] or 0) + 1
    names = [f"_c{i}" for i in range(width)]
    options = {"escape": '"', "maxColumns": str(max(width, 20480)), "maxCharsPerColumn": "-1", "multiLine": "true"}
    parsed = F.from_csv("line", ", ".join(f"{n} STRING" for n in names), options)

    def decoded(cell: Column) -> Column:
        raw = F.encode(cell, "ISO-8859-1")
        return (
            F.when(encoding == "utf-8", F.decode(raw, "UTF-8"))
            .when(encoding == "windows-1252", F.decode(raw, "windows-1252"))
            .otherwise(cell)
        )

    count = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit(""))) + 1
    cells = F.transform(
        F.slice(F.array(*(F.col(f"_csv.{n}") for n in names)), F.lit(1), count),
        lambda cell: F.coalesce(decoded(cell), F.lit("")),
    )
    return records.withColumn("_csv", parsed).withColumn("_cells", cells).drop("_csv", "line")


def listings_of(
    lines: DataFrame, encoding: str | None = None, aliases: dict[str, str] | None = None
) -> DataFrame:
    """Listing rows of stored lines of any number of files."""
    files = file_profiles(lines).select("source_file", "quoted_breaks", F.col("encoding").alias("_encoding"))
    known = lines.join(files, "source_file")
    records = _plain_records(known.where("NOT quoted_breaks")).unionByName(
        _quoted_records(known.where("quoted_breaks"))
    )
    records = stored(records, "csv-records")
    if encoding:
        # Names of the encodings that are told apart.
        name = {"utf8": "utf-8", "latin-1": "iso-8859-1", "cp1252": "windows-1252"}.get(encoding.lower(), encoding.lower())
        if name not in ("utf-8", "iso-8859-1", "windows-1252"):
            raise ValueError(f"lines are read as utf-8, iso-8859-1 or windows-1252, not as {encoding}")
        records = records.withColumn("_encoding", F.lit(name))
    else:
        records = records.join(files.select("source_file", "_encoding"), "source_file")
    split = _split_cells(records, F.col("_encoding"))
    headers = split.where("record = 0").select("source_file", F.col("_cells").alias("_header"))
    rows = split.where("record > 0").join(headers, "source_file")
    return _to_listings(rows.withColumnRenamed("record", "row_no"), aliases or {})


def read_listings(
    spark: SparkSession,
    path: str | list[str],
    encoding: str | None = None,
    aliases: dict[str, str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Listing rows of all CSV files under ``path``.

    Every file keeps its own header, trimmed and lower-cased; headers other than the
    listing columns go to ``extra``, and so do cells without a header, as ``_4`` for
    the fifth. Every file is decoded by its own encoding; a given ``encoding`` holds for
    all. Files are read by their splits, also where quoted values hold line breaks;
    ``multi_line=False`` takes every line as a row whatever its quotes. Blank lines are no
    rows. Rows keep all their cells, however many.
    """
    lines = stored_lines(file_lines(prepare_session(spark).read, path), multi_line)
    return listings_of(lines, encoding, aliases)


def _to_listings(rows: DataFrame, aliases: dict[str, str]) -> DataFrame:
    names = F.transform(
        F.col("_header"), lambda h: F.lower(F.trim(F.regexp_replace(h, "^\ufeff", "")))
    )
    for other, standard in aliases.items():
        names = F.transform(names, lambda n: F.when(n == other, standard).otherwise(n))
    named = F.transform(
        F.arrays_zip(names.alias("k"), F.col("_cells").alias("v")),
        lambda p, i: F.struct(
            F.coalesce(F.nullif(p["k"], F.lit("")), F.concat(F.lit("_"), i)).alias("k"),
            p["v"].alias("v"),
            F.coalesce(p["k"] != "", F.lit(False)).alias("named"),
        ),
    )
    pairs = F.transform(
        F.filter(named, lambda p: p["named"] | (p["v"] != "")),
        lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")),
    )
    listed = rows.select(
        "source_file", "row_no", pairs.alias("_pairs")
    )

    def value(name: str) -> Column:
        # of a repeated header the last column counts
        hits = F.filter(F.col("_pairs"), lambda p: p["k"] == name)
        return F.coalesce(F.get(F.reverse(hits), F.lit(0))["v"], F.lit("")).alias(name)

    others = F.filter(F.col("_pairs"), lambda p: ~p["k"].isin(LISTING_COLUMNS))
    extra = F.map_from_entries(_last_of_each_key(others))
    return listed.select(
        *(value(c) for c in LISTING_COLUMNS), extra.alias("extra"), "row_no", "source_file"
    )


def _last_of_each_key(pairs: Column) -> Column:
    return F.filter(
        pairs,
        lambda p, i: ~F.exists(
            F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))),
            lambda later: later["k"] == p["k"],
        ),
    )


def batch_id_of(source_file: Column) -> Column:
    """Batch of an uploaded file, the same whenever the file is read again."""
    return F.sha2(source_file, 256)


def create_batch(
    listings: DataFrame,
    created_at: Column,
    batch_id: Column | None = None,
    priority: Column | int = 0,
    delay_ms: Column | int = 0,
) -> DataFrame:
    """One job per listing row. Ids follow from batch and row, so a repeated run
    creates the same jobs. Works for any number of batches at once."""
    batch = batch_id_of(F.col("source_file")) if batch_id is None else batch_id

    def option(value: Column | int) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    return listings.withColumn("batch_id", batch).select(
        F.sha2(F.concat_ws(":", "batch_id", "row_no"), 256).alias("job_id"),
        F.lit(JOB_NAME).alias("job_name"),
        "batch_id",
        "row_no",
        *LISTING_COLUMNS,
        F.lit("waiting").alias("state"),
        created_at.alias("created_at"),
        option(priority).alias("priority"),
        option(delay_ms).alias("delay_ms"),
    )


def upload_replies(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """One reply per uploaded file: ``batch_id, jobs_created, message, encoding,
    bom_removed``. ``files`` is the census of the uploaded files."""
    counts = jobs.groupBy("batch_id").agg(F.count(F.lit(1)).alias("jobs_created"))
    uploads = files.select(
        batch_id_of(F.col("path")).alias("batch_id"), "encoding", F.col("bom").alias("bom_removed")
    )
    return uploads.join(counts, "batch_id", "left").select(
        "batch_id",
        F.coalesce("jobs_created", F.lit(0)).alias("jobs_created"),
        F.lit(UPLOAD_MESSAGE).alias("message"),
        "encoding",
        "bom_removed",
    )


def upload(
    spark: SparkSession, path: str | list[str], jobs_path: str, created_at: Column,
    aliases: dict[str, str] | None = None,
) -> tuple[DataFrame, int]:
    """Turn uploaded files into jobs below ``jobs_path``: the replies, and how many jobs the
    write has seen itself write.

    The files are scanned once. Replies count the rows that were written, which are read
    back without their cells; the total comes from the write and costs nothing.
    """
    lines = stored_lines(file_lines(prepare_session(spark).read, path))
    return upload_lines(lines, jobs_path, created_at, aliases)


def upload_lines(
    lines: DataFrame, jobs_path: str, created_at: Column, aliases: dict[str, str] | None = None
) -> tuple[DataFrame, int]:
    """:func:`upload` of stored lines. Uploading the same files again replaces their jobs."""
    written = Observation()
    jobs = create_batch(listings_of(lines, aliases=aliases), created_at)
    write_jobs(jobs.observe(written, F.count(F.lit(1)).alias("jobs")), jobs_path, mode="overwrite")
    files = file_profiles(lines).withColumnRenamed("source_file", "path")
    batches = files.select(batch_id_of(F.col("path")).alias("batch_id"))
    # folders of other uploads are pruned; of these only the folder's name is read
    kept = lines.sparkSession.read.schema(jobs.schema).parquet(jobs_path).join(batches, "batch_id", "left_semi")
    return upload_replies(kept, files), written.get["jobs"]
