"""Exact deduplication over an extendible-hash index kept in shared files.

A text's place in the index follows from the leading bits of its 64-bit key. The
directory has one slot per value of the first ``depth`` bits. It starts with one slot
and doubles whenever an overfull bucket already uses all of its bits; a bucket that is
overfull is split by its next bit, and several slots may share a bucket with a smaller
depth of its own. Which buckets are overfull is read off a histogram of distinct keys
by their leading ``max_depth`` bits, so the driver sees at most ``2 ** max_depth``
numbers whatever the corpus is. Buckets that are overfull at full depth stay as they
are: an owner streams through its bucket in key order and needs no bucket in memory.

Every bucket is owned by one task, which receives its entries sorted by key, chains the
texts that share a key, compares their bytes, and writes the bucket's file. Copies are
combined before the shuffle, so a text that fills a third of the corpus reaches its
owner once per batch of the scan, not once per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from listingloom.llm.common import batches, forget, free_names, rows, texts
from listingloom.session import scratch_folder

# Directory slots are numbered in the plan and on the driver, hence the bound.
MAX_DEPTH = 16
BUCKET_ENTRIES = 4096
NO_TEXT = "_no_text"
BUCKET_BYTES = 16 << 20

ENTRY = "bucket INT, key LONG, text STRING, top_id LONG, n LONG"
CHAINED = "bucket INT, key LONG, chain INT, keep_id LONG, group_size LONG, text STRING"


@dataclass
class Directory:
    """Slots by the key's first ``depth`` bits; ``slots[i]`` is the number of a bucket."""

    depth: int
    slots: np.ndarray
    local_depth: list[int]

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        if self.depth == 0:
            return np.zeros(len(keys), np.int32)
        return self.slots[(keys.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)]


def grow_directory(
    entries: np.ndarray, sizes: np.ndarray, max_entries: int, max_bytes: int
) -> Directory:
    """Split overfull buckets, doubling the directory where it is too short for a split.

    ``entries`` and ``sizes`` hold the number of keys and of bytes by leading bits, for
    the largest depth allowed.
    """
    full = int(np.log2(len(entries)))
    n_sum = np.concatenate([[0], np.cumsum(entries)])
    b_sum = np.concatenate([[0], np.cumsum(sizes)])

    def overfull(prefix: int, depth: int) -> bool:
        lo, hi = prefix << (full - depth), (prefix + 1) << (full - depth)
        n, size = n_sum[hi] - n_sum[lo], b_sum[hi] - b_sum[lo]
        return depth < full and n > 1 and (n > max_entries or size > max_bytes)

    depth, waiting, done = 0, [(0, 0)], []
    while waiting:
        prefix, local = waiting.pop()
        if not overfull(prefix, local):
            done.append((prefix, local))
            continue
        depth = max(depth, local + 1)  # the directory doubles
        waiting += [(2 * prefix, local + 1), (2 * prefix + 1, local + 1)]
    done.sort(key=lambda b: b[0] << (full - b[1]))
    slots = np.zeros(1 << depth, np.int32)
    for number, (prefix, local) in enumerate(done):
        slots[prefix << (depth - local) : (prefix + 1) << (depth - local)] = number
    return Directory(depth, slots, [local for _, local in done])


def text_key(text: Column, key_bits: int = 64) -> Column:
    """64-bit key of a text; fewer bits only to force collisions in tests."""
    return F.xxhash64(text) if key_bits == 64 else F.shiftleft(F.xxhash64(text), 64 - key_bits)


def plan_directory(
    keyed: DataFrame, max_entries: int, max_bytes: int, max_depth: int = MAX_DEPTH
) -> Directory:
    distinct = keyed.groupBy("key").agg(F.max(F.octet_length("text")).alias("size"))
    counted = (
        distinct.groupBy(F.shiftrightunsigned("key", 64 - max_depth).alias("slot"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
        .collect()
    )
    entries = np.zeros(1 << max_depth, np.int64)
    sizes = np.zeros(1 << max_depth, np.int64)
    for slot, n, size in counted:
        entries[slot], sizes[slot] = n, size
    return grow_directory(entries, sizes, max_entries, max_bytes)


def build_index(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_entries: int = BUCKET_ENTRIES,
    max_bytes: int = BUCKET_BYTES,
    key_bits: int = 64,
    path: str | None = None,
    carry: bool = False,
) -> DataFrame:
    """Write the index and return it: one row per distinct text, one folder per bucket.

    Columns: ``bucket``; ``key``; ``chain``, the entry's place among different texts of
    one key; ``keep_id``, the largest id; ``group_size``; ``text``; with ``carry`` also
    ``row``, the other columns of a row with that id.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    others = [F.col(c) for c in docs.columns if c != text_col]
    (no_text,) = free_names(docs, NO_TEXT)
    row = [F.struct(*others, F.col(text_col).isNull().alias(no_text)).alias("row")] if carry else []
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), text_key(text, key_bits).alias("key"), *row
    )
    directory = plan_directory(keyed, max_entries, max_bytes)
    given = ["doc_id", "text", "key", *(["row"] if carry else [])]
    entry, chained = (
        T.StructType([*T.StructType.fromDDL(ddl).fields, *(keyed.schema[c] for c in given[3:])])
        for ddl in (ENTRY, CHAINED)
    )
    entry_schema, chained_schema = to_arrow_schema(entry), to_arrow_schema(chained)

    def combine(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part in parts:
            seen: dict[tuple[int, str], list] = {}
            for doc_id, text, key, *rest in rows(iter([part]), *given):
                _add(seen, (key, text), doc_id, 1, rest)
            keys = np.array([key for key, _ in seen], np.int64)
            found = zip(directory.bucket(keys).tolist(), seen.items())
            made = ((b, key, text, top, n, *rest) for b, ((key, text), (top, n, rest)) in found)
            yield from batches(entry_schema, made)

    def own(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from batches(chained_schema, _chain(rows(parts, *entry_schema.names)))

    path = path or scratch_folder(spark, "exact-index")
    (
        keyed.mapInArrow(combine, entry)
        .repartitionById(len(directory.local_depth), "bucket")
        .sortWithinPartitions("bucket", "key")
        .mapInArrow(own, chained)
        .write.partitionBy("bucket")
        .parquet(path)
    )
    return spark.read.schema(chained).parquet(path)


def _add(seen: dict, key, top_id: int | None, n: int, rest: list) -> None:
    """Count a text's rows, and keep the id and the columns of the one with the largest id."""
    entry = seen.get(key)
    if entry is None:
        seen[key] = [top_id, n, rest]
        return
    entry[1] += n
    if top_id is not None and (entry[0] is None or top_id > entry[0]):
        entry[0], entry[2] = top_id, rest


def _chain(entries: Iterator[tuple]) -> Iterator[tuple]:
    """Entries in key order to one row per distinct text, chained where keys collide."""
    here, chain = None, {}

    def flush() -> Iterator[tuple]:
        for place, text in enumerate(sorted(chain)):
            top_id, n, rest = chain[text]
            yield (*here, place, top_id, n, text, *rest)

    for bucket, key, text, top_id, n, *rest in entries:
        if (bucket, key) != here:
            if here is not None:
                yield from flush()
            here, chain = (bucket, key), {}
        # a dictionary hit means equal text, byte by byte; another text is chained
        _add(chain, text, top_id, n, rest)
    if here is not None:
        yield from flush()


def copy_groups(index: DataFrame) -> DataFrame:
    """Groups of more than one row: ``key``, ``text_sha256``, ``keep_id``, sizes."""
    return index.filter("group_size > 1").select(
        "key", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"
    )


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """One row per row of ``docs`` with its group of identical texts.

    Columns: doc_id, keep_id, group_size, kept, text_sha256. The row with the largest id
    stays. Missing texts count as empty, missing ids as smaller than any other; rows that
    repeat an id and its text are one document with one decision. An empty table gives
    no rows.
    """
    groups = copy_groups(build_index(docs, id_col, text_col, **options))
    members = texts(docs, id_col, text_col).select(
        "doc_id",
        text_key(F.col("text"), options.get("key_bits", 64)).alias("key"),
        F.sha2("text", 256).alias("text_sha256"),
    )
    grouped = members.join(groups, ["key", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return grouped.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per distinct text, the one with the largest id.

    The rows come out of the index, which carries the other columns of each text's last
    row, so that texts are shuffled once and joined with nothing. Missing texts count as
    empty and missing ids as smaller than any other; of rows that tie one stays. All columns
    stay as they are, whatever their names; an empty table stays empty.
    """
    index = build_index(docs, id_col, text_col, carry=True)
    (no_text,) = free_names(docs, NO_TEXT)
    text = F.when(~F.col(f"row.{no_text}"), F.col("text")).cast(docs.schema[text_col].dataType)
    return index.select(
        *(text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns)
    )
