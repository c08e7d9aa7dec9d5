"""What the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text under fixed names, a missing text as an empty one.

    Taking two columns by name keeps every other column, whatever it is called, out
    of the operator and out of the scan.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``docs`` has, in any case."""
    taken = {c.lower() for c in docs.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def learnable(id_col: str = "doc_id") -> Column:
    """Rows whose labels may be learnt from; the others are held out."""
    return ~held_out(id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the ids, by checksum; a missing id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


# Short rows that a task writes at least, where there are so many.
TASK_ROWS = 1 << 18


def in_few_tasks(df: DataFrame, n: int) -> DataFrame:
    """A table of about ``n`` short rows in no more tasks than that takes: a task's file costs
    far more than a few rows, and a shuffle may have any number of tasks."""
    return df.coalesce(1 + n // TASK_ROWS)


# Rows that are turned into Python values at a time.
SLICE = 512


def sliced(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches in pieces of ``SLICE`` rows, so that few texts are strings at once. What
    Arrow keeps of batches that are done goes back to the system."""
    for part in parts:
        for first in range(0, part.num_rows, SLICE):
            yield part.slice(first, SLICE)
        del part
        pa.default_memory_pool().release_unused()


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of record batches as tuples of Python values, few at a time."""
    for batch in sliced(batches):
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


_KEPT: list[dict] = []


def kept_by_worker() -> dict:
    """A dict in which an operator keeps what serves the later tasks of a worker process, too."""
    _KEPT.append({})
    return _KEPT[-1]


def forget() -> None:
    """Empty what operators keep in this worker process, whose memory is now needed by another."""
    for kept in _KEPT:
        kept.clear()


def batches(
    schema: pa.Schema, made: Iterator[tuple], size: int = 4096, bytes_each: int = 16 << 20
) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of bounded length and bounded text size."""
    pending: list[tuple] = []
    weight = 0
    for row in made:
        pending.append(row)
        weight += sum(len(v) for v in row if isinstance(v, (str, list)))
        if len(pending) >= size or weight >= bytes_each:
            yield _batch(schema, pending)
            pending, weight = [], 0
    if pending:
        yield _batch(schema, pending)


def _batch(schema: pa.Schema, pending: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, type=f.type) for c, f in zip(zip(*pending), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """A text's words between blanks, tabs and line breaks, in lists of bounded text size.

    ``bytes.split`` parts at these six characters and no others. A block ends at one of
    them, so that no word is cut.
    """
    start = 0
    while start < len(text):
        end = _SPACE.search(text, start + size) if start + size < len(text) else None
        stop = end.start() if end else len(text)
        if words := text[start:stop].split():
            yield words
        start = stop + 1
