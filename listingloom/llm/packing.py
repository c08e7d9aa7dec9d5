"""Hierarchical best-fit packing of token sequences.

Documents are tokenised, cut where they are longer than a sequence, and packed in the
task that read them: best fit by decreasing length. Sequences that are full up to a few
tokens are done. The others travel as items, a whole sequence each, to a task that merges
several tasks' leftovers and packs them by best fit again, and so on up the tree. Every
round is written down before the next one reads it. A task's input is bounded at every
level, and when a round saves next to nothing the leftovers are sequences as they are, so
no task ever gathers all of them.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.llm.common import forget, rows, texts
from listingloom.session import stored

CAPACITY = 1024
END_ID = 2
SPARE = 4  # a sequence with at most this many free places is done
FAN_IN = 8
TASK_ITEMS = 50_000
TOKENIZER = "byte_bpe_50k"
# The vocabulary's added token, which only ``tokenizers`` knows in a text.
ADDED = "<|endoftext|>"

MEMBER = "doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint"
BINS = f"bin_id BIGINT, used INT, done BOOLEAN, members ARRAY<STRUCT<{MEMBER}>>"
MEMBER_TYPE = pa.struct(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
     ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
BINS_SCHEMA = pa.schema(
    [("bin_id", pa.int64()), ("used", pa.int32()), ("done", pa.bool_()),
     ("members", pa.list_(MEMBER_TYPE))]
)


class Encoder:
    """Ids of the byte-level vocabulary, from its ranks file.

    The ranks give the ids of the vocabulary's ``tokenizers`` file at a fifth of its CPU
    time. Texts that the faster library refuses (white space in very long runs) and those
    that hold the added token go through ``tokenizers``.
    """

    def __init__(self, name: str = TOKENIZER) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        self.name = name
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
            pairs = (line.split() for line in file)
            ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.fast = tiktoken.Encoding(
            name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.exact = None

    def __call__(self, text: str) -> np.ndarray:
        if ADDED in text:
            return self.slow(text)
        try:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        except ValueError:
            return self.slow(text)

    def slow(self, text: str) -> np.ndarray:
        if self.exact is None:
            import public_tokenizers

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(public_tokenizers.path(f"{self.name}.json"))
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def cut(doc_id: int | None, ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple]:
    """A document's pieces; all but the first are full."""
    first = len(ids) % capacity or capacity
    bounds = [0, *range(first, len(ids) + 1, capacity)]
    data = ids.astype("<u4").tobytes()
    return [
        (doc_id, k, lo, hi - lo, zlib.crc32(data[4 * lo : 4 * hi]))
        for k, (lo, hi) in enumerate(zip(bounds, bounds[1:]))
    ]


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Indices of items by bin: largest items first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    free: list[int] = []  # free places that occur, in order
    by_free: dict[int, list[int]] = {}
    for item in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = bisect_left(free, sizes[item])
        if at == len(free):
            number, room = len(bins), capacity
            bins.append([])
        else:
            room = free[at]
            number = by_free[room].pop()
            if not by_free[room]:
                del by_free[room], free[at]
        bins[number].append(item)
        left = room - sizes[item]
        if left:
            if left not in by_free:
                by_free[left] = []
                insort(free, left)
            by_free[left].append(number)
    return bins


def _packed(level: int, items: list[tuple[int, list]], last: bool) -> Iterator[pa.RecordBatch]:
    """Pack one task's items, given as used places and members, into numbered bins."""
    task = TaskContext.get().partitionId()
    found = best_fit([used for used, _ in items])
    for k in range(0, len(found), 2000):
        made = []
        for number, bin_ in enumerate(found[k : k + 2000], k):
            used = sum(items[i][0] for i in bin_)
            members = [m for i in bin_ for m in items[i][1]]
            bin_id = (level << 58) | (task << 32) | number
            made.append((bin_id, used, last or used >= CAPACITY - SPARE, members))
        columns = [pa.array(c, type=f.type) for c, f in zip(zip(*made), BINS_SCHEMA)]
        yield pa.RecordBatch.from_arrays(columns, schema=BINS_SCHEMA)


def tokenised_bins(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER
) -> DataFrame:
    """Tokenise, cut, and pack inside every task of the scan."""
    names = [field.name for field in MEMBER_TYPE]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        encode, items = Encoder(tokenizer), []
        for doc_id, text in rows(parts, "doc_id", "text"):
            ids = np.append(encode(text), np.uint32(END_ID))
            for piece in cut(doc_id, ids):
                items.append((piece[3], [dict(zip(names, piece))]))
        yield from _packed(0, items, False)

    return texts(docs, id_col, text_col).mapInArrow(run, BINS)


def merged_bins(bins: DataFrame, level: int, tasks: int) -> DataFrame:
    """Pack unfinished bins, as items, with those of other tasks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(level, list(rows(parts, "used", "members")), False)

    # all of a task below goes to one task here, in the order of the bin numbers
    task_below = F.shiftrightunsigned(F.col("bin_id"), 32).bitwiseAND(F.lit((1 << 26) - 1))
    return (
        bins.withColumn("_to", (task_below % tasks).cast("int"))
        .repartitionById(tasks, "_to")
        .sortWithinPartitions("bin_id")
        .drop("_to")
        .mapInArrow(run, BINS)
    )


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    fan_in: int = FAN_IN,
    task_items: int = TASK_ITEMS,
) -> DataFrame:
    """One row per piece of a document with its place in a sequence.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A missing or
    empty text is the end id alone; repeated rows are packed like different documents; an
    empty table gives no rows.
    """
    made = stored(tokenised_bins(docs, id_col, text_col, tokenizer), "bins-0")
    done, waiting = made.filter("done"), made.filter("not done")
    count, tasks = waiting.agg(F.count(F.lit(1)), F.count_distinct(F.shiftrightunsigned("bin_id", 32))).first()
    level = 0
    while count > 1 and (tasks > 1 or level == 0):
        level += 1
        tasks = max(-(-tasks // fan_in), -(-count // task_items))
        made = stored(merged_bins(waiting, level, tasks), f"bins-{level}")
        done, waiting = done.unionByName(made.filter("done")), made.filter("not done")
        left, ended = made.agg(F.count_if(~F.col("done")), F.count_if("done")).first()
        before, count = count, left
        if left + ended > 0.999 * before and tasks * task_items < 2 * before:
            break  # the largest tasks allowed saved next to nothing
    placed = done.unionByName(waiting).select("bin_id", "used", F.posexplode("members").alias("_at", "m"), "members")
    before_it = F.aggregate(
        F.slice("members", F.lit(1), F.col("_at")), F.lit(0).cast("long"), lambda n, m: n + m["length"]
    )
    return placed.select(
        "m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32",
        F.col("bin_id").alias("sequence_id"), before_it.alias("offset"),
    )
