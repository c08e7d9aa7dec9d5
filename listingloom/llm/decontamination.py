"""Benchmark decontamination by SimHash over windows of an item's size.

For a benchmark item of L words, every window of L words of a document that could hold it
gets a 64-bit SimHash of its five-word shingles. A multi-index finds all items within
``RADIUS`` bits: a fingerprint is cut into four blocks of 16 bits, and by the pigeonhole
principle two fingerprints within the radius agree in some block up to a quarter of it.
Candidates are then verified by their exact weighted-shingle similarity, the sum of the
smaller over the sum of the larger multiplicities.

A window without any shingle of an item of its size has similarity zero with all of them
and needs no fingerprint, so windows are laid around shingles that occur in an item. That
leaves the search whole: what is skipped could never be verified.

Benchmark items are sent to the tasks in passes of bounded size; the documents are never
shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.llm.common import batches, forget, free_names, rows, texts
from listingloom.session import stored

SHINGLE_WORDS = 5
SIMILARITY = 0.8
# At similarity 0.8 fingerprints differ in about 10 bits, with a deviation of 3.
RADIUS = 19
BLOCKS, BLOCK_BITS = 4, 16
PASS_ITEMS = 1000
PASS_BYTES = 8 << 20
WINDOWS = 1 << 14
WORD = re.compile(r"\w+")

HIT = "doc_id LONG, text_hash LONG, item_id LONG, start LONG, n_words LONG, similarity DOUBLE"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = (mixed ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_fingerprints(hashes: np.ndarray, n: int) -> np.ndarray:
    """SimHash of each window of ``n`` shingles."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=ones[1:])
    majority = (2 * (ones[n:] - ones[:-n]) > n).astype(np.uint8)
    return np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()


@dataclass
class Group:
    """Items of one size, with their fingerprints and the multi-index over these."""

    size: int
    width: int
    items: list[int] = field(default_factory=list)
    prints: np.ndarray | None = None
    keys: list[np.ndarray] = field(default_factory=list)
    owners: list[np.ndarray] = field(default_factory=list)

    def build(self, radius: int) -> None:
        near = np.array(
            [sum(1 << b for b in bits) for k in range(radius // BLOCKS + 1)
             for bits in combinations(range(BLOCK_BITS), k)], np.uint16
        )
        blocks = self.prints.view(np.uint16).reshape(-1, BLOCKS)
        for b in range(BLOCKS):
            keys = (blocks[:, b, None] ^ near).ravel()
            order = np.argsort(keys, kind="stable")
            self.keys.append(keys[order])
            self.owners.append(np.repeat(np.arange(len(blocks)), len(near))[order])

    def within(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a window and an item whose fingerprints are within the radius."""
        pairs = []
        for b in range(BLOCKS):
            block = prints.view(np.uint16).reshape(-1, BLOCKS)[:, b]
            lo = np.searchsorted(self.keys[b], block, "left")
            n = np.searchsorted(self.keys[b], block, "right") - lo
            window = np.repeat(np.arange(len(prints)), n)
            at = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + lo[window]
            pairs.append(window * len(self.items) + self.owners[b][at])
        found = np.unique(np.concatenate(pairs))
        window, item = found // len(self.items), found % len(self.items)
        near = np.bitwise_count(prints[window] ^ self.prints[item]) <= radius
        return window[near], item[near]


class Searcher:
    """One pass's items, ready to be looked for in texts."""

    def __init__(self, items: list[tuple[int | None, str]], radius: int, similarity: float) -> None:
        self.radius, self.similarity = radius, similarity
        self.ids = [item_id for item_id, _ in items]
        self.words = [words_of(text or "") for _, text in items]
        self.groups: dict[int, Group] = {}
        seen: dict[int, list[tuple[int, int]]] = {}  # by shingle width: hash and item size
        prints: dict[int, list[int]] = {}
        for k, words in enumerate(self.words):
            if not words:
                continue
            size = len(words)
            width = min(SHINGLE_WORDS, size)
            hashes = shingle_hashes(word_hashes(words), width)
            group = self.groups.setdefault(size, Group(size, width))
            group.items.append(k)
            prints.setdefault(size, []).append(int(window_fingerprints(hashes, len(hashes))[0]))
            seen.setdefault(width, []).extend((h, size) for h in set(hashes.tolist()))
        for size, group in self.groups.items():
            group.prints = np.array(prints[size], np.uint64)
            group.build(radius)
        self.marks = {}
        for width, found in seen.items():
            found.sort()
            self.marks[width] = (
                np.array([h for h, _ in found], np.uint64),
                np.array([size for _, size in found], np.int64),
            )
        self.shingles = [self._weights(words, min(SHINGLE_WORDS, len(words))) for words in self.words]

    @staticmethod
    def _weights(words: list[str], width: int) -> Counter:
        return Counter(tuple(words[k : k + width]) for k in range(len(words) - width + 1))

    def hits(self, text: str) -> list[tuple]:
        """For each item found: item_id, first word and length of its best window, similarity."""
        words = words_of(text)
        hashed = word_hashes(words)
        best: dict[int, tuple] = {}
        for width, (marks, sizes) in self.marks.items():
            hashes = shingle_hashes(hashed, width)
            lo = np.searchsorted(marks, hashes, "left")
            at = np.flatnonzero(marks[np.minimum(lo, len(marks) - 1)] == hashes)
            if not len(at):
                continue
            n = np.searchsorted(marks, hashes[at], "right") - lo[at]
            place = np.repeat(at, n)
            step = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
            size = sizes[np.repeat(lo[at], n) + step]
            for each in np.unique(size):
                self._search(words, hashes, place[size == each], self.groups[int(each)], best)
        return [(self.ids[k], *found) for k, found in sorted(best.items())]

    def _search(self, words, hashes, places, group: Group, best: dict) -> None:
        size = min(group.size, len(words))  # a shorter text is one window
        n = size - group.width + 1
        last = len(words) - size
        starts = np.unique(np.clip((places[:, None] - np.arange(n)).ravel(), 0, last))
        breaks = np.flatnonzero(np.diff(starts) > 1) + 1
        for run in np.split(starts, breaks):
            for k in range(0, len(run), WINDOWS):
                first, count = int(run[k]), min(WINDOWS, len(run) - k)
                prints = window_fingerprints(hashes[first : first + count + n - 1], n)
                for window, item in zip(*group.within(prints, self.radius)):
                    self._verify(words, first + int(window), size, group, int(item), best)

    def _verify(self, words, start: int, size: int, group: Group, item: int, best: dict) -> None:
        k = group.items[item]
        there, here = self.shingles[k], self._weights(words[start : start + size], group.width)
        both = sum(min(n, here[s]) for s, n in there.items())
        similarity = both / (there.total() + here.total() - both)
        if similarity >= self.similarity and (k not in best or similarity > best[k][2]):
            best[k] = (start, size, similarity)


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    similarity: float = SIMILARITY,
    pass_items: int = PASS_ITEMS,
) -> DataFrame:
    """One row for each row of ``docs`` and item that a window of it holds.

    Columns: doc_id, text_hash, item_id, start (first word of the best window, the first
    of equal ones), n_words, similarity. Words are compared in lower case without
    punctuation; items of fewer than five words are one shingle. Texts and items that are
    missing, empty or without words hold and match nothing; repeated rows and repeated
    items are looked at like different ones.
    """
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    n, size = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    passes = max(1, -(-n // pass_items), -(-(size or 0) // PASS_BYTES))
    spread = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    hashed = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()),
         ("start", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())]
    )

    def search(number: int) -> DataFrame:
        chosen = [tuple(r) for r in items.filter(spread == number).collect()]

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            searcher = Searcher(chosen, radius, similarity)
            found = (
                (doc_id, text_hash, *hit)
                for doc_id, text_hash, text in rows(parts, "doc_id", "text_hash", "text")
                for hit in searcher.hits(text)
            )
            yield from batches(schema, found)

        return hashed.mapInArrow(run, HIT)

    found = search(0)
    for number in range(1, passes):
        found = stored(found.unionByName(search(number)), "benchmark-hits")
    return found


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item.

    Missing and empty texts hold none and stay; rows that repeat go or stay together, as do
    rows without an id of the same text. Very long texts are searched whole. All columns
    stay as they are, whatever their names; an empty table stays empty.
    """
    text_hash, hit_id, hit_hash = free_names(docs, "_text_hash", "_hit_id", "_hit_hash")
    gone = stored(
        benchmark_hits(docs, benchmark, id_col, text_col, **options)
        .select(F.col("doc_id").alias(hit_id), F.col("text_hash").alias(hit_hash))
        .distinct(),
        "contaminated",
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    same_row = F.col(id_col).cast("long").eqNullSafe(F.col(hit_id)) & (
        F.col(text_hash) == F.col(hit_hash)
    )
    return docs.withColumn(text_hash, F.xxhash64(text)).join(gone, same_row, "left_anti").drop(text_hash)
