"""Target-distribution importance resampling over hashed n-grams.

A feature is a run of one to three neighbouring words, and its bucket is its CRC-32 modulo
the number of buckets. The features of the target texts and of all texts give every bucket
a gain, a document's weight is the sum of its features' gains, and Gumbel noise on the
weights draws documents without replacement in proportion to them.

No n-gram is ever built. A document is brought into its normal form (words joined by one
space) and scanned once, which leaves the running CRC at the end of every word and the
words' lengths; both are stored. The CRC of any n-gram follows from two of these prefixes:
``crc(AB) = shift(crc(A), len(B)) ^ crc(B)``, where ``shift`` appends zero bytes, a linear
map over GF(2) put together from the maps for 1, 2, 4, ... bytes. Counting and weighing
both read the stored prefixes, not the texts.

Normal form: A to Z in lower case; words are runs of a to z, 0 to 9 and anything outside
ASCII. Missing and empty texts have no words, no features and weight zero. Texts are read
whole; a very long one is worked through in blocks of words. Rows that repeat are documents
of their own, drawn or not one by one. A missing id draws its noise as an empty one and
comes before all other ids among ties. Only the named columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.llm.common import rows, word_blocks
from listingloom.llm.importance import kth_largest
from listingloom.operators.ordering import position_in_group
from listingloom.session import stored

BUCKETS = 10_000
MAX_WORDS = 3
SEED = 42
PERCENT = 5
MIN_WORDS = 20
# Words that are worked on at once; it bounds the memory of a task, not the text.
BLOCK = 1 << 19

POLYNOMIAL = 0xEDB88320
# Lengths of n-grams are below 2 ** 31, as a text cell is.
SHIFT_BITS = 31


def _byte_table() -> np.ndarray:
    """What one zero byte makes of each value of a CRC's last byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map, given by its images of the four bytes' values, of many CRCs."""
    out = tables[0][crc & 255]
    for place in (1, 2, 3):
        out ^= tables[place][(crc >> np.uint32(8 * place)) & 255]
    return out


def _shift_tables() -> list[np.ndarray]:
    """The maps that append 1, 2, 4, ... zero bytes, each made of the one before."""
    values = np.arange(256, dtype=np.uint32)
    inputs = np.stack([values << np.uint32(8 * place) for place in range(4)])
    step = _byte_table()
    tables = [(inputs >> np.uint32(8)) ^ step[inputs & 255]]
    for _ in range(SHIFT_BITS - 1):
        tables.append(np.stack([_apply(tables[-1], images) for images in tables[-1]]))
    return tables


BYTE = _byte_table()
SHIFTS = _shift_tables()


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs after so many zero bytes."""
    out = crc.copy()
    for bit in range(int(length.max(initial=0)).bit_length()):
        chosen = np.flatnonzero((length >> bit) & 1)
        out[chosen] = _apply(SHIFTS[bit], out[chosen])
    return out


def after_space(crc: np.ndarray) -> np.ndarray:
    """Running CRCs after one more space."""
    state = ~crc
    return ~((state >> np.uint32(8)) ^ BYTE[(state ^ np.uint32(32)) & 255])


def _normal_bytes() -> bytes:
    """Every byte in lower case, or a space where it separates words."""
    kept = bytearray(b" " * 128 + bytes(range(128, 256)))
    for first, last in ((0x30, 0x39), (0x61, 0x7A)):
        kept[first : last + 1] = range(first, last + 1)
    kept[0x41:0x5B] = kept[0x61:0x7B]
    return bytes(kept)


NORMAL = _normal_bytes()


def running_crcs(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The normal form's CRC up to the end of each word, and the words' lengths."""
    all_ends, all_lengths, crc = [np.empty(0, np.uint32)], [np.empty(0, np.int32)], 0
    for block, words in enumerate(word_blocks(text.translate(NORMAL))):
        # a space belongs to every word but the text's first
        joined = (b" " if block else b"") + b" ".join(words)
        pieces = joined.replace(b" ", b"\n ").lstrip(b"\n").split(b"\n")
        running = accumulate(pieces, lambda crc, piece: zlib.crc32(piece, crc), initial=crc)
        next(running)
        all_ends.append(np.fromiter(running, np.uint32, len(words)))
        all_lengths.append(np.fromiter(map(len, words), np.int32, len(words)))
        crc = int(all_ends[-1][-1])
    return np.concatenate(all_ends), np.concatenate(all_lengths)


def ngram_crcs(
    ends: np.ndarray, lengths: np.ndarray, place: np.ndarray, most: int = MAX_WORDS
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length, the numbers of first words and the n-grams' CRCs.

    ``place`` is each word's place in its document, so that neighbouring documents may
    follow each other; only n-grams inside one document are made.
    """
    before = np.zeros_like(ends)
    before[1:] = after_space(ends[:-1])
    before[place == 0] = 0
    size = lengths.astype(np.int64)
    for more in range(most):
        if more:
            size = size[:-1] + 1 + lengths[more:]
        # the last word is so many words into the same document
        first = np.flatnonzero(place[more:] >= more)
        yield first, ends[more:][first] ^ shifted(before[first], size[first])


def feature_buckets(docs: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int, most: int):
    """Blocks of (numbers of documents, buckets) for documents given as running CRCs.

    Short documents are put together and long ones cut, so that numpy works on blocks of
    about ``BLOCK`` words. A cut repeats the words that an n-gram over it needs.
    """
    held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    weight = 0

    def flush():
        ends = np.concatenate([h[2] for h in held])
        lengths = np.concatenate([h[3] for h in held])
        sizes = [len(h[2]) for h in held]
        number = np.repeat([h[0] for h in held], sizes)
        place = np.concatenate([np.arange(h[1], h[1] + len(h[2])) for h in held])
        fresh = np.concatenate([_fresh(h[1], len(h[2]), most) for h in held])
        for more, (first, crc) in enumerate(ngram_crcs(ends, lengths, place, most)):
            # Those that end in a repeated word are counted already. The others begin after
            # the first word of a cut piece, whose prefix is not known.
            new = fresh[first + more]
            yield number[first[new]], (crc[new] % np.uint32(buckets)).astype(np.int64)

    for doc, (ends, lengths) in enumerate(docs):
        start = 0
        while start < len(ends):
            back = min(start, most)
            stop = min(len(ends), start + BLOCK)
            held.append((doc, start - back, ends[start - back : stop], lengths[start - back : stop]))
            weight += stop - start
            start = stop
            if weight >= BLOCK:
                yield from flush()
                held, weight = [], 0
    if held:
        yield from flush()


def _fresh(start: int, size: int, most: int) -> np.ndarray:
    """Which words of a piece are not repeated from the piece before."""
    fresh = np.ones(size, bool)
    if start:
        fresh[:most] = False
    return fresh


PREFIXES = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("ends", pa.binary()), ("lengths", pa.binary())]
)


def scan_prefixes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every document's running CRCs and word lengths, written down once."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = [running_crcs(text or b"") for (text,) in rows(iter([part]), "text")]
            columns = [
                part.column(0),
                pa.array([len(lengths) for _, lengths in made], pa.int64()),
                pa.array([ends.tobytes() for ends, _ in made], pa.binary()),
                pa.array([lengths.tobytes() for _, lengths in made], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=PREFIXES)

    given = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    made = given.mapInArrow(scan, "doc_id LONG, n_words LONG, ends BINARY, lengths BINARY")
    return stored(made, "running-crcs")


def _arrays(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for ends, lengths in rows(iter([part]), "ends", "lengths"):
        yield np.frombuffer(ends, np.uint32), np.frombuffer(lengths, np.int32)


def bucket_counts(prefixes: DataFrame, buckets: int = BUCKETS, most: int = MAX_WORDS) -> list[int]:
    """How many features fall into each bucket: as many numbers as there are buckets."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for part in parts:
            for _, found in feature_buckets(_arrays(part), buckets, most):
                counts += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(counts)
        columns = [pa.array(seen.astype(np.int32)), pa.array(counts[seen])]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    counted = prefixes.select("ends", "lengths").mapInArrow(count, "bucket INT, n LONG")
    counts = [0] * buckets
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def bucket_gains(target: list[int], raw: list[int]) -> np.ndarray:
    """A thousand times the log ratio of a bucket's smoothed shares, rounded down."""
    t_all, s_all, n = sum(target), sum(raw), len(raw)
    ratios = (((t + 1) * (s_all + n)) / ((s + 1) * (t_all + n)) for t, s in zip(target, raw))
    return np.array([math.floor(1000 * math.log(ratio)) for ratio in ratios], np.int64)


def gumbel(id_col: str, seed: int) -> Column:
    """A thousand times Gumbel noise from a hash of the id, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    target_text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS,
    seed: int = SEED, buckets: int = BUCKETS, most: int = MAX_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank.

    Drawn are the ``percent`` of the documents with at least ``min_words`` words that have
    the highest scores, ties to the smaller id; ``rank`` counts them from one and is null
    for the others. Without target texts every feature counts as unseen there. An empty
    table gives no rows.
    """
    prefixes = scan_prefixes(docs, id_col, text_col)
    target = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text_col).alias("text"))
    wanted = bucket_counts(scan_prefixes(target, "doc_id", "text"), buckets, most)
    gains = bucket_gains(wanted, bucket_counts(prefixes, buckets, most))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())]
    )

    def weigh(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            features = np.zeros(part.num_rows, np.int64)
            weights = np.zeros(part.num_rows, np.int64)
            for doc, found in feature_buckets(_arrays(part), buckets, most):
                features += np.bincount(doc, minlength=part.num_rows)
                # sums of integers far below 2 ** 53 are exact in doubles
                weights += np.bincount(doc, gains[found], part.num_rows).astype(np.int64)
            columns = [part.column(0), part.column(1), pa.array(features), pa.array(weights)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    weighed = prefixes.mapInArrow(weigh, "doc_id LONG, n_words LONG, n_features LONG, weight LONG")
    scored = stored(
        weighed.select(
            F.monotonically_increasing_id().alias("row"),  # tells rows that repeat apart
            "doc_id",
            "n_features",
            "weight",
            (F.col("weight") + gumbel("doc_id", seed)).alias("score"),
            (F.col("n_words") >= min_words).alias("eligible"),
        ),
        "weights",
    )
    eligible = scored.filter("eligible")
    k = percent * eligible.count() // 100
    least = kth_largest(eligible.select("score"), "score", k) if k else None
    columns = ["doc_id", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("long").alias("rank")
    if least is None:
        return scored.select(*columns, undrawn)
    # as many rows as are drawn, and those that tie with the last of them
    order = [F.desc("score"), F.asc("doc_id"), F.asc("row")]
    ahead = position_in_group(eligible.filter(F.col("score") >= least), [], order, "rank", start=1)
    drawn = F.when(F.col("rank") <= k, F.col("rank")).cast("long").alias("rank")
    rest = scored.filter(~F.col("eligible") | (F.col("score") < least))
    return ahead.select(*columns, drawn).unionByName(rest.select(*columns, undrawn))
