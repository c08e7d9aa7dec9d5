"""Quality selection by importance resampling.

Two generative models over hashed n-grams, one of all texts and one of texts labelled
good, give each document a weight: the likelihood ratio of the two. Adding Gumbel noise
to the logarithms and taking the k largest is sampling k documents without replacement in
proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.llm.common import learnable, rows, texts
from listingloom.session import stored

BUCKETS = 10_000
# Labelled rows that the target model is fitted on, the first by a hash of the id.
TARGET_SAMPLE = 20_000
# A document's mean log ratio counts as that of so many n-grams, whatever its length.
LENGTH = 100
FRACTION = 0.5
SEED = 1


def features(text: str) -> np.ndarray:
    """Buckets of a text's words and pairs of neighbouring words."""
    words = text.lower().split()
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:]
    two ^= two >> np.uint64(29)
    return (np.concatenate([one, two]) % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the texts; a vector of fixed length."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for (text,) in rows(parts, "text"):
            counts += np.bincount(features(text), minlength=BUCKETS)
        seen = np.flatnonzero(counts)
        columns = [pa.array(seen.astype(np.int32)), pa.array(counts[seen])]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    counted = docs.select("text").mapInArrow(run, "bucket INT, n LONG")
    found = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS)
    counts[found["bucket"].to_numpy(np.int64)] = found["n"]
    return counts


def log_ratios(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    target_sample: int = TARGET_SAMPLE,
) -> np.ndarray:
    """Log ratio of the target's to the raw corpus's share of each bucket."""
    known = labels.filter(learnable() & F.col("doc_id").isNotNull()).filter("quality = 1")
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_sample)
    given = texts(docs, id_col, text_col)
    # at most target_sample numbers
    target = bucket_counts(given.join(F.broadcast(chosen), "doc_id", "left_semi"))
    raw = bucket_counts(given)
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def kth_largest(values: DataFrame, name: str, k: int) -> int | None:
    """The k-th largest of a column of longs, exactly, by four histograms of 16 bits.

    No more than 65,536 counts reach the driver in a round, and no rows are sorted.
    """
    key = F.col(name).bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    prefix, left = 0, k
    for step in range(4):
        shift = 48 - 16 * step
        here = values
        if step:
            here = values.filter(F.shiftrightunsigned(key, shift + 16) == prefix)
        digit = F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(0xFFFF))
        counts = dict(here.groupBy(digit.alias("digit")).count().collect())
        for found in sorted(counts, reverse=True):
            if left <= counts[found]:
                prefix = (prefix << 16) | found
                break
            left -= counts[found]
        else:
            return None
    return prefix - (1 << 63)


def importance_sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    fraction: float = FRACTION, seed: int = SEED, **options,
) -> DataFrame:
    """One row per row of ``docs`` with its weight and whether the sample has it.

    Columns: doc_id, log_weight, key (with noise), selected. Missing and empty texts have
    weight one. Noise follows from seed, id and text, so rows that repeat both share a key
    and are taken together. Without labels of good texts all weights are one. An empty
    table gives no rows.
    """
    ratios = log_ratios(docs, labels, id_col, text_col, **options)
    schema = pa.schema([("doc_id", pa.int64()), ("noise", pa.int64()), ("log_weight", pa.float64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            weights = []
            for (text,) in rows(iter([part]), "text"):
                found = features(text)
                weights.append(LENGTH * float(ratios[found].mean()) if len(found) else 0.0)
            columns = [part.column(0), part.column(1), pa.array(weights, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    hashed = texts(docs, id_col, text_col).select(
        "doc_id", F.xxhash64(F.lit(seed), "doc_id", "text").alias("noise"), "text"
    )
    weighted = hashed.mapInArrow(run, "doc_id LONG, noise LONG, log_weight DOUBLE")
    uniform = (F.shiftrightunsigned("noise", 11).cast("double") + 0.5) / float(1 << 53)
    fixed = F.round((F.col("log_weight") - F.log(-F.log(uniform))) * float(1 << 32)).cast("long")
    keyed = stored(weighted.select("doc_id", "log_weight", fixed.alias("fixed")), "weights")
    k = int(keyed.count() * fraction)
    least = kth_largest(keyed, "fixed", k) if k else None
    return keyed.select(
        "doc_id",
        "log_weight",
        (F.col("fixed") / float(1 << 32)).alias("key"),
        (F.col("fixed") >= least if least is not None else F.lit(False)).alias("selected"),
    )
