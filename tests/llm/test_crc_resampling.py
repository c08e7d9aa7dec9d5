"""Resampling by prefix CRCs against building every n-gram."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from listingloom.llm import crc_resampling
from tests.llm.edge import TEXTS, edge_docs, no_docs


def grams(text):
    text = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    made = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(g.encode()) % 10_000 for g in made]


def brute(docs, target):
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for bucket in grams(text)[1]:
                counts[bucket] += 1
    total_s, total_t = sum(s), sum(t)
    gains = [
        math.floor(1000 * math.log((b + 1) * (total_s + 10_000) / ((a + 1) * (total_t + 10_000))))
        for a, b in zip(s, t)
    ]
    rows = []
    for doc_id, text in docs:
        words, found = grams(text)
        name = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"42:{name}".encode()).hexdigest()[:8], 16)
        weight = sum(gains[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, len(words)])
    able = [r for r in rows if r[5] >= 20]
    able.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, row in enumerate(able[: 5 * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def resampled(docs, target):
    return sorted((tuple(r) for r in crc_resampling.resample(docs, target).collect()), key=str)


@pytest.mark.parametrize("block", [4, 100, 1 << 19])
def test_buckets(monkeypatch, block):
    monkeypatch.setattr(crc_resampling, "BLOCK", block)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abZé9 -漢\n😀") for _ in range(rng.randint(0, 90))) for _ in range(200)]
    texts += ["", "a", "x" * 300_000 + " Y " + "z" * 70_000]
    got = {i: [] for i in range(len(texts))}
    prefixes = (crc_resampling.running_crcs(t.encode()) for t in texts)
    for doc, found in crc_resampling.feature_buckets(prefixes, 10_000, 3):
        for i, bucket in zip(doc.tolist(), found.tolist()):
            got[i].append(bucket)
    assert all(sorted(got[i]) == sorted(grams(t)[1]) for i, t in enumerate(texts))


def test_shift_is_appending_zero_bytes():
    rng = random.Random(3)
    crc = np.array([rng.getrandbits(32) for _ in range(50)], np.uint32)
    size = np.array([rng.choice([0, 1, 2, 7, 255, 256, 70_001]) for _ in range(50)])
    got = crc_resampling.shifted(crc, size)
    for c, n, after in zip(crc.tolist(), size.tolist(), got.tolist()):
        # the linear part of a CRC: what zero bytes do without its first and last inversion
        assert zlib.crc32(bytes(n), c) ^ zlib.crc32(bytes(n)) == after


def test_prefixes_over_blocks(monkeypatch):
    text = ("some Words, and more-words 12 été " * 500).encode()
    whole = crc_resampling.running_crcs(text)
    blocks = crc_resampling.word_blocks
    monkeypatch.setattr(crc_resampling, "word_blocks", lambda t: blocks(t, 50))
    assert all(np.array_equal(a, b) for a, b in zip(whole, crc_resampling.running_crcs(text)))


def test_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs, target = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    got = resampled(docs, target)
    assert got == want and sum(r[4] is not None for r in got) > 3


def test_ties_and_copies(spark):
    docs = [(i, "one two three four five " * 5) for i in range(100)] + [(1, "a b c d e " * 6)] * 60
    given = spark.createDataFrame(docs, "doc_id LONG, text STRING").repartition(5)
    target = spark.createDataFrame([("one two",), (None,)], "text STRING")
    assert resampled(given, target) == brute(docs, ["one two", None])


def test_edges(spark):
    target = spark.createDataFrame([("the end of rend",)], "item_id STRING").withColumnRenamed("item_id", "text")
    docs = edge_docs(spark)
    want = brute(TEXTS, ["the end of rend"])
    assert resampled(docs, target) == want
    clash = docs.select("*", *(F.lit(1).alias(c) for c in ("row", "eligible", "ends", "rank", "weight")))
    assert resampled(clash, target) == want
    assert resampled(docs, target.limit(0)) == brute(TEXTS, [])
    assert resampled(no_docs(spark), target) == []
