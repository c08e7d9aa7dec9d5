"""Prediction by partial matching against a trie of dictionaries that reads letter by letter."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from listingloom.llm import ppm
from tests.llm.edge import edge_docs, no_docs

ORDER = 5
WORDS = [
    (1, "The cat sat on the mat."),
    (2, "the dog sat on\tthe  log"),
    (3, "a cat, a dog and a log"),
    (4, "zebra crossing near the mat"),
    (5, None),
    (6, "the cat sat on the mat and the dog sat on the cat " * 30),
    (7, "Ünïcödé wörds 漢字"),
    (8, "\x00 the \x00\x01 end"),
] + [(i, f"word{i % 7} and text{i % 5} of the {'cat' if i % 3 else 'dog'}") for i in range(9, 60)]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def normal(text):
    return b" ".join((text or "").encode().lower().split()) + b"\n"


def brute(pairs):
    """Scores of texts by walking contexts one by one."""
    longest = defaultdict(Counter)
    for doc_id, text in pairs:
        if not held(doc_id):
            body = b"\n" * ORDER + normal(text)
            for p in range(ORDER, len(body)):
                longest[body[p - ORDER : p]][body[p]] += 1
    tables = {ORDER: longest}
    for size in range(ORDER - 1, -1, -1):
        tables[size] = defaultdict(Counter)
        for context, seen in tables[size + 1].items():
            for symbol in seen:
                tables[size][context[1:]][symbol] += 1

    def probability(context, symbol):
        p, out = 1.0, set()
        for size in range(ORDER, -1, -1):
            seen = tables[size].get(context[ORDER - size :], {})
            left = {s: n for s, n in seen.items() if s not in out}
            if not left:
                continue
            below = 2 * sum(left.values())
            if symbol in left:
                return p * (2 * left[symbol] - 1) / below
            p *= len(left) / below
            out = set(seen)
        return p / (256 - len(out))

    words = Counter()
    ends = 0
    for doc_id, text in pairs:
        if not held(doc_id):
            words.update((text or "").encode().lower().split())
            ends += 1
    n, v = sum(words.values()) + ends, len(words) + (ends > 0)
    made = []
    for doc_id, text in pairs:
        body = b"\n" * ORDER + normal(text)
        score = sum(math.log10(probability(body[p - ORDER : p], body[p])) for p in range(ORDER, len(body)))
        tokens = [words[w] for w in (text or "").encode().lower().split()] + [ends]
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in tokens)
        made.append((doc_id, held(doc_id), len(tokens), sum(c > 0 for c in tokens), n, base, score))
    return made


def same(got, want):
    def key(r):
        return str(r[0]), r[2], round(r[5], 5)

    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 300, "block": 50, "at_once": 1}, {"block": 7, "at_once": 100}])
def test_scores(spark, sizes):
    docs = spark.createDataFrame(WORDS, "doc_id LONG, text STRING").repartition(3)
    same(ppm.text_scores(docs, **sizes).collect(), brute(WORDS))


def test_small_chunks_and_subtrees():
    """Cutting into chunks and blocks changes no string and no code length."""
    chunk = ppm.Chunk()
    for doc_id, text in WORDS:
        chunk.add(doc_id, held(doc_id), (text or "").encode())
    body, starts = b"".join(chunk.parts), np.array(chunk.starts[:-1])
    learnt = np.array([not h for _, h in chunk.docs], np.int64)
    whole = ppm.distinct_strings(body, starts, learnt)
    for size in (3, 50, 1000):
        cut = ppm.distinct_strings(body, starts, learnt, size)
        assert all(np.array_equal(a, b) for a, b in zip(whole, cut))


def test_probabilities_add_up(spark):
    """After any context the bytes' probabilities make one."""
    docs = spark.createDataFrame(WORDS, "doc_id LONG, text STRING")
    chunks = ppm.scan_chunks(docs, "doc_id", "text")
    asked = chunks.select(F.inline(F.arrays_zip("strings", "counts")))
    counted = asked.groupBy(F.col("strings").alias("key")).agg(F.sum("counts").alias("n"))
    contexts = counted.select(F.shiftright("key", 8).alias("c")).distinct().orderBy("c").limit(40)
    extra = contexts.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda s: F.shiftleft("c", 8) + s)).alias("key"),
        F.lit(0).cast("long").alias("n"),
    )
    counted = counted.unionByName(extra).groupBy("key").agg(F.sum("n").alias("n"))
    coded = ppm.coded_strings(counted)
    sums = coded.groupBy(F.shiftright("key", 8).alias("c")).agg(
        F.sum(F.pow(F.lit(10.0), "value")).alias("p"), F.count(F.lit(1)).alias("n")
    )
    rows = sums.filter("n = 256").collect()
    assert len(rows) == 40 and all(r["p"] == pytest.approx(1.0) for r in rows)


def test_edges(spark):
    pairs = [(r.doc_id, r.text) for r in edge_docs(spark).collect()]
    short = [(i, t) for i, t in pairs if len(t or "") < 1000]
    docs = spark.createDataFrame(short, "doc_id LONG, text STRING")
    same(ppm.text_scores(docs).collect(), brute(short))
    assert ppm.text_scores(edge_docs(spark)).count() == len(pairs)
    assert ppm.text_scores(no_docs(spark)).collect() == []


def test_nothing_to_learn(spark):
    ids = [i for i in range(200) if held(i)][:3]
    docs = spark.createDataFrame([(i, "ab") for i in ids], "doc_id LONG, text STRING")
    for row in ppm.text_scores(docs).collect():
        assert row.train_tokens == 0 and row.n_known == 0
        assert row.score == pytest.approx(-3 * math.log10(256))


def test_better_than_words(spark):
    """On held-out documents of known words the trie beats the word shares."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in ppm.text_scores(docs).collect() if r.held_out and r.n_known == r.n_tokens]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_adaptive(spark):
    texts = [(1, "ab " * 50), (2, "abracadabra"), (3, None), (3, None), (None, "x")]
    got = ppm.adaptive_scores(spark.createDataFrame(texts, "doc_id LONG, text STRING")).collect()
    by_id = {r.doc_id: r.score for r in got}
    assert len(got) == 5 and by_id[3] == pytest.approx(-math.log10(256))
    # "x" is new, then its end: nothing but x followed the empty context, a half is left for others
    assert by_id[None] == pytest.approx(-math.log10(256) + math.log10(0.5 / 255))
    assert by_id[1] / 150 > by_id[2] / 12  # what repeats costs less a byte
    assert ppm.adaptive_scores(no_docs(spark)).collect() == []
