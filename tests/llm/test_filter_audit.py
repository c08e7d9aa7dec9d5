"""The filter audit against a loop over documents, orders and steps."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from listingloom.llm import filter_audit
from listingloom.llm.common import word_blocks
from tests.llm.edge import TEXTS, edge_docs, no_docs

LABELS = "doc_id LONG, quality INT, toxic INT"


def brute(docs, labels):
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for doc_id, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ""
        fails += "A" * (len(words) < 200)
        fails += "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
        fails += "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * (doc_id is not None and doc_id > first[text])
        parts.setdefault(part or "", []).append((set(fails), doc_id in good, doc_id in toxic))
    made = []
    for part, rows in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        here = []
        for order in permutations("ABCDE"):
            left = rows
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[0]]
                again = sum(letter in r[0] for r in rows) - len(gone)
                left = [r for r in left if letter not in r[0]]
                removed_by[letter] += len(gone)
                here.append(
                    (part, "".join(order), step, len(left), len(gone), again,
                     sum(r[0] == {letter} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))
                )
        made += [(*h, removed_by[h[1][h[2] - 1]]) for h in here]
    return sorted(made)


def audited(spark, docs, labels, **sizes):
    given = spark.createDataFrame(docs, "doc_id LONG, text STRING, source STRING").repartition(3)
    known = spark.createDataFrame(labels, LABELS)
    return sorted(map(tuple, filter_audit.filter_audit(given, known, **sizes).collect()))


def some_docs(n=400):
    rng = random.Random(5)
    docs = []
    for i in range(n):
        words = [rng.choice(["alpha", "Beta", "gamma", "x#y", "é", "DELTA", str(rng.random())]) for _ in range(rng.choice([0, 5, 199, 200, 250]))]
        docs.append((i, rng.choice([" ", "\t\n", "  "]).join(words), rng.choice(["a", "b", None, ""])))
    docs += [(n + i, docs[rng.randrange(n)][1], "copies") for i in range(100)]
    docs += [(7, docs[7][1], docs[7][2]), (None, docs[3][1], "a"), (None, None, "a"), (n + 500, None, "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, n, 2)]
    return docs, labels + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (99_999, 1, 1)]


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 7}, {"shard_bytes": 5000}])
def test_against_loops(spark, sizes):
    docs, labels = some_docs()
    assert audited(spark, docs, labels, **sizes) == brute(docs, labels)


def test_one_text_everywhere(spark):
    docs = [(i, "same text", "s" if i % 2 else "t") for i in range(3000)]
    assert audited(spark, docs, [(1, 1, 1)]) == brute(docs, [(1, 1, 1)])


def test_edges(spark):
    labels = spark.createDataFrame([], LABELS)
    docs = edge_docs(spark)
    got = sorted(map(tuple, filter_audit.filter_audit(docs, labels).collect()))
    assert got == brute([(i, t, None) for i, t in TEXTS], [])
    clash = docs.select("*", *(F.lit(1).alias(c) for c in ("doc", "mask", "part", "digest", "n", "good", "toxic")))
    assert sorted(map(tuple, filter_audit.filter_audit(clash, labels).collect())) == got
    assert filter_audit.filter_audit(no_docs(spark), labels).collect() == []


def test_matrix_is_the_term_counts(spark):
    """Global columns: the same word has the same number in every shard."""
    docs, _ = some_docs(60)
    given = spark.createDataFrame(docs, "doc_id LONG, text STRING, source STRING").repartition(4)
    shards = filter_audit.local_shards(given, "doc_id", "text", "source", shard_rows=5)
    terms = filter_audit.dictionary(shards, 3)
    matrix = filter_audit.document_term_matrix(shards, 3).collect()
    word = {r.term: bytes(r.spelling) for r in terms.collect()}
    assert len(matrix) > 4 and len(set(word.values())) == len(word)
    found = []
    for shard in matrix:
        ends = filter_audit.unpack(shard.indptr, np.int64)
        columns = filter_audit.unpack(shard.indices, np.int64)
        counts = filter_audit.unpack(shard.counts, np.int32)
        for k, doc in enumerate(shard.docs):
            row = range(ends[k], ends[k + 1])
            found.append((bytes(doc.digest), sorted((word[columns[j]], int(counts[j])) for j in row)))
    want = []
    for _, text, _ in docs:
        words = (text or "").encode().split()
        want.append((hashlib.sha256((text or "").encode()).digest(), sorted((w, words.count(w)) for w in set(words))))
    assert sorted(found) == sorted(want)


def test_word_blocks():
    rng = random.Random(1)
    for size in (1, 3, 10, 1 << 20):
        for _ in range(200):
            text = "".join(rng.choice("ab \t\n\x0b\x1cé\x85") for _ in range(rng.randint(0, 40))).encode()
            blocks = list(word_blocks(text, size))
            assert [w for b in blocks for w in b] == re.findall(rb"[^\x20\x09-\x0D]+", text)
            assert all(blocks)
