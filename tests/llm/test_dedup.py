"""Exact and near duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from listingloom.llm import components, exact_dedup, simhash_trie
from tests.llm.edge import TEXTS, edge_docs, no_docs


def exact_brute(pairs):
    groups = {}
    for doc_id, text in pairs:
        groups.setdefault(text or "", []).append(doc_id)
    made = []
    for doc_id, text in pairs:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256((text or "").encode()).hexdigest()
        made.append((doc_id, keep, len(ids), doc_id == keep, sha))
    return sorted(made, key=str)


def exact_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_exact_edges(spark):
    assert exact_rows(exact_dedup.exact_duplicates(edge_docs(spark))) == exact_brute(TEXTS)
    assert exact_dedup.exact_duplicates(no_docs(spark)).count() == 0


def test_exact_with_forced_collisions_and_full_buckets(spark):
    """Keys of five bits: texts share keys and are chained; buckets split to their limit."""
    random.seed(3)
    pairs = [(k, f"text {random.randrange(150)}") for k in range(600)]
    docs = spark.createDataFrame(pairs, "doc_id LONG, text STRING").repartition(7)
    index = exact_dedup.build_index(docs, max_entries=4, key_bits=5)
    assert index.agg(F.max("chain")).first()[0] > 0
    assert index.groupBy("key").agg(F.count_distinct("bucket").alias("n")).filter("n > 1").isEmpty()
    assert index.select("bucket").distinct().count() > 4
    found = exact_dedup.exact_duplicates(docs, max_entries=4, key_bits=5)
    assert exact_rows(found) == exact_brute(pairs)


def test_directory_doubles_and_shares_buckets():
    entries = np.zeros(1 << 6, np.int64)
    entries[:4] = 3  # all keys begin with 0000
    directory = exact_dedup.grow_directory(entries, entries * 10, 5, 1 << 30)
    assert directory.depth == 6
    assert len(set(directory.slots.tolist())) == len(directory.local_depth) < 64
    assert min(directory.local_depth) == 1  # the half without keys is one bucket
    keys = np.array([0, 1 << 58, -1], np.int64)
    assert len(set(directory.bucket(keys).tolist())) == 3


def test_drop_copies(spark):
    docs = edge_docs(spark)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    rows = [(r.doc_id, r.text or "") for r in left.collect()]
    assert sorted(t for _, t in rows) == sorted({t or "" for _, t in TEXTS})
    assert (2, TEXTS[0][1]) in rows and (4, "") in rows
    assert exact_dedup.drop_copies(no_docs(spark)).count() == 0


def fingerprint_brute(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
    shingles = shingles or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, monkeypatch):
    short = [t for t in TEXTS if len(t[1] or "") < 1000]
    want = sorted((str(i), fingerprint_brute(t)) for i, t in short)
    got = simhash_trie.fingerprints(edge_docs(spark, short)).collect()
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1) for r in got) == want
    # a text read in many blocks
    text = " ".join(random.Random(5).choices(["Ab", "cd", " x", "É"], k=3000))
    monkeypatch.setattr(simhash_trie, "BLOCK", 64)
    assert simhash_trie.fingerprint(text) & (1 << 64) - 1 == fingerprint_brute(text)


def near_brute(fps):
    values = np.array(fps, np.uint64)
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3).tolist():
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def clustered(n, seed):
    """Random values, clusters around some of them, chains, and values that share prefixes."""
    rnd = random.Random(seed)
    made = {rnd.getrandbits(64) for _ in range(n)}
    for value in list(made)[: n // 10]:
        for _ in range(rnd.randrange(12)):
            value = value ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))
            made.add(value)
    made |= {0, (1 << 64) - 1, 7, 15, 1 << 63}
    made |= {(0xABCD << 48) | rnd.getrandbits(20) for _ in range(n // 5)}
    return sorted(made)


def test_trie_join_finds_every_link(spark):
    fps = clustered(700, 1)
    signed = [int(np.uint64(v).view(np.int64)) for v in fps]
    values = np.array(fps, np.uint64)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= 3}
    got = {(int(i), int(j)) for a, b in simhash_trie.trie_pairs(values, values, True, 0, 3) for i, j in zip(a, b)}
    assert got == want
    frame = spark.createDataFrame([(v,) for v in signed], "fp LONG")
    roots = components.connected_components(simhash_trie.near_links(frame, len(fps)))
    of = {r.node: r.root for r in roots.collect()}
    label = near_brute(fps)
    groups = {}
    for k, v in enumerate(signed):
        groups.setdefault(label[k], set()).add(of.get(v, v))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    loop = [(-5, -5), (-5, -6), (-6, -5)]
    links = spark.createDataFrame(chain + star + loop, "a LONG, b LONG")
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    want = {k: 0 for k in range(41)} | {1000 + k: 1000 for k in range(300)} | {-5: -6, -6: -6}
    assert got == want
    assert components.connected_components(links.limit(0)).count() == 0


def test_few_rows_are_written_by_few_tasks(spark):
    """However many tasks a shuffle has."""
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 300, 3)], "a LONG, b LONG")
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(name) for name in names]
    try:
        for name, value in zip(names, ("false", "40")):
            spark.conf.set(name, value)
        found = components.connected_components(links)
        assert len(found.inputFiles()) == 1
        assert {r.node: r.root for r in found.collect()} == {k + i: k for k in range(0, 300, 3) for i in (0, 1)}
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def test_near_edges(spark):
    docs = edge_docs(spark)
    rows = simhash_trie.near_groups(docs).collect()
    assert len(rows) == len(TEXTS)
    of = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert of[1] == of[2] == 1 and of[3] == of[4] == of[5] == of[8] == 3
    left = simhash_trie.drop_near_copies(docs)
    assert left.columns == docs.columns
    kept = sorted((r.doc_id or 0, (r.text or "")[:5]) for r in left.collect())
    assert len(kept) == len({r.root for r in rows})
    assert (1, "One t") in kept and (3, "") in kept and (0, "a row") in kept
    assert simhash_trie.drop_near_copies(no_docs(spark)).count() == 0
