"""SimHash near-duplicates by a self-join of the fingerprints' binary trie.

A fingerprint is a path of 64 bits from the trie's root. The join walks pairs of nodes
of equal depth together. Going down by one bit adds an error where the two bits differ;
a pair with more errors than the budget is dropped with everything below it. Nodes are
ranges of a sorted array, so the trie takes eight bytes a fingerprint.

The walk over the first bits is a mask: two subtrees meet only if their prefixes differ
in at most ``budget`` bits. Every such pair of subtrees is a unit of work, and a
fingerprint is sent to the units of its prefix. Equal fingerprints are one leaf, so a
text that is copied a million times is walked once, and around one text at most 43,745
fingerprints lie within three bits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations, repeat
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.llm.common import forget, free_names, in_few_tasks, rows, texts
from listingloom.llm.components import connected_components
from listingloom.session import stored

BUDGET = 3
SHINGLE_WORDS = 3
SEED = 42
# Fingerprints of one subtree that a unit of work is laid out for.
SUBTREE = 1 << 21
SPACE = re.compile(rb"[\x20\x09-\x0D]")
BLOCK = 1 << 20
# Node pairs and leaf pairs that are looked at in one step.
STEP = 1 << 17
LEAF = 32
# Pairs of fingerprints that are compared at a time.
PAIRS = 1 << 18


# --- fingerprints -----------------------------------------------------------------


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """A text's words, in blocks of about a megabyte of text."""
    start = 0
    while start < len(data):
        end = start + BLOCK
        if end < len(data):
            cut = SPACE.search(data, end)
            end = cut.start() if cut else len(data)
        yield data[start:end].split()
        start = end


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """Majority bits over the hashes of all shingles of ``width`` words, as a signed number."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    for block in word_blocks(text.encode("utf-8", "surrogatepass").lower()):
        words = tail + block
        if len(words) >= width:
            grams = words
            for k in range(1, width):
                grams = list(map(add, map(add, grams, repeat(b" ")), words[k:]))
            n += len(grams)
            ones += _set_bits(grams)
            tail = words[len(words) - width + 1 :]
        else:
            tail = words
    if n == 0:
        if not tail:
            return 0
        n, ones = 1, _set_bits([b" ".join(tail)])
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def _set_bits(grams: list[bytes]) -> np.ndarray:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(grams), 1 << 16):
        part = grams[k : k + (1 << 16)]
        hashes = np.fromiter(
            map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part)
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.uint32)
    return ones


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash`` and ``fp``, the fingerprint as a signed 64-bit number."""
    names = ["doc_id", "text_hash", "fp"]
    schema = pa.schema([(name, pa.int64()) for name in names])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part in parts:
            fps = [fingerprint(text) for (text,) in rows(iter([part]), "text")]
            kept = [part.column(part.schema.get_field_index(name)) for name in names[:2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fps, pa.int64())], schema=schema)

    hashed = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return hashed.mapInArrow(run, "doc_id LONG, text_hash LONG, fp LONG")


# --- trie join --------------------------------------------------------------------


def trie_pairs(
    left: np.ndarray, right: np.ndarray, same: bool, depth: int, budget: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted arrays whose values differ in at most ``budget`` bits.

    ``depth`` bits are known to be equal inside each array. ``same`` says that both are
    one array, of which each pair is wanted once.
    """
    if not len(left) or not len(right):
        return
    errors = 0 if same else int(np.bitwise_count((left[0] ^ right[0]) >> np.uint64(64 - depth)))
    if errors > budget:
        return
    root = np.array([[0], [len(left)], [0], [len(right)], [errors]], np.int64)
    waiting = [(depth, root)]
    while waiting:
        depth, nodes = waiting.pop()
        if nodes.shape[1] > STEP:
            waiting += [(depth, nodes[:, STEP:]), (depth, nodes[:, :STEP])]
            continue
        small = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2]) <= LEAF
        if depth == 64:
            small[:] = True
        yield from _leaf_pairs(left, right, nodes[:, small], same, budget)
        nodes = nodes[:, ~small]
        if not nodes.shape[1]:
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        a, b = _split(left, nodes[0], nodes[1], bit), _split(right, nodes[2], nodes[3], bit)
        twin = (nodes[0] == nodes[2]) if same else np.zeros(nodes.shape[1], bool)
        below = []
        for up, down in ((0, 0), (1, 1), (0, 1), (1, 0)):
            child = np.stack(
                [a if up else nodes[0], nodes[1] if up else a, b if down else nodes[2],
                 nodes[3] if down else b, nodes[4] + (up != down)]
            )
            alive = (child[0] < child[1]) & (child[2] < child[3]) & (child[4] <= budget)
            if (up, down) == (1, 0):
                alive &= ~twin
            below.append(child[:, alive])
        waiting.append((depth + 1, np.concatenate(below, axis=1)))


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where, in each range, the values with this bit set begin."""
    first = (values[lo] & ~(bit | (bit - np.uint64(1)))) | bit
    return np.clip(np.searchsorted(values, first), lo, hi)


def _leaf_pairs(
    left: np.ndarray, right: np.ndarray, nodes: np.ndarray, same: bool, budget: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n, m = nodes[1] - nodes[0], nodes[3] - nodes[2]
    size = n * m
    for lo, hi in _slices(size, PAIRS):
        each = size[lo:hi]
        node = np.repeat(np.arange(lo, hi), each)
        k = np.arange(len(node)) - np.repeat(np.cumsum(each) - each, each)
        i, j = nodes[0][node] + k // m[node], nodes[2][node] + k % m[node]
        near = np.bitwise_count(left[i] ^ right[j]) <= budget
        if same:
            near &= i < j
        if near.any():
            yield i[near], j[near]


def _slices(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of nodes that hold about ``most`` pairs; a leaf has at most ``LEAF``."""
    if not len(size):
        return
    cut = np.searchsorted(np.cumsum(size), np.arange(most, int(size.sum()) + most, most)) + 1
    bounds = np.unique(np.concatenate([[0], np.minimum(cut, len(size)), [len(size)]]))
    yield from zip(bounds[:-1].tolist(), bounds[1:].tolist())


def local_roots(values: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of ``values`` indices is linked to."""
    root = np.arange(values)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while True:  # every index straight to its root
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    return root


def near_links(fps: DataFrame, n: int, budget: int = BUDGET) -> DataFrame:
    """Links ``a``, ``b`` that join distinct fingerprints into their groups.

    Each unit of work walks all its pairs and returns, for each linked fingerprint, the
    smallest one it reaches in the unit: the groups are those of all links, without
    writing every link of a dense group.
    """
    prefix = max(4, math.ceil(math.log2(max(n, 1) / SUBTREE)))
    masks = [sum(1 << b for b in bits) for k in range(budget + 1) for bits in combinations(range(prefix), k)]
    own = F.shiftrightunsigned("fp", 64 - prefix)
    mate = F.explode(F.array(*(F.lit(m).cast("long") for m in masks)))
    sent = fps.select("fp", own.alias("own"), mate.alias("mask")).select(
        "fp", "own", F.col("own").bitwiseXOR(F.col("mask")).alias("mate")
    )
    units = sent.select("fp", F.least("own", "mate").alias("lo"), F.greatest("own", "mate").alias("hi"))

    def join(key: tuple, unit: pa.Table) -> pa.Table:
        lo, hi = (k.as_py() for k in key)
        values = np.sort(unit.column("fp").to_numpy().view(np.uint64))
        start = np.searchsorted(values >> np.uint64(64 - prefix), np.uint64(hi))
        if lo == hi:
            found = trie_pairs(values, values, True, prefix, budget)
        else:
            met = trie_pairs(values[:start], values[start:], False, prefix, budget)
            found = ((i, j + start) for i, j in met)
        root = local_roots(len(values), found)
        linked = np.flatnonzero(root != np.arange(len(values)))
        signed = values.view(np.int64)
        return pa.table({"a": signed[linked], "b": signed[root[linked]]})

    return units.groupBy("lo", "hi").applyInArrow(join, "a LONG, b LONG")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET
) -> DataFrame:
    """One row per row of ``docs`` with the group that links lead to.

    Columns: doc_id, text_hash, fp, root (the group's smallest fingerprint as a signed
    number) and component_id, the smallest id of the group. Missing texts count as empty;
    texts without words have fingerprint zero and link like any other. A missing id is a
    ``component_id`` only where its group has no other. Repeated rows are rows of one
    group. An empty table gives no rows.
    """
    return _counted_groups(docs, id_col, text_col, budget)[0]


def _counted_groups(
    docs: DataFrame, id_col: str, text_col: str, budget: int = BUDGET
) -> tuple[DataFrame, int]:
    """:func:`near_groups` and the number of its rows."""
    marked = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    n_rows = marked.count()
    distinct = stored(in_few_tasks(first, n_rows), "distinct-fps")
    n = distinct.count()
    links = stored(near_links(distinct.select("fp"), n, budget), "near-links")
    linked = connected_components(links).withColumnRenamed("node", "fp")
    rooted = distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = rooted.join(smallest, "root").select("fp", "root", "component_id")
    of_fp = stored(in_few_tasks(of_fp, n), "fp-groups")
    return marked.join(of_fp, "fp").select("doc_id", "text_hash", "fp", "root", "component_id"), n_rows


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest id.

    A document is known by its id and the hash of its text, so missing or repeated ids do
    not pull other documents along; a row without an id stays only where no row of its group
    has one. Missing and empty texts have fingerprint zero and are near copies of each other.
    Rows that repeat are one document. Very long texts are read whole. All columns stay as
    they are, whatever their names; an empty table stays empty.
    """
    text_hash, near_id, near_hash = free_names(docs, "_text_hash", "_near_id", "_near_hash")
    found, n = _counted_groups(docs, id_col, text_col)
    groups = stored(in_few_tasks(found, n), "near-groups")
    leaders = groups.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    )
    leads = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (
        F.col("text_hash") == F.col("first.text_hash")
    )
    placed = groups.join(leaders, "root").withColumn("leads", leads)
    copies = placed.filter(~F.col("leads")).select(F.col("doc_id").alias(near_id), F.col("text_hash").alias(near_hash))
    gone = stored(in_few_tasks(copies.distinct(), n), "near-copies")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    same_row = F.col(id_col).cast("long").eqNullSafe(F.col(near_id)) & (
        F.col(text_hash) == F.col(near_hash)
    )
    left = docs.withColumn(text_hash, F.xxhash64(text)).join(gone, same_row, "left_anti")
    led = placed.filter("leads").groupBy("root").count().filter("count > 1")
    if not led.isEmpty():  # the same id and text in several rows
        left = left.dropDuplicates([id_col, text_hash])
    return left.drop(text_hash)
