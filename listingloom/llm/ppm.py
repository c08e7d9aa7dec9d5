"""Scores of texts by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to five bytes. A byte is predicted in the
longest context that was seen; if it never followed there, the model escapes to the next
shorter context, where the bytes just found missing are excluded. Escape and symbol
probabilities are those of method D: a byte seen n times among N has (2n - 1) / 2N, and
q different bytes leave q / 2N for the escape. Contexts are counted with update exclusion:
in the longest a byte counts as often as it occurs, in a shorter one once for every longer
context it occurs in. Below the empty context all bytes left are equally likely.

A text is coded in its normal form: A to Z in lower case, words joined by one space, then
a line feed as its end; before its beginning stand line feeds. All learnable texts are
learnt from, so the trie grows with the corpus; it is never in one place. Scan tasks put
documents together into chunks of bounded text. A chunk asks for each of its different
six-byte strings (five of context and the byte) once. Strings are counted over all
chunks, dealt out by the three bytes before their last, and coded there: under three bytes
lie at most 2 ** 24 strings, with all longer contexts they need. The bytes after two-byte
contexts are joined to them, those after one byte, 65,536 numbers, go to every task. The
code lengths are joined back to the chunks, which add them up by document. Word counts
for the base score take the same way.

Missing texts are empty; they consist of their end. Rows that repeat are scored one by one,
and learnt from one by one. A missing id is learnt from. Very long texts are worked through
in blocks, whole. Without learnable texts all bytes are equally likely. An empty table
gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingloom.llm.common import rows, word_blocks
from listingloom.session import stored

ORDER = 5
# Contexts that a task must have whole are those below so many bytes.
SHARED = 3
SYMBOLS = 256
END = b"\n"
# Text of a chunk, and positions worked on at once.
CHUNK_BYTES = 32 << 20
CHUNK_ROWS = 1 << 16
BLOCK = 1 << 19
# Strings that are coded together, at least, and by one task, on average.
STRINGS, STRINGS_A_TASK = 1 << 18, 1 << 19
MOST_TASKS = 1 << 16


def _held_out(id_col: str) -> Column:
    """A fifth of the ids, by checksum; a missing id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


# --- strings: contexts with the byte that follows, the byte before it first -------------


def strings(body: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The strings that end at positions ``start`` to ``stop``, as packed numbers.

    The last context byte has the highest place, so the strings of a context and of all
    contexts that end in it are neighbours: sorted, they are the trie in preorder.
    """
    out = body[start:stop].astype(np.int64)
    for back in range(1, ORDER + 1):
        out |= body[start - back : stop - back].astype(np.int64) << (8 * (ORDER - back + 1))
    return out


def shorter(keys: np.ndarray) -> np.ndarray:
    """Strings without their first byte, which is the last but one in the number."""
    return ((keys >> 16) << 8) | (keys & 255)


def blocks(body: bytes, starts: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of a chunk: first position, strings, and which positions are coded."""
    text = np.frombuffer(body, np.uint8)
    for begin in range(ORDER, len(text), block):
        stop = min(begin + block, len(text))
        coded = np.ones(stop - begin, bool)
        docs = starts[np.searchsorted(starts, begin - ORDER) : np.searchsorted(starts, stop)]
        pads = (docs[:, None] + np.arange(ORDER)).ravel() - begin
        coded[pads[(pads >= 0) & (pads < len(coded))]] = False
        yield begin, strings(text, begin, stop), coded


def distinct_strings(body: bytes, starts: np.ndarray, learnt: np.ndarray, block: int = BLOCK):
    """The different strings of a chunk and how often they occur in learnable documents."""
    merged = np.empty(0, np.int64), np.empty(0, np.int64)
    held, size = [merged], 0
    for begin, found, coded in blocks(body, starts, block):
        first = np.searchsorted(starts, begin, "right") - 1
        edges = np.append(starts[first : np.searchsorted(starts, begin + len(found))], begin + len(found))
        flags = np.repeat(learnt[first : first + len(edges) - 1], np.diff(np.maximum(edges, begin)))
        marked, times = np.unique(((found << 1) | flags)[coded], return_counts=True)
        held.append((marked >> 1, times * (marked & 1)))
        size += len(marked)
        if size > len(merged[0]) // 2 + block:
            merged = _merged(held)
            held, size = [merged], 0
    return _merged(held)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(c) for c in zip(*held))
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts, first)


# --- the trie ---------------------------------------------------------------------------


class Level:
    """The contexts of one length, with the bytes that follow them."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, counts
        self.contexts, first = np.unique(keys >> 8, return_index=True)
        self.first = first
        self.total = np.add.reduceat(counts, first) if len(first) else counts
        self.symbols = np.diff(np.append(first, len(keys)))

    def excluding(self, longer: Level) -> tuple[np.ndarray, np.ndarray]:
        """For each longer context, the counts and bytes left here without the bytes it has."""
        known = self.counts[np.searchsorted(self.keys, shorter(longer.keys))]
        parent = np.searchsorted(self.contexts, longer.contexts >> 8)
        return (
            self.total[parent] - np.add.reduceat(known, longer.first),
            self.symbols[parent] - longer.symbols,
        )


def _find(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of values, -1 where there is none."""
    if not len(sorted_values):
        return np.full(len(wanted), -1)
    place = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return np.where(sorted_values[place] == wanted, place, -1)


def levels(keys: np.ndarray, counts: np.ndarray, low: Level, after_byte: np.ndarray) -> list[Level]:
    """The trie from the longest contexts down to the empty one.

    ``keys`` holds whole subtrees below contexts of ``SHARED`` bytes, ``low`` the contexts
    one byte shorter, ``after_byte`` the counts of all bytes after each byte.
    """
    seen = counts > 0
    found = [Level(keys[seen], counts[seen])]
    for _ in range(ORDER, SHARED, -1):
        found.append(Level(*np.unique(shorter(found[-1].keys), return_counts=True)))
    found.append(low)
    one = np.flatnonzero(after_byte)
    found.append(Level(one, after_byte.ravel()[one]))
    found.append(Level(*np.unique(one & 255, return_counts=True)))
    return found


def code_lengths(keys: np.ndarray, trie: list[Level]) -> np.ndarray:
    """Log10 probability of each string's byte after its context."""
    out = np.zeros(len(keys))
    todo = np.arange(len(keys))  # strings whose byte is not found yet
    longer = np.full(len(keys), -1)  # the context before, where it was seen
    outer = None
    for back, level in enumerate(trie):
        if not len(level.contexts):
            continue
        here = keys[todo] >> (8 * back)
        here = (here & ~255) | (keys[todo] & 255)
        context = _find(level.contexts, here >> 8)
        place = _find(level.keys, here)
        total, left = level.total[context], level.symbols[context]
        if outer is not None:
            less_total, less_left = level.excluding(outer)
            total = np.where(longer >= 0, less_total[longer], total)
            left = np.where(longer >= 0, less_left[longer], left)
        alive = (context >= 0) & (left > 0)
        found = alive & (place >= 0)
        whole = level.symbols[context] == SYMBOLS  # nothing is left to escape for
        n = level.counts[place[found]]
        out[todo[found]] += np.log10(
            np.where(whole[found], n / total[found], (2 * n - 1) / (2 * total[found]))
        )
        escaped = alive & ~found
        out[todo[escaped]] += np.log10(left[escaped] / (2 * total[escaped]))
        todo, longer, outer = todo[~found], context[~found], level
    out[todo] -= math.log10(max(1, SYMBOLS - len(trie[-1].keys)))
    return out


# --- chunks -----------------------------------------------------------------------------

DOC = "STRUCT<doc_id LONG, held_out BOOLEAN>"
CHUNKS = (
    f"chunk LONG, docs ARRAY<{DOC}>, body BINARY, starts BINARY, strings ARRAY<LONG>, "
    "counts ARRAY<LONG>, words ARRAY<BINARY>, word_counts ARRAY<LONG>"
)


class Chunk:
    """Documents in normal form, one after the other, while they are put together."""

    def __init__(self, most_bytes: int = CHUNK_BYTES, block: int = BLOCK) -> None:
        self.most_bytes, self.block = most_bytes, block
        self.parts: list[bytes] = []
        self.starts = [0]
        self.docs: list[tuple[int | None, bool]] = []
        self.words = _numbering()
        self.learnt = np.zeros(1024, np.int64)
        self.learnt_docs = 0

    def add(self, doc_id: int | None, held_out: bool, text: bytes) -> None:
        size = ORDER + len(END)
        self.parts.append(END * ORDER)
        for block, words in enumerate(word_blocks(text.lower())):
            joined = (b" " if block else b"") + b" ".join(words)
            self.parts.append(joined)
            size += len(joined)
            codes = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            if len(self.learnt) < len(self.words):
                self.learnt = np.concatenate([self.learnt, np.zeros(len(self.words), np.int64)])
            if not held_out:
                times = np.bincount(codes)
                self.learnt[: len(times)] += times
        self.parts.append(END)
        self.starts.append(self.starts[-1] + size)
        self.docs.append((doc_id, held_out))

    def full(self) -> bool:
        return self.starts[-1] >= self.most_bytes or len(self.docs) >= CHUNK_ROWS

    def record(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        body, starts = b"".join(self.parts), np.array(self.starts, np.int64)
        self.parts.clear()
        learnt = np.array([not held_out for _, held_out in self.docs], np.int64)
        keys, counts = distinct_strings(body, starts[:-1], learnt, self.block)
        values = [
            number,
            [{"doc_id": i, "held_out": h} for i, h in self.docs],
            zstandard.compress(body, 3),
            starts.tobytes(),
            keys,
            counts,
            list(self.words),
            self.learnt[: len(self.words)],
        ]
        columns = [pa.array([v], f.type) for v, f in zip(values, schema)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def _numbering() -> defaultdict[bytes, int]:
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


def scan_chunks(
    docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES, block: int = BLOCK
) -> DataFrame:
    """Chunks with their documents, different strings and different words."""
    doc = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_())])
    numbers = pa.list_(pa.int64())
    schema = pa.schema(
        [("chunk", pa.int64()), ("docs", pa.list_(doc)), ("body", pa.binary()), ("starts", pa.binary()),
         ("strings", numbers), ("counts", numbers), ("words", pa.list_(pa.binary())), ("word_counts", numbers)]
    )

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().partitionId() << 32, Chunk(chunk_bytes, block)
        for part in parts:
            for doc_id, held_out, text in zip(part.column(0), part.column(1), part.column(2)):
                chunk.add(doc_id.as_py(), held_out.as_py(), text.as_py())
                if chunk.full():
                    yield chunk.record(number, schema)
                    number, chunk = number + 1, Chunk(chunk_bytes, block)
        if chunk.docs:
            yield chunk.record(number, schema)

    given = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        _held_out(id_col).alias("held_out"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    return stored(given.mapInArrow(scan, CHUNKS), "text-chunks", compression="zstd")


def without_first(key: str) -> Column:
    """:func:`shorter` for a column."""
    kept = F.shiftleft(F.shiftright(key, 16), 8)
    return kept.bitwiseOR(F.col(key).bitwiseAND(F.lit(255)))


def coded_strings(counted: DataFrame, at_once: int = STRINGS) -> DataFrame:
    """``key`` and ``value``, the log10 probability of every string of ``key`` and ``n``."""
    cut = 8 * (ORDER - SHARED)
    symbol = F.col("key").bitwiseAND(F.lit(255))
    shared = F.shiftleft(F.shiftright("key", cut + 8), 8).bitwiseOR(symbol)
    known = counted.filter("n > 0").select(shared.alias("key")).distinct()
    two = known.groupBy(without_first("key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    two = stored(two, "contexts-of-two")
    one = two.groupBy(without_first("key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    after_byte = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    for key, n in one.collect():  # at most 65,536 rows
        after_byte[key >> 8, key & 255] = n

    def code(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_subtrees(parts, at_once):
            group, low, keys, counts = part
            low_keys, first = np.unique(keys[low], return_index=True)
            two = Level(low_keys, counts[low][first])
            keys, counts = keys[~low], counts[~low]
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            found = code_lengths(keys, levels(keys, counts, two, after_byte))
            for begin in range(0, len(keys), STRINGS):
                columns = [pa.array(x[begin : begin + STRINGS]) for x in (keys, found)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "value"])

    high = counted.select(F.shiftright("key", cut + 8).alias("group"), F.lit(False).alias("low"), "key", "n")
    # a group meets the bytes after its last two: at most 256 rows for each group
    low = (
        high.select("group").distinct().withColumn("two", F.shiftright("group", 8))
        .join(two.withColumn("two", F.shiftright("key", 8)), "two")
        .select("group", F.lit(True).alias("low"), "key", "n")
    )
    tasks = min(MOST_TASKS, 1 + counted.count() // STRINGS_A_TASK)
    dealt = high.unionByName(low).repartition(tasks, "group").sortWithinPartitions("group")
    return dealt.mapInArrow(code, "key LONG, value DOUBLE")


def whole_subtrees(parts: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows sorted by group, in blocks that hold whole groups."""
    held: list[list[np.ndarray]] = []
    size = 0
    for part in parts:
        if not part.num_rows:
            continue
        here = [c.to_numpy(zero_copy_only=False) for c in part.columns]
        ends = np.flatnonzero(np.diff(here[0])) + 1
        if held and held[-1][0][-1] != here[0][0]:
            ends = np.insert(ends, 0, 0)
        if len(ends) and size + ends[-1] >= at_once:
            held.append([c[: ends[-1]] for c in here])
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, size = [], 0
            here = [c[ends[-1] :] for c in here]
        held.append(here)
        size += len(here[0])
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


SCORES = "doc_id LONG, held_out BOOLEAN, n_tokens LONG, n_known LONG, base_score DOUBLE, score DOUBLE"


def text_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES, block: int = BLOCK, at_once: int = STRINGS,
) -> DataFrame:
    """One row per row of ``docs`` with its log10 probability under the pretrained model.

    Columns: doc_id, held_out, n_tokens (words and the end), n_known (those that learnable
    documents have), train_tokens, base_score (each token by its share of the learnable
    tokens, half a count added), score.
    """
    chunks = scan_chunks(docs, id_col, text_col, chunk_bytes, block)
    asked = chunks.select("chunk", F.inline(F.arrays_zip("strings", "counts")))
    asked = asked.withColumnsRenamed({"strings": "key", "counts": "n"})
    counted = stored(asked.groupBy("key").agg(F.sum("n").alias("n")), "strings", compression="zstd")
    lengths = asked.select("chunk", "key").join(coded_strings(counted, at_once), "key")

    words = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "word_counts")).alias("place", "word"))
    same = Window.partitionBy("word.words")  # a row for each chunk that has the word
    known = stored(
        words.select(
            "chunk",
            "place",
            F.col("word.word_counts").alias("own"),
            F.sum("word.word_counts").over(same).alias("n"),
            (F.min("chunk").over(same) == F.col("chunk")).alias("first"),
        ),
        "word-counts",
        compression="zstd",
    )
    learnt_docs = F.size(F.filter("docs", lambda d: ~d["held_out"]))
    sums = chunks.agg(
        F.coalesce(F.sum(learnt_docs), F.lit(0)).alias("ends"), F.count(F.lit(1)).alias("chunks")
    ).first()
    tokens, types = known.filter("first").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    tokens, types = tokens + sums["ends"], types + (sums["ends"] > 0)
    below = tokens + 0.5 * (types + 1)
    # a word's place below zero tells it from a string; a word that no other chunk has learnt
    # needs no answer, as its chunk knows its count
    place, count = -1 - F.col("place").cast("long"), F.col("n").cast("double")
    answers = lengths.select("chunk", "key", "value").unionByName(
        known.filter("n <> own").select("chunk", place.alias("key"), count.alias("value"))
    )

    def score(texts: pa.Table, answered: pa.Table) -> pa.Table:
        keys, values = (answered.column(c).to_numpy() for c in ("key", "value"))
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        words = np.searchsorted(keys, 0)  # they stand first
        made = []
        for batch in texts.to_batches():
            own = batch.column(batch.schema.get_field_index("word_counts")).values
            known = own.to_numpy().astype(float)
            known[-1 - keys[:words]] = values[:words]
            made.append(_scored(batch, keys[words:], values[words:], known, sums["ends"], below, block))
        return pa.Table.from_batches(made)

    tasks = max(1, min(MOST_TASKS, sums["chunks"]))
    bodies = chunks.select(F.col("chunk").alias("of_chunk"), "docs", "body", "starts", "word_counts")
    answered = answers.repartition(tasks, "chunk").groupBy("chunk")
    scored = bodies.repartition(tasks, "of_chunk").groupBy("of_chunk").cogroup(answered)
    return scored.applyInArrow(score, SCORES).select(
        "doc_id", "held_out", "n_tokens", "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def _scored(
    chunk: pa.RecordBatch, keys: np.ndarray, values: np.ndarray, known: np.ndarray, ends: int, below: float, block: int
) -> pa.RecordBatch:
    """A chunk's documents with the answers for its strings and words added up."""
    (docs, body, packed) = next(rows(iter([chunk]), "docs", "body", "starts"))
    starts, body = np.frombuffer(packed, np.int64), zstandard.decompress(body)
    score = np.zeros(len(docs))
    for begin, found, coded in blocks(body, starts[:-1], block):
        lengths = np.where(coded, values[np.minimum(np.searchsorted(keys, found), len(keys) - 1)], 0.0)
        first = np.searchsorted(starts, begin, "right") - 1
        last = np.searchsorted(starts[:-1], begin + len(found))
        cuts = np.maximum(starts[first:last], begin) - begin
        score[first:last] += np.add.reduceat(lengths, cuts)
    share = np.log10((known + 0.5) / below)
    end_share = math.log10((ends + 0.5) / below)
    numbers = _numbering()  # words get the numbers that the scan gave them
    n_tokens, n_known, base = [], [], []
    for start, stop in zip(starts[:-1], starts[1:]):
        tokens, seen, total = 1, int(ends > 0), end_share
        for words in word_blocks(body[start + ORDER : stop - 1]):
            codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            tokens += len(codes)
            seen += int(np.count_nonzero(known[codes]))
            total += float(share[codes].sum())
        n_tokens.append(tokens)
        n_known.append(seen)
        base.append(total)
    columns = [
        pa.array([d["doc_id"] for d in docs], pa.int64()),
        pa.array([d["held_out"] for d in docs], pa.bool_()),
        pa.array(n_tokens, pa.int64()),
        pa.array(n_known, pa.int64()),
        pa.array(base, pa.float64()),
        pa.array(score),
    ]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    return pa.RecordBatch.from_arrays(columns, names=names)


# --- adaptive ---------------------------------------------------------------------------


class AdaptiveTrie:
    """A trie that learns every byte right after coding it, starting with nothing."""

    def __init__(self, order: int = ORDER) -> None:
        self.order = order
        self.nodes: defaultdict[bytes, dict[int, int]] = defaultdict(dict)

    def code(self, context: bytes, symbol: int) -> float:
        """Log10 probability of a byte after a context, which the trie then knows."""
        total, excluded, found = 0.0, frozenset(), 0
        for size in range(self.order, -1, -1):
            seen = self.nodes.get(context[len(context) - size :], {})
            left = {s: n for s, n in seen.items() if s not in excluded}
            if not left:
                continue
            n_all = sum(left.values())
            if symbol in left:
                n = left[symbol]
                total += math.log10(n / n_all if len(seen) == SYMBOLS else (2 * n - 1) / (2 * n_all))
                found = size
                break
            total += math.log10(len(left) / (2 * n_all))
            excluded = frozenset(seen)
        else:
            total -= math.log10(SYMBOLS - len(excluded))
        # shorter contexts than the one it was found in do not learn it again
        for size in range(found, self.order + 1):
            here = self.nodes[context[len(context) - size :]]
            here[symbol] = here.get(symbol, 0) + 1
        return total


def adaptive_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, each text's log10 probability under a model of itself alone.

    The trie of a text holds at most six contexts for each of its bytes.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            scores = []
            for (text,) in rows(iter([part]), "text"):
                trie = AdaptiveTrie()
                body = END * ORDER + b" ".join((text or b"").lower().split()) + END
                places = range(ORDER, len(body))
                scores.append(sum(trie.code(body[p - ORDER : p], body[p]) for p in places))
            columns = [part.column(0), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score"])

    given = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    return given.mapInArrow(run, "doc_id LONG, score DOUBLE")
