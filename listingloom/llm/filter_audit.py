"""How filters overlap, audited over every order in which they may be applied.

Five filters look at a document: A too few words, B too few different words, C too many
capitals, D signs of markup, E the text of a smaller id. The audit says for every order
and step how many documents the step removes, finds removed already, removes alone, and
which labelled documents it costs.

A and B are read off a sparse document-term matrix. Scan tasks cut the documents into
shards of bounded size and write each as a CSR matrix over the shard's own words. The
words of all shards are dealt out by hash and sorted, which numbers every different word
once for the whole table; the numbers go back to the shards, whose columns are then those of
the global matrix. Row sums are word counts, nonzero counts are counts of different words.
A shard carries id, part, the other flags and the text's digest of its rows, so that no
text is read twice or shuffled.

A missing text is an empty one: it fails A alone, and E if a smaller id has an empty text.
A missing part is the empty string. A missing id is neither smaller nor larger than any
other, so it never fails E nor makes another row fail it. Rows that repeat are counted one
by one and, having one id, are no copies of each other. Several labels of one id count
together. Very long texts are read whole, a block of words at a time. An empty table has
no parts and gives no rows. Only the named columns are read, whatever else there is.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingloom.llm.common import word_blocks
from listingloom.session import stored

FILTERS = "ABCDE"
BIT = {letter: 1 << place for place, letter in enumerate(FILTERS)}
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITALS_PERCENT = 2
MARKUP = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Bytes of UTF-8 that begin no character.
CONTINUED = bytes(range(0x80, 0xC0))

# A shard is closed when it has so much text or so many documents.
SHARD_BYTES = 32 << 20
SHARD_ROWS = 1 << 16
# Words that a task numbers, on average; tasks are no more than this.
WORDS_A_TASK = 1 << 19
MOST_TASKS = 1 << 16
# Rows without an id are spread over so many keys, as none of them has a label.
NO_ID_KEYS = 1024

ROW = "STRUCT<doc_id LONG, part STRING, digest BINARY, mask INT>"
MATRIX = f"shard LONG, docs ARRAY<{ROW}>, indptr BINARY, indices BINARY, counts BINARY"
SHARDS = f"{MATRIX}, words ARRAY<BINARY>"


def text_mask(text: bytes) -> int:
    """The failures of C and D, which the text alone tells."""
    capitals = len(text) - len(text.translate(None, CAPITALS))
    characters = len(text.translate(None, CONTINUED))
    mask = BIT["C"] if 100 * capitals > CAPITALS_PERCENT * characters else 0
    return mask | (BIT["D"] if len(text.translate(None, MARKUP)) < len(text) else 0)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes."""
    return zstandard.compress(numbers.tobytes(), 1)


def unpack(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), kind)


class Shard:
    """A CSR matrix over its own words while documents are added."""

    def __init__(self, most_rows: int, most_bytes: int) -> None:
        self.most_rows, self.most_bytes = most_rows, most_bytes
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.indptr, self.indices, self.counts = [0], [], []
        self.docs: list[pa.Array] = []
        self.digests: list[bytes] = []
        self.masks: list[int] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        code = self.vocabulary.__getitem__
        found = [np.fromiter(map(code, words), np.int32, len(words)) for words in word_blocks(text)]
        columns, counts = np.unique(
            np.concatenate(found) if found else np.empty(0, np.int32), return_counts=True
        )
        self.indices.append(columns.astype(np.int32))
        self.counts.append(counts.astype(np.int32))
        self.indptr.append(self.indptr[-1] + len(columns))
        self.digests.append(hashlib.sha256(text).digest())
        self.masks.append(text_mask(text))
        self.size += len(text)

    def full(self) -> bool:
        return self.size >= self.most_bytes or len(self.indptr) > self.most_rows

    def record(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        given = pa.concat_arrays(self.docs)
        row = schema.field("docs").type.value_type
        values = [*given.flatten(), pa.array(self.digests, pa.binary()), pa.array(self.masks, pa.int32())]
        docs = pa.StructArray.from_arrays(values, fields=list(row))
        columns = [
            pa.array([number], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
            pa.array([pack(np.array(self.indptr, np.int64))], pa.binary()),
            pa.array([pack(np.concatenate(self.indices))], pa.binary()),
            pa.array([pack(np.concatenate(self.counts))], pa.binary()),
            pa.array([list(self.vocabulary)], pa.list_(pa.binary())),
        ]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def local_shards(
    docs: DataFrame, id_col: str, text_col: str, part_col: str,
    shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """CSR shards over their own words. ``indptr`` are packed 64-bit numbers, ``indices``
    and ``counts`` 32-bit ones."""
    given = pa.struct([("doc_id", pa.int64()), ("part", pa.string())])
    row = pa.struct([*given, ("digest", pa.binary()), ("mask", pa.int32())])
    schema = pa.schema(
        [("shard", pa.int64()), ("docs", pa.list_(row)), ("indptr", pa.binary()),
         ("indices", pa.binary()), ("counts", pa.binary()), ("words", pa.list_(pa.binary()))]
    )

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shard = Shard(shard_rows, shard_bytes)
        for part in parts:
            rows, start = part.column(0).cast(given), 0
            for place, text in enumerate(part.column(1)):
                shard.add(text.as_py())
                if shard.full() or place == part.num_rows - 1:
                    shard.docs.append(rows.slice(start, place + 1 - start))
                    start = place + 1
                if shard.full():
                    yield shard.record(number, schema)
                    number, shard = number + 1, Shard(shard_rows, shard_bytes)
        if shard.docs:
            yield shard.record(number, schema)

    doc = F.struct(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(doc.alias("doc"), text.alias("text"))
    return stored(rows.mapInArrow(cut, SHARDS), "csr-shards")


def numbered(words: DataFrame, tasks: int) -> DataFrame:
    """Rows with ``word`` instead of which they get ``term``, its number.

    A word's number is made of the task its hash deals it to and of its place among the
    different words there, in order; it is the same whenever it is asked for.
    """
    others = [c for c in words.columns if c != "word"]

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, last = (TaskContext.get().partitionId() << 40) - 1, None
        for part in parts:
            if not part.num_rows:
                continue
            word = part.column(part.schema.get_field_index("word"))
            fresh = np.ones(part.num_rows, np.int64)
            fresh[0] = word[0].as_py() != last
            fresh[1:] = pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
            terms = term + np.cumsum(fresh)
            term, last = int(terms[-1]), word[-1].as_py()
            columns = [part.column(part.schema.get_field_index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(terms)], names=[*others, "term"])

    types = {f.name: f.dataType.simpleString() for f in words.schema}
    schema = ", ".join([*(f"{c} {types[c]}" for c in others), "term LONG"])
    return words.repartition(tasks, "word").sortWithinPartitions("word").mapInArrow(number, schema)


def tasks_for(shards: DataFrame) -> int:
    """How many tasks number the words."""
    words = shards.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    return min(MOST_TASKS, 1 + words // WORDS_A_TASK)


def dictionary(shards: DataFrame, tasks: int) -> DataFrame:
    """``term`` and ``spelling`` of every different word of the shards."""
    words = shards.select(F.explode("words").alias("word")).distinct()
    return numbered(words.withColumn("spelling", F.col("word")), tasks)


def document_term_matrix(shards: DataFrame, tasks: int) -> DataFrame:
    """The shards with the columns of the whole table's matrix: shard, docs, indptr,
    indices, counts; ``indices`` are packed 64-bit numbers now."""
    coded = numbered(shards.select("shard", F.posexplode("words").alias("place", "word")), tasks)

    def recode(local: pa.Table, terms: pa.Table) -> pa.Table:
        numbers = np.empty(terms.num_rows, np.int64)
        numbers[terms.column("place").to_numpy()] = terms.column("term").to_numpy()
        made = [pack(numbers[unpack(i.as_py(), np.int32)]) for i in local.column("indices")]
        columns = [local.column(c) for c in ("of_shard", "docs", "indptr", "indices", "counts")]
        columns[3] = pa.array(made, pa.binary())
        return pa.table(columns, names=["shard", "docs", "indptr", "indices", "counts"])

    pieces = max(1, min(MOST_TASKS, shards.count()))
    local = shards.select(F.col("shard").alias("of_shard"), "docs", "indptr", "indices", "counts")
    both = local.repartition(pieces, "of_shard").groupBy("of_shard").cogroup(
        coded.repartition(pieces, "shard").groupBy("shard")
    )
    return both.applyInArrow(recode, MATRIX)


def row_figures(matrix: DataFrame) -> DataFrame:
    """Each document's row sum and nonzero count: doc, n_words, n_distinct."""
    schema = f"doc {ROW}, n_words LONG, n_distinct LONG"

    def figures(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            docs, indptr, counts = (part.column(part.schema.get_field_index(c)) for c in ("docs", "indptr", "counts"))
            for k in range(part.num_rows):
                ends = unpack(indptr[k].as_py(), np.int64)
                total = np.concatenate([[0], np.cumsum(unpack(counts[k].as_py(), np.int32), dtype=np.int64)])
                columns = [docs[k].values, pa.array(np.diff(total[ends])), pa.array(np.diff(ends))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_words", "n_distinct"])

    return matrix.mapInArrow(figures, schema)


def failures(docs: DataFrame, id_col: str, text_col: str, part_col: str, **sizes) -> DataFrame:
    """Documents with their failures of A to D: doc_id, part, digest, mask, n rows alike."""
    shards = local_shards(docs, id_col, text_col, part_col, **sizes)
    figures = row_figures(document_term_matrix(shards, tasks_for(shards)))
    few = F.when(F.col("n_words") < MIN_WORDS, BIT["A"]).otherwise(0)
    alike = F.col("n_distinct") * 100 < F.col("n_words") * DISTINCT_PERCENT
    mask = F.col("doc.mask") + few + F.when(alike, BIT["B"]).otherwise(0)
    rows = figures.select("doc.doc_id", "doc.part", "doc.digest", mask.alias("mask"))
    return rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))


def with_labels(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Add ``good`` and ``toxic``, false where an id has no label."""
    known = labels.groupBy(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).alias("key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    key = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NO_ID_KEYS))).otherwise(0)
    joined = rows.withColumn("key", key.cast("int")).join(known, ["doc_id", "key"], "left").drop("key")
    return joined.fillna(False, ["good", "toxic"])


def combinations(rows: DataFrame) -> DataFrame:
    """How many documents of a part fail the same filters: part, mask, good, toxic, n.

    Copies are counted before they meet: of one text a row is left for each part and
    label, so a text that fills a third of the table is no large group anywhere.
    """
    has_id = F.col("doc_id").isNotNull()
    alike = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(has_id, F.col("n"))), F.lit(0)).alias("with_id"),
        F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first"),
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    first = F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    copies = alike.withColumn("copies", F.col("with_id") - F.coalesce(first, F.lit(0)))
    both = F.array(
        F.struct((F.col("mask") + BIT["E"]).alias("mask"), F.col("copies").alias("n")),
        F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")),
    )
    split = copies.select("part", "good", "toxic", F.inline(both))
    return split.filter("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(counted: DataFrame) -> DataFrame:
    """Every order and step over the combinations of a part, at most 128 of them."""
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    ordered = counted.select("*", F.explode(orders).alias("filter_order"))
    steps = ordered.select("*", F.posexplode(F.split("filter_order", "(?<=.)(?=.)")).alias("place", "letter"))

    def bits(letters: Column) -> Column:
        found = [F.when(F.contains(letters, F.lit(c)), F.lit(b)).otherwise(0) for c, b in BIT.items()]
        return sum(found[1:], found[0])

    earlier = F.col("mask").bitwiseAND(bits(F.expr("substring(filter_order, 1, place)"))) != 0
    own = bits(F.col("letter"))
    fails = F.col("mask").bitwiseAND(own) != 0
    removed = ~earlier & fails

    def total(rows: Column, name: str) -> Column:
        return F.sum(F.when(rows, F.col("n")).otherwise(F.lit(0))).cast("long").alias(name)

    made = steps.groupBy("part", "filter_order", "place", "letter").agg(
        total(~earlier & ~fails, "kept"),
        total(removed, "removed"),
        total(earlier & fails, "redundant"),
        total(F.col("mask") == own, "unique_fails"),
        total(removed & F.col("good"), "good_lost"),
        total(removed & F.col("toxic"), "toxic_lost"),
    )
    of_filter = Window.partitionBy("part", "letter")  # 120 rows
    return made.select(
        "part",
        "filter_order",
        (F.col("place") + 1).cast("int").alias("step"),
        *("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"),
        F.sum("removed").over(of_filter).cast("long").alias("shapley"),
    )


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    part_col: str = "source", label_id_col: str = "doc_id", **sizes,
) -> DataFrame:
    """One row per part, order and step, zeros included; see the module for the cases.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley (removed by the step's filter, summed over all orders).
    """
    rows = failures(docs, id_col, text_col, part_col, **sizes)
    return audit(combinations(with_labels(rows, labels, label_id_col)))
