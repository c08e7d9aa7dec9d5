"""Language identification, words first.

A word that training texts have scores by its log frequency in each language. A word they
lack backs off to its character n-grams: the longest length at which any of its n-grams
is known decides, by their mean log frequency. A text scores the mean of its words.

Labelled rows are sampled language by language, the first of each by a hash of the id.
Every word and n-gram of the sample is kept; the sample bounds the model.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.llm.common import batches, learnable, rows, texts
from listingloom.session import stored

# Bound of the sample that is learnt from, shared out among the languages.
SAMPLE = 20_000
LONGEST = 4
REMEMBERED = 1 << 19
# Words that a text's certainty grows with.
CERTAIN_WORDS = 30
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[k : k + n] for k in range(len(padded) - n + 1)] if n > 1 else list(word)


def equal_share(sizes: list[int], total: int) -> int:
    """The largest share such that all sizes, cut to it, add up to at most ``total``; 1 at least."""
    left = total
    for k, size in enumerate(sorted(sizes)):
        share = left // (len(sizes) - k)
        if size > share:
            return max(1, share)
        left -= size
    return max(1, *sizes, 1)


def frequencies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample: int = SAMPLE,
) -> DataFrame:
    """``lang``, ``size`` (0 for words, else the n-gram's length), ``gram``, ``n``, ``total``.

    Learnt from at most ``sample`` documents (one a language at least): each language has all of its own or an equal
    share, its first by hash, and what small languages leave goes to the large ones.
    """
    known = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang")
    ).filter(learnable() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    known = stored(known.groupBy("doc_id").agg(F.min("lang").alias("lang")), "language-labels")
    sizes = {lang: n for lang, n in known.groupBy("lang").count().collect()}
    share = equal_share(list(sizes.values()), sample)
    large = sorted(lang for lang, n in sizes.items() if n > share)
    chosen = known.filter(~F.col("lang").isin(large)) if large else known
    for lang in large:
        own = known.filter(F.col("lang") == lang)
        chosen = chosen.unionByName(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(share))
    # at most ``sample`` ids
    learnt = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    schema = pa.schema(
        [("lang", pa.string()), ("size", pa.int32()), ("gram", pa.string()), ("n", pa.int64())]
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for text, lang in rows(parts, "text", "lang"):
            words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        for lang, counted in words.items():
            yield from batches(schema, ((lang, 0, word, n) for word, n in counted.items()))
            for size in range(1, LONGEST + 1):
                found: Counter = Counter()
                for word, n in counted.items():
                    for gram in grams(word, size):
                        found[gram] += n
                yield from batches(schema, ((lang, size, gram, n) for gram, n in found.items()))

    counted = stored(
        learnt.mapInArrow(run, "lang STRING, size INT, gram STRING, n LONG")
        .groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")),
        "language-counts",
    )
    totals = counted.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    return counted.join(totals, ["lang", "size"])


class Model:
    """Log frequencies of words and n-grams: their places by size, and a row for each."""

    def __init__(self, found: list[tuple[str, int, str, int, int]]) -> None:
        self.languages = sorted({lang for lang, *_ in found})
        place = {lang: k for k, lang in enumerate(self.languages)}
        totals: dict[int, np.ndarray] = {}
        for lang, size, _, _, total in found:
            totals.setdefault(size, np.ones(len(place)))[place[lang]] = total
        # half an occurrence where a language lacks what another has
        absent = {size: np.log(0.5 / total) for size, total in totals.items()}
        self.places: dict[int, dict[str, int]] = {size: {} for size in range(LONGEST + 1)}
        made: list[np.ndarray] = []
        for lang, size, gram, n, total in found:
            table = self.places[size]
            if gram not in table:
                table[gram] = len(made)
                made.append(absent[size].copy())
            made[table[gram]][place[lang]] = np.log(n / total)
        self.rows = np.array(made, np.float32).reshape(len(made), len(place))

    def word(self, word: str) -> np.ndarray:
        """Log frequencies of a word, or of its n-grams where it is unknown."""
        at = self.places[0].get(word)
        if at is not None:
            return self.rows[at]
        for size in range(LONGEST, 0, -1):
            table = self.places[size]
            seen = [table[g] for g in grams(word, size) if g in table]
            if seen:
                return self.rows[seen].sum(0) / len(seen)
        return np.zeros(len(self.languages), np.float32)


class WordTable(dict):
    """Places of the words a task has met in a growing matrix of their log frequencies."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.matrix = np.zeros((1 << 12, len(model.languages)), np.float32)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[at] = self.model.word(word)
        self[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text and any(map(str.isalpha, text)) else []
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.model.languages))
        for k in range(0, len(words), REMEMBERED // 2):  # a block's words fit the table
            block = words[k : k + REMEMBERED // 2]
            if len(self) + len(block) > REMEMBERED:
                self.clear()
            at = np.fromiter(map(self.__getitem__, block), np.int64, len(block))
            total += self.matrix[at].sum(0)
        mean = total / len(words)
        best = int(mean.argmax())  # the first by name of equal ones
        certain = np.exp((mean - mean[best]) * min(len(words), CERTAIN_WORDS))
        return self.model.languages[best], float(1 / certain.sum())


def languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample: int = SAMPLE,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score.

    ``und`` with score 0 where a text is missing or has no letter, or where no language
    could be learnt. Equal languages go by name. Repeated rows are predicted alike; an
    empty table gives no rows.
    """
    found = frequencies(docs, id_col, text_col, lang_col, sample).select("lang", "size", "gram", "n", "total")
    # what at most ``sample`` documents hold
    columns = found.toArrow().to_pydict()
    model = Model(list(zip(*columns.values())))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(model)
        made = ((doc_id, *table.predict(text)) for doc_id, text in rows(parts, "doc_id", "text"))
        yield from batches(schema, made)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id LONG, lang_pred STRING, score DOUBLE")
