"""Toxicity of texts whose words may be disguised.

Restoring is decoding a noisy channel. A disguised word is a lattice: every symbol it is
written with may stand for some letters, a repeated letter may be superfluous, a sign
between letters may be nothing or a word break. The Viterbi path through the lattice is
the likeliest one under a model of four-character sequences, counted over all texts.
Words of plain letters without a doubled one have a single path and are left as they are.
White space may be a sign between letters too: runs of chunks of one to three symbols go
through the lattice as a whole. What is scored are the words as written and as restored.

Restored words are then scored: a word's evidence is the largest log odds of its parts
(the word, its beginnings, its endings), by the share of toxic and of other learnable
documents that have them, and a document's score is a logistic function of its
strongest words.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingloom.llm.common import batches, forget, free_names, kept_by_worker, learnable, rows, sliced, texts
from listingloom.session import stored

THRESHOLD = 0.3
# Bounds of the sample that the classifier is fitted on, which bound its parts as well.
TOXIC_SAMPLE, OTHER_SAMPLE = 4_000, 16_000
MIN_TOXIC = 2
# Tokens whose evidence a worker remembers, each time two generations of so many.
REMEMBERED = 1 << 18
# Restored words, and ways through a chunk, that a worker remembers.
RESTORED, WAYS, LONG_RUN = 1 << 17, 1 << 17, 64
# Beginnings of runs, of two chunks, whose paths a worker remembers.
BEGUN = 1 << 14
# Tokens whose parts a task remembers.
PARTS = 1 << 16

# Symbols and the letters they stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
    "*": "aeiou", "#": "h",
}
JOINERS = " .-_*'~"
EDGES = ".,;:?\"()[]{}<>«»„“”…'`-_~/\\#&%="
# Edges that may be letters as well.
PLAIN_EDGES = "".join(c for c in EDGES if c not in LEET)
# Runs of chunks of one to three symbols, possessive, so that long gaps are read once.
CHUNK = r"(?:[^\W_]|[@$!|+*€]){1,3}+(?![\w@$!|+*€])"
GAP = r"(?:\s++(?:[._*~-]\s*+)?|[._*~-]\s*+)"
RUN = re.compile(rf"""(?<![^\s"'`([{{<«„“‘‚‹]){CHUNK}(?:{GAP}{CHUNK})+""")
# The same where there is no underscore, as one set of symbols, which is read faster.
PLAIN_CHUNK = r"[\w@$!|+*€]{1,3}+(?![\w@$!|+*€])"
PLAIN_RUN = re.compile(rf"""(?<![^\s"'`([{{<«„“‘‚‹]){PLAIN_CHUNK}(?:{GAP}{PLAIN_CHUNK})+""")
CHUNKS, GAPS = re.compile(CHUNK), re.compile(GAP)
# Within a run, words spelt out symbol by symbol are read on their own as well.
SPELT = re.compile(rf"(?<!\w)[^\s._~-](?!\w)(?:{GAP}[^\s._~-](?!\w)){{2,}}")
LETTERS = re.compile(r"[^\W\d_]+")
DOUBLE = re.compile(r"(.)\1")
# Letters that all have a class, and a few signs behind them.
LATIN = re.compile(r"([a-zà-öø-ÿ]*+)([^\w\s]{0,6}+)")
SPACE_IN = re.compile(r"\s")

# Costs of the channel, as log probabilities.
AS_IS, FOR_LETTER, DROP_SIGN, BREAK, DROP_REPEAT, KEEP_REPEAT = 0.0, -1.0, -0.5, -2.0, -0.7, -0.7
# White space next to a chunk of several symbols is a break more often than nothing.
DROP_SPACE, SPACE = -1.5, -0.2
# By kind of gap, nothing and a break; 0 is no gap.
GAP_COSTS = [(0.0, 0.0), (DROP_SIGN, BREAK), (DROP_SPACE, SPACE)]
REPEATS = len(GAP_COSTS)

# Character classes: 0 is no letter, 1 to 26 are a to z without accents, 27 other letters.
CLASSES = 28
GRAMS, STATES = CLASSES**4, CLASSES**3


def class_table() -> np.ndarray:
    table = np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        letter = chr(code).lower()
        base = unicodedata.normalize("NFKD", letter)[:1]
        if "a" <= base <= "z":
            table[code] = ord(base) - 96
        elif letter.isalpha():
            table[code] = 27
    return table


# --- character model --------------------------------------------------------------


def _blocks(texts_: Iterator[str], size: int = 1 << 20) -> Iterator[str]:
    """Texts set apart by a line break, in blocks of about a million characters."""
    pending, weight = [], 0
    for text in texts_:
        for k in range(0, len(text), size):
            pending.append(text[k : k + size])
            weight += len(pending[-1])
            if weight >= size:
                yield "\n".join(pending)
                pending, weight = [], 0
    if pending:
        yield "\n".join(pending)


def gram_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``gram`` and ``n``: four-character sequences over all texts, counted per task first."""
    schema = pa.schema([("gram", pa.int32()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # a new model begins, for which nothing is known of words
        table, counts = class_table(), np.zeros(GRAMS, np.int64)
        for block in _blocks(text for (text,) in rows(parts, "text")):
            units = np.frombuffer(block.encode("utf-16-le", "surrogatepass"), np.uint16)
            classes = np.concatenate([[0], table[units], [0]]).astype(np.int32)
            classes = classes[(classes > 0) | (np.roll(classes, 1) > 0)]
            classes = np.concatenate([[0, 0, 0], classes])
            grams = classes[:-3]
            for later in (classes[1:-2], classes[2:-1], classes[3:]):
                grams = grams * CLASSES + later
            counts += np.bincount(grams, minlength=GRAMS)
        seen = np.flatnonzero(counts)
        columns = [pa.array(seen.astype(np.int32)), pa.array(counts[seen])]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    counted = texts(docs, id_col, text_col).mapInArrow(run, "gram INT, n LONG")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def character_model(counts: DataFrame) -> np.ndarray:
    """Log probability of each class after three others; a table of fixed size."""
    found = counts.toPandas()
    four = np.zeros(GRAMS)
    four[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    four = four.reshape((CLASSES,) * 4)
    three, two, one = four.sum(0), four.sum((0, 1)), four.sum((0, 1, 2))
    p = (one + 1) / (one.sum() + CLASSES)
    for n in (two, three, four):
        p = (n + 8 * p) / (n.sum(-1, keepdims=True) + 8)
    return np.log(p).astype(np.float32)


class Classes(dict):
    """The class of each character that is met."""

    def __init__(self) -> None:
        super().__init__()
        self.table = class_table()

    def __missing__(self, letter: str) -> int:
        code = ord(letter)
        self[letter] = int(self.table[code]) if code < 1 << 16 else 27 * letter.isalpha()
        return self[letter]


class Plain(Classes):
    """The class of each letter that is met; 0 for what is no letter."""

    def __missing__(self, symbol: str) -> int:
        c = super().__missing__(symbol)
        self[symbol] = c if symbol.isalpha() else 0
        return self[symbol]


# Where ways through a chunk end, their scores and their letters.
Ways = tuple[tuple[int, ...], tuple[float, ...], tuple[str, ...]]


class Restorer:
    """Viterbi decoding of disguised words under a character model."""

    def __init__(self, model: np.ndarray) -> None:
        # read entry by entry, which a list does several times faster than an array
        values, places = np.unique(model, return_inverse=True)
        values = values.tolist()  # one object for equal entries, which are half of them
        self.model = [values[k] for k in places.reshape(-1)]
        self.classes, self.plain = Classes(), Plain()
        self.choices: dict[str, list[tuple[str, float]]] = {}
        self.restored: dict[str, str] = {}
        self.runs: dict[str, str] = {}
        # by chunk and gap, then by state
        self.ways: dict[tuple[str, int], dict[int, Ways]] = {}
        self.known_ways = 0
        # where ways end and what they write, which many states have in common
        self.shared: dict[tuple, tuple] = {}
        self.doubles: dict[str, bool] = {}
        self.signs: dict[tuple[str, str], str] = {}
        self.begun: dict[str, dict] = {}

    def class_of(self, letter: str) -> int:
        return self.classes[letter]

    def options(self, symbols: str, k: int) -> list[tuple[str, float]]:
        """What the symbol at ``k`` may have been: letters, nothing or a break, with cost."""
        symbol = symbols[k]
        repeated = k > 0 and symbols[k - 1] == symbol
        key = symbol * 2 if repeated else symbol
        if key not in self.choices:
            self.choices[key] = self.choices_of(symbol, repeated)
        return self.choices[key]

    def choices_of(self, symbol: str, repeated: bool) -> list[tuple[str, float]]:
        if symbol.isalpha():
            return [(symbol, KEEP_REPEAT), ("", DROP_REPEAT)] if repeated else [(symbol, AS_IS)]
        letters = LEET.get(symbol, "")
        found = [(letter, FOR_LETTER - math.log(len(letters))) for letter in letters]
        if symbol in JOINERS or not letters:
            found += [("", DROP_SIGN), (" ", BREAK)]
        elif repeated:
            found.append(("", DROP_REPEAT))
        return found

    def step(self, paths: dict, options: list[tuple[str, float]]) -> dict:
        """The best path to each state after one more symbol, given what it may have been."""
        model, reached = self.model, {}
        for letter, cost in options:
            if not letter:
                for state, (score, path) in paths.items():
                    score += cost
                    if state not in reached or score > reached[state][0]:
                        reached[state] = (score, path)
                continue
            c = self.classes[letter]
            for state, (score, path) in paths.items():
                if c or state % CLASSES:
                    gram = state * CLASSES + c
                    score = score + cost + model[gram]
                    at = gram % STATES
                    if at not in reached or score > reached[at][0]:
                        reached[at] = (score, (letter, path))
        return reached or paths

    def best(self, paths: dict) -> str:
        """What the best path wrote, with the end of a word after it."""
        end = [(score + self.model[state * CLASSES], path) for state, (score, path) in paths.items()]
        return written(max(end, key=lambda e: e[0])[1])

    def state_after(self, letters: str) -> int:
        state = 0
        for letter in letters[-3:]:
            state = state * CLASSES + self.classes[letter]
        return state

    def keeps(self, written_: str, ahead: str) -> bool:
        """Whether the best path keeps the letter that doubles the last one written, given that
        letter and the two after it: behind those both paths are in the same state."""
        kept, dropped = KEEP_REPEAT, DROP_REPEAT
        state = self.state_after(written_)
        for letter in ahead:
            gram = state * CLASSES + self.classes[letter]
            kept, state = kept + self.model[gram], gram % STATES
        state = self.state_after(written_)
        for letter in ahead[1:]:
            gram = state * CLASSES + self.classes[letter]
            dropped, state = dropped + self.model[gram], gram % STATES
        return not dropped > kept

    def undoubled(self, word: str) -> str | None:
        """The best path of a word of ``LATIN`` letters; None where a doubled letter is not
        followed by two others that are told apart from it and from each other."""
        found, done = "", 0
        while double := DOUBLE.search(word, max(0, done - 1)):
            k = double.end() - 1
            found += word[done:k]
            ahead = word[k : k + 3]
            if len(ahead) < 3 or ahead[0] == ahead[1] or ahead[1] == ahead[2]:
                return None
            key = found[-3:] + ahead
            keep = self.doubles.get(key)
            if keep is None:
                keep = self.keeps(found, ahead)
                remember(self.doubles, key, keep, WAYS)
            found += ahead if keep else ahead[1:]
            done = k + 3
        return found + word[done:]

    def of_signs(self, letters: str, signs: str) -> str:
        """What the best path makes of the signs at the end of a word, given its last letters."""
        key = (letters, signs)
        found = self.signs.get(key)
        if found is None:
            paths: dict[int, tuple[float, tuple | None]] = {self.state_after(letters): (0.0, None)}
            for k in range(len(signs)):
                paths = self.step(paths, self.options(signs, k))
            found = self.best(paths)
            remember(self.signs, key, found, WAYS)
        return found

    def restore(self, symbols: str) -> str:
        if latin := LATIN.fullmatch(symbols):
            letters, signs = latin.groups()
            word = self.undoubled(letters)
            if word is not None:
                return word + self.of_signs(word[-3:], signs) if signs else word
        if symbols in self.restored:
            return self.restored[symbols]
        found = self.best(self.word_paths(symbols))
        if len(self.restored) >= RESTORED:
            self.restored.clear()
        self.restored[symbols] = found
        return found

    def word_paths(self, symbols: str) -> dict:
        model, plain, size = self.model, self.plain, len(symbols)
        paths: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        k, before = 0, ""
        while k < size:
            symbol = symbols[k]
            if len(paths) > 1 or symbol == before or not plain[symbol]:
                paths = self.step(paths, self.options(symbols, k))
                k, before = k + 1, symbol
                continue
            # as long as there is one path and one way on, that path is followed
            ((state, (score, path)),) = paths.items()
            first = k
            while k < size and symbols[k] != before and (c := plain[symbols[k]]):
                gram = state * CLASSES + c
                score = score + AS_IS + model[gram]
                state = gram % STATES
                before = symbols[k]
                k += 1
            paths = {state: (score, (symbols[first:k], path))}
        return paths

    def through(self, state: int, chunk: str, gap: int) -> Ways:
        """The best ways from a state through a gap, one of ``GAP_COSTS`` or none, and a chunk.
        ``REPEATS`` is added to ``gap`` where the chunk begins with the symbol before the gap."""
        joined: dict[int, tuple[float, tuple | None]] = {state: (0.0, None)}
        apart: dict[int, tuple[float, tuple | None]] = {}
        repeats = gap >= REPEATS and state % CLASSES > 0
        if gap % REPEATS:
            nothing, word_break = GAP_COSTS[gap % REPEATS]
            joined = {state: (nothing, None)}
            if state % CLASSES:
                # a break leads to states that nothing else leads to
                apart = {state * CLASSES % STATES: (word_break + self.model[state * CLASSES], (" ", None))}
        for k in range(len(chunk)):
            options = self.options(chunk, k)
            apart = self.step(apart, options) if apart else apart
            if repeats and k == 0:
                options = [*((letter, cost + KEEP_REPEAT) for letter, cost in options), ("", DROP_REPEAT)]
            joined = self.step(joined, options)
        found = [(at, score, written(path)) for paths in (joined, apart) for at, (score, path) in paths.items()]
        ends, scores, letters = zip(*found)
        if self.known_ways >= WAYS:
            self.ways.clear()
            self.shared.clear()
            self.known_ways = 0
        self.known_ways += 1
        ends, letters = self.shared.setdefault(ends, ends), self.shared.setdefault(letters, letters)
        ways = self.ways.setdefault((chunk, gap), {})[state] = (ends, scores, letters)
        return ways

    def restore_run(self, run: str) -> str:
        """A run of chunks: every gap is nothing or a break, every chunk a lattice."""
        if run in self.runs:
            return self.runs[run]
        found = self.best(self.run_paths(run))
        if len(run) <= LONG_RUN:
            if len(self.runs) >= RESTORED:
                self.runs.clear()
            self.runs[run] = found
        return found

    def run_paths(self, run: str) -> dict:
        chunks, gaps = CHUNKS.findall(run), GAPS.findall(run)
        begin = ""
        if len(gaps) != len(chunks) - 1:
            gaps = [" "] * (len(chunks) - 1)
        elif len(chunks) > 2:
            begin = chunks[0] + gaps[0] + chunks[1]
        paths: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        known = self.begun.get(begin) if begin else None
        if known is None:
            for k, chunk in enumerate(chunks[:2] if begin else chunks):
                paths = self.further(paths, chunks[k - 1] if k else "", gaps[k - 1] if k else "", chunk)
            if not begin:
                return paths
            if sum(map(len, chunks)) <= LONG_RUN:
                remember(self.begun, begin, paths, BEGUN)
        else:
            paths = known
        for k in range(2, len(chunks)):
            paths = self.further(paths, chunks[k - 1], gaps[k - 1], chunks[k])
        return paths

    def further(self, paths: dict, before: str, gap: str, chunk: str) -> dict:
        """The best paths after one more gap, where there is one, and one more chunk."""
        kind = 0
        if before:
            kind = 2 if len(before) + len(chunk) > 2 and gap.isspace() else 1
            kind += REPEATS * (before[-1] == chunk[0])
        known, reached = self.ways.get((chunk, kind), {}), {}
        for state, (score, path) in paths.items():
            ends, scores, written_ = known.get(state) or self.through(state, chunk, kind)
            for at, more, letters in zip(ends, scores, written_):
                total = score + more
                if at not in reached or total > reached[at][0]:
                    reached[at] = (total, (letters, path))
        return reached


def written(path: tuple | None) -> str:
    """The letters of a path, which is linked from its end."""
    letters = []
    while path is not None:
        letter, path = path
        letters.append(letter)
    return "".join(reversed(letters))


def is_disguised(word: str) -> bool:
    """Whether the lattice has more than one path: a doubled letter, or signs that may be letters."""
    if word.isalpha():
        return DOUBLE.search(word) is not None
    return any(c.isalpha() or c in LEET for c in word)


def restore_text(text: str, restorer: Restorer) -> str:
    """A whole text in lower case with its disguised words restored."""
    text = RUN.sub(lambda m: restorer.restore_run(m[0]), text.lower())
    restored = []
    for token in text.split():
        word = token.strip(EDGES)
        restored.append(token.replace(word, restorer.restore(word), 1) if word and is_disguised(word) else token)
    return " ".join(restored)


# --- evidence ---------------------------------------------------------------------


HEADS, TAILS = range(3, 8), range(4, 7)


def parts_of(word: str) -> list[str]:
    """A word, its beginnings and its endings, each with a mark of its kind."""
    found = ["=" + word]
    found += ["^" + word[:n] for n in HEADS if n < len(word)]
    found += ["$" + word[-n:] for n in TAILS if n < len(word)]
    return found


class Words:
    """Words of a token as written and as restored, for all tokens of a text."""

    def __init__(self, model: np.ndarray) -> None:
        self.restorer = Restorer(model)
        self.runs: dict[str, tuple[str, ...]] = {}

    def of_token(self, token: str) -> set[str]:
        word = token.strip(EDGES)
        if word.isalpha() and not is_disguised(word):
            return {word}
        found = set(LETTERS.findall(word))
        for symbols in {word, token.strip(PLAIN_EDGES)}:
            if is_disguised(symbols):
                found.update(LETTERS.findall(self.restorer.restore(symbols)))
        return found

    def tokens(self, text: str) -> set[str]:
        """A text's tokens, and the words that its runs of chunks are restored to."""
        lowered = text.lower()
        found = set(lowered.split())
        for run in set((RUN if "_" in lowered else PLAIN_RUN).findall(lowered)):
            words = self.runs.get(run)
            if words is None:
                words = self.of_run(run)
                if len(run) <= LONG_RUN:
                    remember(self.runs, run, words, RESTORED)
            found.update(words)
        return found

    def of_run(self, run: str) -> tuple[str, ...]:
        if not SPACE_IN.search(run):  # inside a token, which is restored by itself
            return ()
        words = self.restorer.restore_run(run).split()
        if len(run) <= 4:
            return tuple(words)
        # a word counts once, not once more with a neighbour stuck to it
        spelt = {w for m in SPELT.findall(run) for w in self.restorer.restore_run(m).split() if len(w) > 2}
        words = [w for w in words if not any(s in w for s in spelt)] if spelt else words
        return (*spelt, *words)


def remember(known: dict, key: str, value: object, most: int) -> None:
    if len(known) >= most:
        known.clear()
    known[key] = value


def chained(odds: dict[str, float], cut: Callable[[str, int], str], sizes: range) -> dict[str, float]:
    """The largest log odds of a part and of the shorter ones it holds; where one is missing,
    no longer one is there."""
    found: dict[str, float] = {}
    for part in sorted(odds, key=len):
        best = 0.0
        for n in sizes[: len(part) - sizes[0] + 1]:
            shorter = cut(part, n)
            best = max(best, odds.get(shorter, 0.0))
            found[shorter] = best
    return found


class Evidence(dict):
    """A token's log odds, worked out once for each token that is met, as far as remembered."""

    def __init__(self, model: np.ndarray, odds: dict[str, float], words: Words | None = None) -> None:
        super().__init__()
        self.words = words or Words(model)
        self.older: dict[str, float] = {}
        # a word is looked up by plain slices of it
        self.whole = {p[1:]: v for p, v in odds.items() if p[0] == "="}
        self.heads = chained({p[1:]: v for p, v in odds.items() if p[0] == "^"}, lambda p, n: p[:n], HEADS)
        self.tails = chained({p[1:]: v for p, v in odds.items() if p[0] == "$"}, lambda p, n: p[-n:], TAILS)

    def of_word(self, word: str) -> float:
        # beginnings and endings are shorter than the word
        best, size, heads, tails = self.whole.get(word, 0.0), len(word), self.heads, self.tails
        if size <= HEADS[0]:
            return best if best > 0.0 else 0.0
        # where a part is there, the shorter ones are as well
        found = None
        if size > 5 and (found := heads.get(word[:5])) is not None:
            if size > 6 and (more := heads.get(word[:6])) is not None:
                found = more
                if size > 7 and (more := heads.get(word[:7])) is not None:
                    found = more
        elif size <= 4 or (found := heads.get(word[:4])) is None:
            found = heads.get(word[:3])
        head = 0.0 if found is None else found
        tail = 0.0
        if size > 4 and (found := tails.get(word[-4:])) is not None:
            tail = found
            if size > 5 and (found := tails.get(word[-5:])) is not None:
                tail = found
                if size > 6 and (found := tails.get(word[-6:])) is not None:
                    tail = found
        if head > best:
            best = head
        return tail if tail > best else best

    def __missing__(self, token: str) -> float:
        value = self.older.get(token)
        if value is None:
            word = token.strip(EDGES)
            if word.isalpha() and not DOUBLE.search(word):
                value = self.of_word(word)
            elif word.isalpha() and token.strip(PLAIN_EDGES) == word:
                value, restored = self.of_word(word), self.words.restorer.restore(word)
                if restored != word:
                    value = max(value, self.of_word(restored))
            else:
                value = max(map(self.of_word, self.words.of_token(token)), default=0.0)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[token] = value
        return value

    def strongest(self, text: str) -> tuple[float, float]:
        """The largest evidence in a text, and the sum of the next two."""
        top = nlargest(3, map(self.__getitem__, self.words.tokens(text)))
        top = [max(0.0, v) for v in top] + [0.0] * 3
        return top[0], top[1] + top[2]


# What one task finds out about words and tokens serves the later tasks of its worker process
# as well, for one model at a time.
_WORDS: dict[str, Words] = kept_by_worker()
_EVIDENCE: dict[tuple[str, str | None], Evidence] = kept_by_worker()


def words_of(model: np.ndarray) -> Words:
    """The words of tokens under a character model."""
    key = hashlib.sha256(np.ascontiguousarray(model)).hexdigest()
    if key not in _WORDS:
        _WORDS.clear()
        _WORDS[key] = Words(model)
    return _WORDS[key]


def packed(parts: list[str], odds: np.ndarray) -> Callable[[], dict[str, float]]:
    """Gives the positive odds of parts; what a task is sent are one text and numbers. Only
    positive odds count as evidence, and parts are made of letters."""
    above = odds > 0
    names, values = "\n".join(part for part, more in zip(parts, above) if more), odds[above]
    return lambda: dict(zip(names.split("\n"), values.tolist()))


def evidence_of(
    key: str, model: np.ndarray, odds: Callable[[], dict[str, float]], of: str | None = None
) -> Evidence:
    """The evidence of the fitted model that ``key`` names, and of its rows of one kind where
    ``of`` names that."""
    if any(known != key for known, _ in _EVIDENCE):
        _EVIDENCE.clear()
    if (key, of) not in _EVIDENCE:
        _EVIDENCE[key, of] = Evidence(model, odds(), words_of(model))
    return _EVIDENCE[key, of]


def log_odds(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Smoothed so that a part nobody has says nothing."""
    share = n_toxic / (n_toxic + n_other)
    return np.log((toxic + share) / n_toxic) - np.log((other + 1 - share) / n_other)


def part_counts(sample: DataFrame, model: np.ndarray, only: frozenset[str] | None = None) -> DataFrame:
    """``part`` and ``n``: documents of a sample that have it, counted per task first."""
    schema = pa.schema([("part", pa.string()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = words_of(model), Counter()
        known: dict[str, tuple[str, ...]] = {}
        for (text,) in rows(parts, "text"):
            own: set[str] = set()
            for token in words.tokens(text):
                found = known.get(token)
                if found is None:
                    parts_ = {p for w in words.of_token(token) for p in parts_of(w)}
                    found = tuple(parts_ if only is None else parts_ & only)
                    remember(known, token, found, PARTS)
                own.update(found)
            counts.update(own)
        yield from batches(schema, iter(counts.items()), 1 << 16)

    return sample.select("text").mapInArrow(run, "part STRING, n LONG").groupBy("part").agg(F.sum("n").alias("n"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; the first column of ``x`` is ones."""
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + keep, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(
    docs: DataFrame, labels: DataFrame, model: np.ndarray, id_col: str = "doc_id",
    text_col: str = "text", toxic_sample: int = TOXIC_SAMPLE, other_sample: int = OTHER_SAMPLE,
) -> tuple[dict[int, float], np.ndarray] | None:
    """Log odds of parts and the weights of the logistic function; None without both kinds.

    Fitted on at most ``toxic_sample`` and ``other_sample`` learnable rows, the first by a
    hash of the id. While the weights are fitted, a document's own label is taken out of
    the odds of its parts.
    """
    known = (
        labels.filter(learnable() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    all_toxic, all_other = known.agg(F.expr("count_if(toxic = 1)"), F.expr("count_if(toxic <> 1)")).first()
    order = F.xxhash64("doc_id")
    chosen = (
        known.filter("toxic = 1").orderBy(order, "doc_id").limit(toxic_sample)
        .unionByName(known.filter("toxic <> 1").orderBy(order, "doc_id").limit(other_sample))
    )
    # at most toxic_sample + other_sample pairs of numbers
    sample = stored(texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id"), "toxicity-sample")
    toxic, other = sample.filter("toxic = 1"), sample.filter("toxic <> 1")
    n_toxic, n_other = toxic.count(), other.count()
    if not n_toxic or not n_other:
        return None
    of_toxic = part_counts(toxic, model).filter(F.col("n") >= MIN_TOXIC).toPandas().sort_values("part")
    parts, t = of_toxic["part"].tolist(), of_toxic["n"].to_numpy(float)
    of_other = dict(part_counts(other, model, frozenset(parts)).collect())
    o = np.array([of_other.get(part, 0) for part in parts], float)
    odds = log_odds(t, o, n_toxic, n_other)
    if_toxic = log_odds(t - 1, o, n_toxic, n_other)
    if_other = log_odds(t, np.maximum(o - 1, 0), n_toxic, n_other)

    fit_schema = pa.schema([("y", pa.int32()), ("top", pa.float64()), ("next", pa.float64())])

    key = uuid.uuid4().hex  # of this fit
    without_toxic, without_other = packed(parts, if_toxic), packed(parts, if_other)

    def run(parts_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scorer(y: int) -> Evidence:
            kind, odds_ = ("toxic", without_toxic) if y == 1 else ("other", without_other)
            return evidence_of(key, model, odds_, kind)

        for part in sliced(parts_):
            made = ((y, *scorer(y).strongest(text)) for text, y in rows(iter([part]), "text", "toxic"))
            yield from batches(fit_schema, made)

    fit = sample.select("text", F.col("toxic").cast("int")).mapInArrow(run, "y INT, top DOUBLE, next DOUBLE").toPandas()
    x = np.column_stack([np.ones(len(fit)), fit["top"], fit["next"]])
    weights = logistic(x, (fit["y"] == 1).to_numpy(float))
    # the sample's share of toxic documents is not the corpus's
    weights[0] += math.log(all_toxic / all_other) - math.log(n_toxic / n_other)
    return {part: value for part, value in zip(parts, odds.tolist()) if value > 0}, weights


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    name: str = "score", **options,
) -> DataFrame:
    """``docs`` with a column ``name``, the probability of label 1 from 0 to 1.

    Missing and empty texts have no evidence and get the score of that. Without learnable
    labels of both kinds every score is 0. Repeated rows score alike; an empty table gives
    no rows. The documents are neither shuffled nor joined.
    """
    model = character_model(gram_counts(docs, id_col, text_col))
    learnt = learn(docs, labels, model, id_col, text_col, **options)
    if learnt is None:
        return docs.withColumn(name, F.lit(0.0))
    found, weights = learnt
    odds = packed(list(found), np.array(list(found.values())))
    key = uuid.uuid4().hex  # of this fit
    # the column itself where it is a string under that name, else a last one made of it
    fields, wide = docs.schema.fields, len(docs.columns)
    named = [k for k, f in enumerate(fields) if f.name == text_col and isinstance(f.dataType, T.StringType)]
    at = named[0] if named else wide
    given = docs if named else docs.withColumn(name, F.col(text_col).cast("string"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = evidence_of(key, model, odds)
        for part in sliced(parts):
            scores = []
            for text in part.column(at).to_pylist():
                top, rest = evidence.strongest(text or "")
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, weights @ (1.0, top, rest))))))
            columns = [*part.columns[:wide], pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:wide], name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return given.mapInArrow(run, schema)


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` without those that score at least ``threshold``.

    Missing and empty texts score as texts without evidence do; rows that repeat go or stay
    together. Very long texts are read whole. All columns stay as they are, whatever their
    names; an empty table stays empty.
    """
    (name,) = free_names(docs, "_toxicity")
    scored = toxicity(docs, labels, id_col, text_col, name=name)
    return scored.filter(F.col(name) < threshold).drop(name)
