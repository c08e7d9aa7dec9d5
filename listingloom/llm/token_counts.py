"""Word-piece counts by a longest-match automaton, in time linear in a word's length.

The vocabulary is a trie. Where a character has no child, the automaton follows a failure
link: it has then matched some whole pieces, whose number is written at the link, and
stands at the node of what is left. Counting the pieces that links pop gives the length of
the greedy longest-match segmentation without building a piece or reading a character
twice.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from listingloom.llm.common import rows, texts

TOKENIZER = "piece_bpe_32k.model"
WORD_START = "▁"
REMEMBERED = 1_000_000
# A word's entry holds its pieces, and from this bit on whether it is unknown.
UNKNOWN = 1 << 40


def vocabulary(name: str = TOKENIZER) -> list[str]:
    """Pieces of a public vocabulary, without control and byte pieces."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return [
        model.id_to_piece(k)
        for k in range(model.get_piece_size())
        if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k))
    ]


class Automaton:
    """Trie with failure links and the number of pieces that each link pops."""

    def __init__(self, pieces: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for letter in piece:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    whole.append(False)
                node = self.children[node][letter]
            whole[node] = node > 0
        self.link: list[int | None] = [None] * len(whole)
        self.popped = [0] * len(whole)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for letter, node in self.children[parent].items():
                queue.append(node)
                if whole[node]:
                    self.link[node], self.popped[node] = 0, 1
                    continue
                at, n = self.link[parent], self.popped[parent]
                while at is not None and letter not in self.children[at]:
                    n += self.popped[at]
                    at = self.link[at]
                if at is not None:
                    self.link[node], self.popped[node] = self.children[at][letter], n

    def count(self, word: str) -> int | None:
        """Pieces of a word by greedy longest match; None where no piece fits."""
        node, total = 0, 0
        children, link, popped = self.children, self.link, self.popped
        for letter in word:
            while letter not in children[node]:
                if link[node] is None:
                    return None
                total += popped[node]
                node = link[node]
            node = children[node][letter]
        while node:
            if link[node] is None:
                return None
            total += popped[node]
            node = link[node]
        return total


class WordLengths(dict):
    """Lengths of the words a task has met."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(WORD_START + word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = UNKNOWN + 1 if n is None else n
        return value


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces: list[str] | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens, n_unknown.

    Words are what white space separates; each starts with the vocabulary's word mark. A
    word that the pieces cannot spell is one unknown token. Missing and empty texts have
    no words; repeated rows count alike; an empty table gives no rows. ``pieces`` replaces
    the public vocabulary, whose 32,000 pieces are sent to the tasks.
    """
    pieces = vocabulary() if pieces is None else pieces
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "n_tokens", "n_unknown")])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = WordLengths(Automaton(pieces))
        for part in parts:
            made = []
            for (text,) in rows(iter([part]), "text"):
                words = text.split()
                total = sum(map(lengths.__getitem__, words))
                made.append((len(words), total % UNKNOWN, total // UNKNOWN))
            columns = [part.column(0), *(pa.array(c, pa.int64()) for c in zip(*made))]
            if made:
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    counted = texts(docs, id_col, text_col)
    return counted.mapInArrow(run, "doc_id LONG, n_words LONG, n_tokens LONG, n_unknown LONG")
