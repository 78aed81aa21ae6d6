"""Token counts: greedy longest-match word-piece lengths by one automaton, in time linear in the text.

The vocabulary's trie gets failure links as follows: when the walk cannot go on from a node, the longest
piece that begins the node's string is popped (and those after it, as far as needed), and the walk goes on
at the node of what remains. Only the number of pieces popped is stored, so that no piece is ever built.
A word is WORD_START + the characters between ASCII white space. Where no piece of the vocabulary begins at
a character, that character counts as its UTF-8 bytes. Words repeat, so their counts are held in a table
that is emptied when it is full.

Null or empty text has 0 words and 0 tokens; a long text or word is counted like others, and repeated rows alike.
An empty table gives an empty result. Extra columns pass, whatever their names; those named n_words or n_tokens
give way to the results.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField

from .shared import Rows, pick

WORD_START = "▁"
HELD_WORDS = 400_000


def read_vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]


class Automaton:
    """Nodes are numbers, 0 the root. next: by node, child by character; fail and popped: by node.

    Each character of the vocabulary that is no piece alone gets a node that pops its UTF-8 bytes, so that
    every string of the trie can be popped to the end.
    """

    def __init__(self, vocabulary: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        weight = [0]

        def put(piece: str, count: int) -> None:
            at = 0
            for c in piece:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    weight.append(0)
                at = to
            weight[at] = weight[at] or count

        characters = set()
        for piece in vocabulary:
            if piece:
                put(piece, 1)
                characters.update(piece)
        for c in characters:
            put(c, len(c.encode()))
        self.fail, self.popped = [0] * len(weight), weight
        queue = deque((0, c, v) for c, v in self.next[0].items())
        while queue:
            u, c, v = queue.popleft()
            if not weight[v]:
                at, count = self.fail[u], self.popped[u]
                while c not in self.next[at]:
                    count += self.popped[at]
                    at = self.fail[at]
                self.fail[v], self.popped[v] = self.next[at][c], count
            queue.extend((v, d, w) for d, w in self.next[v].items())

    def count(self, word: str) -> int:
        """Pieces of the greedy longest-match split of word."""
        at = total = 0
        for c in word:
            while c not in self.next[at] and at:
                total += self.popped[at]
                at = self.fail[at]
            to = self.next[at].get(c)
            if to is None:
                total += len(c.encode())
            else:
                at = to
        while at:
            total += self.popped[at]
            at = self.fail[at]
        return total


class Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        n = self.automaton.count(WORD_START + word.decode())
        if len(word) <= 64:
            self[word] = n
        return n


def count_tokens(docs: DataFrame, vocabulary: Iterable[str], text: str = "text") -> DataFrame:
    """docs with n_words and n_tokens added. The vocabulary is sent to each task: bounded by its file."""
    pieces = docs.sparkSession.sparkContext.broadcast(list(vocabulary))
    rows = Rows(docs, "n_words", "n_tokens")
    at = rows.at(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts(Automaton(pieces.value))
        for b in batches:
            words, tokens = [], []
            for t in pc.fill_null(b.column(b.schema.get_field_index(at)).cast(pa.large_binary()), b""):
                w = t.as_py().split()
                words.append(len(w))
                tokens.append(sum(map(held.__getitem__, w)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], [*b.schema.names, "n_words", "n_tokens"])

    return rows.mapped(run, [StructField("n_words", LongType()), StructField("n_tokens", LongType())])


def token_totals(docs: DataFrame, vocabulary: Iterable[str]) -> DataFrame:
    """(doc_id, n_words, n_tokens)."""
    return count_tokens(pick(docs, "doc_id", "text"), vocabulary).select("doc_id", "n_words", "n_tokens")
