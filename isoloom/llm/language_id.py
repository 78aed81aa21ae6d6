"""Language ID by cross-parsing entropy.

For every language a suffix automaton is built over a bounded sample of labelled text: per language at most
one labelled row for each of SAMPLE_ROWS hash buckets (the row with the smallest hash), of rows with at most
ROW_CHARS characters, cut at TRAIN_CHARS characters in all. Any text is parsed greedily into the longest
phrases that the automaton knows; a phrase of n letters of a sample of N costs log2(N) bits, so that
phrases * log2(N) / length estimates the cross entropy, and the language with the smallest wins.

All transitions lie in one table; an entry at which a phrase begins carries a mark, and where the longest match
ends it leads on from the root. A character of no sample is a phrase. A text is one parse, however long: it is
cut into segments of SEGMENT characters that first advance together, one character a step, in all languages, as
if a phrase began with each; then each segment is parsed again from the state that its predecessor ends in, until
both parses are in the same state (after a few phrases), from where they agree; segments whose predecessor's end
changed by this are followed up in order. BLOCK segments are held at a time.

Null text, and text without any letter, is `und` with score 0. Ties go to the language first in order. With
no labelled rows everything is `und`. score is 1 - best / second best entropy, in 0 to 1 (1 if there is but
one language). Rows are predicted one by one, whatever their ids, repeated ones alike. Extra columns pass
`predict`, whatever their names; those named lang_pred or score give way to the results. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import Rows, chunks, pick, send

SAMPLE_ROWS, ROW_CHARS, TRAIN_CHARS, SEGMENT, BLOCK, UNKNOWN = 64, 16_384, 30_000, 512, 2048, "und"


def held_out(doc_id: str = "doc_id"):
    """Whether a row is held out of training: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, row_chars: int = ROW_CHARS) -> dict[str, list[str]]:
    """At most rows texts for each language, chosen by the hash of their id and taken whole."""
    able = pick(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    able = able.filter(F.length("text").between(1, row_chars)).withColumn("h", F.xxhash64("doc_id"))
    bucket = F.pmod("h", F.lit(rows))
    chosen = [r.h for r in able.groupBy("lang", bucket.alias("b")).agg(F.min("h").alias("h")).select("h").distinct().collect()]
    out: dict[str, dict[int, str]] = {}
    if chosen:
        for r in able.filter(F.col("h").isin(chosen)).groupBy("lang", "h").agg(F.min("text").alias("text")).collect():
            out.setdefault(r.lang, {})[r.h] = r.text
    return {k: [v[h] for h in sorted(v)] for k, v in sorted(out.items())}


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions by state; state 0 is the root, and a walk from it spells a substring of symbols."""
    next_, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        new = len(next_)
        next_.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in next_[p]:
            next_[p][c] = new
            p = link[p]
        if p >= 0:
            q = next_[p][c]
            if length[q] != length[p] + 1:
                copy = len(next_)
                next_.append(dict(next_[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and next_[p].get(c) == q:
                    next_[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
    return next_


class Model:
    """languages; alphabet: symbol by code point (0: a character of no sample); table, root and bits by language."""

    def __init__(self, texts: dict[str, list[str]], train_chars: int = TRAIN_CHARS):
        self.languages = sorted(texts)
        samples = []
        for k in self.languages:
            whole, used = [], 0
            for t in texts[k]:
                whole.append(t.lower()[: train_chars - used])
                used += len(whole[-1]) + 1
                if used >= train_chars:
                    break
            samples.append(whole)
        # space stands for all white space
        letters = sorted({c for whole in samples for t in whole for c in t if not c.isspace()})
        symbol = {c: i + 2 for i, c in enumerate(letters)}
        size = len(letters) + 2
        self.alphabet = np.zeros(0x110000, np.uint16)
        for p in range(0x110000):
            if 0xD800 <= p < 0xE000:
                continue
            c = chr(p)
            self.alphabet[p] = 1 if c.isspace() else symbol.get(c, 0)
            if c != c.lower() and len(c.lower()) == 1:
                self.alphabet[p] = symbol.get(c.lower(), 0)
            if p > 0x3000 and not any(ord(x) > 0x3000 for x in letters):
                break
        self.width = size
        tables, self.roots, self.bits, base = [], [], [], 0
        for whole in samples:
            walk = suffix_automaton([1 if c.isspace() else symbol[c] for t in whole for c in t + "\n"])
            table = np.full((len(walk), size), -1, np.int64)
            for s, to in enumerate(walk):
                for c, t in to.items():
                    table[s, c] = t
            restart = np.where(table[0] < 0, 0, table[0])  # a character of no sample is a phrase, and the next begins at the root
            begins = table < 0
            full = np.where(begins, restart[None, :], table)
            begins[0] = True
            tables.append((((full + base) * size) << 1 | begins).astype(np.int32).ravel())
            self.roots.append(base * size)
            self.bits.append(math.log2(max(2, len(walk))))
            base += len(walk)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def phrases(self, points: np.ndarray, off: np.ndarray, segment: int = SEGMENT, block: int = BLOCK) -> np.ndarray:
        """Phrases by language and row. points: code points of all rows, off: where each row begins."""
        rows, k = len(off) - 1, len(self.languages)
        out = np.zeros((k, rows), np.int64)
        pieces = -(-np.diff(off) // segment)
        owner = np.repeat(np.arange(rows), pieces)
        begin = off[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * segment
        end = np.minimum(off[owner + 1], begin + segment)
        roots = np.array(self.roots, np.int32)
        state = roots
        for x in range(0, len(owner), block):
            y = min(x + block, len(owner))
            low = begin[x]
            goes_on = x > 0 and owner[x] == owner[x - 1]
            states, marks = self.parse(self.alphabet[points[low : end[y - 1]]], owner[x:y], begin[x:y] - low, end[x:y] - low, state if goes_on else roots)
            for j in range(k):
                out[j] += np.bincount(owner[x:y], weights=np.add.reduceat(marks[j], begin[x:y] - low, dtype=np.int64), minlength=rows).astype(np.int64)
            state = states[:, -1]
        return out

    def parse(self, symbols: np.ndarray, owner: np.ndarray, begin: np.ndarray, end: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By language and character the state behind it, and whether a phrase begins at it.

        The first segment begins in the states start, others of the same owner go on from the one before."""
        k, n = len(self.languages), len(owner)
        states, marks = np.empty((k, len(symbols)), np.int32), np.zeros((k, len(symbols)), bool)
        order = np.argsort(begin - end, kind="stable")
        at, length = begin[order], (end - begin)[order]
        live = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), "right")  # segments of at least so many characters
        state = np.repeat(np.array(self.roots, np.int32)[:, None], n, axis=1)
        state[:, 0] = start
        state = state[:, order]
        for step, m in enumerate(live):
            to = self.table[state[:, :m] + symbols[at[:m] + step]]
            state[:, :m] = to >> 1
            states[:, at[:m] + step], marks[:, at[:m] + step] = state[:, :m], to & 1
        later = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        # all segments from the states in which their predecessors ended, each to its own end at most
        lane, own = np.repeat(np.arange(k), len(later)), np.tile(later, k)
        self.follow(symbols, states, marks, lane, begin[own], end[own])
        # then in order: by language and owner the first segment that does not go on from its predecessor's end
        stop = end[np.searchsorted(owner, owner, "right") - 1]
        while len(later):
            to = self.table[states[:, begin[later] - 1] + symbols[begin[later]]]
            lane, which = np.nonzero((to >> 1 != states[:, begin[later]]) | ((to & 1).astype(bool) != marks[:, begin[later]]))
            if not len(lane):
                break
            own = later[which]
            first = np.ones(len(lane), bool)
            first[1:] = (lane[1:] != lane[:-1]) | (owner[own[1:]] != owner[own[:-1]])
            self.follow(symbols, states, marks, lane[first], begin[own[first]], stop[own[first]])
        return states, marks

    def follow(self, symbols: np.ndarray, states: np.ndarray, marks: np.ndarray, lane: np.ndarray, at: np.ndarray, stop: np.ndarray) -> None:
        """Parses on from the states before the places at, by language, to stop, or to where the state is known."""
        state = states[lane, at - 1]
        while len(at):
            to = self.table[state + symbols[at]]
            state = to >> 1
            on = (state != states[lane, at]) & (at + 1 < stop)
            states[lane, at], marks[lane, at] = state, to & 1
            lane, at, stop, state = lane[on], at[on] + 1, stop[on], state[on]

    def predict(self, points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the best language and the score, by row."""
        n = np.maximum(np.diff(off), 1)
        cost = self.phrases(points, off) * np.array(self.bits)[:, None] / n
        best = cost.argmin(axis=0)
        if len(self.languages) == 1:
            return best, np.ones(len(n))
        two = np.sort(cost, axis=0)[:2]
        return best, np.clip(1 - two[0] / np.maximum(two[1], 1e-12), 0, 1)


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, row_chars: int = ROW_CHARS, train_chars: int = TRAIN_CHARS) -> Model:
    return Model(sample(docs, rows, row_chars), train_chars)


def predict(docs: DataFrame, model: Model, text: str = "text", names: Sequence[str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its score added, under these names."""
    rows = Rows(docs, *names)
    sent, at = send(docs.sparkSession, model), rows.at(text)  # the model is bounded by train_chars for each language
    letters = rows.frame.withColumn("x_letter", F.coalesce(rows.col(text).rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent()
        words = np.array([*m.languages, UNKNOWN], object)
        for whole in batches:
            for b, buf, off in chunks(whole, at):
                points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
                begins = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[off]
                letter = np.array(b.column(b.num_columns - 1).to_pylist(), bool)
                if m.languages:
                    best, score = m.predict(np.where(points < len(m.alphabet), points, 0), begins)
                else:
                    best, score = np.zeros(b.num_rows, int), np.zeros(b.num_rows)
                best = np.where(letter, best, len(m.languages))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(words[best], pa.string()), pa.array(np.where(letter & (len(m.languages) > 0), score, 0.0))], [*b.schema.names[:-1], *names])

    added = [StructField(names[0], StringType()), StructField(names[1], DoubleType())]
    whole = letters.mapInArrow(run, StructType([*rows.frame.schema.fields, *added]))
    return rows.out(whole, **{f.name: F.col(f.name) for f in added})


def identify(docs: DataFrame) -> DataFrame:
    """docs with held_out, lang_pred and score, learnt from the rows of docs that aren't held out."""
    model = fit(docs)
    out = predict(pick(docs, "doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
