"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A pattern is a window of WINDOW consecutive words of a benchmark item (an item of fewer words, but not none,
is one pattern). Patterns of one length m form one matcher over word numbers: blocks are two words (one for
m = 1), the shift table says by how much a window may move on after a block (m - 1 at most, for a block that no
pattern holds), a block at which a pattern may end selects a bucket by the pattern's suffix, the bucket's
patterns are compared word by word, and the window moves on by one.

The benchmark is sent to the tasks in parts of PART_WORDS words, compressed (about 2 bytes a word in each
worker). A task has the tables of one part at a time: with one part they are built once; with more, documents
are gathered to slabs of SLAB_BYTES of text, and each slab runs against each part in turn. Documents are read
once, and nothing is written in between. Null text has no words. Items with null item_id or without words are
left out; rows of one item_id are one item. Repeated rows get the same result, a long text is searched whole.
Extra columns pass, whatever their names; those named n_words, hits or items give way to the results. An empty
benchmark hits nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField

from .shared import Rows, pick

WINDOW, PART_WORDS, MIN_ITEMS, SLAB_BYTES = 8, 1_000_000, 2, 32 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # bytes.lower() is A-Z alone


class Matcher:
    """Patterns of length m, tuples of word numbers from 1; a document's unknown words are 0."""

    def __init__(self, m: int, patterns: dict[tuple[int, ...], set[str]]):
        self.m, self.block = m, min(2, m)
        self.shift: dict[tuple[int, ...], int] = {}
        self.buckets: dict[tuple[int, ...], list[tuple[tuple[int, ...], set[str]]]] = {}
        for p, items in patterns.items():
            for end in range(self.block, m + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, m), m - end)
            self.buckets.setdefault(p[m - self.block :], []).append((p, items))

    def find(self, ids: list[int], hit: np.ndarray, items: set[str]) -> None:
        m, n, shift, far = self.m, len(ids), self.shift.get, self.m - self.block + 1
        pairs = self.block == 2
        at = m
        while at <= n:
            key = (ids[at - 2], ids[at - 1]) if pairs else (ids[at - 1],)
            move = shift(key, far)
            if move:
                at += move
                continue
            own = tuple(ids[at - m : at])
            for pattern, names in self.buckets[key]:
                if pattern == own:
                    hit[at - m : at] = True
                    items |= names
            at += 1


class Patterns:
    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for name, words in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            m = min(window, len(ids))
            for k in range(len(ids) - m + 1):
                by_length.setdefault(m, {}).setdefault(tuple(ids[k : k + m]), set()).add(name)
        self.matchers = [Matcher(m, p) for m, p in sorted(by_length.items())]


def parts(benchmark: DataFrame, part_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    part, size = [], 0
    for r in pick(benchmark, "item_id", "text").filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        words = words_of(r.text.encode())
        if words:
            part.append((r.i, words))
            size += len(words)
        if size >= part_words:
            yield part
            part, size = [], 0
    if part:
        yield part


def slabs(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches that follow each other, with size bytes of text together, if there are so many; one batch if size is 0."""
    held, total = [], 0
    for b in batches:
        held.append(b)
        total += b.column(b.schema.get_field_index(column)).nbytes
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", part_words: int = PART_WORDS, slab_bytes: int = SLAB_BYTES, names: Sequence[str] = ("n_words", "hits", "items")) -> DataFrame:
    """docs with n_words, hits (array of [begin, end) runs of hit words, flat) and items (sorted as strings) added, under these names."""
    rows = Rows(docs, *names)
    at, sc = rows.at(text), docs.sparkSession.sparkContext
    sent = [sc.broadcast(zlib.compress(pickle.dumps(part), 1)) for part in parts(benchmark, part_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = lambda part: Patterns(pickle.loads(zlib.decompress(part.value)), window)
        one = load(sent[0]) if len(sent) == 1 else None
        for slab in slabs(batches, at, slab_bytes if len(sent) > 1 else 0):
            texts = [t.as_py() for b in slab for t in pc.fill_null(b.column(b.schema.get_field_index(at)).cast(pa.large_binary()), b"")]
            hits: list[np.ndarray] = [np.zeros(0, bool)] * len(texts)
            items: list[set[str]] = [set() for _ in texts]
            for turn, part in enumerate(sent or [None]):
                patterns = one if one is not None else load(part) if part is not None else Patterns([])
                number = patterns.number.get
                for k, t in enumerate(texts):
                    words = words_of(t)
                    if not turn:
                        hits[k] = np.zeros(len(words), bool)
                    ids = [number(w, 0) for w in words]
                    for matcher in patterns.matchers:
                        matcher.find(ids, hits[k], items[k])
            done = 0
            for b in slab:
                own, found = hits[done : done + b.num_rows], items[done : done + b.num_rows]
                done += b.num_rows
                edges = [np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist() for hit in own]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(len, own), pa.int64()), pa.array(edges, pa.list_(pa.int64())), pa.array(map(sorted, found), pa.list_(pa.string()))], [*b.schema.names, *names])

    return rows.mapped(run, [StructField(n, k) for n, k in zip(names, (LongType(), ArrayType(LongType()), ArrayType(StringType())), strict=True)])


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    runs = F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", runs.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= MIN_ITEMS).alias("contaminated"))
