"""Substring dedup: fixed-block anchors.

WINDOW consecutive words of one document are removed where the same words also start anywhere else. Any such
run holds a whole reference block: BLOCK = (WINDOW + 1) // 2 words that begin at a multiple of BLOCK.

1. Documents are dealt into cells of about CELL_CHARS characters. Each cell sends the hashes of all its
   rolling windows of BLOCK words to buckets of the hash range, sorted and packed, twice at most for a value
   that repeats in the cell (so that a passage of a third of all documents is two entries a cell), and beside
   them those that are reference blocks.
2. A bucket joins the blocks with the rolling windows: a block whose hash occurs at two places is an anchor.
   Anchors go back to the cells that have them.
3. In its cell each hit is extended over its words to both sides: the windows of WINDOW words that hold the hit
   are sent on as 128-bit BLAKE2b digests of their words, again once or twice a cell; those that occur at two
   places are repeats, and the cell learns of them by a bit for each value it sent. Consecutive repeated windows
   are the maximal exact repeats.
4. The cell drops the words that they cover.

The hashes of step 1 are short polynomials modulo 2^61 - 1 with bases drawn for the run; a false hit costs a
needless probe in step 3, and equal words never miss each other. In step 3 windows are equal if their words'
keyed digests are. All steps are one plan over one exchange of the text, which Spark reuses.

Null text has no words. Rows with the same doc_id, and repeated rows, are different places. A text longer than
a cell is a cell. Extra columns pass, whatever their names; those named n_words, n_removed or kept_text give way
to the results. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .shared import NOT_SPACE, Rows, bytes_of, draw, joined, window_hashes, windows, word_hashes, words_of

WINDOW, CELL_CHARS, BUCKET_CHARS = 35, 2_000_000, 20_000_000


def twice(values: np.ndarray) -> np.ndarray:
    """Sorted values, each once, or twice if it occurs more than once."""
    v, n = np.unique(values, return_counts=True)
    return np.repeat(v, np.minimum(n, 2))


def packed(values: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The runs of one bucket of values that are ordered by it."""
    if len(values):
        at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield int(bucket[a]), values[a:b]


class Cell:
    """The words of a cell's rows."""

    def __init__(self, column: pa.Array, window: int, seed: tuple[int, int, bytes]):
        self.window, self.block, self.seed = window, (window + 1) // 2, seed
        self.buf, self.off = bytes_of(column)
        self.start, self.end, self.first = words_of(self.buf, self.off, NOT_SPACE)
        self.words = word_hashes(self.buf, self.start, self.end, seed)

    def rolling(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a window of block words begins, its hash, and whether it is a reference block."""
        at, count = windows(self.first, self.block)
        place = at - np.repeat(self.first[:-1], count)
        return at, window_hashes(self.words, self.block, self.seed)[at], place % self.block == 0

    def full(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of window words begin that hold a hit, and the digests of their words."""
        n = len(self.words)
        marks = np.zeros(n + self.window + 1, np.int64)
        marks[hit] = 1
        sums = np.concatenate([[0], np.cumsum(marks)])
        at, _ = windows(self.first, self.window)
        at = at[sums[at + self.window - self.block + 1] > sums[at]]
        text, begin, stop = joined(self.buf, self.start, self.end)
        text, blake, key = memoryview(text), hashlib.blake2b, self.seed[2]
        digests = [blake(text[x:y], digest_size=16, key=key).digest() for x, y in zip(begin[at].tolist(), stop[at + self.window - 1].tolist(), strict=True)]
        return at, np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def short(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and 32 bits inside the bucket."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def ordered(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and short value, once or twice, ordered."""
    bucket, low = short(hashes, buckets)
    v = twice(bucket.astype(np.uint64) << np.uint64(32) | low)
    return (v >> np.uint64(32)).astype(np.int64), (v & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def among(values: np.ndarray, known: np.ndarray, bits: int = 20) -> np.ndarray:
    """Which 64-bit hashes are known: by a table of their middle bits, then exactly."""
    place = lambda v: (v >> np.uint64(8)) & np.uint64((1 << bits) - 1)
    table = np.zeros(1 << bits, bool)
    table[place(known)] = True
    maybe = table[place(values)]
    maybe[maybe] = np.isin(values[maybe], known)
    return maybe


def order128(h: np.ndarray) -> np.ndarray:
    """Rows of two 64-bit numbers, ordered."""
    out = h[np.argsort(h[:, 0])]
    if ((out[1:, 0] == out[:-1, 0]) & (out[1:, 1] != out[:-1, 1])).any():
        out = h[np.lexsort((h[:, 1], h[:, 0]))]
    return out


def as_before(h: np.ndarray, back: int = 1) -> np.ndarray:
    """Which of the ordered rows equal the one back rows before."""
    out = np.zeros(len(h), bool)
    out[back:] = (h[back:] == h[:-back]).all(axis=1)
    return out


def among128(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which rows are among the known ones, which are ordered and different."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known[:, 0], values[:, 0]), len(known) - 1)
    out = (known[at] == values).all(axis=1)
    while True:  # others with the same first half
        at = np.minimum(at + 1, len(known) - 1)
        more = (known[at, 0] == values[:, 0]) & ~out & (known[at, 1] <= values[:, 1])
        if not more.any() or (at == len(known) - 1).all():
            return out | (known[at] == values).all(axis=1)
        out |= (known[at] == values).all(axis=1)


def mark_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", cell_chars: int = CELL_CHARS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """docs with n_words, n_removed and kept_text (the other words joined by one space) added."""
    rows, seed = Rows(docs, "n_words", "n_removed", "kept_text"), draw()
    body, names = rows.at(text), rows.frame.columns
    total = rows.frame.agg(F.sum(F.length(body))).first()[0] or 0
    cells, buckets = max(1, math.ceil(total / cell_chars)), max(1, math.ceil(total / bucket_chars))
    ids = [rows.col("doc_id")] if any(f.name.lower() == "doc_id" for f in rows.fields) else []
    dealt = rows.frame.withColumn("__cell", F.pmod(F.xxhash64(body, *ids), F.lit(cells)).cast("int"))

    def whole(table: pa.Table) -> Cell:
        c = table.column(body).combine_chunks() if table.num_rows else pa.array([], pa.string())
        return Cell(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c, window, seed)

    def probe(table: pa.Table) -> pa.Table:
        number = table.column("__cell")[0].as_py()
        _, h, block = whole(table).rolling()
        blocks = dict(packed(*reversed(ordered(h[block], buckets))))
        out = [(b, number, blocks[b].tobytes() if b in blocks else b"", v.tobytes()) for b, v in packed(*reversed(ordered(h, buckets)))]
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "__cell": pa.array([x[1] for x in out], pa.int32()), "blocks": pa.array([x[2] for x in out], pa.binary()), "rolling": pa.array([x[3] for x in out], pa.binary())})

    def anchors(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        rolling = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("rolling")]
        blocks = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("blocks")]))
        every = np.sort(np.concatenate(rolling))
        again = np.unique(every[1:][every[1:] == every[:-1]])
        found = again[np.isin(again, blocks, assume_unique=True)]
        out = [(number.as_py(), np.intersect1d(own, found)) for number, own in zip(table.column("__cell"), rolling, strict=True)] if len(found) else []
        out = [x for x in out if len(x[1])]
        return pa.table({"__cell": pa.array([x[0] for x in out], pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()), "found": pa.array([x[1].tobytes() for x in out], pa.binary())})

    def hits(cell: Cell, found: pa.Table) -> np.ndarray:
        at, h, _ = cell.rolling()
        bucket, low = short(h, buckets)
        value = bucket.astype(np.uint64) << np.uint64(32) | low
        known = [np.frombuffer(x.as_py(), np.uint32).astype(np.uint64) | np.uint64(b.as_py() << 32) for b, x in zip(found.column("bucket"), found.column("found"), strict=True)]
        return at[among(value, np.concatenate(known))] if known else at[:0]

    def candidates(cell: Cell, found: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
        """Windows that hold an anchor, their hashes, and by bucket the ordered hashes, each once or twice."""
        at, h = cell.full(hits(cell, found))
        v = order128(h)
        v = v[~as_before(v, 2)]
        return at, h, list(packed(v, short(v[:, 0], buckets)[0]))

    def extend(table: pa.Table, found: pa.Table) -> pa.Table:
        out = candidates(whole(table), found)[2] if table.num_rows and found.num_rows else []
        number = table.column("__cell")[0].as_py() if out else 0
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "__cell": pa.array([number] * len(out), pa.int32()), "values": pa.array([x.tobytes() for _, x in out], pa.binary())})

    def repeats(table: pa.Table) -> pa.Table:
        """For each cell's hashes of the bucket a bit: whether it occurs at two places."""
        values = [np.frombuffer(x.as_py(), np.uint64).reshape(-1, 2) for x in table.column("values")]
        every = order128(np.concatenate(values))
        again = every[as_before(every)]
        again = again[~as_before(again)]
        out = [(c.as_py(), among128(own, again)) for c, own in zip(table.column("__cell"), values, strict=True)]
        out = [x for x in out if x[1].any()]
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"__cell": pa.array([x[0] for x in out], pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()), "bits": pa.array([np.packbits(x[1]).tobytes() for x in out], pa.binary())})

    def drop(table: pa.Table, found: pa.Table, again: pa.Table) -> pa.Table:
        cell = whole(table)
        n = len(cell.words)
        gone = np.zeros(n + 1, np.int64)
        if again.num_rows and found.num_rows:
            at, h, sent = candidates(cell, found)
            bits = dict(zip(again.column("bucket").to_pylist(), again.column("bits").to_pylist(), strict=True))
            known = [v[np.unpackbits(np.frombuffer(bits[b], np.uint8), count=len(v)).astype(bool)] for b, v in sent if b in bits]
            known = np.concatenate(known)
            at = at[among128(h, known[~as_before(known)])]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + window, -1)
        gone = np.cumsum(gone)[:n] > 0
        words = np.diff(cell.first)
        sums = np.concatenate([[0], np.cumsum(gone)])
        removed = sums[cell.first[1:]] - sums[cell.first[:-1]]
        kept = []
        for k in range(len(words)):
            own = cell.buf[cell.off[k] : cell.off[k + 1]].tobytes().split()
            kept.append(b" ".join(compress(own, (~gone[cell.first[k] : cell.first[k + 1]]).tolist()) if removed[k] else own))
        return table.select(names).append_column("n_words", pa.array(words, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64())).append_column("kept_text", pa.array([x.decode() for x in kept], pa.string()))

    probes = dealt.groupBy("__cell").applyInArrow(probe, "bucket int, __cell int, blocks binary, rolling binary")
    anchor = probes.groupBy("bucket").applyInArrow(anchors, "__cell int, bucket int, found binary")
    extended = dealt.groupBy("__cell").cogroup(anchor.groupBy("__cell")).applyInArrow(extend, "bucket int, __cell int, values binary")
    again = extended.groupBy("bucket").applyInArrow(repeats, "__cell int, bucket int, bits binary")
    both = anchor.select("__cell", "bucket", "found", F.lit(None).cast("binary").alias("bits")).unionByName(again.select("__cell", "bucket", F.lit(None).cast("binary").alias("found"), "bits"))

    def finish(table: pa.Table, side: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in table.schema if f.name != "__cell"} | {"n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        has = side.column("found").is_valid()
        return drop(table, side.filter(has), side.filter(side.column("bits").is_valid()))

    added = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())]
    out = dealt.groupBy("__cell").cogroup(both.groupBy("__cell")).applyInArrow(finish, StructType([*rows.frame.schema.fields, *added]))
    return rows.out(out, **{f.name: F.col(f.name) for f in added})
