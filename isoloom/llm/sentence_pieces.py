"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback.

A batch's text is cut where no piece can reach across (before a run of white space; `PieceModel` makes sure
that no piece holds white space behind another character). Units repeat, so that each is encoded once while
it is held. The new units of a batch are joined to one text, whose suffixes are sorted by their first
LONGEST characters (no piece is longer); every piece finds its range of suffixes by binary search, the
occurrences are the edges, they are sorted by their end, and each end is relaxed: the last piece of the best
encoding up to there is the one that begins where an encoding ends whose last piece stays apart from it under
the model's merges. That pair test fixes the encoding up to each place, so the result is the model's own.
All units of a batch are relaxed together, a character at a time.

A character of no piece becomes its UTF-8 bytes. Null text gives no tokens, and decodes to null; empty text
gives none, and decodes to empty. Very long units are relaxed like others. Other columns pass; an empty
table gives an empty result. Decoding restores the text, but for U+2581, which the model reads as a space.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from .shared import HELD, Rows, chunks, pick, send

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
HELD_UNITS, HELD_PAIRS, NEW_CHARS = 100_000, 250_000, 200_000
#: Units that are relaxed together at least; bits of a slot in the table of pair verdicts.
TOGETHER, SLOT_BITS = 24, 20
#: Stands for characters of no piece.
NO_SYMBOL = 0xFFFE
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceModel:
    """pieces: id by string; score: by id; surface: UTF-8 by id; raw: the ids of the 256 bytes."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.vocab_size())
        names = [m.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.raw = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.score = [m.get_score(i) for i in ids]
        probe = "  ﬁ  a\tＡ "
        if not all(map(m.is_byte, self.raw)) or m.decode(m.encode(probe)) != probe or m.encode("a", out_type=str)[0][:1] != SPACE:
            raise ValueError("only models with byte fallback, a leading space and no normalisation are supported")
        if any(SPACE in names[i].lstrip(SPACE) or "\n" in names[i] for i in plain):
            raise ValueError("pieces with line feeds, or with white space behind other characters, are not supported")
        self.pieces = {names[i]: i for i in plain}
        self.name = {i: names[i] for i in plain}
        self.pieces = {k: v for k, v in self.pieces.items() if self.merge(k) == [v]}
        self.surface = [b""] * len(names)
        for i in plain:
            self.surface[i] = names[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.raw):
            self.surface[i] = bytes([b])
        self.longest = max(map(len, self.pieces))

    def merge(self, text: str) -> list[int] | None:
        """The ids that the merges leave of a text whose characters are pieces: highest score first, then leftmost."""
        parts, ids, score = list(text), self.pieces, self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ids[p] for p in parts] if all(p in ids for p in parts) else None


@lru_cache(maxsize=2)
def load(path: str = MODEL) -> PieceModel:
    return PieceModel(path)


class Encoder(dict):
    """By unit the bytes of its ids as 32-bit numbers; units not met since the last renewal lie in old."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model
        self.apart: dict[tuple[int, int], bool] = {}
        self.old: dict[str, bytes] = {}
        self.table = np.full(1 << SLOT_BITS, -1, np.int64)
        self.names = sorted(model.pieces)
        self.ids = np.array([model.pieces[p] for p in self.names], np.int32)
        self.sizes = np.array([len(p) for p in self.names], np.int64)
        self.symbol = {c: k + 1 for k, c in enumerate(sorted({c for p in self.names for c in p}))}
        if len(self.symbol) >= NO_SYMBOL:
            raise ValueError("too many characters")
        self.symbols = np.zeros((len(self.names), model.longest), np.uint16)
        for k, p in enumerate(self.names):
            self.symbols[k, : len(p)] = [self.symbol[c] for c in p]
        self.points = np.full(0x110000, NO_SYMBOL, np.uint16)
        self.points[[ord(c) for c in self.symbol]] = list(self.symbol.values())

    @staticmethod
    def of_worker(key: str, model: Callable[[], PieceModel]) -> Encoder:
        """The encoder that this Python worker keeps from task to task for one broadcast model."""
        held = sys.__dict__.setdefault(HELD, {})
        if key not in held:
            held.clear()
            held[key] = Encoder(model())
        return held[key]

    def __missing__(self, unit: str) -> bytes:
        found = self[unit] = self.old[unit]
        return found

    def renew(self) -> None:
        if len(self) > HELD_UNITS:
            self.old = dict(self)
            self.clear()

    def stays_apart(self, a: int, b: int) -> bool:
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) >= HELD_PAIRS:
                self.apart.clear()
            known = self.apart[a, b] = self.model.merge(self.model.name[a] + self.model.name[b]) == [a, b]
        return known

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of pieces: piece numbers and sizes ordered by end and then by size, and the first edge of each end."""
        width = self.model.longest
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(points == 10, np.uint16(NO_SYMBOL), self.points[points])
        # the batch's own symbols in their order, as bytes if they are few; pieces with others do not occur
        met = np.zeros(NO_SYMBOL + 1, bool)
        met[codes] = True
        met[NO_SYMBOL] = False
        count = int(met.sum())
        kind, none, above = ("u1", 0xFE, 0xFF) if count < 0xFE else (">u2", NO_SYMBOL, 0xFFFF)
        short = np.where(met, np.cumsum(met), none).astype(kind)
        padded = np.concatenate([short[codes], np.zeros(width, kind)])
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width)[: len(codes)])
        may = np.flatnonzero(met[self.symbols].sum(axis=1) == self.sizes)
        low = short[self.symbols[may]]
        low[self.symbols[may] == 0] = 0
        high = np.where(low == 0, np.array(above, kind), low)
        each = keys.dtype.itemsize * width
        suffixes, low, high = (np.ascontiguousarray(x).view(f"S{each}").ravel() for x in (keys, low, high))
        if each % 8 == 0:
            parts = keys.view(">u8")
            order = np.lexsort([parts[:, k].astype(np.uint64) for k in range(each // 8 - 1, -1, -1)])
        else:
            order = np.argsort(suffixes, kind="stable")
        suffixes = suffixes[order]
        lo, hi = np.searchsorted(suffixes, low, "left"), np.searchsorted(suffixes, high, "right")
        found = np.maximum(hi - lo, 0)
        piece = np.repeat(may, found)
        place = order[np.arange(found.sum()) + np.repeat(lo - (np.cumsum(found) - found), found)]
        end = place + self.sizes[piece]
        by_end = np.argsort(end * (width + 1) + width - self.sizes[piece])
        return self.ids[piece[by_end]], self.sizes[piece[by_end]], np.searchsorted(end[by_end], np.arange(len(codes) + 2))

    def all_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """stays_apart of many pairs, by a direct-mapped table of verdicts."""
        key = a.astype(np.int64) << 31 | b
        slot = (key.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - SLOT_BITS)
        held = self.table[slot]
        ok = (held & 1).astype(bool)
        miss = np.flatnonzero(held >> 1 != key)
        if len(miss):
            new, at, back = np.unique(key[miss], return_index=True, return_inverse=True)
            verdict = np.fromiter(map(self.stays_apart, (new >> 31).tolist(), (new & 0x7FFFFFFF).tolist()), bool, len(new))
            self.table[slot[miss[at]]] = new << 1 | verdict
            ok[miss] = verdict[back]
        return ok

    def relax(self, begin: np.ndarray, size: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each end in the text the last piece of the encoding up to there (-2: a character of no piece) and where it begins.

        All units advance by one character at a time; the few longest are finished one by one."""
        ids, sizes, first = edges
        last, back = np.full(len(first), -1, np.int64), np.zeros(len(first), np.int64)
        order = np.argsort(-size)
        begin, size = begin[order], size[order]
        e, live = 1, len(size)
        while live >= TOGETHER:
            at = begin[:live] + e
            last[at], back[at] = -2, at - 1
            edge, stop = first[at], first[at + 1]
            while len(at):
                more = edge < stop
                at, edge, stop = at[more], edge[more], stop[more]
                s, own = at - sizes[edge], ids[edge]
                before = last[s]
                ok = before < 0
                pair = np.flatnonzero(~ok)
                ok[pair] = self.all_apart(before[pair], own[pair])
                last[at[ok]], back[at[ok]] = own[ok], s[ok]
                at, edge, stop = at[~ok], edge[~ok] + 1, stop[~ok]
            e += 1
            live = int(np.searchsorted(-size, -e, "right"))
        for b, n in zip(begin[:live].tolist(), size[:live].tolist()):
            self.relax_one(b, e, n, last, back, edges)
        return last, back

    def relax_one(self, begin: int, e: int, n: int, last: np.ndarray, back: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """relax for the ends e to n of one unit."""
        ends = edges[2][begin : begin + n + 2].tolist()
        ids, sizes = (x[ends[0] : ends[-1]].tolist() for x in edges[:2])
        own_last, own_back = last[begin : begin + n + 1].tolist(), back[begin : begin + n + 1].tolist()
        for to in range(e, n + 1):
            own_last[to], own_back[to] = -2, begin + to - 1
            for k in range(ends[to] - ends[0], ends[to + 1] - ends[0]):
                s = to - sizes[k]
                if own_last[s] < 0 or self.stays_apart(own_last[s], ids[k]):
                    own_last[to], own_back[to] = ids[k], begin + s
                    break
        last[begin : begin + n + 1], back[begin : begin + n + 1] = own_last, own_back

    def learn(self, units: list[str]) -> None:
        """Adds the units, which hold no line feed."""
        text = "\n".join(units)
        size = np.fromiter(map(len, units), np.int64, len(units))
        begin = np.cumsum(size + 1) - size - 1
        last, back = self.relax(begin, size, self.edges(text))
        used = np.zeros(len(last), bool)
        at, stop = begin + size, begin
        while len(at):
            used[at] = True
            at = back[at]
            go = at > stop
            at, stop = at[go], stop[go]
        ends = np.flatnonzero(used)
        tokens, cut = last[ends], np.searchsorted(ends, begin, "right")
        blob = tokens.astype(np.int32).tobytes()
        cuts = [*(4 * cut).tolist(), len(blob)]
        self.update(zip(units, map(blob.__getitem__, map(slice, cuts[:-1], cuts[1:]))))
        raw = self.model.raw
        for k in np.unique(np.searchsorted(begin, ends[tokens < 0], "left") - 1).tolist():
            lo, hi = cuts[k] // 4, cuts[k + 1] // 4
            out = []
            for end, i in zip((ends[lo:hi] - begin[k]).tolist(), tokens[lo:hi].tolist()):
                out += [i] if i >= 0 else [raw[x] for x in units[k][end - 1].encode()]
            self[units[k]] = np.array(out, np.int32).tobytes()


def units_of(text: str) -> list[str]:
    """Units, with line feeds as units of their own."""
    out = []
    for k, line in enumerate((SPACE + text.replace(" ", SPACE)).split("\n")):
        if k:
            out.append("\n")
        out += UNIT.findall(line)
    return out


def encoded(encoder: Encoder, rows: list[list[str] | None]) -> list[bytes | None]:
    """The ids of each row's units, as bytes."""
    todo = [u for u in set().union(*(units for units in rows if units)) if u not in encoder and u not in encoder.old]
    if "\n" in todo:
        todo.remove("\n")
        encoder["\n"] = np.array([encoder.model.raw[10]], np.int32).tobytes()
    at = 0
    while at < len(todo):
        to, size = at, 0
        while to < len(todo) and size < NEW_CHARS:
            size += len(todo[to]) + 1
            to += 1
        encoder.learn(todo[at:to])
        at = to
    blobs = [None if units is None else b"".join(map(encoder.__getitem__, units)) for units in rows]
    encoder.renew()
    return blobs


def text_of(ids: np.ndarray, surface: list[bytes]) -> str:
    whole = b"".join(map(surface.__getitem__, ids.tolist()))
    return (whole[1:] if whole[:1] == b" " else whole).decode("utf-8", "replace")


def encode(docs: DataFrame, model: PieceModel | None = None, text: str = "text", decoded: str | None = None) -> DataFrame:
    """docs with tokens (array of ids) added, and with their decoded text if a name for it is given.

    The model is sent to the tasks: bounded by its file."""
    sent, key = send(docs.sparkSession, model or load()), uuid.uuid4().hex
    more = ["tokens", *([decoded] if decoded else [])]
    rows = Rows(docs, *more)
    at = rows.at(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(key, sent)
        for b, _, _ in (piece for whole in batches for piece in chunks(whole, at)):
            blobs = encoded(encoder, [None if t is None else units_of(t) if t else [] for t in b.column(b.schema.get_field_index(at)).to_pylist()])
            offsets = np.zeros(len(blobs) + 1, np.int32)
            np.cumsum([len(x or b"") // 4 for x in blobs], out=offsets[1:])
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(x or b"" for x in blobs), np.int32), pa.int32()), mask=pa.array([x is None for x in blobs]))
            last = [pa.array([None if x is None else text_of(np.frombuffer(x, np.int32), encoder.model.surface) for x in blobs], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*b.columns, tokens, *last], [*b.schema.names, *more])

    return rows.mapped(run, [StructField("tokens", ArrayType(IntegerType())), *([StructField(decoded, StringType())] if decoded else [])])


def decode(docs: DataFrame, model: PieceModel | None = None, tokens: str = "tokens", to: str = "decoded") -> DataFrame:
    """docs with the text of their tokens added."""
    model = model or load()
    sent = docs.sparkSession.sparkContext.broadcast(model.surface)
    rows = Rows(docs, to)
    at = rows.at(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = sent.value
        for b in batches:
            column = b.column(b.schema.get_field_index(at))
            ids, bounds = column.values.to_numpy(), column.offsets.to_numpy()
            empty = column.is_null().to_pylist()
            out = [None if empty[k] else text_of(ids[bounds[k] : bounds[k + 1]], surface) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, to])

    return rows.mapped(run, [StructField(to, StringType())])


def summary(docs: DataFrame, model: PieceModel | None = None) -> DataFrame:
    """doc_id, n_tokens, tokens_sha256 (ids joined by commas) and round_trip (whether decoding gives the text)."""
    out = encode(pick(docs, "doc_id", "text"), model, decoded="decoded")
    return out.select("doc_id", F.size(F.coalesce("tokens", F.array().cast("array<int>"))).cast("long").alias("n_tokens"), F.sha2(F.array_join(F.coalesce("tokens", F.array().cast("array<int>")).cast("array<string>"), ","), 256).alias("tokens_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
