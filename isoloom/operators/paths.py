"""Pairwise alignment with one or two affine gap costs, with bounded free ends, and its path.

All pairs of a batch advance together, one numpy step for each row of the matrix. Paths keep the rows of a batch, so
that a batch is cut by its number of cells; a single pair needs about 4 * (1 + 2 * gaps) bytes a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .align import FAR, _ramp, cigar, codes

CELLS = 1 << 22


@dataclass(frozen=True)
class Costs:
    """mismatch (None: none allowed) and gaps (opening, extension); of several the cheapest for its length counts."""

    mismatch: int | None = 4
    gaps: tuple[tuple[int, int], ...] = ((6, 2),)

    @property
    def weighted(self) -> bool:
        """Whether scores are negative costs; edit and indel distances are positive."""
        return not (self.mismatch in (None, 1) and self.gaps == ((0, 1),))


EDIT, INDEL, LINEAR, AFFINE, DUAL = Costs(1, ((0, 1),)), Costs(None, ((0, 1),)), Costs(4, ((0, 2),)), Costs(), Costs(4, ((6, 2), (24, 1)))


@dataclass(frozen=True)
class Free:
    """How many letters at the ends of the pattern and the text may stay unaligned at no cost."""

    pattern_begin: int = 0
    pattern_end: int = 0
    text_begin: int = 0
    text_end: int = 0


def _across(row: np.ndarray, opening: int, extension: int) -> np.ndarray:
    """The cost of a gap of text letters that ends at each column."""
    out = np.full_like(row, FAR)
    out[:, 1:] = _ramp(row + np.int32(opening), extension)[:, :-1] + np.int32(extension)
    return out


def rows(p: np.ndarray, t: np.ndarray, costs: Costs, free: Free) -> Iterator[tuple[np.ndarray, list, list]]:
    """For each row of the matrices of all pairs: best, and for each gap cost the best that ends in a gap down or across."""
    width = t.shape[1] + 1
    other = FAR if costs.mismatch is None else np.int32(costs.mismatch)
    new = np.tile(np.where(np.arange(width) <= free.text_begin, 0, FAR).astype(np.int32), (len(p), 1))
    down = [np.full_like(new, FAR) for _ in costs.gaps]
    for i in range(p.shape[1] + 1):
        if i:
            down = [np.minimum(d, best + np.int32(o)) + np.int32(e) for d, (o, e) in zip(down, costs.gaps, strict=True)]  # noqa: F821
            new = np.minimum.reduce(down)
            new[:, 1:] = np.minimum(new[:, 1:], best[:, :-1] + other * (t != p[:, i - 1 : i]))  # noqa: F821
            if i <= free.pattern_begin:
                new[:, 0] = 0
        across = [_across(new, o, e) for o, e in costs.gaps]
        best = np.minimum.reduce([new, *across])
        yield best, down, across


def span_costs(patterns: list[str], texts: list[str], costs: Costs = AFFINE, free: Free = Free()) -> np.ndarray:
    """The lowest cost of each pair."""
    p, n = codes(patterns)
    t, m = codes(texts)
    columns = np.arange(t.shape[1] + 1)[None, :]
    ends = (columns <= m[:, None]) & (columns >= (m - free.text_end)[:, None])
    out = np.full(len(n), FAR, np.int64)
    for i, (best, _, _) in enumerate(rows(p, t, costs, free)):
        last = np.where(n == i, np.where(ends, best, FAR).min(axis=1), FAR)
        early = np.where((n >= i) & (n - i <= free.pattern_end), best[np.arange(len(n)), m], FAR)
        out = np.minimum(out, np.minimum(last, early))
    return out


def _traces(n: np.ndarray, m: np.ndarray, p: np.ndarray, t: np.ndarray, best: np.ndarray, down: np.ndarray, across: np.ndarray, costs: Costs, free: Free) -> list[tuple[int, str, int, int, int, int]]:
    """(cost, operations, begin and end in the pattern, in the text) of all pairs of a batch from their matrices, a step of
    all at a time. best: rows, pairs, columns; down and across: gaps, rows, pairs, columns."""
    pairs, gaps = np.arange(len(n)), len(costs.gaps)
    other = int(FAR) if costs.mismatch is None else costs.mismatch
    # of equal costs the end nearest to both ends, first those in the last row
    ends = [(n, m - k, k <= m) for k in range(min(free.text_end, int(m.max(initial=0))) + 1)]
    more = [(n - k, m, k <= n) for k in range(1, min(free.pattern_end, int(n.max(initial=0))) + 1)]
    away = np.array([*range(len(ends)), *range(1, len(more) + 1)])
    order = np.argsort(away, kind="stable")
    tried = [(ends + more)[k] for k in order]
    found = np.stack([np.where(able, best[np.maximum(i, 0), pairs, np.maximum(j, 0)], np.iinfo(np.int32).max) for i, j, able in tried])
    chosen = found.argmin(axis=0)
    cost = found[chosen, pairs]
    i, j = (np.stack([np.broadcast_to(x[w], n.shape) for x in tried])[chosen, pairs] for w in (0, 1))
    end_i, end_j = i.copy(), j.copy()
    begin_i, begin_j = i.copy(), j.copy()
    extension = np.array([e for _, e in costs.gaps])
    gap = np.full(len(n), -1)  # the open gap: its cost's number, those across after those down
    out, at = np.zeros((p.shape[1] + t.shape[1] + 1, len(n)), np.uint8), np.zeros(len(n), np.int64)
    r = pairs
    while True:
        g = gap[r]
        stop = (g < 0) & (((i == 0) & (j <= free.text_begin)) | ((j == 0) & (i <= free.pattern_begin)))
        begin_i[r[stop]], begin_j[r[stop]] = i[stop], j[stop]
        r, i, j, g = r[~stop], i[~stop], j[~stop], g[~stop]
        if not len(r):
            break
        is_open = g >= 0
        same = (i > 0) & (j > 0) & (p[r, np.maximum(i - 1, 0)] == t[r, np.maximum(j - 1, 0)]) if p.shape[1] and t.shape[1] else np.zeros(len(r), bool)
        here = best[i, r, j]
        both = ~is_open & (i > 0) & (j > 0) & (here == best[np.maximum(i - 1, 0), r, np.maximum(j - 1, 0)] + np.where(same, 0, other))
        out[at[r[both]], r[both]] = np.where(same[both], ord("M"), ord("X"))
        # a step in an open gap; it closes where the gap did not go on
        falls = is_open & (g < gaps)
        own = np.where(is_open, g % gaps, 0)
        i1, j1 = np.where(falls, i - 1, i), np.where(is_open & ~falls, j - 1, j)
        goes = np.where(falls, down[own, i, r, j] == down[own, np.maximum(i1, 0), r, j] + extension[own], across[own, i, r, j] == across[own, i, r, np.maximum(j1, 0)] + extension[own])
        out[at[r[is_open]], r[is_open]] = np.where(falls[is_open], ord("D"), ord("I"))
        # no gap and no letters: the first gap that ends here opens
        opens = ~is_open & ~both
        first = np.full(len(r), -1)
        for k in range(2 * gaps - 1, -1, -1):
            held = (down if k < gaps else across)[k % gaps]
            first = np.where(held[i, r, j] == here, k, first)
        gap[r] = np.where(opens, first, np.where(is_open & goes, g, -1))
        at[r] += both | is_open
        i, j = np.where(both, i - 1, i1), np.where(both, j - 1, j1)
    ways = out.T.copy()
    result = []
    for k, (c, bi, bj, ei, ej, size, pn, tn) in enumerate(zip(*(x.tolist() for x in (cost, begin_i, begin_j, end_i, end_j, at, n, m)), strict=True)):
        way = ways[k, :size][::-1].tobytes().decode()
        result.append((c, "I" * bj + "D" * bi + way + "D" * (pn - ei) + "I" * (tn - ej), bi, ei, bj, ej))
    return result


def paths(patterns: list[str], texts: list[str], costs: Costs = AFFINE, free: Free = Free()) -> list[tuple[int, str, int, int, int, int]]:
    """(cost, operations, begin and end in the pattern, in the text) of each pair. From the end M goes before X, D and
    I; unaligned ends are operations too; of several ends the one nearest to both ends counts, the text's shorter first."""
    out = []
    k = 0
    while k < len(patterns):
        size, wide, high = 0, 0, 0
        while k + size < len(patterns):
            wide, high = max(wide, len(patterns[k + size])), max(high, len(texts[k + size]))
            if size and (size + 1) * (wide + 1) * (high + 1) > CELLS:
                break
            size += 1
        (p, n), (t, m) = codes(patterns[k : k + size]), codes(texts[k : k + size])
        kept = list(rows(p, t, costs, free))
        best = np.stack([b for b, _, _ in kept])
        down, across = (np.stack([np.stack([x[w][g] for x in kept]) for g in range(len(costs.gaps))]) for w in (1, 2))
        out.extend(_traces(n, m, p, t, best, down, across, costs, free))
        k += size
    return out


def with_path(pairs: DataFrame, costs: Costs = AFFINE, free: Free = Free(), extended: bool = True) -> DataFrame:
    """pairs (pattern, text) with score, cigar and the aligned part (p_begin, p_end, t_begin, t_end); null is empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = paths(pdf.pattern.fillna("").tolist(), pdf.text.fillna("").tolist(), costs, free)
            score = [-x[0] if costs.weighted else x[0] for x in found]
            yield pdf.assign(score=score, cigar=[cigar(x[1], extended) for x in found], **{c: [x[2 + k] for x in found] for k, c in enumerate(("p_begin", "p_end", "t_begin", "t_end"))})

    more = [StructField("score", LongType()), StructField("cigar", StringType()), *(StructField(c, LongType()) for c in ("p_begin", "p_end", "t_begin", "t_end"))]
    return pairs.mapInPandas(run, StructType([*pairs.schema.fields, *more]))


def operations_cost(operations: str, costs: Costs) -> int:
    """The cost of operations, all of them paid."""
    total = 0
    for kind, run in groupby(operations):
        size = len(list(run))
        if kind == "X":
            total += size * (int(FAR) if costs.mismatch is None else costs.mismatch)
        elif kind in "ID":
            total += min(o + e * size for o, e in costs.gaps)
    return total


def relabelled(operations: str, pattern: str, text: str) -> str:
    """The operations with M and X by what the letters are."""
    out, i, j = [], 0, 0
    for kind in operations:
        out.append(("M" if pattern[i] == text[j] else "X") if kind in "MX" else kind)
        i, j = i + (kind != "I"), j + (kind != "D")
    return "".join(out)


def valid(operations: str, pattern: str, text: str) -> bool:
    """Whether the operations use up both sequences and say of each letter pair what it is."""
    spent = len(operations) - operations.count("I") == len(pattern) and len(operations) - operations.count("D") == len(text)
    return spent and set(operations) <= set("MXID") and relabelled(operations, pattern, text) == operations


def best_prefix(operations: str, costs: Costs, match: int) -> tuple[str, int]:
    """The shortest prefix of the operations with the highest score, and it; each M gains match."""
    best, score, at, size = 0, 0, 0, 0
    for kind, run in groupby(operations):
        own = len(list(run))
        score += match * own if kind == "M" else -operations_cost(kind * own, costs)
        at += own
        if score > best:
            best, size = score, at
    return operations[:size], best
