"""Pairwise alignment: edit distance with global, prefix and infix ends, and gap-affine scores, in Arrow batches.

All pairs of a batch advance together: one numpy step for each row of the matrix, over all pairs and columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAR = np.int32(1 << 28)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points padded with 0, and the sizes."""
    size = np.array([len(t) for t in texts], np.int64)
    most = int(size.max(initial=0))
    if not most:
        return np.zeros((len(texts), 0), np.uint32), size
    return np.array(texts, f"<U{most}").view(np.uint32).reshape(len(texts), most), size


def _ramp(values: np.ndarray, step: int) -> np.ndarray:
    """min over k <= j of values[k] + step * (j - k), along the last axis."""
    slope = np.arange(values.shape[1], dtype=np.int32) * step
    return np.minimum.accumulate(values - slope, axis=1) + slope


def edit_distances(patterns: list[str], texts: list[str], mode: str = "global", mismatch: int = 1, gap: int = 1) -> np.ndarray:
    """Costs of patterns against texts. prefix: the text's end is free; infix: both its ends are. With mismatch 2
    only insertions and deletions are left (the indel distance)."""
    p, n = codes(patterns)
    t, m = codes(texts)
    row = np.zeros((len(n), t.shape[1] + 1), np.int32) if mode == "infix" else np.tile(np.arange(t.shape[1] + 1, dtype=np.int32) * gap, (len(n), 1))
    inside = np.arange(t.shape[1] + 1)[None, :] <= m[:, None]
    pick = lambda r: r[np.arange(len(n)), m] if mode == "global" else np.where(inside, r, FAR).min(axis=1)
    out = np.where(n == 0, pick(row), 0)
    for i in range(p.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = (i + 1) * gap
        new[:, 1:] = np.minimum(row[:, :-1] + mismatch * (t != p[:, i : i + 1]), row[:, 1:] + gap)
        row = _ramp(new, gap)
        ended = n == i + 1
        if ended.any():
            out = np.where(ended, pick(row), out)
    return out


def _narrow(p: np.ndarray, t: np.ndarray, mismatch: int, opening: int, extension: int) -> tuple[type, int]:
    """Numbers, and one that stands for no way, such that no cost, and none on the way, reaches half of their range."""
    most = 2 * opening + (mismatch + 2 * extension) * (p.shape[1] + t.shape[1] + 1)
    return (np.int16, 1 << 14) if most < 1 << 13 else (np.int32, int(FAR))


def _letters(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same codes in fewer bits."""
    most = max(p.max(initial=0), t.max(initial=0))
    if most < 256:
        return p.astype(np.uint8), t.astype(np.uint8)
    return p, t


def _band(p: np.ndarray, n: np.ndarray, t: np.ndarray, m: np.ndarray, w: int, mismatch: int, opening: int, extension: int) -> np.ndarray:
    """The lowest gap-affine costs of ways that stay within w diagonals of the first one.

    Rows are diagonals and columns pairs. A diagonal's costs stand lower by extension times its number, so that a gap
    of text letters costs its opening alone and the best of them is a running minimum."""
    kind, far = _narrow(p, t, mismatch, opening, extension)
    width, pairs = 2 * w + 1, len(n)
    text = np.zeros((max(p.shape[1], t.shape[1]) + width, pairs), t.dtype)
    text[w : w + t.shape[1]] = t.T
    pattern = np.ascontiguousarray(p.T)
    steps = np.arange(width)
    first = np.where(steps < w, far, np.where(steps > w, opening + extension * (steps - w), 0)) - extension * steps
    best = np.repeat(first.astype(kind)[:, None], pairs, axis=1)
    down, low, other = np.full_like(best, far), np.empty_like(best), np.empty_like(best)
    chain = list(zip(best[1:], low, low[1:], strict=False))  # a row, the running minimum before it and with it
    mismatch, opened, twice = kind(mismatch), kind(opening), kind(2 * extension)
    out, ends = np.zeros(pairs, np.int64), m - n + w
    at = np.flatnonzero(n == 0)
    out[at] = best[ends[at], at] + extension * ends[at]
    finished = np.bincount(n, minlength=p.shape[1] + 1)
    for i in range(p.shape[1]):
        np.add(best, opened, out=low)
        np.minimum(down[1:], low[1:], out=down[:-1])
        down[-1] = far
        down[:-1] += twice
        np.multiply(text[i : i + width] != pattern[i], mismatch, out=other)
        best += other
        np.minimum(best, down, out=best)
        low[0] = best[0]
        for now, before, after in chain:
            np.minimum(now, before, out=after)
        low += opened
        np.minimum(best[1:], low[:-1], out=best[1:])
        if finished[i + 1]:
            at = np.flatnonzero(n == i + 1)
            out[at] = best[ends[at], at] + extension * ends[at]
    return out


def affine_costs(patterns: list[str], texts: list[str], mismatch: int = 4, opening: int = 6, extension: int = 2, free_text: bool = False, band: int = 8) -> np.ndarray:
    """Gap-affine costs end to end, or with both ends of the text free.

    End to end, ways near the first diagonal are tried first. One that goes beyond w diagonals and comes back to the
    end's, d, has two gaps of w + 1 and w + 1 - |d| letters at least; a cost that is not above theirs is the lowest of
    all. Other pairs are tried with twice the band, and in the end in the whole matrix."""
    p, n = codes(patterns)
    t, m = codes(texts)
    p, t = _letters(p, t)
    if free_text or not len(n):
        return _whole(p, n, t, m, mismatch, opening, extension, free_text)
    out, left, off = np.zeros(len(n), np.int64), np.arange(len(n)), np.abs(m - n)
    while len(left) and 2 * band + 1 < t.shape[1]:
        near = left[off[left] <= band]
        if len(near):
            cost = _band(p[near], n[near], t[near], m[near], band, mismatch, opening, extension)
            sure = cost <= 2 * opening + extension * (2 * (band + 1) - off[near])
            out[near[sure]] = cost[sure]
            left = np.setdiff1d(left, near[sure], assume_unique=True)
        band *= 2
    if len(left):
        out[left] = _whole(p[left], n[left], t[left], m[left], mismatch, opening, extension, False)
    return out


def _whole(p: np.ndarray, n: np.ndarray, t: np.ndarray, m: np.ndarray, mismatch: int, opening: int, extension: int, free_text: bool) -> np.ndarray:
    """Gap-affine costs by whole matrices."""
    width, rows = t.shape[1] + 1, len(n)
    kind, far = _narrow(p, t, mismatch, opening, extension)
    mismatch, opening, extension = (kind(x) for x in (mismatch, opening, extension))
    first = np.zeros((rows, width), kind) if free_text else np.tile(np.where(np.arange(width) > 0, opening + extension * np.arange(width), 0).astype(kind), (rows, 1))
    best, down = first, np.full((rows, width), far, kind)
    inside = np.arange(width)[None, :] <= m[:, None]
    pick = lambda r: np.where(inside, r, kind(far)).min(axis=1) if free_text else r[np.arange(rows), m]
    out = np.where(n == 0, pick(best), 0)
    slope = np.arange(width, dtype=kind) * extension
    new, across = np.empty_like(best), np.empty_like(best)
    for i in range(p.shape[1]):
        down += extension
        best += opening + extension
        np.minimum(down, best, out=down)
        new[:, 0] = down[:, 0]
        # the diagonal step from the row before, which stands higher by a gap's opening and one letter
        np.multiply(t != p[:, i : i + 1], mismatch, out=new[:, 1:])
        new[:, 1:] += best[:, :-1] - (opening + extension)
        np.minimum(new[:, 1:], down[:, 1:], out=new[:, 1:])
        np.subtract(new, slope, out=across)
        np.minimum.accumulate(across, axis=1, out=across)
        across += slope + (opening + extension)
        best[:, 0] = new[:, 0]
        np.minimum(new[:, 1:], across[:, :-1], out=best[:, 1:])
        ended = n == i + 1
        if ended.any():
            out = np.where(ended, pick(best), out)
    return out.astype(np.int64)


def with_cost(pairs: DataFrame, kind: str = "affine", name: str = "score", batch: int = 8192, cells: int = 1 << 21, most: int | None = None, **options) -> DataFrame:
    """pairs (pattern, text) with a score added: negative for weighted costs, positive for edit and indel; null where
    the cost is above most.

    Pairs of like texts are aligned together, batch at most, and fewer where a row of their matrices has more than cells."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            patterns, texts = (np.array([x or "" for x in c.tolist()], object) for c in (pdf.pattern, pdf.text))
            width = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
            order = np.argsort(width, kind="stable")
            out, k = np.zeros(len(pdf), np.int64), 0
            while k < len(order):
                size = min(batch, len(order) - k)
                while size > 1 and size * width[order[k + size - 1]] > cells:
                    size //= 2
                at = order[k : k + size]
                k += size
                p, t = patterns[at].tolist(), texts[at].tolist()
                if kind == "affine":
                    out[at] = -affine_costs(p, t, **options)
                elif kind == "linear":
                    out[at] = -edit_distances(p, t, "global", **options)
                elif kind == "indel":
                    out[at] = edit_distances(p, t, "global", mismatch=2)
                else:
                    out[at] = edit_distances(p, t, kind)
            yield pdf.assign(**{name: out if most is None else pd.Series(out, pdf.index, "Int64").mask(np.abs(out) > most)})

    from pyspark.sql.types import LongType, StructField, StructType

    return pairs.mapInPandas(run, StructType([*pairs.schema.fields, StructField(name, LongType())]))


def traced(pattern: str, text: str) -> str:
    """The operations of a global alignment with fewest edits: M equal, X other, I of the text, D of the pattern; M before X before D before I from the end."""
    n, m = len(pattern), len(text)
    d = [[i + j if i == 0 or j == 0 else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j - 1] + (pattern[i - 1] != text[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and pattern[i - 1] == text[j - 1] and d[i][j] == d[i - 1][j - 1]:
            out.append("M")
            i, j = i - 1, j - 1
        elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
            out.append("X")
            i, j = i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            out.append("D")
            i -= 1
        else:
            out.append("I")
            j -= 1
    return "".join(reversed(out))


def cigar(operations: str, extended: bool = True) -> str:
    """Run lengths; the standard form writes M for both equal and other."""
    own = operations.replace("M", "=") if extended else operations.replace("X", "M")
    return "".join(f"{len(x[0])}{x[1]}" for x in re.findall(r"((.)\2*)", own))


def cigar_cost(operations: Column, mismatch: int, opening: int, extension: int) -> Column:
    """Gap-affine cost of operations in the form 3=1X2I."""
    n, op = F.regexp_extract_all(operations, F.lit(r"(\d+)([MXID=])"), 1), F.regexp_extract_all(operations, F.lit(r"(\d+)([MXID=])"), 2)
    cost = lambda k, o: F.when(o == "X", k.cast("long") * mismatch).when(o.isin("I", "D"), opening + k.cast("long") * extension).otherwise(0)
    return F.aggregate(F.zip_with(n, op, cost), F.lit(0).cast("long"), lambda a, x: a + x)


def generated_pairs(ids: DataFrame, length: int, error: float, letters: str = "ACGT", seed: int = 7) -> DataFrame:
    """(id, pattern, text) for each id: a random pattern, and the pattern after round(length * error) random edits, each
    a mismatch, an insertion or a deletion. A pair depends on its id and the seed alone."""
    edits = round(length * error)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k in pdf.id.tolist():
                rng = np.random.default_rng([seed, k])
                base = rng.integers(0, len(letters), length)
                own = base.tolist()
                for kind, at, letter in zip(rng.integers(0, 3, edits).tolist(), rng.random(edits).tolist(), rng.integers(1, len(letters), edits).tolist(), strict=True):
                    spot = int(at * len(own))
                    if kind == 0:
                        own[spot] = (own[spot] + letter) % len(letters)
                    elif kind == 1:
                        own.insert(spot, letter)
                    else:
                        del own[spot]
                out.append((k, "".join(letters[x] for x in base), "".join(letters[x] for x in own)))
            yield pd.DataFrame(out, columns=["id", "pattern", "text"])

    return ids.select(F.col("id").cast("long").alias("id")).mapInPandas(run, "id long, pattern string, text string")
