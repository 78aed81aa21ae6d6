"""Demultiplexing: find the read structure, correct barcodes and UMIs, cut reads."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from . import paths
from .align import codes, edit_distances


@dataclass(frozen=True)
class Structure:
    """Parts (name, sequence; ? and the letters of MATCHES are several bases) and the edits allowed for the whole."""

    parts: tuple[tuple[str, str], ...]
    edits: int

    @property
    def pattern(self) -> str:
        return "".join(s for _, s in self.parts)


#: Read structures of the two searching modes.
STRUCTURES = {
    "visium": Structure((("primer", "CTACACGACGCTCTTCCGATCT"), ("barcode", "?" * 16), ("umi", "?" * 12), ("tail", "T" * 10)), 8),
    "magicseq": Structure((("primer", "CTACACGACGCTCTTCCGATCT"), ("x", "?" * 8), ("link1", "CAGTCATGTCATGAGCTA"), ("y", "?" * 8), ("link2", "TGATGCGACACTGATCGA"), ("z", "?" * 8), ("umi", "?" * 12), ("tail", "T" * 10)), 20),
}


#: Letters that stand for several bases. A letter and its bases match on either side, it and another don't.
MATCHES = {"R": "AG", "K": "GT", "S": "GC", "Y": "CT", "M": "AC", "W": "AT", "B": "CGT", "H": "ACT", "?": "ACGT", "D": "AGT", "V": "ACG", "N": "ACGT"}


def _equal() -> np.ndarray:
    out = np.eye(256, dtype=bool)
    for letter, bases in MATCHES.items():
        for base in bases:
            out[ord(letter), ord(base)] = out[ord(base), ord(letter)] = True
    return out


EQUAL = _equal()


def structure(mode: str) -> Structure:
    if mode not in STRUCTURES:
        raise ValueError(f"{mode} is not searched")
    return STRUCTURES[mode]


#: Cells of a row of the matrices that advance together.
CELLS = 1 << 17


def _steps(pattern: str, text: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of the matrices of all texts (a column each, letters down), each cell lower by its place in the text."""
    kind = np.int16 if len(pattern) + len(text) < 1 << 13 else np.int32
    better = {c: (~EQUAL[ord(c)]).astype(kind)[text] - kind(1) for c in set(pattern)}
    row = np.repeat(-np.arange(len(text) + 1, dtype=kind)[:, None], text.shape[1], axis=1)
    yield row
    for c in pattern:
        new = row + kind(1)
        np.minimum(new[1:], row[:-1] + better[c], out=new[1:])
        row = np.minimum.accumulate(new, axis=0)
        yield row


def _letters(reads: list[str]) -> tuple[np.ndarray, np.ndarray]:
    letters, sizes = codes(reads)
    return np.where(letters < 256, letters, 0).astype(np.uint8).T.copy(), sizes


def locate_all(pattern: str, reads: list[str], edits: int) -> list[tuple[int, list[int]] | None]:
    """For each read (cost, where each pattern letter begins in the read and the end) of the best place; None beyond edits.

    Reads of near lengths advance together. Only the last row of their matrices is kept; a place within edits begins at
    most as many letters before the pattern's length, so that its way is traced in a second matrix of that part alone."""
    out: list[tuple[int, list[int]] | None] = [None] * len(reads)
    order = sorted((k for k in range(len(reads)) if len(reads[k]) >= len(pattern)), key=lambda k: len(reads[k]), reverse=True)
    while order:
        size = max(CELLS // (len(reads[order[0]]) + 1), 1)
        now, order = order[:size], order[size:]
        text, sizes = _letters([reads[k] for k in now])
        place = np.arange(len(text) + 1)[:, None]
        for last in _steps(pattern, text):
            pass
        cost = np.where(place <= sizes, last.astype(np.int32) + place, np.iinfo(np.int32).max)
        end = cost.argmin(axis=0)
        cost = cost[end, np.arange(len(now))]
        hits = np.flatnonzero(cost <= edits)
        if len(hits):
            begin = np.maximum(end[hits] - len(pattern) - edits, 0)
            part = _letters([reads[now[h]][b:e] for h, b, e in zip(hits.tolist(), begin.tolist(), end[hits].tolist(), strict=True)])
            at = _traced(pattern, *part) + begin
            for h, c, way in zip(hits.tolist(), cost[hits].tolist(), at.T.tolist(), strict=True):
                out[now[h]] = c, way
    return out


def _traced(pattern: str, text: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where each pattern letter (down) begins in each text (across) on the best way to its end, and the end."""
    n, across = len(pattern), np.arange(text.shape[1])
    rows = np.stack(list(_steps(pattern, text)))
    differs = ~EQUAL[np.frombuffer(pattern.encode(), np.uint8)]
    at = np.zeros((n + 1, len(end)), np.int64)
    at[n] = end
    i, j = np.full(len(end), n), end.copy()
    while len(across):
        here, letter = rows[i, j, across], text[np.maximum(j - 1, 0), across]
        # rows are lower by the place: a step to the left in the text counts one more
        both = (j > 0) & (here == rows[i - 1, np.maximum(j - 1, 0), across] + differs[i - 1, letter] - 1)
        up = ~both & (here == rows[i - 1, j, across] + 1)
        i, j = i - (both | up), j - ~up
        moved = both | up
        at[i[moved], across[moved]] = j[moved]
        on = i > 0
        i, j, across = i[on], j[on], across[on]
    return at


def locate(pattern: str, read: str, edits: int) -> tuple[int, list[int]] | None:
    """(cost, where each pattern letter begins in the read and the end) of the best place in the read; None beyond edits."""
    return locate_all(pattern, [read], edits)[0]


@dataclass
class Correcter:
    """The nearest barcodes within most edits, exactly.

    A barcode cut into d + 1 pieces keeps one of them whole under d edits, moved by at most d letters. So all
    barcodes within d edits of what was seen are among those that share a piece with it; d goes up from 1 until
    one of them is that near."""

    barcodes: list[str]
    most: int
    index: dict[tuple[int, int, int, str], list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.known = set(self.barcodes)
        self.sizes = sorted({len(b) for b in self.known})
        for b in sorted(self.known):
            for d in range(1, self.most + 1):
                for i, (s, e) in enumerate(self.cuts(len(b), d)):
                    self.index.setdefault((len(b), d, i, b[s:e]), []).append(b)

    @staticmethod
    def cuts(size: int, d: int) -> list[tuple[int, int]]:
        return [(size * i // (d + 1), size * (i + 1) // (d + 1)) for i in range(d + 1)]

    def sharing(self, seen: str, d: int) -> list[str]:
        """Barcodes of which a piece lies whole in seen, at most d letters from its place."""
        out = set()
        for size in self.sizes:
            for i, (s, e) in enumerate(self.cuts(size, d)):
                for at in range(max(s - d, 0), s + d + 1):
                    out.update(self.index.get((size, d, i, seen[at : at + e - s]), ()))
        return sorted(out)

    def correct(self, seen: str) -> tuple[str | None, int, bool]:
        """(barcode, distance, whether others are as near); no barcode and most + 1 beyond most edits."""
        return self.correct_all([seen])[seen]

    def correct_all(self, seen: Iterable[str]) -> dict[str, tuple[str | None, int, bool]]:
        """By what was seen, as correct() has it; all are compared at once for each number of edits."""
        out = {s: (s, 0, False) if s in self.known else (None, self.most + 1, False) for s in seen}
        left = [s for s in out if s not in self.known]
        for d in range(1, self.most + 1):
            pairs = [(b, s) for s in left for b in self.sharing(s, d)]
            hits: dict[str, list[str]] = {}
            for k in range(0, len(pairs), 1 << 14):
                some = pairs[k : k + (1 << 14)]
                for (b, s), x in zip(some, edit_distances([b for b, _ in some], [s for _, s in some]), strict=True):
                    if x <= d:
                        hits.setdefault(s, []).append(b)
            out.update({s: (found[0], d, len(found) > 1) for s, found in hits.items()})
            left = [s for s in left if s not in hits]
        return out


def correct_umi(seen: str, known: list[str], most: int = 3, k: int = 0) -> str:
    """The whitelisted UMI nearest to the seen one (the smallest of several), or what was seen. With k only those count
    that share k letters in a row with it."""
    if not known or seen in known:
        return seen
    runs = [seen[p : p + k] for p in range(len(seen) - k + 1) if set(seen[p : p + k]) <= set("ACGT")]
    able = [u for u in known if any(w in u for w in runs)]
    if not able:
        return seen
    d = edit_distances(able, [seen] * len(able))
    best = int(d.min())
    return min(u for u, x in zip(able, d, strict=True) if x == best) if best <= most else seen


def words(texts: list[str], k: int, before: str = "") -> dict[str, list[str]]:
    """The texts that hold each run of k letters, when they follow before."""
    out: dict[str, list[str]] = {}
    for t in texts:
        own = before + t
        for w in {own[p : p + k] for p in range(len(own) - k + 1)}:
            out.setdefault(w, []).append(t)
    return out


def sharing(index: dict[str, list[str]], seen: str, k: int) -> list[str]:
    return sorted({t for p in range(len(seen) - k + 1) for t in index.get(seen[p : p + k], ())})


def _within(patterns: list[str], text: str) -> np.ndarray:
    return edit_distances(patterns, [text] * len(patterns), "infix")


@dataclass
class Segments:
    """Barcodes of three listed segments, and the whole ones that are allowed.

    A segment is itself if it is listed (or there is no list). Else it is any of the listed ones that, between the
    linkers beside it, lie in the read with fewest edits, fewer than 10 (z: 8, without a linker behind); else any that
    lies alone in the segment with fewer than 3 edits. All of a list are compared, ties are kept."""

    form: Structure
    lists: dict[str, list[str]]
    whole: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.lists = {n: sorted(set(self.lists.get(n) or ())) for n in "xyz"}
        self.names = [n for n, _ in self.form.parts]
        self.text = dict(self.form.parts)
        self.index = words(sorted(set(self.whole)), 9)

    def able(self, name: str, read: str, at: dict[str, tuple[int, int]]) -> list[str]:
        seen, listed = read[slice(*at[name])], self.lists[name]
        if not listed or seen in listed:
            return [seen]
        k = self.names.index(name)
        before, after = self.names[k - 1], self.names[k + 1] if name != "z" else None
        part = read[at[before][0] : at[after][1] if after else at[name][1]]
        far = _within([self.text[before] + b + (self.text[after] if after else "") for b in listed], part)
        if far.min() < (10 if after else 8):
            return [b for b, x in zip(listed, far, strict=True) if x == far.min()]
        return [b for b, x in zip(listed, _within(listed, seen), strict=True) if x < 3]

    def flanked(self, barcode: str) -> str:
        own = iter((barcode[:8], barcode[8:16], barcode[16:]))
        return "".join(next(own) if n in "xyz" else s for n, s in self.form.parts[: self.names.index("z") + 1])

    def correct(self, read: str, at: dict[str, tuple[int, int]]) -> tuple[str | None, int, bool]:
        """(barcode, edits against the segments, whether others are as good).

        With whole barcodes: of those that share 9 letters in a row with a combination of segments the one that costs
        least, with gaps (6, 2) and mismatches 4, against the read from the primer to z; the first by name of several.
        Without: the combination whose structure lies in the read with fewest edits."""
        found = [self.able(n, read, at) for n in "xyz"]
        if not all(found):
            return None, 100, False
        seen = "".join(f[0] if len(f) == 1 else read[slice(*at[n])] for n, f in zip("xyz", found, strict=True))
        among = sorted("".join(c) for c in product(*found))
        if self.whole:
            among = sorted({w for c in among for w in sharing(self.index, c, 9)})
            if not among:
                return None, 100, False
            part = read[at["primer"][0] : at["z"][1]]
            cost = paths.span_costs([self.flanked(b) for b in among], [part] * len(among), paths.AFFINE)
            tied = False
        else:
            cost = _within([self.flanked(b) for b in among], read[at["primer"][0] : at["tail"][1]])
            tied = int((cost == cost.min()).sum()) > 1
        best = among[int(cost.argmin())]
        return best, int(_within([seen], best)[0]), tied


@dataclass
class Spots:
    """Barcodes of one part, chosen by what stands around them, for lists that come with UMIs."""

    barcodes: list[str]
    before: str = "CCGATCT"
    k: int = 11

    def __post_init__(self) -> None:
        self.known = set(self.barcodes)
        self.index = words(sorted(self.known), self.k, self.before)
        self.near = Correcter(sorted(self.known), 3)

    def correct(self, read: str, begin: int, end: int, size: int) -> tuple[str | None, int, bool]:
        """(barcode, edits, whether others are as good). A listed one is itself; else of all that share k letters in a
        row, with the primer's end before them, the one that costs least, with gaps (5, 1) and mismatches 4 and one
        free letter on both sides, against the part and 5 letters around it; else the nearest within 3 edits."""
        seen = read[begin:end]
        around = read[max(begin - 5, 0) :][: size + 10]
        among = [seen] if seen in self.known else sharing(self.index, self.before + seen, self.k)
        if not among:
            return self.near.correct(seen)
        cost = paths.span_costs(among, [around] * len(among), paths.Costs(4, ((5, 1),)), paths.Free(0, 0, 1, 1))
        best = among[int(cost.argmin())]
        return best, int(_within([best], around)[0]), False


def search(read: str, form: Structure, correcter: Correcter | Segments | Spots | None, umis: dict[str, list[str]], most: int = 2) -> list[tuple[str, str, int, int, int, int]]:
    """The hits of one read, as search_all() has them."""
    return search_all([read], form, correcter, umis, most)[0]


def search_all(reads: list[str], form: Structure, correcter: Correcter | Segments | Spots | None, umis: dict[str, list[str]], most: int = 2) -> list[list[tuple[str, str, int, int, int, int]]]:
    """For each read (barcode, umi, flank edits, barcode edits, begin, end) of each structure in it: a hit that is near and
    unambiguous is masked and the search goes on. Without a list every barcode is itself. All reads are searched at once."""
    out: list[list[tuple[str, str, int, int, int, int]]] = [[] for _ in reads]
    names = [n for n, _ in form.parts]
    sizes = {n: len(s) for n, s in form.parts}
    begins = np.cumsum([0, *sizes.values()]).tolist()
    left = dict(enumerate(reads))
    while left:
        found = [(k, *x) for k, x in zip(left, locate_all(form.pattern, list(left.values()), form.edits), strict=True) if x is not None]
        parts = {k: {n: (at[begins[i]], at[begins[i + 1]]) for i, n in enumerate(names)} for k, _, at in found}
        raw = {k: "".join(left[k][slice(*part[n])] for n in names if n in ("barcode", "x", "y", "z")) for k, part in parts.items()}
        near = correcter.correct_all(raw.values()) if isinstance(correcter, Correcter) else {}
        more = {}
        for k, cost, at in found:
            read, part = left[k], parts[k]
            if isinstance(correcter, Segments):
                barcode, edits, tied = correcter.correct(read, part)
            elif isinstance(correcter, Spots):
                barcode, edits, tied = correcter.correct(read, *part["barcode"], sizes["barcode"])
            else:
                barcode, edits, tied = near[raw[k]] if correcter else (raw[k], 0, False)
            if barcode is None or edits > most or tied:
                continue
            umi = read[part["umi"][0] :][: sizes["umi"]].ljust(sizes["umi"], "N")
            out[k].append((barcode, correct_umi(umi, umis.get(barcode, []), k=4), cost, edits, at[0], at[-1]))
            more[k] = read[: at[0]] + "X" * (at[-1] - at[0]) + read[at[-1] :]
        left = more
    return [sorted(hits, key=lambda h: h[4]) for hits in out]


def correcter(form: Structure, barcodes: list[str] | None, umis: dict[str, list[str]], segments: dict[str, list[str]] | None) -> Correcter | Segments | Spots | None:
    """What corrects barcodes: lists of segments, a list that comes with UMIs, or a list of whole barcodes."""
    if any(n == "x" for n, _ in form.parts) and segments:
        return Segments(form, segments, sorted(umis) or list(barcodes or ()))
    if any(n == "barcode" for n, _ in form.parts) and umis:
        return Spots(sorted(barcodes or umis))
    return Correcter(barcodes, 3) if barcodes else None


def demultiplex(reads: DataFrame, mode: str = "visium", barcodes: list[str] | None = None, umis: dict[str, list[str]] | None = None, trim: bool = True, segments: dict[str, list[str]] | None = None) -> DataFrame:
    """Trimmed pieces of both strands: (read_id, barcode, umi, flank_edits, barcode_edits, strand, k, n, chimeric, seq, qual).

    A piece runs from the end of its structure to the begin of the next; empty ones are left out. segments: the lists
    of x, y and z. The lists are sent to the tasks; they are kits' lists of fixed size."""
    form = structure(mode)
    sent = reads.sparkSession.sparkContext.broadcast((barcodes, umis or {}, segments))
    rows = reads.select("read_id", "seq", "qual", S.reverse_complement(F.col("seq")).alias("back"))
    schema = "read_id string, barcode string, umi string, flank_edits int, barcode_edits int, strand string, k int, n int, chimeric boolean, seq string, qual string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, by, parts = sent.value
        corrects = correcter(form, known, by, parts)
        for pdf in frames:
            out = []
            hits_of = iter(search_all([s for pair in zip(pdf.seq, pdf.back, strict=True) for s in pair if s], form, corrects, by))
            for name, seq, qual, back in pdf.itertuples(index=False):
                both = [(sign, s, q, next(hits_of)) for sign, s, q in (("+", seq, qual), ("-", back, qual[::-1] if qual else None)) if s]
                chimeric = len(both) == 2 and all(x[3] for x in both)
                for sign, s, q, hits in both:
                    for k, (barcode, umi, flank, edits, _, end) in enumerate(hits):
                        to = hits[k + 1][4] if k + 1 < len(hits) else len(s)
                        piece = s[end:to] if trim else s
                        if piece and (trim or k == 0):
                            out.append((name, barcode, umi, flank, edits, sign, k + 1, len(hits), chimeric, piece, (q[end:to] if trim else q) if q else None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInPandas(run, schema)


#: Most k-mers whose subsets are listed.
FEW_KMERS = 8


def kmer_candidates(seen: DataFrame, barcodes: DataFrame, k: int, top: int) -> DataFrame:
    """(id, barcode, votes, rank): of each seen sequence the barcodes that share most k-mers, ties by name.

    Different sets of k-mers are compared. A barcode among the top is, by name, among the first top of those that hold
    all k-mers which it shares with the sequence: any before it by name have as many votes. So for each subset of a
    barcode's k-mers only its first top barcodes are kept, and sequences look up their subsets. That is done between
    sides of at most FEW_KMERS k-mers; others are compared with all that share one."""
    words = lambda df, c: F.array_sort(S.kmers(F.col(c), k))
    ids = seen.select("id", words(seen, "seq").alias("words")).filter(F.size("words") > 0).distinct()
    one = ids.select("words").distinct()
    two = barcodes.select("barcode", words(barcodes, "barcode").alias("own")).filter(F.size("own") > 0).distinct()
    few = lambda c: F.size(c) <= FEW_KMERS
    by_name = two.filter(few("own")).select("own", "barcode", F.explode(_subsets("own")).alias("subset"))
    by_name = by_name.withColumn("__n", F.row_number().over(Window.partitionBy("subset").orderBy("barcode"))).filter(F.col("__n") <= top)
    met = one.filter(few("words")).select("words", F.explode(_subsets("words")).alias("subset")).join(by_name, "subset").select("words", "barcode", "own").distinct()
    met = met.select("words", "barcode", F.size(F.array_intersect("words", "own")).cast("long").alias("votes"))
    kmer = lambda df, c: df.withColumn("kmer", F.explode(c))
    for mine, theirs in ((~few("words"), F.lit(True)), (few("words"), ~few("own"))):
        met = met.unionByName(kmer(one.filter(mine), "words").join(kmer(two.filter(theirs), "own"), "kmer").groupBy("words", "barcode").agg(F.count(F.lit(1)).alias("votes")))
    w = Window.partitionBy("words").orderBy(F.desc("votes"), "barcode")
    best = met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ids.join(best, "words").select("id", "barcode", "votes", "rank")


def _subsets(c: str) -> Column:
    """All subsets but the empty one of few words."""
    masks = F.sequence(F.lit(1), F.shiftleft(F.lit(1), FEW_KMERS) - 1)
    able = F.filter(masks, lambda m: F.expr(f"shiftleft(1, size({c}))") > m)
    return F.transform(able, lambda m: F.filter(F.col(c), lambda _, i: F.pmod(F.floor(m / F.pow(F.lit(2.0), i)), F.lit(2)) == 1))


def listed(rows: DataFrame, barcodes: DataFrame, column: str = "barcode") -> DataFrame:
    """The rows whose barcode is in a list. Spark broadcasts the list if it is small, by its own measure."""
    return rows.join(barcodes.select(column), column, "left_semi")


def stats(hits: DataFrame) -> DataFrame:
    """(Read, CellBarcode, FlankEditDist, BarcodeEditDist, UMI): a row for each hit."""
    return hits.select(F.col("read_id").alias("Read"), F.col("barcode").alias("CellBarcode"), F.col("flank_edits").alias("FlankEditDist"), F.col("barcode_edits").alias("BarcodeEditDist"), F.col("umi").alias("UMI"))
