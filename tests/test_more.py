"""Alignment paths, segment and spot barcodes, BAM tags and streamed reads."""

import gzip
import random
import struct

import numpy as np
import pytest

from isoloom.operators import align, demux, paths
from isoloom.sources import bam
from isoloom.streaming import demux as streamed


def cost_of_all(a, b, costs, free):
    """Gaps of every length at every cell; the free letters by trying every cut."""

    def whole(p, t):
        d = [[10**6] * (len(t) + 1) for _ in range(len(p) + 1)]
        d[0][0] = 0
        for i in range(len(p) + 1):
            for j in range(len(t) + 1):
                for o, e in costs.gaps:
                    for x in range(1, i + 1):
                        d[i][j] = min(d[i][j], d[i - x][j] + o + e * x)
                    for x in range(1, j + 1):
                        d[i][j] = min(d[i][j], d[i][j - x] + o + e * x)
                if i and j and (p[i - 1] == t[j - 1] or costs.mismatch is not None):
                    d[i][j] = min(d[i][j], d[i - 1][j - 1] + (0 if p[i - 1] == t[j - 1] else costs.mismatch))
        return d[-1][-1]

    begins = [(x, 0) for x in range(min(free.pattern_begin, len(a)) + 1)] + [(0, x) for x in range(min(free.text_begin, len(b)) + 1)]
    ends = [(x, 0) for x in range(min(free.pattern_end, len(a)) + 1)] + [(0, x) for x in range(min(free.text_end, len(b)) + 1)]
    return min(whole(a[pb : len(a) - pe], b[tb : len(b) - te]) for pb, tb in begins for pe, te in ends if pb + pe <= len(a) and tb + te <= len(b))


SPANS = [paths.Free(), paths.Free(0, 0, 1, 1), paths.Free(2, 0, 0, 3), paths.Free(0, 3, 2, 0), paths.Free(9, 9, 9, 9)]


@pytest.mark.parametrize("costs", [paths.EDIT, paths.INDEL, paths.LINEAR, paths.AFFINE, paths.Costs(4, ((6, 2), (9, 1))), paths.Costs(3, ((5, 1),))])
def test_spans_and_paths_against_all_gaps(costs):
    rng = random.Random(str(costs))
    word = lambda: "".join(rng.choice("ACG") for _ in range(rng.randrange(9)))
    a, b = ["", "", "A", *(word() for _ in range(17))], ["", "ACG", "", *(word() for _ in range(17))]
    for free in SPANS:
        want = [cost_of_all(x, y, costs, free) for x, y in zip(a, b)]
        assert paths.span_costs(a, b, costs, free).tolist() == want
        for x, y, w, (cost, ops, pb, pe, tb, te) in zip(a, b, want, paths.paths(a, b, costs, free)):
            assert cost == w and paths.valid(ops, x, y)
            assert pb <= free.pattern_begin and len(x) - pe <= free.pattern_end and tb <= free.text_begin and len(y) - te <= free.text_end
            inner = ops[pb + tb : len(ops) - (len(x) - pe) - (len(y) - te)]
            assert paths.operations_cost(inner, costs) == w


def test_dual_gaps_and_tools(spark):
    p, t = "ACGT" * 5 + "GATTACA", "ACGT" * 5 + "C" * 40 + "GATTACA"
    assert paths.span_costs([p], [t], paths.DUAL).tolist() == [64] and paths.span_costs([p], [t], paths.AFFINE).tolist() == [86]
    df = spark.createDataFrame([(1, p, t), (2, None, "AC"), (3, "", "")], "id int, pattern string, text string")
    got = {r.id: (r.score, r.cigar) for r in paths.with_path(df, paths.DUAL).collect()}
    assert got == {1: (-64, "20=40I7="), 2: (-10, "2I"), 3: (0, "")}
    assert {r.score for r in paths.with_path(df.filter("id = 2"), paths.EDIT).collect()} == {2}
    assert paths.relabelled("MMX", "ACG", "ATG") == "MXM" and not paths.valid("MM", "AC", "ACG") and not paths.valid("MX", "AC", "AC")
    assert paths.best_prefix("MMMXMMMMIIM", paths.AFFINE, 2) == ("MMMXMMMM", 10) and paths.best_prefix("X", paths.AFFINE, 1) == ("", 0)
    # batches are cut by cells; results do not depend on the cut
    many = ["ACGT" * k for k in range(1, 12)]
    whole = paths.paths(many, many[::-1])
    paths.CELLS, kept = 200, paths.CELLS
    try:
        assert paths.paths(many, many[::-1]) == whole
    finally:
        paths.CELLS = kept


def test_bands_against_whole_matrices(spark):
    rng = random.Random(14)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, b = [], []
    for k in range(300):
        own = word(rng.randrange(120))
        other = list(own)
        for _ in range(rng.randrange(12)):
            at, size = rng.randrange(len(other) + 1), rng.choice([0, 1, 1, 2, 30])
            other[at : at + size] = word(rng.choice([0, 1, 2, 25]))
        a.append(own)
        b.append("".join(other) if k % 9 else word(rng.randrange(120)))
    a[7], b[8], a[9] = "", "", "é" * 300
    want = paths.span_costs(a, b, paths.AFFINE).tolist()
    for band in (1, 2, 8):
        assert align.affine_costs(a, b, band=band).tolist() == want
    assert align.affine_costs(a, b, 3, 0, 1).tolist() == paths.span_costs(a, b, paths.Costs(3, ((0, 1),))).tolist()
    assert align.affine_costs(a, b, 400, 600, 200).tolist() == paths.span_costs(a, b, paths.Costs(400, ((600, 200),))).tolist()
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(zip(a, b))] + [(-1, None, "ACG")], "k int, pattern string, text string")
    for cells in (50, 5000, 1 << 21):
        assert {r.k: -r.score for r in align.with_cost(df, cells=cells).collect()} == {**dict(enumerate(want)), -1: 12}


def changed(rng, text, n):
    """text with n letters replaced by others."""
    out = list(text)
    for at in rng.sample(range(len(text)), n):
        out[at] = rng.choice([x for x in "ACGT" if x != out[at]])
    return "".join(out)


def magic(x, y, z, umi, rest):
    form = dict(demux.structure("magicseq").parts)
    return form["primer"] + x + form["link1"] + y + form["link2"] + z + umi + form["tail"] + rest


def test_segments(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    lists = {n: [word(8) for _ in range(30)] for n in "xyz"}
    form = demux.structure("magicseq")
    whole = sorted({"".join(rng.choice(lists[n]) for n in "xyz") for _ in range(40)})
    umi, rest = word(12), "GCAGCAGCAGGACCAGCA"
    rows, want = [], {}
    for k, b in enumerate(whole[:12]):
        parts = [b[:8], b[8:16], b[16:]]
        parts[k % 3] = changed(rng, parts[k % 3], k % 2)
        rows.append((f"r{k}", word(15) + magic(*parts, umi, rest), None))
        want[f"r{k}"] = b
    df = spark.createDataFrame(rows, "read_id string, seq string, qual string")
    hits = {r.read_id: r for r in demux.demultiplex(df, "magicseq", None, {b: [umi] for b in whole}, segments=lists).collect()}
    assert {k: r.barcode for k, r in hits.items()} == want
    assert all(r.umi == umi and r.seq == rest and r.barcode_edits <= 2 for r in hits.values())
    # without whole barcodes the nearest combination counts, and listed segments are themselves
    corrects = demux.Segments(form, lists)
    at = dict(zip([n for n, _ in form.parts], zip(np.cumsum([0, *[len(s) for _, s in form.parts]])[:-1].tolist(), np.cumsum([len(s) for _, s in form.parts]).tolist())))
    x, y, z = (lists[n][3] for n in "xyz")
    assert corrects.correct(magic(x, y, z, umi, rest), at) == (x + y + z, 0, False)
    assert corrects.correct(magic(x, y, "N" * 8, umi, rest), at)[0] is None  # no z is nearer than 8 edits
    twins = demux.Segments(form, {**lists, "z": ["AAAACCCC", "AAAAGGGG"]})
    assert twins.able("z", magic(x, y, "AAAACCGG", umi, rest), at) == ["AAAACCCC", "AAAAGGGG"]
    assert twins.correct(magic(x, y, "AAAACCGG", umi, rest), at)[2]  # both are as good
    assert demux.Segments(form, twins.lists, [x + y + "AAAAGGGG"]).correct(magic(x, y, "AAAACCGG", umi, rest), at) == (x + y + "AAAAGGGG", 2, False)
    # a linker that is not there is no structure
    lost = magic(x, y, z, umi, rest).replace("CAGTCATGTCATGAGCTA", "G" * 18).replace("TGATGCGACACTGATCGA", "G" * 18)
    assert demux.locate(form.pattern, lost, form.edits) is None


def test_spots_and_umis():
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    known = [word(16) for _ in range(200)]
    spots = demux.Spots(known)
    primer = "CTACACGACGCTCTTCCGATCT"
    for b in known[:40]:
        seen = b[:9] + ("A" if b[9] != "A" else "C") + b[10:]
        read = primer + seen + word(12) + "T" * 10
        assert spots.correct(read, 22, 38, 16)[:2] == (b, 1)
        assert spots.correct(primer + b + word(22), 22, 38, 16) == (b, 0, False)
    # three letters apart there is no run of 11 left: the nearest of all within 3 edits
    seen = list(known[0])
    for at in (3, 8, 13):
        seen[at] = "A" if seen[at] != "A" else "C"
    assert spots.correct(primer + "".join(seen) + word(22), 22, 38, 16) == (known[0], 3, False)
    assert spots.correct(primer + "N" * 16 + word(22), 22, 38, 16)[0] is None
    # a UMI that shares no four letters in a row is not taken
    assert demux.correct_umi("AAACAAACAAAC", ["AAAGAAAGAAAG"], k=4) == "AAACAAACAAAC" and demux.correct_umi("AAAACAAACAAA", ["AAAAGAAAGAAA"], k=4) == "AAAAGAAAGAAA"
    assert demux.correct_umi("AAACAAACAAAC", ["AAAGAAAGAAAG"]) == "AAAGAAAGAAAG" and demux.correct_umi("NNNNNNNNNNNN", ["AAAAGAAAGAAA"], k=4) == "NNNNNNNNNNNN"


def bam_bytes(reads):
    """A BAM file of unmapped reads with the tags given, its gzip members cut at any place."""
    text = b"@HD\tVN:1.6\n"
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    for name, seq, tags in reads:
        more = b"".join(t.encode() + (b"Z" + v.encode() + b"\0" if isinstance(v, str) else b"i" + struct.pack("<i", v) if isinstance(v, int) else b"BS" + struct.pack("<i", len(v)) + struct.pack(f"<{len(v)}H", *v)) for t, v in tags)
        body = struct.pack("<iiBBHHHiiii", -1, -1, len(name) + 1, 0, 0, 2, 4, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack("<II", 160, 32) + bytes((len(seq) + 1) // 2) + bytes(len(seq)) + more
        out += struct.pack("<i", len(body)) + body
    cuts = list(range(0, len(out), 97)) + [len(out)]
    return b"".join(gzip.compress(out[a:b]) for a, b in zip(cuts, cuts[1:])) + gzip.compress(b"")


def test_bam_tags(spark, tmp_path):
    reads = [("a", "ACGTA", [("NM", 3), ("CB", "ACGT-1"), ("XB", [1, 2, 3]), ("UB", "TTT")]), ("b", "", [("CB", "ACGT-1")]), ("c", "AC", [("UB", "GGG"), ("CB", "TTTT")]), ("d", "A", [])]
    (tmp_path / "one.bam").write_bytes(bam_bytes(reads))
    (tmp_path / "two.bam").write_bytes(bam_bytes([(f"r{k}", "A" * (k % 90), [("CB", f"C{k % 5}-2"), ("UB", f"U{k}")]) for k in range(20_000)]))
    (tmp_path / "none.bam").write_bytes(bam_bytes([]))
    names = [str(tmp_path / f"{n}.bam") for n in ("one", "two", "none")]
    got = {r.read_id: (r.flag, r.CB, r.UB) for r in bam.bam_tags(spark, names).filter("path like '%one.bam'").collect()}
    assert got == {"a": (4, "ACGT-1", "TTT"), "b": (4, "ACGT-1", None), "c": (4, "TTTT", "GGG"), "d": (4, None, None)}
    assert sorted(map(tuple, bam.barcode_umis(spark, names[:1]).collect())) == [("ACGT", "TTT"), ("TTTT", "GGG")]
    listed = spark.createDataFrame([("C3",), ("C3",), ("TTTT",)], "barcode string")
    assert bam.barcode_umis(spark, names, listed).count() == 4001
    (tmp_path / "cut.bam").write_bytes(bam_bytes(reads)[:-60])
    with pytest.raises(Exception, match="ends inside"):
        bam.bam_tags(spark, [str(tmp_path / "cut.bam")]).collect()


def test_streamed_demultiplexing(spark, tmp_path):
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    known = [word(16) for _ in range(10)]
    reads = []
    for k in range(30):
        seq = word(9) + "CTACACGACGCTCTTCCGATCT" + known[k % 10] + word(12) + "T" * 10 + "GCA" * 9
        reads.append((f"r{k}", seq, "I" * len(seq)))
    for kind in ("fastq", "framed"):
        d = tmp_path / kind
        (d / "in").mkdir(parents=True)
        line = (lambda r: f"@{r[0]} x\n{r[1]}\n+\n{r[2]}\n") if kind == "fastq" else (lambda r: "\t".join(r) + "\n")
        (d / "in" / "one").write_text("".join(map(line, reads[:12])))
        arrived = getattr(streamed, kind)(spark, str(d / "in"), 1)
        assert arrived.isStreaming
        go = lambda: streamed.start(arrived, str(d / "out"), str(d / "state"), "visium", known).awaitTermination()  # noqa: B023, E731
        go()
        assert spark.read.parquet(str(d / "out")).count() == 12
        (d / "in" / "two").write_text("".join(map(line, reads[12:])))
        go()  # only what is new
        want = sorted(map(tuple, demux.demultiplex(spark.createDataFrame(reads, "read_id string, seq string, qual string"), "visium", known).collect()), key=str)
        assert sorted(map(tuple, spark.read.parquet(str(d / "out")).collect()), key=str) == want and len(want) == 30
        hits = demux.demultiplex(getattr(streamed, kind)(spark, str(d / "in")), "visium", known)
        query = streamed.barcode_counts(hits).writeStream.format("memory").queryName(f"counts_{kind}").outputMode("complete").option("checkpointLocation", str(d / "counts")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert {r.n for r in spark.table(f"counts_{kind}").collect()} == {3}
