"""Hand-made cases and brute force for the operators of reads."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoloom.functions import intervals as I
from isoloom.functions import sequences as S
from isoloom.operators import align, demux, graph, quantify, ranges, reads, umi


def covered(xs):
    return {p for s, e in xs for p in range(s, e + 1)}


def apart(a, b):
    alone = lambda p, q: sum(e - s + 1 for s, e in p if not any(s <= f and t <= e for t, f in q))
    return alone(a, b) + alone(b, a)


CHAINS = {
    403: [(8373, 8629), (8991, 13672), (13829, 15019)],
    404: [(8373, 8629), (8991, 13672), (13823, 14592)],
    405: [(8991, 13672)],
    408: [(8373, 8629), (8748, 8846), (8991, 13672), (13829, 15019)],
    409: [(1347, 1678), (1886, 2389)],
    410: [(1886, 2251)],
    406: [(4104, 5007)],
}


@pytest.mark.parametrize("a,b,want", [(403, 404, (6136, 5703, 0, 433)), (403, 405, (6130, 4682, 1448, 0)), (403, 408, (6229, 6130, 99, 0)), (404, 408, (6235, 5703, 99, 433)), (409, 410, (836, 366, 332, 138)), (403, 406, (7034, 0, 7034, 0))])
def test_chain_pairs(spark, a, b, want):
    df = spark.createDataFrame([(CHAINS[a], CHAINS[b])], "a array<struct<s:int,e:int>>, b array<struct<s:int,e:int>>")
    c, d = F.col("a"), F.col("b")
    assert tuple(df.select(I.union_length(c, d), I.intersect_length(c, d), I.apart_length(c, d), I.chain_distance(c, d)).first()) == want


def test_random_kernels(spark):
    rng = random.Random(5)

    def some():
        at, out = 0, []
        for _ in range(rng.randrange(5)):
            at += rng.randrange(1, 12)
            out.append((at, at := at + rng.randrange(6)))
            at += 1
        return out

    rows = [(k, some(), some()) for k in range(120)]
    df = spark.createDataFrame(rows, "k int, a array<struct<s:int,e:int>>, b array<struct<s:int,e:int>>")
    got = {r[0]: tuple(r)[1:] for r in df.select("k", I.union_length(F.col("a"), F.col("b")), I.intersect_length(F.col("a"), F.col("b")), I.apart_length(F.col("a"), F.col("b")), I.merge(F.concat("a", "b"))).collect()}
    for k, a, b in rows:
        u, i, n, merged = got[k]
        assert (u, i, n) == (len(covered(a) | covered(b)), len(covered(a) & covered(b)), apart(a, b))
        assert covered([tuple(x) for x in merged]) == covered(a) | covered(b)
        assert all(x.e < y.s for x, y in zip(merged, merged[1:]))


def test_islands_touching_and_bins(spark):
    df = spark.createDataFrame([("c", 1, 5), ("c", 5, 8), ("c", 9, 12), ("c", 10, 90), ("c", 70, 75), ("c", 91, 92), ("d", 3, 3)], "chrom string, s long, e long")
    for width in (4, 1 << 20):
        got = sorted((r.chrom, r.s, r.island_start) for r in ranges.islands(df, ["chrom"], bin_width=width).collect())
        assert got == [("c", 1, 1), ("c", 5, 1), ("c", 9, 9), ("c", 10, 9), ("c", 70, 9), ("c", 91, 91), ("d", 3, 3)]


def test_range_join_against_loops(spark):
    rng = random.Random(3)
    one = [(k % 2, k, s := rng.randrange(300), s + rng.randrange(60)) for k in range(60)]
    two = [(k % 2, k, s := rng.randrange(300), s + rng.randrange(60)) for k in range(60)]
    a, b = spark.createDataFrame(one, "c int, i int, s int, e int"), spark.createDataFrame(two, "c int, j int, t int, f int")
    got = sorted((r.i, r.j) for r in ranges.range_join(a, b, ["c"], ("s", "e"), ("t", "f"), 16).collect())
    assert got == sorted((i, j) for c, i, s, e in one for d, j, t, f in two if c == d and s <= f and t <= e)


def test_cigar_and_junctions(spark):
    rows = [("a", 0, "c", 100, 60, "5S10M2I3D20M100N30M4H", 67), ("b", 16, "c", 100, 60, "20M18N20M", 40), ("d", 0, "c", 100, 60, "11M19N11M", 22), ("e", 0, "c", 100, 60, "12M19N11M", 23), ("f", 256, "c", 1, 60, "5M", 5), ("g", 2048, "c", 1, 60, "5M", 5), ("h", 0, "c", 1, 60, "5M", 6), ("i", 4, "*", 0, 0, "*", 5)]
    df = spark.createDataFrame(rows, "read_id string, flag int, chrom string, pos int, mapq int, cigar string, seq_len int")
    out = {r.read_id: r for r in reads.spliced(reads.usable(df)).collect()}
    assert set(out) == {"a", "b", "d", "e"}
    assert [tuple(x) for x in out["a"].blocks] == [(100, 109), (113, 132), (233, 262)]
    assert [tuple(x) for x in out["a"].chain] == [(133, 232)] and out["b"].chain == [] and out["b"].strand == 0
    assert out["d"].anchored == [False] and out["e"].anchored == [True]


def test_signals_and_packing(spark):
    df = spark.createDataFrame([("gt", "ag"), ("CT", "GC"), ("GT", "GG")], "d string, a string")
    assert [r[0] for r in df.select(S.signal_code(F.col("d"), F.col("a"))).collect()] == [1, 2, 0]
    df = spark.createDataFrame([("ACGTTGCA",), ("ANG",)], "s string")
    assert [tuple(r) for r in df.select(S.unpack(S.pack(F.col("s")), 8), S.reverse_complement(F.col("s"))).collect()] == [("ACGTTGCA", "TGCAACGT"), (None, "CNT")]


def brute_cliques(n, pairs):
    near = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    sets = [frozenset(i for i in range(n) if m >> i & 1) for m in range(1, 1 << n)]
    full = [s for s in sets if all((a, b) in near for a in s for b in s if a != b)]
    return {s for s in full if not any(s < t for t in full)}


def test_cliques_random():
    rng = random.Random(1)
    for _ in range(30):
        n = rng.randrange(1, 9)
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        got = graph.maximal_cliques(range(n), pairs)
        assert {frozenset(c) for c in got} == brute_cliques(n, pairs) and len(got) == len({tuple(c) for c in got})


def test_verdict(spark):
    cases = {"k": ([(0, True, 5), (1, False, 4), (2, False, 6)], [(0, 1), (0, 2), (1, 2)], {0: True, 1: False, 2: True}), "z": ([(0, True, 0), (1, False, 9)], [(0, 1)], {0: True, 1: False}), "n": ([(0, False, 7), (1, False, 7), (2, False, 3)], [(0, 1), (0, 2), (1, 2)], {0: True, 1: True, 2: False})}
    nodes = spark.createDataFrame([(g, 0, *n) for g, (ns, _, _) in cases.items() for n in ns], "chrom string, group_id int, node int, known boolean, count int")
    pairs = spark.createDataFrame([(g, 0, *e) for g, (_, es, _) in cases.items() for e in es], "chrom string, group_id int, a int, b int")
    got = {(r.chrom, r.node): r.verdict for r in graph.verdict(graph.cliques(nodes, pairs), nodes).collect()}
    assert got == {(g, n): v for g, (_, _, want) in cases.items() for n, v in want.items()}


def test_em():
    assert np.allclose(quantify.maximise(np.ones((1, 2)), np.array([4.0]), np.array([3.0, 1.0])), [5.875, 2.125])
    assert np.allclose(quantify.maximise(np.zeros((0, 2)), np.zeros(0), np.array([3.0, 1.0])), [3, 1])


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def affine(a, b, x, o, e):
    big = 10**9
    m = [[big] * (len(b) + 1) for _ in range(len(a) + 1)]
    d, i = [r[:] for r in m], [r[:] for r in m]
    m[0][0] = 0
    for p in range(len(a) + 1):
        for q in range(len(b) + 1):
            if p:
                d[p][q] = min(d[p - 1][q] + e, m[p - 1][q] + o + e)
            if q:
                i[p][q] = min(i[p][q - 1] + e, m[p][q - 1] + o + e)
            s = m[p - 1][q - 1] + x * (a[p - 1] != b[q - 1]) if p and q else (0 if not p and not q else big)
            m[p][q] = min(s, d[p][q], i[p][q])
    return m[-1][-1]


def test_alignment():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ACGT") for _ in range(rng.randrange(12)))
    a, b = [word() for _ in range(150)], [word() for _ in range(150)]
    assert align.edit_distances(a, b).tolist() == [edit(p, t) for p, t in zip(a, b)]
    assert align.edit_distances(a, b, "prefix").tolist() == [min(edit(p, t[:k]) for k in range(len(t) + 1)) for p, t in zip(a, b)]
    assert align.edit_distances(a, b, "infix").tolist() == [min(edit(p, t[j:k]) for j in range(len(t) + 1) for k in range(j, len(t) + 1)) for p, t in zip(a, b)]
    assert align.affine_costs(a, b).tolist() == [affine(p, t, 4, 6, 2) for p, t in zip(a, b)]
    assert align.affine_costs(a, b, 4, 5, 1, True).tolist() == [min(affine(p, t[j:k], 4, 5, 1) for j in range(len(t) + 1) for k in range(j, len(t) + 1)) for p, t in zip(a, b)]
    for p, t in zip(a, b):
        ops = align.traced(p, t)
        assert len(ops) - ops.count("M") == edit(p, t) and len(ops) - ops.count("I") == len(p) and len(ops) - ops.count("D") == len(t)
    assert align.cigar("MMMXXI") == "3=2X1I" and align.cigar("MMMXXI", False) == "5M1I"
    assert align.edit_distances(["GATTACA"], ["GATCACTA"]).tolist() == [2]


def test_umi(spark):
    rows = [("k", "r1", "AAAAAAAAAAAA", 100), ("k", "r2", "AAAAAAAAATTT", 101), ("k", "r3", "AAAAAAAATTTT", 100), ("k", "r4", "AAAAAAAAAAAA", 110), ("l", "r5", "AAAAAAAAAAAA", 100)]
    df = spark.createDataFrame(rows, "g string, read_id string, umi string, seq_len int")
    assert sorted(r.read_id for r in umi.greedy(df, ["g"]).collect()) == ["r1", "r3", "r5"]  # r4 has the UMI of r1, whatever the length of its read
    rng = random.Random(9)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    df = spark.createDataFrame([(0, k, s, k % 7) for k, s in enumerate(seqs)], "g int, read_id int, umi string, n int")
    got = sorted((r.a, r.b, r.distance) for r in umi.near_pairs(df, ["g"], size="n", most=3).collect())
    assert got == sorted((i, j, edit(seqs[i], seqs[j])) for i in range(60) for j in range(i + 1, 60) if edit(seqs[i], seqs[j]) <= 3 and abs(i % 7 - j % 7) <= 3)


def test_demultiplex(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    known = [word(16) for _ in range(20)]
    primer, form = "CTACACGACGCTCTTCCGATCT", demux.structure("visium")
    piece, u = word(60).replace("T", "G"), word(12)
    bad = known[0][:5] + ("A" if known[0][5] != "A" else "C") + known[0][6:]
    seq = word(20) + primer + bad + u + "T" * 10 + piece
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    df = spark.createDataFrame([("a", seq, "I" * len(seq)), ("b", back, None), ("c", word(30), None)], "read_id string, seq string, qual string")
    got = sorted(map(tuple, demux.demultiplex(df, "visium", known).select("read_id", "barcode", "umi", "barcode_edits", "strand", "seq", "chimeric").collect()))
    assert got == [("a", known[0], u, 1, "+", piece, False), ("b", known[0], u, 1, "-", piece, False)]
    assert demux.correct_umi("AAAT", ["AAAA", "CCCC"]) == "AAAA" and demux.correct_umi("GGGG", ["AAAACCCC"]) == "GGGG"
    assert form.edits == 8
    with pytest.raises(ValueError):
        demux.structure("stereoseq")


def test_cigars_against_expressions(spark):
    rng = random.Random(6)
    rows = [(k, rng.randrange(1, 10**6), "".join(f"{rng.choice([1, 9, 10, 123, 4567, 10**8])}{rng.choice('MIDNSHP=X')}" for _ in range(rng.randrange(12)))) for k in range(300)] + [(900, 5, "*"), (901, 5, None), (902, None, "3M")]
    df = spark.createDataFrame(rows, "k int, pos int, cigar string")
    want = {r.k: ([tuple(x) for x in r.b or []], r.n or 0) for r in df.select("k", S.blocks(F.coalesce("pos", F.lit(0)), F.col("cigar")).alias("b"), S.query_length(F.col("cigar")).alias("n")).collect()}
    got = {r.k: ([tuple(x) for x in r.blocks], r.counted) for r in reads.measured(df).collect()}
    assert got == want


def test_generated_pairs(spark):
    got = align.generated_pairs(spark.range(50), 100, 0.05).collect()
    again = {r.id: tuple(r) for r in align.generated_pairs(spark.range(50).repartition(3), 100, 0.05).collect()}
    assert {r.id: tuple(r) for r in got} == again and len({r.pattern for r in got}) == 50
    assert all(len(r.pattern) == 100 and 0 < edit(r.pattern, r.text) <= 5 for r in got)


def test_umi_groups_against_loops(spark):
    rng = random.Random(10)
    rows = [(k % 3, f"r{k:03}", "".join(rng.choice("ACGT") for _ in range(rng.randrange(4, 9)))) for k in range(150)]
    kept = {}
    for g, name, u in rows:
        if all(edit(u, v) > 2 for _, v in kept.setdefault(g, [])):
            kept[g].append((name, u))
    got = umi.greedy(spark.createDataFrame(rows, "g int, read_id string, umi string"), ["g"], most=2).collect()
    assert sorted((r.g, r.read_id, r.umi) for r in got) == sorted((g, *x) for g, xs in kept.items() for x in xs)
