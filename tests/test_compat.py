"""Compatibility rows, cliques by node and sparse expectation-maximisation against plain loops."""

import random

import numpy as np

from isoloom.operators import compat, demux, graph, quantify

CHAIN = "array<struct<s:int,e:int>>"


def bases(chain):
    return {x for s, e in chain for x in range(s, e + 1)}


def random_chain(rng):
    out, at = [], rng.randrange(5)
    for _ in range(rng.randrange(1, 5)):
        e = at + rng.randrange(1, 8)
        out.append((at, e))
        at = e + rng.randrange(2, 6)
    return out


def test_partial_rows(spark):
    cases = [("g", 1, [(5, 6), (9, 11)])]
    reported = [("g", 1, "a", [(1, 2), (5, 6), (9, 11)]), ("g", 1, "b", [(1, 2), (5, 6), (7, 8), (9, 11)]), ("g", 1, "c", [(5, 6), (9, 11)]), ("g", 1, "d", [(1, 2), (3, 4), (5, 6), (9, 11)]), ("g", 2, "e", [(5, 6), (9, 11), (13, 14)])]
    c = spark.createDataFrame(cases, f"chrom string, group_id int, chain {CHAIN}")
    r = spark.createDataFrame(reported, f"chrom string, group_id int, isoform string, chain {CHAIN}")
    # b has a junction between, c isn't longer, d is longer than a, e is of another group
    assert [(x.isoform, x.row_id) for x in compat.partial_rows(c, r).collect()] == [("a", "5-6,9-11")]


def test_least_apart_against_all_pairs(spark):
    rng = random.Random(4)
    rejected = [("c", g, f"n{k}", random_chain(rng)) for g in range(3) for k in range(12)]
    reported = [("c", g, f"i{k}", random_chain(rng)) for g in range(2) for k in range(15)]
    rejected += [("c", g, "far", [(900, 901)]) for g in range(2)]
    got = {(r.group_id, r.node): r.isoform for r in compat.least_apart(spark.createDataFrame(rejected, f"chrom string, group_id int, node string, chain {CHAIN}"), spark.createDataFrame(reported, f"chrom string, group_id int, isoform string, chain {CHAIN}"), 4).collect()}
    want = {}
    for _, g, n, chain in rejected:
        able = [(len(bases(chain) ^ bases(w)), i) for _, h, i, w in reported if h == g]
        if able:
            want[g, n] = min(able)[1]
    assert got == want and len(want) == 26


def test_rejected_rows_by_steps(spark):
    one = [(1, 5)]
    rejected = [("c", 0, n, one) for n in ("next", "two", "alone")]
    pairs = [("c", 0, "A", "next"), ("c", 0, "mid", "two"), ("c", 0, "B", "mid"), ("c", 0, "mid", "next")]
    reported = [("c", 0, "A", [(1, 9)]), ("c", 0, "B", [(1, 8)]), ("c", 0, "C", [(1, 6)])]
    got = compat.rejected_rows(spark.createDataFrame(rejected, f"chrom string, group_id int, node string, chain {CHAIN}"), spark.createDataFrame(pairs, "chrom string, group_id int, a string, b string"), spark.createDataFrame(reported, f"chrom string, group_id int, isoform string, chain {CHAIN}"))
    assert sorted(r.isoform for r in got.collect()) == ["A", "B", "C"]


def test_cliques_by_node_against_the_whole_group(spark):
    rng = random.Random(5)
    groups = {g: [(a, b) for a in range(12) for b in range(a + 1, 12) if rng.random() < share] for g, share in enumerate([0.0, 0.2, 0.5, 0.8, 1.0])}
    nodes = spark.createDataFrame([("c", g, n) for g in groups for n in range(12)], "chrom string, group_id int, node long")
    pairs = spark.createDataFrame([("c", g, *(e if rng.random() < 0.5 else e[::-1])) for g, es in groups.items() for e in es], "chrom string, group_id int, a long, b long")
    got = {}
    for r in graph.cliques(nodes, pairs).collect():
        got.setdefault((r.group_id, r.clique), []).append(r.node)
    want = {(g, k): c for g, es in groups.items() for k, c in enumerate(graph.maximal_cliques(range(12), es))}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_sparse_em_of_pairs_against_a_matrix(spark):
    rng = np.random.default_rng(6)
    member, reads, seed = (rng.random((9, 5)) < 0.4).astype(int), rng.integers(1, 9, 9).astype(float), rng.integers(0, 4, 5).astype(float)
    member[3] = 0
    share, z = np.full(5, 0.2), None
    for _ in range(9):
        z = member * share
        total = z.sum(1, keepdims=True)
        expected = reads @ np.divide(z, total, out=np.zeros_like(z, float), where=total > 0)
        new = (expected + seed) / (expected + seed).sum()
        change, share = np.abs(new - share).sum(), new
        if change <= 0.05:
            break
    rows = [("k", f"r{r}", f"i{i}", float(reads[r])) for r, i in zip(*np.nonzero(member))]
    compat_rows = spark.createDataFrame(rows + rows[:3], "k string, row_id string, isoform string, n double")
    seeds = spark.createDataFrame([("k", f"i{i}", float(seed[i])) for i in range(5)], "k string, isoform string, count double")
    got = {r.isoform: r["count"] for r in quantify.em(compat_rows, seeds, ["k"]).collect()}
    assert np.allclose([got[f"i{i}"] for i in range(5)], seed + expected)


def test_fasta_reads_over_blocks(spark, tmp_path):
    from isoloom.sources import text

    rng, want, out = random.Random(7), {}, []
    for k in range(40):
        rows = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 6))]
        want[f"r{k}"] = "".join(rows)
        out += [f">r{k} more", *rows]
    (tmp_path / "x.fa").write_text("\n".join(out) + "\n")
    assert {r.read_id: r.seq for r in text.reads(spark, str(tmp_path / "x.fa")).collect()} == want
    lines = spark.createDataFrame([("p", n, x if x.startswith(">") else None) for n, x in enumerate(out)], "path string, no long, head string")
    seen, last = {r.no: r.x_head for r in text.headed(lines, "head", 3).collect()}, None
    for n, x in enumerate(out):
        last = x if x.startswith(">") else last
        assert seen[n] == last


def test_one_scan_of_samples(spark, tmp_path):
    from isoloom.sources import text

    line = "{}\t0\tchr1\t{}\t60\t5M\t*\t0\t0\tACGTA\tIIIII\n"
    for k, name in enumerate(["b one.sam", "a%20.sam"]):
        (tmp_path / name).write_text("@HD\n" + "".join(line.format(f"r{k}{j}", j + 1) for j in range(3)))
    paths = [str(tmp_path / "b one.sam"), str(tmp_path / "a%20.sam"), str(tmp_path / "b one.sam")]
    got = sorted((r.sample, r.read_id) for r in text.sam(spark, paths).collect())
    assert got == [(k, f"r{k % 2}{j}") for k in range(3) for j in range(3)]


def test_islands_of_equal_and_null_ranges(spark):
    from isoloom.operators import ranges

    rows = [("a", 1, 5, k) for k in range(50)] + [("a", 5, 8, 50), ("a", 9, 12, 51), (None, 2, 3, 52), (None, 3, 3, 53)]
    got = {r.id: r.island_start for r in ranges.islands(spark.createDataFrame(rows, "chrom string, s int, e int, id int"), ["chrom"], bin_width=4).collect()}
    assert got == {**{k: 1 for k in range(51)}, 51: 9, 52: 2, 53: 2}


def test_letters_of_several_bases():
    rng = random.Random(8)

    def cost(pattern, read):
        row = [0] * (len(read) + 1)
        for i, x in enumerate(pattern, 1):
            new = [i]
            for j, y in enumerate(read, 1):
                same = x == y or y in demux.MATCHES.get(x, "") or x in demux.MATCHES.get(y, "")
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (not same)))
            row = new
        return min(row)

    for _ in range(200):
        pattern, read = ("".join(rng.choice("ACGT?NRX") for _ in range(n)) for n in (6, 14))
        assert demux.locate(pattern, read, 6)[0] == cost(pattern, read)
    assert demux.locate("AC??GT", "TTANAAGTTT", 0)[0] == 0  # a read's N is any base of the structure
    assert demux.locate("AC??GT", "TTACXXGTTT", 1) is None  # what is masked matches nothing


def test_places_in_order(spark):
    from isoloom.sources import sinks

    rng = random.Random(9)
    words = ["".join(rng.choice("AB") for _ in range(rng.randrange(12))) for _ in range(300)] + [None, "z", "é"]
    got = {r.w: r.i for r in sinks.ordered(spark.createDataFrame([(w,) for w in words], "w string"), "w", "i").collect()}
    assert got == {w: k for k, w in enumerate([None, *sorted({w for w in words if w is not None})], 1)}
    numbers = [rng.randrange(-20000, 20000) for _ in range(300)]
    got = {r.w: r.i for r in sinks.ordered(spark.createDataFrame([(w,) for w in numbers], "w long"), "w", "i").collect()}
    assert got == {w: k for k, w in enumerate(sorted(set(numbers)), 1)}
