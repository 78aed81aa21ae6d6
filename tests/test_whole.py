"""Queries and operators over whole inputs: what a filter, a cap or a missing rule would lose."""

import random

import pytest
from pyspark.sql import functions as F

from isoloom.operators import demux
from isoloom.params import Params
from isoloom.plans import isoforms
from isoloom.plans import queries as plans


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Lines of all part keys and line numbers, some repeated, and suppliers of all nations."""
    d = str(tmp_path_factory.mktemp("tables"))
    lines = [(k // 7, k % 7 + 1, k * 3 + 1, k % 11 + 1, float(k * 13 % 50 + 1)) for k in range(70)] + [(0, 1, 8, 2, 44.0), (0, 1, 1, 1, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k, k * 7 % 25) for k in range(1, 101)], "s_suppkey long, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    return d, lines


def test_nearest_tie_of_all_lines(spark, tables):
    d, lines = tables
    want = {}
    for o, n, p, _, q in lines:
        for tx in range(1, 101):
            nation = tx * 7 % 25
            if nation == p % 25:
                best = (abs(int(q) - tx % 50) + abs(int(q) + 10 - nation), tx)
                want[o, n] = min(want.get((o, n), best), best)
    got = {(r.l_orderkey, r.l_linenumber): (r.off, r.tx) for r in plans.QUERIES["fsm_nearest_tie"](spark, d).collect()}
    assert got == want and set(got) == {x[:2] for x in lines}


def test_gtf_of_whole_transcripts(spark, tables):
    d, lines = tables
    exons = {}
    for o, n, _, _, q in lines:
        exons.setdefault(str(o), set()).add((n * 100, n * 100 + int(q)))
    got = {}
    for r in plans.QUERIES["gtf_lines"](spark, d).collect():
        got.setdefault(r.transcript_id, {})[r.no] = tuple(map(int, r.line.split("\t")[3:5]))
    assert got == {o: {0: (min(x)[0], max(e for _, e in x)), **dict(enumerate(sorted(x), 1))} for o, x in exons.items()}


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_barcode_behind_many_that_share_its_letters(spark):
    true, half = "TGACTGCAGTCATGCA", "GTCATGCA"
    seen = true[:7] + "C" + half
    decoys = ["ACACTGGC" + half, *("A" + "".join(x) + half for x in zip("CCCCCCCCCCCC", "AAACCCGGGTTT", "CCCCCCCCCCCC", "ACGTACGTACGT", "AAAAAAAAAAAA", "CCCCCCCCCCCC", "AAAAAAAAAAAA"))]
    assert edit(true, seen) == 1 and edit(decoys[0], seen) == 3 and min(edit(x, seen) for x in decoys) == 3
    rival = true[:7] + "T" + half
    rest = "ACGTTGCAACGGTTAA"
    read = "G" * 9 + "CTACACGACGCTCTTCCGATCT" + seen + "ACGTACGTACGT" + "T" * 10 + rest
    df = spark.createDataFrame([("a", read, None)], "read_id string, seq string, qual string")
    got = [tuple(r) for r in demux.demultiplex(df, "visium", [true, *decoys]).select("read_id", "barcode", "barcode_edits", "seq").collect()]
    assert got == [("a", true, 1, rest)]
    # one as near as the nearest, which is the last by name, makes it ambiguous
    assert demux.demultiplex(df, "visium", [true, rival, *decoys]).count() == 0


def test_barcodes_against_all():
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    for size in (6, 9, 16):
        known = [word(size + rng.randrange(-1, 2)) for _ in range(80)] + ["AC", ""]
        correcter = demux.Correcter(known, 3)
        for k in range(120):
            seen = list(rng.choice(known)) if k % 4 else list(word(rng.randrange(size + 3)))
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(seen) + 1)
                seen[at : at + rng.randrange(2)] = rng.choice(["", "A", "C", "G", "T"])
            seen = "".join(seen)
            far = {b: edit(b, seen) for b in known}
            best = min(far.values())
            near = sorted(b for b, x in far.items() if x == best)
            assert correcter.correct(seen) == ((near[0], best, len(near) > 1) if best <= 3 else (None, 4, False))


def test_gene_of_novel_isoforms(spark):
    kind = "array<struct<s:int,e:int>>"
    known = [("c", "A", [(100, 200), (300, 310)]), ("c", "B", [(100, 200), (250, 400)]), ("c", "B", [(100, 200)]), ("c", "C", [(1000, 1100)]), ("d", "D", [(100, 200)])]
    genes = [("c", "A", 50, 500), ("c", "B", 60, 490), ("c", "C", 950, 1150), ("c", "E", 4000, 6000), ("c", "F", 3000, 5100), ("d", "D", 50, 9000)]
    true = [
        ("tie", False, None, 70, 450, [(100, 200), (300, 400)]),  # one equal junction each, B overlaps more
        ("count", False, None, 70, 450, [(100, 199), (300, 310)]),  # one equal junction, with A; as much overlap with B
        ("past", False, None, 900, 1300, [(1010, 1200)]),  # overlaps C only and reaches past it
        ("inside", False, None, 4200, 5000, [(4300, 4400)]),  # no junction met: in E and F, nearer to F's end
        ("none", False, None, 7000, 8000, [(7300, 7400)]),
        ("old", True, "A", 50, 500, [(100, 200), (300, 310)]),
    ]
    df = spark.createDataFrame([("c", *x) for x in true], f"chrom string, node string, known boolean, gene_id string, begin int, finish int, chain {kind}")
    k = spark.createDataFrame(known, f"chrom string, gene_id string, chain {kind}")
    g = spark.createDataFrame(genes, "chrom string, gene_id string, start int, end int")
    named = lambda p: {r.node: r.gene_id for r in isoforms._with_gene(df, g, k, p).collect()}
    want = {"tie": "B", "count": "A", "past": None, "inside": "F", "none": None, "old": "A"}
    assert named(Params()) == want
    wide = spark.createDataFrame([("c", "wide", False, None, 70, 450, [(300, 310), (350, 400)])], df.schema)
    assert [isoforms._with_gene(wide, g, k, cells=x).first().gene_id for x in (True, False)] == ["A", "B"]


def test_infix_costs_of_whole_columns(spark):
    d = "/root/testdata/sf0.001"
    got = {r.p_partkey: r.distance for r in plans.QUERIES["align_infix"](spark, d).collect()}
    want = {}
    for r in plans.table(spark, d, "part").collect():
        # a row of the matrix for each letter of the pattern; the text's ends are free
        row = [0] * (len(r.p_name) + 1)
        for i, x in enumerate(r.p_brand, 1):
            row, old = [i], row
            for j, y in enumerate(r.p_name, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        want[r.p_partkey] = min(row)
    assert got == want and max(want.values()) > 0
