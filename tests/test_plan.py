"""Files to isoforms on a small made-up genome, and the driver's queries on the smallest tables."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from isoloom.params import Params
from isoloom.plans import isoforms
from isoloom.plans import queries as plans
from isoloom.sources import sinks, text


def genome(size=6000, seed=11):
    rng = random.Random(seed)
    g = [rng.choice("ACGT") for _ in range(size)]
    for s, e in [(1101, 1300), (1401, 1600), (1801, 2000), (1151, 1300)]:
        g[s - 1 : s + 1], g[e - 2 : e] = "GT", "AG"
    return "".join(g)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    g = genome()
    (d / "g.fa").write_text(">chr1 made up\n" + "\n".join(g[k : k + 70] for k in range(0, len(g), 70)) + "\n")
    exon = lambda gene, tx, s, e: f'chr1\tx\texon\t{s}\t{e}\t.\t+\t.\tgene_id "{gene}"; transcript_id "{tx}";\n'
    (d / "g.gtf").write_text("#c\n" + exon("G1", "T1", 1001, 1100) + exon("G1", "T1", 1301, 1400) + exon("G1", "T1", 1601, 1800) + exon("G2", "S1", 4001, 4300))
    rows = []

    def read(name, pos, cigar, flag=0):
        n = sum(int(x) for x, o in __import__("re").findall(r"(\d+)([MIDNS])", cigar) if o in "MIS")
        rows.append((pos, f"{name}\t{flag}\tchr1\t{pos}\t60\t{cigar}\t*\t0\t0\t{'A' * n}\t{'I' * n}\n"))

    for k in range(5):
        read(f"full{k}", 1001, "100M200N100M200N200M")
    for k in range(4):
        read(f"new{k}", 1001, "100M200N100M200N200M200N100M")
    for k in range(3):
        read(f"part{k}", 1301, "100M200N150M")
    for k in range(2):
        read(f"one{k}", 4011, "200M")
    read("second", 1001, "100M", 256)
    rows.sort()
    (d / "a.sam").write_text("@HD\n" + "".join(x for _, x in rows))
    return d


def test_bulk(spark, files, tmp_path):
    r = isoforms.run(spark, str(files / "a.sam"), str(files / "g.fa"), str(files / "g.gtf"), str(tmp_path / "out"))
    counts = {x.transcript_id: (x.gene_id, round(x["count"], 6)) for x in r.transcript_counts.collect()}
    novel = next(k for k in counts if "novel" in k)
    # the novel isoform reaches past G1, whose junctions it shares: it has no gene
    assert counts["S1"] == ("G2", 2.0) and counts[novel][0] is None
    # partial reads belong to T1, whose ratio is best
    assert counts["T1"] == ("G1", 8.0) and counts[novel][1] == 4.0
    assert {x.gene_id: x["count"] for x in r.gene_counts.collect()} == {"G1": 8.0, "G2": 2.0}
    trace = {x.read_id: (x.category, x.transcript_id) for x in r.trace.collect()}
    assert trace["full0"] == ("FSM", "T1") and trace["new1"] == ("novel", novel) and trace["part2"] == ("ISM", "T1") and trace["one0"] == ("SE", "S1") and "second" not in trace
    lines = [x.value for x in spark.read.text(str(tmp_path / "out" / "updated_annotations.gtf")).collect()]
    assert sum("\ttranscript\t" in x for x in lines) == 3 and sum("novel_isoform" in x and "\texon\t" in x for x in lines) == 4


def test_without_annotation_rows(spark, files, tmp_path):
    (tmp_path / "e.gtf").write_text("#none\n")
    r = isoforms.run(spark, str(files / "a.sam"), str(files / "g.fa"), str(tmp_path / "e.gtf"), str(tmp_path / "out"), Params())
    assert all(not x.known for x in r.isoforms.collect())


def test_cells(spark, files, tmp_path):
    lines = (files / "a.sam").read_text().splitlines()
    out = []
    for k, x in enumerate(x for x in lines if not x.startswith("@")):
        f = x.split("\t")
        out.append("\t".join([f"ACGTACGTACGTACG{'AC'[k % 2]}-1_{'ACGT' * 2}{'ACGTACGTACGTACGT'[k]}{'TTGGCCAATTGGCCAA'[k]}TT#r{k}", *f[1:]]))
    (tmp_path / "c.sam").write_text("\n".join(out) + "\n")
    r = isoforms.run(spark, str(tmp_path / "c.sam"), str(files / "g.fa"), str(files / "g.gtf"), str(tmp_path / "out"), cells=True)
    total = r.gene_counts.groupBy("gene_id").agg(F.sum("count").alias("n")).collect()
    assert {x.gene_id for x in total} == {"G1", "G2"} and r.transcript_counts.select("barcode").distinct().count() == 2


def test_barcode_of_two_files(spark, files, tmp_path):
    """A barcode of two files is a cell of each; UMIs are compared, not reads; the gene of a novel isoform is not written."""
    lines = [x.split("\t") for x in (files / "a.sam").read_text().splitlines() if not x.startswith("@")]
    named = lambda keep, umi: "".join("\t".join([f"ACGTACGTACGTACGA-1_{umi(k)}#r{k}", *f[1:]]) + "\n" for k, f in enumerate(f for f in lines if f[0].startswith(keep)))
    far = lambda k: ["AAAACCCCGGGG", "CCCCGGGGTTTT", "GGGGTTTTAAAA", "TTTTAAAACCCC", "ACACGTGTACAC"][k]
    (tmp_path / "one.sam").write_text(named(("full", "one"), lambda k: far(k % 5)))
    (tmp_path / "two.sam").write_text(named(("new",), far))
    (tmp_path / "all.txt").write_text(f"{tmp_path}/one.sam\n{tmp_path}/two.sam\n")
    isoforms.run(spark, str(tmp_path / "all.txt"), str(files / "g.fa"), str(files / "g.gtf"), str(tmp_path / "out"), cells=True)
    read = lambda name: sorted(map(tuple, spark.read.csv(str(tmp_path / "out" / name), sep="\t", header=True).collect()))
    one, two = read("counts_transcript_0"), read("counts_transcript_1")
    assert ("T1", "G1", "5") in one and [x[1:] for x in two if x[0] != "T1"] == [("NA", "4")]
    assert ("G1", "5") in read("counts_gene_0") and read("counts_gene_1") == []


def test_sources(spark, tmp_path):
    (tmp_path / "r.fq").write_text("@a x\nACGT\n+\nIIII\n@b\nGG\n+\nII\n")
    (tmp_path / "r.fa").write_text(">a x\nAC\nGT\n>b\nGG\n")
    (tmp_path / "p.seq").write_text(">AC\n<AG\n>T\n<TT\n")
    (tmp_path / "b.txt").write_text("ACGTACGTACGTACGT-1 short\nACGTACGTACGTACGA\n")
    (tmp_path / "w.txt").write_text("ACGTACGTACGTACGT\tACGTACGTACGT\nACGTACGTACGTACGT\tACGTACGTACGN\n")
    (tmp_path / "m.tsv").write_text("id\ts1\ts2\nt\t1\t0\nu\t2\t3\n")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(text.reads(spark, str(tmp_path / "r.fq"))) == [("a", "ACGT", "IIII"), ("b", "GG", "II")]
    assert rows(text.reads(spark, str(tmp_path / "r.fa"))) == [("a", "ACGT", None), ("b", "GG", None)]
    assert rows(text.pairs(spark, str(tmp_path / "p.seq"))) == [(0, "AC", "AG"), (1, "T", "TT")]
    assert rows(text.barcodes(spark, str(tmp_path / "b.txt"), 16)) == [("ACGTACGTACGTACGA",), ("ACGTACGTACGTACGT",)]
    assert rows(text.whitelist(spark, str(tmp_path / "w.txt"))) == [("ACGTACGTACGTACGT", ["ACGTACGTACGT"])]
    m = text.matrix(spark, str(tmp_path / "m.tsv"))
    sinks.write_mtx(m, str(tmp_path / "out"), "id", "column", "value")
    body = [r.value for r in spark.read.text(str(tmp_path / "out" / "matrix.mtx")).collect()]
    assert body[1] == "2 2 3" and body[2:] == ["1 1 1", "2 1 2", "2 2 3"]
    (tmp_path / "l.txt").write_text("# c\n\n x.sam \n")
    assert text.inputs(spark, str(tmp_path / "l.txt")) == ["x.sam"]


def test_command_line(spark, files, tmp_path):
    from isoloom import __main__ as command

    a = command.parser().parse_args(["cells", "-s", "a", "-f", "b", "-g", "c", "-o", "d", "-k", "1", "-n", "3"])
    assert command.params(a) == Params(support=3, dedup_umi=True, single_exon_edge=500)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    known = [word(16) for _ in range(5)]
    reads = [(f"r{k}", word(8) + "CTACACGACGCTCTTCCGATCT" + known[k % 5] + word(12) + "T" * 10 + "ACGGCA" * 6) for k in range(10)]
    (tmp_path / "r.fa").write_text("".join(f">{n}\n{s}\n" for n, s in reads))
    (tmp_path / "b.txt").write_text("\n".join(known) + "\n")
    for more in (["-c", str(tmp_path / "b.txt"), "-p"], []):
        command.run_demux(spark, command.parser().parse_args(["demux", "-r", str(tmp_path / "r.fa"), "-o", str(tmp_path / "demux"), *more]))
        stats = spark.read.csv(str(tmp_path / "demux" / "stats"), sep="\t", header=True).collect()
        assert sorted((r.Read, r.CellBarcode) for r in stats) == sorted((n, known[k % 5]) for k, (n, _) in enumerate(reads))
    assert spark.read.text(str(tmp_path / "demux" / "reads")).count() == 20
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "demux" / "barcodes_counts"), sep="\t").collect()] == [(b, "2") for b in sorted(known)]
    (tmp_path / "m.tsv").write_text("gene_id\tc1\tc2\nG1\t1\t0\nG9\t2\t3\nG2\t0\t2.5\n")
    (tmp_path / "n.gtf").write_text('c\tx\tgene\t5\t90\t.\t+\t.\tgene_id "G1"; gene_name "one";\nc\tx\tgene\t100\t190\t.\t+\t.\tgene_id "G2";\n')
    command.run_sparse(spark, command.parser().parse_args(["sparse", "-i", str(tmp_path / "m.tsv"), "-g", str(tmp_path / "n.gtf"), "-o", str(tmp_path / "mtx"), "-n", "7"]))
    body = lambda name: [r.value for r in spark.read.text(str(tmp_path / "mtx" / name)).collect()]
    assert body("matrix.mtx") == ["%%MatrixMarket matrix coordinate real general", "2 2 2", "1 1 1", "2 2 2.5"]
    assert body("features.tsv") == ["G1\tone\tc\t5\t90", "G2\tG2\tc\t100\t190"] and body("barcodes.tsv") == ["c1-7", "c2-7"]


def test_many_sequences(spark, tmp_path):
    rng = random.Random(3)
    names = {f"s{k}": "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 400))) for k in range(50)}
    (tmp_path / "m.fa").write_text("".join(f">{n} x\n" + "".join(s[k : k + 7] + "\n" for k in range(0, len(s), 7)) for n, s in names.items()))
    got = {}
    for r in sorted(text.fasta(spark, str(tmp_path / "m.fa"), 64).collect(), key=lambda r: r.chunk_no):
        got[r.chrom] = got.get(r.chrom, "") + r.seq[:64]
    assert got == names


def test_fasta_chunks(spark, files):
    got = {r.chunk_no: r.seq for r in text.fasta(spark, str(files / "g.fa"), 100).collect()}
    g = genome()
    assert all(got[k] == g[k * 100 : k * 100 + 101] for k in got) and len(got) == 60


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_queries_against_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = plans.QUERIES[name](spark, d)
    columns = sorted(df.columns)
    want = c.sql(plans.ORACLES[name]).df()[columns].astype(str).replace(r"\.0$", "", regex=True).values.tolist()
    got = df.toPandas()[columns].astype(str).replace(r"\.0$", "", regex=True).values.tolist()
    assert sorted(got) == sorted(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(5).count() == 5 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
