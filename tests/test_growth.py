"""Work that grows no faster than the input: copies and equal rows are worked on once, and in batches."""

import random

from isoloom.operators import align, annotation, classify, compat, demux, paths, single_exon, umi
from isoloom.sources import sinks

CHAIN = "array<struct<s:int,e:int>>"


def test_reads_are_searched_in_batches(monkeypatch):
    """One matrix for reads of near lengths, whatever their number; hits as if each were searched alone."""
    r = random.Random(7)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    form, bars = demux.structure("visium"), [word(16) for _ in range(9)]
    at = lambda b: form.parts[0][1] + b + word(12) + "T" * 10 + word(r.randrange(30))
    reads = [word(r.randrange(9)) + "".join(at(r.choice(bars)) for _ in range(k % 3)) for k in range(60)] + ["", "ACGT"]
    near = demux.Correcter(bars, 3)
    steps, calls = demux._steps, []
    monkeypatch.setattr(demux, "_steps", lambda *x: (calls.append(1), steps(*x))[1])
    got = demux.search_all(reads, form, near, {})
    assert len(calls) <= 6  # two for each of three rounds
    assert got == [demux.search(s, form, near, {}) for s in reads]
    assert [len(h) for h in got] == [k % 3 for k in range(60)] + [0, 0]
    assert all(h[0] in bars and h[2:4] == (0, 0) for hits in got for h in hits)


def joined_rows(df) -> int:
    """The most rows that a join of the plan gave."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan()
    found, left = [0], [text]
    while left:
        node = left.pop()
        for i in range(node.children().size()):
            left.append(node.children().apply(i))
        if node.nodeName() == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
        if hasattr(node, "plan") and node.nodeName().endswith("QueryStage"):
            left.append(node.plan())
        if "Join" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
    return max(found)


def test_nearest_compares_different_ends(spark):
    reads = spark.range(2000).selectExpr("0 sample", "'c' chrom", "0 group_id", "id read_id", "array(named_struct('s', 10, 'e', 15)) chain", "cast(id % 5 as int) read_start", "cast(20 + id % 3 as int) read_end")
    tx = spark.range(300).selectExpr("'c' chrom", "0 group_id", "array(named_struct('s', 10, 'e', 15)) chain", "concat('t', 1000 + id) transcript_id", "'g' gene_id", "cast(id % 4 as int) tx_start", "cast(20 + id % 7 as int) tx_end")
    out = classify.nearest(reads, tx)
    got = {r.read_id: (r.off, r.transcript_id) for r in out.collect()}
    known = [(r.tx_start, r.tx_end, r.transcript_id) for r in tx.collect()]
    assert got == {r.read_id: min((abs(r.read_start - s) + abs(r.read_end - e), t) for s, e, t in known) for r in reads.collect()}
    assert joined_rows(out) <= 2000


def stepped(k: int, more: int):
    """A chain of one junction, longer by more."""
    return f"array(named_struct('s', {k}, 'e', {k} + 50 + cast({more} as int)))"


def test_near_full_compares_different_chains(spark):
    seen = spark.range(4).selectExpr("'c' chrom", "0 group_id", "array(named_struct('s', 100, 'e', cast(150 + 4 * id as int))) chain", "'low' confidence")
    known = spark.range(900).selectExpr("'c' chrom", "concat('t', 1000 + id) transcript_id", "'g' gene_id", "array(named_struct('s', 100, 'e', cast(153 + id % 3 as int))) chain")
    seeds = spark.range(0, 900, 2).selectExpr("'c' chrom", "id % 10 div 8 group_id", "concat('t', 1000 + id) transcript_id", "id % 7 count")
    out = classify.near_full(seen, known, seeds)
    got = {r.chain[0].e: (r.transcript_id, r.distance) for r in out.collect()}
    count = {r.transcript_id: r["count"] for r in seeds.collect() if r.group_id == 0}
    want = {}
    for e in (150, 154, 158, 162):
        near = [(-count.get(k.transcript_id, 0), abs(k.chain[0].e - e), k.transcript_id) for k in known.collect() if k.chain[0].e != e]
        want[e] = min(near)[2], min(near)[1]
    assert got == want
    assert joined_rows(out) <= 900


def test_least_apart_compares_different_chains(spark):
    nodes = spark.range(200).selectExpr("'c' chrom", "0 group_id", "concat('n', id) node", f"{stepped(100, 'id % 4 * 4')} chain")
    reported = spark.range(300).selectExpr("'c' chrom", "0 group_id", "concat('t', 1000 + id) isoform", f"{stepped(100, 'id % 3 * 5')} chain")
    out = compat.least_apart(nodes, reported)
    want = {r.node: min((abs(k.chain[0].e - r.chain[0].e), k.isoform) for k in reported.collect())[1] for r in nodes.collect()}
    assert {r.node: r.isoform for r in out.collect()} == want
    assert joined_rows(out) <= 300


def test_kmer_candidates_keep_few_barcodes_of_a_subset(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("AC") for _ in range(n))
    bars = sorted({word(r.choice([5, 8, 14])) for _ in range(400)})
    seqs = [(i, word(r.choice([3, 6, 8, 16]))) for i in range(120)]
    runs = lambda s: {s[p : p + 4] for p in range(len(s) - 3)}
    want = set()
    for i, s in seqs:
        votes = sorted((-len(runs(s) & runs(b)), b) for b in bars if runs(s) & runs(b))
        want |= {(i, b, -v, k + 1) for k, (v, b) in enumerate(votes[:3])}
    known = spark.createDataFrame([(b,) for b in bars + bars[:50]], "barcode string")  # listed twice counts once
    assert {tuple(x) for x in demux.kmer_candidates(spark.createDataFrame(seqs, "id int, seq string"), known, 4, 3).collect()} == want
    many = spark.range(20000).selectExpr("concat('ACGTA', lpad(translate(conv(id, 10, 4), '0123', 'ACGT'), 8, 'A')) barcode").selectExpr("substr(barcode, 1, 8) barcode").distinct()
    same = spark.range(3000).selectExpr("id", "'ACGTACCA' seq")
    out = demux.kmer_candidates(same, many.unionByName(spark.range(500).selectExpr("concat('ACGT', 'T') || cast(id as string) barcode")), 4, 3)
    assert joined_rows(out) <= 9000


def test_paths_are_traced_in_batches(monkeypatch):
    """Steps of all pairs at a time: as many calls for many pairs as for one; paths as of each pair alone."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("ACG") for _ in range(r.randrange(12)))
    a, b = [word() for _ in range(300)], [word() for _ in range(300)]
    calls, traces = [], paths._traces
    monkeypatch.setattr(paths, "_traces", lambda *x: (calls.append(1), traces(*x))[1])
    for costs, free in ((paths.EDIT, paths.Free()), (paths.DUAL, paths.Free(2, 0, 1, 20))):
        calls.clear()
        got = paths.paths(a, b, costs, free)
        assert len(calls) == 1
        assert got == [paths.paths([x], [y], costs, free)[0] for x, y in zip(a, b, strict=True)]
        assert all(paths.valid(x[1], p, t) for x, p, t in zip(got, a, b, strict=True))


def test_genes_of_novel_isoforms_meet_near_ones_only(spark):
    """Genes of 40 bases: bins of their length, not of 1,600 of them."""
    at = lambda s, e: f"named_struct('s', cast(id * 40 + {s} as int), 'e', cast(id * 40 + {e} as int))"
    exons = spark.range(2000).selectExpr("'c' chrom", "cast(id as string) gene_id", "cast(id as string) transcript_id", "'+' strand", f"explode(array({at(1, 9)}, {at(20, 36)})) x").selectExpr("chrom", "gene_id", "transcript_id", "strand", "x.s s", "x.e e")
    tx = annotation.transcripts(exons)
    novel = spark.range(2000).selectExpr("'c' chrom", "cast(id as string) node", "false known", f"array({at(12, 19)}) chain", "cast(null as string) gene_id", "cast(id * 40 + 3 as int) begin", "cast(id * 40 + 30 as int) finish")
    out = annotation.with_gene(novel, annotation.genes(tx), tx, bin_width=64)
    assert all(r.node == r.gene_id for r in out.collect())
    assert joined_rows(out) <= 10000


def test_greedy_compares_kept_umis_that_share_a_piece(spark, monkeypatch):
    r = random.Random(11)
    word = lambda: "".join(r.choice("ACGT") for _ in range(r.choice([7, 8, 9])))
    rows = [(k % 2, k, word()) for k in range(600)] + [(0, 600 + k, "ACGTACGT") for k in range(50)]
    want = []
    for g in (0, 1):
        kept = []
        for _, i, u in (x for x in rows if x[0] == g):
            if not kept or align.edit_distances([u] * len(kept), kept).min() > 1:
                kept.append(u)
                want.append(i)
    got = umi.greedy(spark.createDataFrame(rows, "g int, read_id int, umi string"), ["g"], most=1).collect()
    assert sorted(x.read_id for x in got) == sorted(want)
    kept = umi.Kept(1)
    for _, _, u in rows:
        kept.add(u)
    for u in ("ACGTACGT", "CCCCCCC", "ACGTTTTTA"):
        near = {v for _, _, v in rows if align.edit_distances([u], [v])[0] <= 1}
        assert near <= set(kept.sharing(u)) and len(kept.sharing(u)) < 150


def test_traces_join_names_by_set(spark):
    """Reads and names of a few keys are not paired."""
    reads = spark.range(6000).selectExpr("cast(id div 2 as string) read_id", "cast(if(id % 2 = 0, id % 5, 4 + id % 3) as int) k").distinct()
    names = spark.range(900).selectExpr("cast(if(id < 10, null, id % 6) as int) k", "cast(id % 800 as string) isoform")
    out = sinks.trace_rows(reads, names, ["k"], ["read_id"])
    of, own = {}, {}
    for r in names.collect():
        of.setdefault(r.k, set()).add(r.isoform)
    for r in reads.collect():
        if r.k in of:
            own.setdefault(r.read_id, set()).update(of[r.k])
    assert {r.read_id: r.transcript_id for r in out.collect()} == {k: ",".join(sorted(v)) for k, v in own.items()}
    assert joined_rows(out) <= 6000


def cascade(s: int, e: int, met: list):
    """What stays of (exons, order) for a read, by loops."""
    common = lambda x: sum(max(0, min(e, f) - max(s, b) + 1) for b, f in x[0])
    apart = lambda x: min(min(abs(b - s), abs(f - e)) for b, f in x[0])
    near = [x for x in met if apart(x) <= min(map(apart, met)) + 10]
    most = [x for x in near if common(x) >= max(map(common, near)) - 10]
    ones = [x for x in most if len(x[0]) == 1]
    return min(ones if len(ones) == 1 else most, key=lambda x: x[1])[1]


def test_lone_reads_stay_one_row(spark):
    """Neither genes nor transcripts of a read are rows; short and long reads, in bins of their width."""
    r = random.Random(13)
    rows, merged = [], {}
    for k in range(400):
        chrom, gene, at = r.choice("ab"), f"g{k // 4 % 70}", r.randrange(-300, 2500)
        cuts = sorted(r.sample(range(0, r.choice([60, 700]), 4), 2 * r.choice([1, 1, 2, 3])))
        rows += [(chrom, gene, f"t{k}", "+", at + b, at + f) for b, f in zip(cuts[::2], cuts[1::2], strict=True)]
    tx = annotation.transcripts(spark.createDataFrame(rows, "chrom string, gene_id string, transcript_id string, strand string, s int, e int")).cache()
    genes = annotation.genes(tx).cache()
    lone = []
    for k in range(1500):
        s = r.randrange(-400, 3300)
        e = s + r.choice([-5, 0, 15, 16, 17, 31, 32, 33, r.randrange(100), 64, 600, 5000])
        lone.append((0, r.choice("abz"), 0, k, s, e))
    reads = spark.createDataFrame(lone, "sample int, chrom string, group_id int, read_id int, read_start int, read_end int")
    seeds = spark.createDataFrame([(c, k % 3, f"t{k}", k % 5) for c in "ab" for k in range(0, 400, 2)], "chrom string, group_id int, transcript_id string, count int")
    placed = single_exon.to_genes(reads, genes, 16)
    out = single_exon.to_transcripts(placed, tx, seeds)

    listed = lambda a: [(x.s, x.e) for x in a]
    for x in genes.collect():
        merged.setdefault(x.chrom, []).append((listed(x.merged_exons), (x.gene_id,)))
    own = {}
    for x in tx.collect():
        n = int(x.transcript_id[1:])
        own.setdefault((x.chrom, x.gene_id), []).append((listed(x.exons), (-(n % 5) if n % 2 == 0 else 0, x.transcript_id, x.n_exons)))
    meets = lambda s, e, known: [x for x in known if any(min(e, f) >= max(s, b) for b, f in x[0])]
    want_genes, want = {}, {}
    for _, chrom, _, i, s, e in lone:
        met = meets(s, e, merged.get(chrom, []))
        if met:
            want_genes[i] = cascade(s, e, met)[0]
            all_of = own[chrom, want_genes[i]]
            left = all_of if len(all_of) == 1 else meets(s, e, all_of)
            if left:
                want[i] = (want_genes[i], *cascade(s, e, left)[1:])
    assert {x.read_id: x.gene_id for x in placed.collect()} == want_genes
    assert {x.read_id: (x.gene_id, x.transcript_id, x.n_exons) for x in out.collect()} == want
    assert len(want) > 500
    assert joined_rows(out) <= 1500
