"""Queries that apply the operators to whole tables of the test data, and their SQL.

Lines of orders stand for reads: the supplier is the chromosome, a line covers quantity positions from
40 * part key on; the parts of an order are its chain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import sequences as S
from ..operators import align, annotation, classify, compat, demux, graph, paths, quantify, ranges, single_exon, umi
from ..params import Params
from ..sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores: rows that take long to work on can lie in a file of one row group, which is one task."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, 64))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_partkey") * 40
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chrom"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), s.alias("s"), (s + F.col("l_quantity").cast("int") - 1).alias("e"))


SPANS = "select l_suppkey chrom, l_orderkey ok, l_linenumber ln, l_partkey * 40 s, l_partkey * 40 + cast(l_quantity as int) - 1 e from lineitem"
ISLANDS = f"""p as ({SPANS}),
f as (select *, max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) m from p),
i as (select *, max(case when m is null or s > m then s end) over (partition by chrom order by s, e rows unbounded preceding) island from f)"""


@query(f"with {ISLANDS} select chrom, island island_start, max(e) island_end, count(*) n_reads from i group by 1, 2")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranges.islands(spans(spark, sf_dir), ["chrom"], bin_width=1 << 14)
    return out.groupBy("chrom", "island_start").agg(F.max("e").alias("island_end"), F.count(F.lit(1)).alias("n_reads"))


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order two sorted lists of intervals without overlaps."""
    a = F.struct((F.col("l_linenumber") * 100).alias("s"), (F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")).alias("e"))
    t = F.col("l_linenumber") * 100 + (F.col("l_partkey") % 60).cast("int") - 30
    b = F.struct(t.alias("s"), (t + (F.col("l_quantity") / 2).cast("int")).alias("e"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_quantity").alias("l_quantity"))
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(a)).alias("a"), F.array_sort(F.collect_set(b)).alias("b"))


LISTS = """l as (select l_orderkey, l_linenumber, min(l_partkey) l_partkey, min(l_quantity) l_quantity from lineitem group by 1, 2),
a as (select l_orderkey k, l_linenumber * 100 s, l_linenumber * 100 + cast(l_quantity as int) e from l),
b as (select l_orderkey k, l_linenumber * 100 + cast(l_partkey % 60 as int) - 30 s, l_linenumber * 100 + cast(l_partkey % 60 as int) - 30 + cast(floor(l_quantity / 2) as int) e from l)"""
KERNELS = f"""{LISTS},
t as (select k, sum(e - s + 1) n from (select * from a union all select * from b) group by 1),
i as (select a.k, sum(least(a.e, b.e) - greatest(a.s, b.s) + 1) x from a join b on a.k = b.k and a.s <= b.e and b.s <= a.e group by 1),
o as (select k, sum(e - s + 1) y from (
  select * from a where not exists (select 1 from b where a.k = b.k and a.s <= b.e and b.s <= a.e)
  union all select * from b where not exists (select 1 from a where a.k = b.k and a.s <= b.e and b.s <= a.e)) group by 1)"""


@query(f"with {KERNELS} select t.k l_orderkey, n - coalesce(x, 0) union_len, coalesce(x, 0) intersect_len, coalesce(y, 0) apart_len, n - 2 * coalesce(x, 0) - coalesce(y, 0) distance from t left join i on i.k = t.k left join o on o.k = t.k")
def interval_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return lists(spark, sf_dir).select("l_orderkey", I.union_length(a, b).alias("union_len"), I.intersect_length(a, b).alias("intersect_len"), I.apart_length(a, b).alias("apart_len"), I.chain_distance(a, b).alias("distance"))


@query(f"""with {LISTS}, u as (select k, s, e from a union all select k, s, e from b),
f as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) m from u),
g as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by k order by s, e rows unbounded preceding) n from f),
h as (select k, n, min(s) s, max(e) e from g group by 1, 2)
select k l_orderkey, string_agg(s || '-' || e, ',' order by s) merged from h group by 1""")
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists(spark, sf_dir).select("l_orderkey", I.render(I.merge(F.concat("a", "b"))).alias("merged"))


@query(f"with {LISTS} select a.k l_orderkey, min(least(abs(a.s - 250), abs(a.e - 400))) distance from a group by 1")
def boundary_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists(spark, sf_dir).select("l_orderkey", I.boundary_distance(F.col("a"), F.lit(250), F.lit(400)).alias("distance"))


@query(f"with p as ({SPANS}) select chrom, count(*) n_pairs, sum(least(e, p_partkey * 40 + 10 + p_size) - greatest(s, p_partkey * 40 + 10) + 1) bases from p join part on s <= p_partkey * 40 + 10 + p_size and p_partkey * 40 + 10 <= e group by 1")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("p_partkey") * 40 + 10
    genes = table(spark, sf_dir, "part").select(F.lit(1).alias("k"), g.alias("gs"), (g + F.col("p_size")).alias("ge"))
    met = ranges.range_join(spans(spark, sf_dir).withColumn("k", F.lit(1)), genes, ["k"], ("s", "e"), ("gs", "ge"), 512)
    return met.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.least("e", "ge") - F.greatest("s", "gs") + 1).alias("bases"))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.col("l_partkey") % 5).cast("int") * 100
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ok")).agg(F.array_sort(F.collect_set(F.struct(v.alias("s"), (v + 50).alias("e")))).alias("chain")).withColumn("chrom", (F.col("ok") % 10).cast("string"))


CHAINS = """v as (select distinct l_orderkey ok, cast(l_partkey % 5 as int) * 100 v from lineitem),
c as (select ok, cast(ok % 10 as varchar) chrom, string_agg(v || '-' || (v + 50), ',' order by v) chain, count(*) n from v group by 1),
k as (select * from c where ok % 7 = 0), q as (select chrom, chain, n, count(*) n_reads from c where ok % 7 <> 0 group by 1, 2, 3)"""


def known_and_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = chains(spark, sf_dir)
    known = c.filter("ok % 7 = 0").select("chrom", F.lit("g").alias("gene_id"), F.col("ok").cast("string").alias("transcript_id"), "chain", F.lit(0).alias("start"), F.lit(500).alias("end"))
    seen = c.filter("ok % 7 <> 0").withColumn("group_id", F.lit(0)).groupBy("chrom", "group_id", "chain").agg(F.count(F.lit(1)).alias("n_reads"))
    return known, seen


def chain_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reads: a junction for each residue of its parts, trusted (code 1) where a line of it has a discount over 0.02."""
    v = (F.col("l_partkey") % 5).cast("int") * 100
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("read_id"), v.alias("s")).agg(F.max(F.when(F.col("l_discount") > 0.02, 1).otherwise(0)).cast("tinyint").alias("code"))
    j = F.array_sort(F.collect_list(F.struct("s", (F.col("s") + 50).alias("e"), "code")))
    out = per.groupBy("read_id").agg(j.alias("j"))
    chain = F.transform("j", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    return out.select("read_id", F.lit(0).alias("sample"), (F.col("read_id") % 10).cast("string").alias("chrom"), F.lit(0).alias("group_id"), chain.alias("chain"), F.transform("j", lambda x: x["code"]).alias("sj_code"), (F.col("read_id") % 97).cast("int").alias("read_start"), (F.col("read_id") % 89 + 500).cast("int").alias("read_end"))


CLUSTERS = """v as (select l_orderkey ok, cast(l_partkey % 5 as int) * 100 v, max(case when l_discount > 0.02 then 1 else 0 end) code from lineitem group by 1, 2),
c as (select ok, string_agg(v || '-' || (v + 50), ',' order by v) chain, count(*) n from v group by 1),
q as (select cast(ok % 10 as varchar) chrom, chain, n, count(*) n_reads, min(ok % 97) b, max(ok % 89 + 500) e from c group by 1, 2, 3),
t as (select cast(c.ok % 10 as varchar) chrom, chain, v.v, sum(code) n from c join v on c.ok = v.ok group by 1, 2, 3),
l as (select chrom, chain, min(n) least_trusted from t group by 1, 2)"""


@query(f"with {CLUSTERS} select q.chrom, q.chain, n_reads, b begin, e \"end\", cast(least_trusted as bigint) least_trusted from q join l on q.chrom = l.chrom and q.chain = l.chain")
def chain_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.clusters(chain_reads(spark, sf_dir)).select("chrom", I.render(F.col("chain")).alias("chain"), "n_reads", "begin", "end", "least_trusted")


@query(f"with {CHAINS} select q.chrom, q.chain, n_reads, k.ok || '' transcript_id from q join k on q.chrom = k.chrom and q.chain = k.chain")
def fsm_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, seen = known_and_clusters(spark, sf_dir)
    return classify.full_matches(seen, known).select("chrom", I.render(F.col("chain")).alias("chain"), "n_reads", "transcript_id")


@query(f"with {CHAINS} select q.chrom, q.chain, n_reads, k.ok || '' transcript_id from q join k on q.chrom = k.chrom and k.n > q.n and contains(',' || k.chain || ',', ',' || q.chain || ',')")
def ism_sublist(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, seen = known_and_clusters(spark, sf_dir)
    return classify.partial_matches(seen, known).select("chrom", I.render(F.col("chain")).alias("chain"), "n_reads", "transcript_id")


@query(f"""with {CHAINS}, x as (select q.chrom, q.chain, max(case when k.chain = q.chain then 2 when k.n > q.n and contains(',' || k.chain || ',', ',' || q.chain || ',') then 1 else 0 end) m
from q left join k on q.chrom = k.chrom group by 1, 2) select chrom, chain, case m when 2 then 'FSM' when 1 then 'ISM' else 'other' end category from x""")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, seen = known_and_clusters(spark, sf_dir)
    return classify.classify(seen, known).select("chrom", I.render(F.col("chain")).alias("chain"), "category")


@query("""with r as (select l_orderkey, l_linenumber, l_partkey, cast(l_quantity as int) q from lineitem),
c as (select r.*, s_suppkey tx, abs(q - s_suppkey % 50) + abs(q + 10 - s_nationkey) off from r join supplier on s_nationkey = l_partkey % 25)
select l_orderkey, l_linenumber, min_by(tx, off * 100000 + tx) tx, min(off) off from c group by 1, 2""")
def fsm_nearest_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are reads of the chain of a nation, suppliers its transcripts."""
    chain = lambda n: F.array(F.struct((n.cast("int") * 10).alias("s"), (n.cast("int") * 10 + 5).alias("e"))).alias("chain")
    q = F.col("l_quantity").cast("int")
    reads = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0).alias("sample"), F.lit("c").alias("chrom"), F.lit(0).alias("group_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("read_id"), chain(F.col("l_partkey") % 25), q.alias("read_start"), (q + 10).alias("read_end"))
    known = table(spark, sf_dir, "supplier").select(F.lit("c").alias("chrom"), F.lit(0).alias("group_id"), chain(F.col("s_nationkey")), F.col("s_suppkey").alias("transcript_id"), F.lit("g").alias("gene_id"), (F.col("s_suppkey") % 50).alias("tx_start"), F.col("s_nationkey").alias("tx_end"))
    return classify.nearest(reads, known).select("l_orderkey", "l_linenumber", F.col("transcript_id").alias("tx"), "off")


@query("""with c as (select l_partkey, p_partkey - l_partkey d, p_size, p_partkey, l_orderkey, l_linenumber from lineitem join part on p_partkey between l_partkey and l_partkey + 6),
m as (select *, min(d % 5) over w b from c window w as (partition by l_orderkey, l_linenumber)),
x as (select * from m where d % 5 <= b + 1), y as (select *, max(p_size) over (partition by l_orderkey, l_linenumber) t from x), z as (select * from y where p_size >= t - 10)
select l_orderkey, l_linenumber, min(p_partkey) chosen from z group by 1, 2""")
def staged_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.explode(F.sequence(F.col("l_partkey"), F.col("l_partkey") + 6)).alias("p_partkey"))
    c = li.join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").withColumn("d", (F.col("p_partkey") - F.col("l_partkey")) % 5)
    return ranges.staged(c, ["l_orderkey", "l_linenumber"], [("d", "min", 1), ("p_size", "max", 10)], ["p_partkey"]).select("l_orderkey", "l_linenumber", F.col("p_partkey").alias("chosen"))


@query(f"""with {CLUSTERS}, h as (select q.*, n_reads >= 2 and least_trusted > 2 high from q join l on q.chrom = l.chrom and q.chain = l.chain)
select chrom, chain, case when high and not exists (select 1 from h k where k.chrom = h.chrom and k.high and k.n > h.n and contains(',' || k.chain || ',', ',' || h.chain || ',')) then 'high' else 'low' end confidence from h""")
def support_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = classify.clusters(chain_reads(spark, sf_dir)).withColumn("category", F.lit("other"))
    return classify.confidence(seen).select("chrom", I.render(F.col("chain")).alias("chain"), "confidence")


CIGAR_SQL = "cast(l_quantity as int) || 'M' || (l_partkey % 30 + 1) || 'N' || l_linenumber || 'I' || (l_suppkey % 20 + 1) || 'M2D' || l_linenumber || 'M3S'"


def cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda c: c.cast("string")
    text = F.concat(t(F.col("l_quantity").cast("int")), F.lit("M"), t(F.col("l_partkey") % 30 + 1), F.lit("N"), t(F.col("l_linenumber")), F.lit("I"), t(F.col("l_suppkey") % 20 + 1), F.lit("M2D"), t(F.col("l_linenumber")), F.lit("M3S"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("pos"), text.alias("cigar"))


@query(f"""with c as (select l_orderkey, l_linenumber, {CIGAR_SQL} cigar, l_partkey p, cast(l_quantity as int) q, l_partkey % 30 + 1 n, l_suppkey % 20 + 1 m, l_linenumber k from lineitem)
select l_orderkey, l_linenumber, cigar, p || '-' || (p + q - 1) || ',' || (p + q + n) || '-' || (p + q + n + m - 1) || ',' || (p + q + n + m + 2) || '-' || (p + q + n + m + k + 1) blocks, q + k + m + k + 3 counted,
case when n > 18 then (p + q) || '-' || (p + q + n - 1) else '' end chain from c""")
def cigar_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import reads

    out = reads.spliced(reads.measured(cigars(spark, sf_dir).withColumn("flag", F.lit(0))))
    return out.select("l_orderkey", "l_linenumber", "cigar", I.render(F.col("blocks")).alias("blocks"), "counted", I.render(F.col("chain")).alias("chain"))


@query("""with b as (select p_partkey, translate(upper(p_name), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ ', 'ACGTACGTACGTACGTACGTACGTACN') q from part)
select p_partkey, translate(regexp_replace(reverse(q), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA') revcomp,
case when left(q, 2) || right(q, 2) in ('GTAG', 'GCAG', 'ATAC') then 1 when left(q, 2) || right(q, 2) in ('CTAC', 'CTGC', 'GTAT') then 2 else 0 end code from b""")
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.translate(F.upper("p_name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ ", "ACGTACGTACGTACGTACGTACGTACN")
    b = table(spark, sf_dir, "part").select("p_partkey", q.alias("q"))
    return b.select("p_partkey", S.reverse_complement(F.col("q")).alias("revcomp"), S.signal_code(F.substring("q", 1, 2), F.expr("right(q, 2)")).cast("int").alias("code"))


_CODE = "array_to_string([substr('ACGT', 1 + cast(({k} // cast(pow(4, i) as bigint)) % 4 as int), 1) for i in range(0, 8)], '')"


def code8(k: F.Column) -> F.Column:
    """Eight letters for a number."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(F.lit("ACGT"), ((F.floor(k / F.pow(F.lit(4.0), i)) % 4) + 1).cast("int"), F.lit(1))), "")


@query(f"""with r as (select c_nationkey g, c_custkey id, {_CODE.format(k='(c_custkey * 7919 % 65536)')} u from customer)
select a.g, a.id a, b.id b, levenshtein(a.u, b.u) distance from r a join r b on a.g = b.g and a.id < b.id where levenshtein(a.u, b.u) <= 1""")
def umi_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("id"), code8(F.col("c_custkey") * 7919 % 65536).alias("u"))
    return umi.near_pairs(r, ["g"], "id", "u", most=1)


@query(f"""with recursive r as (select c_nationkey g, c_custkey id, {_CODE.format(k='(c_custkey * 7919 % 65536)')} u, row_number() over (partition by c_nationkey order by c_custkey) k from customer),
t as (select g, 0 k, []::varchar[] kept, []::bigint[] ids from (select distinct g from r)
union all select t.g, t.k + 1, case when free then list_append(kept, u) else kept end, case when free then list_append(ids, id) else ids end
from t join r on r.g = t.g and r.k = t.k + 1, lateral (select len(list_filter(kept, lambda x: levenshtein(x, r.u) <= 1)) = 0 free) f)
select r.g, r.id, r.u from r join (select g, max_by(ids, k) ids from t group by 1) e on e.g = r.g and list_contains(e.ids, r.id)""")
def umi_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("id"), code8(F.col("c_custkey") * 7919 % 65536).alias("u"))
    return umi.greedy(r, ["g"], "id", "u", 1)


@query(f"""with s as (select p_partkey id, {_CODE.format(k='(p_partkey * 31 % 65536)')} q from part), b as (select {_CODE.format(k='(s_suppkey * 977 % 65536)')} barcode from supplier),
x as (select distinct id, substr(q, i, 4) m from (select id, q, unnest(range(1, 6)) i from s)), y as (select distinct barcode, substr(barcode, i, 4) m from (select barcode, unnest(range(1, 6)) i from b)),
v as (select id, barcode, count(*) votes from x join y using (m) group by 1, 2), r as (select *, row_number() over (partition by id order by votes desc, barcode) rank from v)
select id, barcode, votes, rank from r where rank <= 3""")
def kmer_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), code8(F.col("p_partkey") * 31 % 65536).alias("seq"))
    known = table(spark, sf_dir, "supplier").select(code8(F.col("s_suppkey") * 977 % 65536).alias("barcode"))
    return demux.kmer_candidates(seen, known, 4, 3)


def nation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, sf_dir, "nation").select(F.lit("n").alias("chrom"), F.lit(0).alias("group_id"), F.col("n_nationkey").alias("node"), (F.col("n_nationkey") % 3 == 0).alias("known"))
    count = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.count(F.lit(1)).alias("count"))
    nodes = n.join(count, "node", "left").fillna(0, ["count"])
    a, b = n.select("chrom", "group_id", F.col("node").alias("a")), n.select("chrom", F.col("node").alias("b"))
    pairs = a.join(b, "chrom").filter("a < b and (a * 5 + b * 7) % 4 = 0")
    return nodes, pairs


NATION_CLIQUES = """with recursive e as (select a.n_nationkey a, b.n_nationkey b from nation a join nation b on a.n_nationkey < b.n_nationkey where (a.n_nationkey * 5 + b.n_nationkey * 7) % 4 = 0),
s as (select a, b from e union all select b, a from e),
c as (select [n_nationkey] m from nation union all select list_append(m, n_nationkey) from c join nation on n_nationkey > m[len(m)] where (select count(*) from s where s.a = n_nationkey and list_contains(m, s.b)) = len(m)),
x as (select m from c where not exists (select 1 from nation where not list_contains(m, n_nationkey) and (select count(*) from s where s.a = n_nationkey and list_contains(m, s.b)) = len(m)))"""


@query(f"{NATION_CLIQUES}\nselect array_to_string(m, ',') clique from x")
def cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cliques(*nation_graph(spark, sf_dir)).groupBy("clique").agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("c")).select(F.col("c").alias("clique"))


@query(f"""{NATION_CLIQUES}, i as (select row_number() over () clique, m from x), u as (select clique, unnest(m) node from i),
w as (select clique, node, node % 3 = 0 known, (select count(*) from customer where c_nationkey = node) n from u),
b as (select clique, min(case when known then n end) bar, max(n) top, count(*) size, count(*) filter (known) ks from w group by 1),
v as (select w.*, case when ks > 0 and ks < size then known or (bar <> 0 and n >= bar) when ks > 0 then n > 0 when size = 1 then n > 0 else n = top end good from w join b using (clique))
select node, known, n count, min(good) verdict from v group by 1, 2, 3""")
def clique_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, pairs = nation_graph(spark, sf_dir)
    return graph.verdict(graph.cliques(nodes, pairs), nodes).select("node", "known", "count", "verdict")


@query("select l_returnflag gene_id, l_linestatus sample, sum(l_quantity) count from lineitem where l_returnflag <> 'R' group by 1, 2")
def gene_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("sample"), F.when(F.col("l_returnflag") == "R", "NA").otherwise(F.col("l_returnflag")).alias("gene_id"), F.col("l_quantity").alias("count"), "l_linenumber")
    return quantify.gene_counts(li.filter("l_linenumber > 2"), li.filter("l_linenumber <= 2"), ["sample"]).select("gene_id", "sample", "count")


@query("select l_partkey || '' transcript_id, min(l_returnflag) gene_id, case when sum(l_quantity) >= 500 then sum(l_quantity) else 0 end count from lineitem group by l_partkey")
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("transcript_id"), F.col("l_returnflag").alias("gene_id"), F.col("l_quantity").alias("count"))
    return sinks.thresholded(quantify.compact(li, []), 500)


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("select c_nationkey, " + ", ".join(f"count(*) filter (c_mktsegment = '{s}') {s}" for s in _SEGMENTS) + " from customer group by 1")
def count_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("one", F.lit(1).cast("long"))
    return sinks.pivot_counts(c, ["c_nationkey"], "c_mktsegment", "one", _SEGMENTS)


@query("""with c as (select c_mktsegment r, c_nationkey k, count(*) v from customer group by 1, 2), a as (select r, row_number() over (order by r) i from (select distinct r from c)), b as (select k, row_number() over (order by k) j from (select distinct k from c))
select i, j, v value from c join a using (r) join b using (k)""")
def mtx_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("one", F.lit(1).cast("long"))
    return sinks.triplets(c, "c_mktsegment", "c_nationkey", "one")[0]


@query("with c as (select o_custkey, count(*) n from orders group by 1) select n, count(*) barcodes from c group by 1")
def barcode_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.barcode_histogram(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "barcode"))


@query("""with t as (select l_orderkey o, l_suppkey % 3 || '' c, l_linenumber n, l_linenumber * 100 s, l_linenumber * 100 + cast(l_quantity as int) e, case when l_orderkey % 2 = 0 then '+' else '-' end d, case when l_orderkey % 3 = 0 then 'annotated_isoform' else 'novel_isoform' end src from lineitem),
g as (select o, d, src, min(s) s, max(e) e from t group by 1, 2, 3), x as (select distinct o, s, e, d, src from t), y as (select *, row_number() over (partition by o order by s, e) - 1 k from x),
z as (select o, 0 no, 'c1' || chr(9) || src || chr(9) || 'transcript' || chr(9) || s || chr(9) || e || chr(9) || '.' || chr(9) || d || chr(9) || '.' || chr(9) || 'gene_id "g' || o % 5 || '"; transcript_id "' || o || '";' line from g
union all select o, k + 1, 'c1' || chr(9) || src || chr(9) || 'exon' || chr(9) || s || chr(9) || e || chr(9) || '.' || chr(9) || d || chr(9) || '.' || chr(9) || 'gene_id "g' || o % 5 || '"; transcript_id "' || o || '"; exon_number "' || k || '";' from y)
select o || '' transcript_id, no, line from z""")
def gtf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "lineitem"))


def lines_of(exons: DataFrame) -> DataFrame:
    s, o = F.col("l_linenumber") * 100, F.col("l_orderkey")
    t = exons.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct(s.alias("s"), (s + F.col("l_quantity").cast("int")).alias("e")))).alias("exons"))
    t = t.select(F.lit("c1").alias("chrom"), F.concat(F.lit("g"), (o % 5).cast("string")).alias("gene_id"), o.cast("string").alias("transcript_id"), F.when(o % 2 == 0, "+").otherwise("-").alias("strand"), (o % 3 == 0).alias("known"), "exons")
    return sinks.gtf_lines(t).select("transcript_id", "no", "line")


@query("""select l_orderkey || '' read_id, string_agg(distinct s_suppkey || '', ',' order by s_suppkey || '') transcript_id from lineitem join supplier on s_nationkey = l_partkey % 25 group by 1""")
def trace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are reads, and compatible with the suppliers of their lines' nations."""
    reads = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("read_id"), (F.col("l_partkey") % 25).cast("int").alias("k")).distinct()
    compat = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").cast("string").alias("isoform"))
    return sinks.trace_rows(reads, compat, ["k"], ["read_id"])


@query("select p_partkey, levenshtein(p_name, p_type) distance from part")
def align_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("pattern"), F.col("p_type").alias("text"))
    return align.with_cost(t, "global", "distance").select("p_partkey", "distance")


@query("select p_partkey, cast(levenshtein(p_name, p_type) as bigint) score, cast(levenshtein(p_name, p_type) as bigint) edits from part")
def align_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance, and the edits of the path that was found."""
    t = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("pattern"), F.col("p_type").alias("text"))
    return paths.with_path(dealt(t), paths.EDIT).select("p_partkey", "score", align.cigar_cost(F.col("cigar"), 1, 0, 1).alias("edits"))


@query("select p_partkey, case when levenshtein(p_name, p_type) <= 15 then cast(levenshtein(p_name, p_type) as bigint) end distance from part")
def align_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("pattern"), F.col("p_type").alias("text"))
    return align.with_cost(t, "global", "distance", most=15).select("p_partkey", "distance")


# a row of the matrix at a time: h the best costs, d those that end in a gap of the text; a gap of n letters costs 6 + 2 n
AFFINE_SQL = """with recursive t as (
  select p_partkey, p_name a, p_type b, 0 k, [case when q = 0 then 0 else 6 + 2 * q end for q in range(0, length(p_type) + 1)] h, [1000000 for q in range(0, length(p_type) + 1)] d from part
  union all
  select p_partkey, a, b, k, [list_min([g[r + 1] + case when r = q then 0 else 6 + 2 * (q - r) end for r in range(0, q + 1)]) for q in range(0, length(b) + 1)], d from (
    select p_partkey, a, b, k, d, [least(d[q + 1], case when q = 0 then 1000000 else h[q] + case when substr(a, cast(k as int), 1) = substr(b, cast(q as int), 1) then 0 else 4 end end) for q in range(0, length(b) + 1)] g from (
      select p_partkey, a, b, k + 1 k, h, [least(d[q + 1] + 2, h[q + 1] + 8) for q in range(0, length(b) + 1)] d from t where k < length(a))))
select p_partkey, -h[length(b) + 1] score from t where k = length(a)"""


@query(AFFINE_SQL)
def align_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("pattern"), F.col("p_type").alias("text"))
    return align.with_cost(t, "affine").select("p_partkey", "score")


@query("""with t as (select p_partkey, p_brand b, p_name n from part), c as (select p_partkey, b, substr(n, i, k) x from t, lateral (select unnest(range(1, length(n) + 1)) i) u, lateral (select unnest(range(0, length(n) - i + 2)) k) w)
select p_partkey, min(levenshtein(b, x)) distance from c group by 1""")
def align_infix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("pattern"), F.col("p_name").alias("text"))
    return align.with_cost(t, "infix", "distance").select("p_partkey", "distance")


@query("""with n as (select l_orderkey, l_linenumber, l_extendedprice, l_suppkey from lineitem)
select l_orderkey, count(*) n, max(l_extendedprice) best from n where l_suppkey in (select s_suppkey from supplier where s_acctbal > 0) group by 1""")
def whitelist_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return demux.listed(table(spark, sf_dir, "lineitem"), known, "l_suppkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("best"))


def sam_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as alignments: of two lines of an order at one place the longer stays; some are secondary, some have a wrong length."""
    n = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("read_id"), F.lit(0).alias("sample"), (F.col("l_suppkey") % 10).cast("string").alias("chrom"), F.lit(0).alias("group_id"), F.when(F.col("l_linenumber") == 7, 256).otherwise(0).alias("flag"),
        (F.col("l_partkey") % 60).cast("int").alias("mapq"), F.concat(n.cast("string"), F.lit("M"), F.col("l_linenumber").cast("string"), F.lit("S")).alias("cigar"), (n + F.when(F.col("l_suppkey") % 13 == 0, 0).otherwise(F.col("l_linenumber"))).alias("seq_len"), F.col("l_partkey").alias("read_start"),
    )


SAM = """r as (select l_orderkey read_id, l_suppkey % 10 || '' chrom, case when l_linenumber = 7 then 256 else 0 end flag, l_partkey % 60 mapq, cast(l_quantity as int) || 'M' || l_linenumber || 'S' cigar,
cast(l_quantity as int) + l_linenumber counted, cast(l_quantity as int) + case when l_suppkey % 13 = 0 then 0 else l_linenumber end seq_len, l_partkey read_start from lineitem)"""


@query(f"with {SAM}, g as (select *, mapq >= 20 and flag & 2304 = 0 ok from r) select count(*) seen, count(*) filter (not ok) low_quality, count(*) filter (ok and counted <> seq_len) inconsistent from g")
def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import reads

    return reads.survey(sam_rows(spark, sf_dir), Params(min_mapq=20))


@query(f"""with {SAM}, u as (select * from r where mapq >= 20 and flag & 2304 = 0 and counted = seq_len),
o as (select *, row_number() over (partition by chrom, read_id order by seq_len desc, read_start, cigar) k from u) select chrom, read_id, cigar, seq_len, read_start from o where k = 1""")
def read_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import reads

    return reads.once(reads.usable(sam_rows(spark, sf_dir), Params(min_mapq=20))).select("chrom", "read_id", "cigar", "seq_len", "read_start")


@query(f"""with {CHAINS}, x as (select c.ok, -10 + 0 * c.ok s0, 600 e0 from c), b as (select ok, v, lead(v) over (partition by ok order by v) w, row_number() over (partition by ok order by v) k from v),
e as (select ok, s0 s, min(v) - 1 e from x join v using (ok) group by 1, 2 union all select ok, v + 51, coalesce(w - 1, 600) from b)
select ok, string_agg(s || '-' || e, ',' order by s) exons from e group by 1""")
def novel_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains(spark, sf_dir).select("ok", I.render(sinks.rebuilt_exons(F.col("chain"), F.lit(-10), F.lit(600))).alias("exons"))


@query("""with recursive g as (select distinct l_suppkey % 20 g from lineitem),
r as (select l_suppkey % 20 g, l_partkey % 30 row_id, count(*) n from lineitem group by 1, 2),
m as (select distinct g, row_id, n, iso from r, (select 7 d union all select 5) k, lateral (select row_id % d || '' iso)),
s as (select l_suppkey % 20 g, (l_linenumber - 1) || '' iso, count(*) c from lineitem group by 1, 2),
i as (select distinct g, iso from (select g, iso from m union all select g, iso from s)),
a as (select i.g, i.iso, coalesce(c, 0) seed, 1.0::double / count(*) over (partition by i.g) share from i left join s on s.g = i.g and s.iso = i.iso),
t as (
  select 0 k, g, iso, seed, share, 0.0::double expected, 1.0::double change from a
  union all
  select k, g, iso, seed, new, expected, sum(abs(new - share)) over (partition by g) from (
    select k, g, iso, seed, share, expected, (expected + seed) / sum(expected + seed) over (partition by g) new from (
      select t.k + 1 k, t.g, t.iso, t.seed, t.share, coalesce(y.e, 0) expected from t left join (
        select z.k, z.g, z.iso, sum(z.n * z.share / z.total) e from (select t.k, m.g, m.iso, m.n, t.share, sum(t.share) over (partition by t.k, m.g, m.row_id) total from m join t on t.g = m.g and t.iso = m.iso) z where z.total > 0 group by 1, 2, 3) y
      on y.k = t.k and y.g = t.g and y.iso = t.iso where t.k < 9 and t.change > 0.05))),
f as (select *, row_number() over (partition by g, iso order by k desc) o from t)
select g, iso isoform, round(seed + expected, 6) count from f where o = 1""")
def em_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    compat = li.groupBy((F.col("l_suppkey") % 20).alias("g"), (F.col("l_partkey") % 30).alias("row_id")).agg(F.count(F.lit(1)).alias("n"))
    compat = compat.withColumn("isoform", F.explode(F.array((F.col("row_id") % 7).cast("string"), (F.col("row_id") % 5).cast("string")))).distinct()
    seeds = li.groupBy((F.col("l_suppkey") % 20).alias("g"), (F.col("l_linenumber") - 1).cast("string").alias("isoform")).agg(F.count(F.lit(1)).alias("count"))
    return quantify.em(compat, seeds, ["g"]).withColumn("count", F.round("count", 6))


def generated(spark: SparkSession, sf_dir: str, copies: int = 1) -> DataFrame:
    """A pair of sequences of 100 letters with 5 % of edits for each part, times copies."""
    parts = table(spark, sf_dir, "part").select(F.explode(F.sequence(F.col("p_partkey") * copies, F.col("p_partkey") * copies + copies - 1)).alias("id"))
    return align.generated_pairs(parts, 100, 0.05)


@query()
def align_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.with_cost(generated(spark, sf_dir), "affine").select("id", "score")


def shifted_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the chain of the residues of its parts, junctions longer by a number of the order."""
    v, more = (F.col("l_partkey") % 5).cast("int") * 100, (F.floor(F.col("l_orderkey") / 10) % 9 * 4).cast("int")
    j = F.struct(v.alias("s"), (v + 50 + more).alias("e"))
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ok")).agg(F.array_sort(F.collect_set(j)).alias("chain"))
    return c.withColumns({"chrom": (F.col("ok") % 10).cast("string"), "group_id": F.lit(0)})


SHIFTED = """v as (select distinct l_orderkey ok, cast(l_partkey % 5 as int) * 100 v, cast(l_partkey % 5 as int) * 100 + 50 + cast(l_orderkey // 10 % 9 as int) * 4 e from lineitem),
c as (select ok, cast(ok % 10 as varchar) chrom, string_agg(v || '-' || e, ',' order by v) chain, list({'v': v, 'e': e} order by v) j, count(*) n from v group by 1, 2)"""


@query(f"""with {SHIFTED}, k as (select chrom, ok || '' t, chain, j, n, ok % 13 seed from c where ok % 7 = 0), q as (select chrom, chain, any_value(j) j, any_value(n) n from c where ok % 7 <> 0 group by 1, 2),
m as (select q.chrom, q.chain, t, seed, (select sum(abs(x.u.e - y.u.e)) from (select unnest(q.j) u) x, (select unnest(k.j) u) y where x.u.v = y.u.v) d from q join k on q.chrom = k.chrom and q.n = k.n),
r as (select *, row_number() over (partition by chrom, chain order by seed desc, d, t) o from m where d between 1 and 59)
select chrom, chain, t transcript_id, cast(d as bigint) distance from r where o = 1""")
def near_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = shifted_chains(spark, sf_dir)
    known = c.filter("ok % 7 = 0").select("chrom", F.col("ok").cast("string").alias("transcript_id"), F.lit("g").alias("gene_id"), "chain")
    seeds = c.filter("ok % 7 = 0").select("chrom", "group_id", F.col("ok").cast("string").alias("transcript_id"), (F.col("ok") % 13).alias("count"))
    seen = c.filter("ok % 7 <> 0").select("chrom", "group_id", "chain").distinct().withColumn("confidence", F.lit("low"))
    return classify.near_full(seen, known, seeds).select("chrom", I.render(F.col("chain")).alias("chain"), "transcript_id", "distance")


NODES = f"{SHIFTED}, n as (select chrom, chain node, any_value(j) j, min(ok) % 3 = 0 known, count(*) count from c group by 1, 2)"


def chain_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = shifted_chains(spark, sf_dir).groupBy("chrom", "group_id", "chain").agg(F.count(F.lit(1)).alias("count"), F.min("ok").alias("ok"))
    return n.select("chrom", "group_id", I.render(F.col("chain")).alias("node"), (F.col("ok") % 3 == 0).alias("known"), "chain", "count")


@query(f"""with {NODES}, m as (select a.chrom, a.node a, b.node b, (select sum(abs(x.u.e - y.u.e)) from (select unnest(a.j) u) x, (select unnest(b.j) u) y where x.u.v = y.u.v) d from n a join n b on a.chrom = b.chrom and a.node < b.node where not (a.known and b.known))
select chrom, a, b, cast(d as bigint) distance from m where d between 1 and 60""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(chain_nodes(spark, sf_dir)).select("chrom", "a", "b", "distance")


def part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts are nodes, linked where they have one size and keys within 200; counts are those of their lines."""
    n = table(spark, sf_dir, "part").select(F.lit("p").alias("chrom"), F.col("p_size").alias("group_id"), F.col("p_partkey").alias("node"), (F.col("p_partkey") % 3 == 0).alias("known"))
    count = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.count(F.lit(1)).alias("count"))
    nodes = n.join(count, "node", "left").fillna(0, ["count"])
    a = n.select("chrom", "group_id", F.col("node").alias("a"), (F.col("node") + 1).alias("s"), (F.col("node") + 200).alias("e"))
    b = n.select("chrom", "group_id", F.col("node").alias("b"), F.col("node").alias("bs"), F.col("node").alias("be"))
    return nodes, ranges.range_join(a, b, ["chrom", "group_id"], ("s", "e"), ("bs", "be"), 1 << 8).select("chrom", "group_id", "a", "b")


# nodes in a row within 200: a maximal clique is a longest run, so one that no run from an earlier node reaches as far as
PART_CLIQUES = """p as (select p_size g, p_partkey k from part), r as (select a.g, a.k, max(b.k) reach from p a join p b on a.g = b.g and b.k between a.k and a.k + 200 group by 1, 2),
l as (select *, max(reach) over (partition by g order by k rows between unbounded preceding and 1 preceding) before from r), s as (select g, k, reach, row_number() over (partition by g order by k) - 1 clique from l where before is null or reach > before),
m as (select s.g, s.clique, p.k node from s join p on p.g = s.g and p.k between s.k and s.reach)"""


@query(f"with {PART_CLIQUES} select g group_id, clique, node from m")
def cliques_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cliques(*part_graph(spark, sf_dir)).select("group_id", "clique", "node")


@query(f"""with {PART_CLIQUES}, c as (select l_partkey k, count(*) n from lineitem group by 1), x as (select m.*, node % 3 = 0 known, coalesce(n, 0) n from m left join c on c.k = node),
b as (select g, clique, min(case when known then n end) bar, max(n) top, count(*) size, count(*) filter (known) ks from x group by 1, 2),
v as (select x.*, case when ks > 0 and ks < size then known or (bar <> 0 and n >= bar) when ks > 0 then n > 0 when size = 1 then n > 0 else n = top end good from x join b on b.g = x.g and b.clique = x.clique)
select g group_id, node, n count, min(good) verdict from v group by 1, 2, 3""")
def verdict_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, pairs = part_graph(spark, sf_dir)
    return graph.verdict(graph.cliques(nodes, pairs), nodes).select("group_id", "node", "count", "verdict")


EXONS = """x as (select p_partkey // 3 g, p_partkey t, 40 * p_partkey + 5 s, 40 * p_partkey + 25 e from part union all select p_partkey // 3, p_partkey, 40 * p_partkey + 35, 40 * p_partkey + 60 from part where p_partkey % 2 = 1),
t as (select g, t, min(s) s, max(e) e, count(*) n, string_agg(s || '-' || e, ',' order by s) exons, case when count(*) = 2 then (min(e) + 1) || '-' || (max(s) - 1) else '' end chain from x group by 1, 2),
f as (select *, max(e) over (partition by g order by s, e rows between unbounded preceding and 1 preceding) m from x), h as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by g order by s, e rows unbounded preceding) b from f),
u as (select g, b, min(s) s, max(e) e from h group by 1, 2), y as (select g, count(*) n, string_agg(s || '-' || e, ',' order by s) merged from u group by 1)"""


def part_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are transcripts of one exon, or of two; three parts are a gene."""
    k = F.col("p_partkey")
    span = lambda s, e: F.struct((k * 40 + s).cast("int").alias("s"), (k * 40 + e).cast("int").alias("e"))
    x = F.explode(F.when(k % 2 == 1, F.array(span(5, 25), span(35, 60))).otherwise(F.array(span(5, 25))))
    return table(spark, sf_dir, "part").select(F.lit("c").alias("chrom"), F.floor(k / 3).cast("string").alias("gene_id"), k.cast("string").alias("transcript_id"), F.lit("+").alias("strand"), x.alias("x")).select("*", "x.s", "x.e").drop("x")


@query(f"with {EXONS} select t || '' transcript_id, g || '' gene_id, s start, e \"end\", n n_exons, exons, chain from t")
def known_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.transcripts(part_exons(spark, sf_dir)).select("transcript_id", "gene_id", "start", "end", F.col("n_exons").cast("long").alias("n_exons"), I.render(F.col("exons")).alias("exons"), I.render(F.col("chain")).alias("chain"))


@query(f"with {EXONS}, z as (select g, min(s) s, max(e) e, count(*) n_tx from t group by 1) select z.g || '' gene_id, z.s start, z.e \"end\", n_tx, merged from z join y on y.g = z.g")
def known_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.genes(annotation.transcripts(part_exons(spark, sf_dir))).select("gene_id", "start", "end", "n_tx", I.render(F.col("merged_exons")).alias("merged"))


def lone_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as reads without junctions."""
    s = F.col("l_partkey") * 40 + F.col("l_linenumber") * 4
    return table(spark, sf_dir, "lineitem").select(F.lit(0).alias("sample"), F.lit("c").alias("chrom"), F.lit(0).alias("group_id"), F.monotonically_increasing_id().alias("read_id"), "l_orderkey", "l_linenumber", "l_partkey", s.cast("int").alias("read_start"), (s + F.col("l_quantity").cast("int")).cast("int").alias("read_end"))


# each read against the genes around its part, by the stages of the cascade
LONE = f"""{EXONS}, r as (select row_number() over () i, l_orderkey, l_linenumber, l_partkey, 40 * l_partkey + 4 * l_linenumber rs, 40 * l_partkey + 4 * l_linenumber + cast(l_quantity as int) re from lineitem),
a as (select i, l_orderkey, l_linenumber, l_partkey, rs, re, u.g, min(least(abs(u.s - rs), abs(u.e - re))) d, sum(greatest(0, least(u.e, re) - greatest(u.s, rs) + 1)) x from r, unnest([-1, 0, 1, 2]) o(o) join u on u.g = r.l_partkey // 3 + o.o group by all),
a1 as (select *, min(d) over (partition by i) best from a where x > 0), a2 as (select *, max(x) over (partition by i) most from a1 where d <= best + 10), a3 as (select a2.*, y.n = 1 alone from a2 join y on y.g = a2.g where x >= most - 10),
a4 as (select *, count(*) filter (alone) over (partition by i) ones from a3), ag as (select *, row_number() over (partition by i order by case when alone and ones = 1 then 0 else 1 end, g || '') o from a4)"""


@query(f"with {LONE} select l_orderkey, l_linenumber, l_partkey, re read_end, g || '' gene_id from ag where o = 1")
def single_exon_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = annotation.genes(annotation.transcripts(part_exons(spark, sf_dir)))
    return single_exon.to_genes(lone_reads(spark, sf_dir), genes, 1 << 8).select("l_orderkey", "l_linenumber", "l_partkey", "read_end", "gene_id")


@query(f"""with {LONE}, b as (select ag.i, ag.l_orderkey, ag.l_linenumber, ag.l_partkey, ag.rs, ag.re, ag.g, t.t, t.n from ag join t on t.g = ag.g where o = 1),
b1 as (select b.*, count(*) over (partition by i) cnt from b), b2 as (select b1.*, min(least(abs(x.s - rs), abs(x.e - re))) d, sum(greatest(0, least(x.e, re) - greatest(x.s, rs) + 1)) m from b1 join x on x.t = b1.t group by all),
b3 as (select *, min(d) over (partition by i) best from b2 where cnt = 1 or m > 0), b4 as (select *, max(m) over (partition by i) most from b3 where d <= best + 10), b5 as (select *, count(*) filter (n = 1) over (partition by i) ones from b4 where m >= most - 10),
b6 as (select *, row_number() over (partition by i order by case when n = 1 and ones = 1 then 0 else 1 end, -(t % 4), t || '') k from b5)
select l_orderkey, l_linenumber, l_partkey, re read_end, g || '' gene_id, t || '' transcript_id from b6 where k = 1""")
def single_exon_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = annotation.transcripts(part_exons(spark, sf_dir))
    seeds = tx.select("chrom", "transcript_id", (F.col("transcript_id").cast("long") % 4).alias("count"))
    lone = single_exon.to_genes(lone_reads(spark, sf_dir), annotation.genes(tx), 1 << 8)
    return single_exon.to_transcripts(lone, tx, seeds).select("l_orderkey", "l_linenumber", "l_partkey", "read_end", "gene_id", "transcript_id")


@query(f"""with {SHIFTED}, k as (select chrom, ok || '' iso, j, n from c where ok % 7 = 0), q as (select chrom, chain, any_value(j) j, any_value(n) n from c where ok % 7 <> 0 group by 1, 2),
m as (select q.chrom, q.chain, k.iso, q.n / k.n ratio, count(*) over (partition by q.chrom, q.chain) cnt, max(q.n / k.n) over (partition by q.chrom, q.chain) best from q join k on q.chrom = k.chrom and q.n < k.n
where list_position(k.j, q.j[1]) > 0 and list_position(k.j, q.j[q.n]) - list_position(k.j, q.j[1]) = q.n - 1)
select chrom, chain, iso isoform from m where cnt = 1 or best < 0.5 or ratio = best""")
def compat_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = shifted_chains(spark, sf_dir)
    reported = c.filter("ok % 7 = 0").select("chrom", "group_id", F.col("ok").cast("string").alias("isoform"), "chain")
    return compat.partial_rows(c.filter("ok % 7 <> 0").select("chrom", "group_id", "chain").distinct(), reported).select("chrom", F.col("row_id").alias("chain"), "isoform")


@query(f"""with {SHIFTED}, k as (select chrom, ok || '' iso, j from c where ok % 7 = 0), q as (select chrom, chain, any_value(j) j from c where ok % 7 <> 0 group by 1, 2),
m as (select q.chrom, q.chain, k.iso, list_sum([x.e - x.v + 1 for x in q.j]) + list_sum([x.e - x.v + 1 for x in k.j]) - 2 * coalesce((select sum(least(x.u.e, y.u.e) - x.u.v + 1) from (select unnest(q.j) u) x, (select unnest(k.j) u) y where x.u.v = y.u.v), 0) d from q join k on q.chrom = k.chrom),
r as (select *, row_number() over (partition by chrom, chain order by d, iso) o from m) select chrom, chain, iso isoform from r where o = 1""")
def compat_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected nodes without neighbours go to the nearest isoform."""
    c = shifted_chains(spark, sf_dir)
    reported = c.filter("ok % 7 = 0").select("chrom", "group_id", F.col("ok").cast("string").alias("isoform"), "chain")
    rejected = c.filter("ok % 7 <> 0").select("chrom", "group_id", "chain").distinct().withColumn("node", I.render(F.col("chain")))
    return compat.least_apart(rejected.select("chrom", "group_id", "node", "chain"), reported).select("chrom", F.col("node").alias("chain"), "isoform")


@query("""select l_orderkey, l_linenumber, case when l_orderkey % 2 = 0 then 1 else 0 end strand, l_partkey read_start, l_partkey + cast(l_quantity as int) + l_partkey % 30 + l_suppkey % 20 + l_linenumber + 3 read_end,
case when l_partkey % 30 + 1 > 18 then cast(cast(l_quantity as int) >= 12 and l_suppkey % 20 + 1 >= 11 as varchar) else '' end anchored from lineitem""")
def strand_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import reads

    out = reads.spliced(cigars(spark, sf_dir).withColumn("flag", F.when(F.col("l_orderkey") % 2 == 0, 0).otherwise(16)))
    return out.select("l_orderkey", "l_linenumber", "strand", "read_start", "read_end", F.array_join(F.transform("anchored", lambda x: x.cast("string")), ",").alias("anchored"))


# a line is a novel isoform of two junctions near its part; the introns of parts of two exons are known
NOVEL = f"""{EXONS}, w as (select g, min(s) gs, max(e) ge from t group by 1), k as (select distinct g, split_part(chain, '-', 1)::bigint ks, split_part(chain, '-', 2)::bigint ke from t where chain <> ''),
n as (select distinct l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || cast(l_quantity as int) node, l_partkey p, cast(l_quantity as int) q from lineitem),
j as (select node, p, 40 * p + 26 + q % 5 ms, 40 * p + 34 me from n union all select node, p, 40 * p + 66, 40 * p + 74 + q % 3 from n),
o as (select node, k.g, count(*) filter (ms = ks and me = ke) same, sum(least(me, ke) - greatest(ms, ks) + 1) shared from j join k on k.g between p // 3 - 1 and p // 3 + 1 and ms <= ke and ks <= me group by 1, 2),
i as (select node, w.g, 40 * p + 6 + q % 20 - gs l, ge - (40 * p + 80) r from n join w on w.g between p // 3 - 1 and p // 3 + 1 where gs < 40 * p + 6 + q % 20 and 40 * p + 80 < ge)"""
NOVEL_END = """ff as (select * from i qualify row_number() over (partition by node order by far, g || '') = 1)
select n.node, case when b.g is null then ff.g when w.gs < 40 * p + 6 + q % 20 and 40 * p + 80 < w.ge then b.g end || '' gene_id from n left join b on b.node = n.node left join w on w.g = b.g left join ff on ff.node = n.node"""


def novel_genes(spark: SparkSession, sf_dir: str, cells: bool) -> DataFrame:
    p, q = F.col("l_partkey"), F.col("l_quantity").cast("int")
    at = lambda a, b: F.struct((p * 40 + a).cast("int").alias("s"), (p * 40 + b).cast("int").alias("e"))
    node = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), p.cast("string"), q.cast("string"))
    novel = table(spark, sf_dir, "lineitem").select(F.lit("c").alias("chrom"), node.alias("node"), F.lit(False).alias("known"), F.array(at(26 + q % 5, 34), at(66, 74 + q % 3)).alias("chain"), F.lit(None).cast("string").alias("gene_id"), (p * 40 + 6 + q % 20).alias("begin"), (p * 40 + 80).alias("finish")).distinct()
    tx = annotation.transcripts(part_exons(spark, sf_dir))
    return annotation.with_gene(novel, annotation.genes(tx), tx, cells=cells, bin_width=1 << 8).select("node", "gene_id")


@query(f"with {NOVEL.replace('l, ge - (40 * p + 80) r', 'l, least(40 * p + 6 + q % 20 - gs, ge - (40 * p + 80)) far')}, b as (select * from o qualify row_number() over (partition by node order by shared desc, g || '') = 1), {NOVEL_END}")
def gene_of_novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novel_genes(spark, sf_dir, False)


@query(f"with {NOVEL.replace('l, ge - (40 * p + 80) r', 'l, greatest(40 * p + 6 + q % 20 - gs, ge - (40 * p + 80)) far')}, b as (select * from o where same > 0 qualify row_number() over (partition by node order by same desc, shared desc, g || '') = 1), {NOVEL_END}")
def gene_of_novel_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novel_genes(spark, sf_dir, True)


_CELL = f"{_CODE.format(k='((n_nationkey * 7919 + 13) % 65536)')} || {_CODE.format(k='((n_nationkey * 30977 + 5) % 65536)')}"


# customers are reads of their nation's barcode; some have a wrong letter in the barcode or the primer, half are the other strand
@query(f"""with b as (select n_nationkey, {_CELL} barcode from nation),
r as (select c_custkey, barcode true_one, case when c_custkey % 2 = 0 then overlay_at else barcode end raw, {_CODE.format(k='(c_custkey * 7919 % 65536)')} || 'ACGA' umi, c_custkey % 3 flank, {_CODE.format(k='(c_custkey * 31 % 65536)')} piece
from (select *, left(barcode, c_custkey % 16) || translate(substr(barcode, 1 + c_custkey % 16, 1), 'ACGT', 'CGTA') || substr(barcode, 2 + c_custkey % 16) overlay_at from customer join b on n_nationkey = c_nationkey)),
m as (select c_custkey, b.barcode, levenshtein(raw, b.barcode) d, umi, flank, piece from r, b where levenshtein(raw, b.barcode) <= 2),
o as (select *, min(d) over (partition by c_custkey) best from m), t as (select *, count(*) over (partition by c_custkey) ties from o where d = best)
select c_custkey || '' read_id, barcode, umi, d barcode_edits, case flank when 0 then 1 else 0 end flank_edits, case when c_custkey % 5 < 2 then '-' else '+' end strand, 'GA' || piece || 'GGA' seq from t where ties = 1""")
def demultiplexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("n_nationkey").cast("long")
    cells = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(code8((n * 7919 + 13) % 65536), code8((n * 30977 + 5) % 65536)).alias("barcode"))
    at = (k % 16).cast("int")
    wrong = F.concat(F.col("barcode").substr(F.lit(1), at), F.translate(F.col("barcode").substr(at + 1, F.lit(1)), "ACGT", "CGTA"), F.col("barcode").substr(at + 2, F.lit(16)))
    primer = demux.STRUCTURES["visium"].parts[0][1]
    seq = F.concat(
        code8(k * 977 % 65536), F.when(k % 3 == 0, primer[:5] + "T" + primer[6:]).otherwise(primer), F.when(k % 2 == 0, wrong).otherwise(F.col("barcode")),
        code8(k * 7919 % 65536), F.lit("ACGA" + "T" * 10 + "GA"), code8(k * 31 % 65536), F.lit("GGA"),
    )
    reads = table(spark, sf_dir, "customer").join(cells, "c_nationkey").select(k.cast("string").alias("read_id"), F.when(k % 5 < 2, S.reverse_complement(seq)).otherwise(seq).alias("seq"), F.lit(None).cast("string").alias("qual"))
    listed = [r.barcode for r in cells.select("barcode").collect()]  # the kit's list, of 25
    return demux.demultiplex(dealt(reads), "visium", listed).select("read_id", "barcode", "umi", "barcode_edits", "flank_edits", "strand", "seq")
