"""The whole analysis: alignments to isoforms, counts, trace and annotation, by sample and barcode."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..operators import annotation, classify, graph, quantify, single_exon, umi
from ..operators import compat as compat_rows
from ..operators import reads as R
from ..operators.annotation import with_gene as _with_gene
from ..params import Params
from ..sources import sinks, text

KEY = ["chrom", "group_id"]


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that later plans stay small and survive lost executors."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder and not df.sparkSession.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = folder or tempfile.mkdtemp(prefix="isoloom-")
    path = f"{folder.rstrip('/')}/isoforms-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Result:
    isoforms: DataFrame
    transcript_counts: DataFrame
    gene_counts: DataFrame
    trace: DataFrame
    annotation: DataFrame
    annotated: DataFrame


def analyse(alignments: DataFrame, sequence: DataFrame, exons: DataFrame, p: Params = Params(), chunk: int = text.CHUNK, samples: int | None = None) -> Result:
    """alignments as text.sam() gives them; by barcode if they have that column. samples: how many there are, if it is known."""
    split = ["sample", *([c for c in ("barcode",) if c in alignments.columns])]
    tx = annotation.transcripts(exons)
    known = tx.select("chrom", "gene_id", "transcript_id", "strand", "start", "end", "chain", "exons", "n_exons")
    reads = R.once(R.grouped(R.spliced(R.usable(alignments, p), p)))
    dedup = p.dedup_umi and "umi" in alignments.columns
    if dedup:  # spliced reads by chain; others by gene, once they have one
        spliced = reads.filter(F.size("chain") > 0).withColumn("__c", I.render(F.col("chain")))
        reads = umi.greedy(spliced, ["chrom", "group_id", "__c", "barcode"]).drop("__c").unionByName(reads.filter(F.size("chain") == 0))
    reads = settled(R.coded(reads, sequence, chunk))
    c = settled(classify.confidence(classify.classify(classify.clusters(reads), known), p))
    multi = reads.filter(F.size("chain") > 0)

    full = classify.nearest(multi, classify.full_matches(c.filter("category = 'FSM'"), known)).select(*split, *KEY, "read_id", "transcript_id", "gene_id").withColumn("category", F.lit("FSM"))
    seeds = full.groupBy(*KEY, "transcript_id").agg(F.count(F.lit(1)).alias("count"))
    near = classify.near_full(c, known, seeds, p)
    adopted = multi.join(near.select(*KEY, "chain", "transcript_id", "gene_id"), [*KEY, "chain"]).select(*split, *KEY, "read_id", "transcript_id", "gene_id").withColumn("category", F.lit("simFSM"))
    owned = settled(full.unionByName(adopted))
    seeds = owned.groupBy(*KEY, "transcript_id").agg(F.count(F.lit(1)).alias("count"))

    partial = classify.partial_matches(c.filter("category = 'ISM'"), known)
    k = owned.select(*KEY, "transcript_id").unionByName(partial.select(*KEY, "transcript_id")).distinct().join(known, [c0 for c0 in ("transcript_id", "chrom")])
    k = k.join(seeds, [*KEY, "transcript_id"], "left").select(*KEY, F.col("transcript_id").alias("node"), F.lit(True).alias("known"), "chain", F.coalesce("count", F.lit(0)).alias("count"), "gene_id", F.col("strand").alias("strand"), F.col("start").cast("int").alias("begin"), F.col("end").cast("int").alias("finish"), F.size("chain").alias("size"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("chain"))
    high = c.filter("confidence = 'high'").withColumn("__r", rank)
    novel = high.select(*KEY, F.concat_ws("-", "chrom", F.lit("novel"), F.col("group_id").cast("string"), F.col("__r").cast("string")).alias("node"), F.lit(False).alias("known"), "chain", F.col("n_reads").alias("count"), F.lit(None).cast("string").alias("gene_id"), F.col("sj_strand").alias("strand"), F.col("begin"), F.col("end").alias("finish"), F.size("chain").alias("size"))
    nodes = settled(k.unionByName(novel))
    pairs = settled(graph.edges(nodes, p))
    judged = settled(graph.verdict(graph.cliques(nodes, pairs), nodes))
    true = judged.filter("verdict").filter(F.col("known") | (F.col("chrom") != p.mitochondrion))
    true = settled(_with_gene(true, annotation.genes(tx), known, p, "barcode" in split))

    # compatibility: partial matches with reported isoforms, and rejected clusters with their reported neighbours
    reported = true.select(*KEY, F.col("node").alias("isoform"), "chain")
    ism = compat_rows.partial_rows(c.filter("category = 'ISM'"), reported).withColumn("category", F.lit("ISM"))
    false = judged.filter("not verdict and not known").select(*KEY, "node", "chain")
    simnovel = compat_rows.rejected_rows(false, pairs, reported).withColumn("category", F.lit("simNovel"))
    compat = settled(ism.unionByName(simnovel))
    per = multi.groupBy(*split, *KEY, "chain").agg(F.count(F.lit(1)).alias("n"))
    system = compat.join(per, [*KEY, "chain"]).select(*split, *KEY, "row_id", "isoform", "n")

    own_novel = multi.join(true.filter("not known").select(*KEY, "chain", F.col("node").alias("transcript_id"), "gene_id"), [*KEY, "chain"]).select(*split, *KEY, "read_id", "transcript_id", "gene_id").withColumn("category", F.lit("novel"))
    direct = owned.unionByName(own_novel).join(true.select(*KEY, F.col("node").alias("transcript_id")), [*KEY, "transcript_id"])
    seed = direct.groupBy(*split, *KEY, F.col("transcript_id").alias("isoform")).agg(F.count(F.lit(1)).alias("count"))
    absent = system.select(*split, *KEY, "isoform").distinct().join(seed, [*split, *KEY, "isoform"], "left_anti").withColumn("count", F.lit(0).cast("long"))
    counts = quantify.em(system, seed.unionByName(absent), [*split, *KEY], p).withColumnRenamed("isoform", "transcript_id").join(true.select(*KEY, F.col("node").alias("transcript_id"), "gene_id"), [*KEY, "transcript_id"])

    lone = single_exon.to_genes(reads.filter(F.size("chain") == 0), annotation.genes(tx), p=p)
    if dedup:
        lone = umi.greedy(lone, ["chrom", "group_id", "gene_id", "barcode"])
    lone = settled(single_exon.to_transcripts(lone, tx, seeds, p))
    single = lone.groupBy(*split, "gene_id").agg(F.count(F.lit(1)).cast("double").alias("count"))
    lone_tx = lone.groupBy(*split, *KEY, "transcript_id", "gene_id").agg(F.count(F.lit(1)).cast("double").alias("count"))
    final = quantify.compact(counts.select(*split, "transcript_id", "gene_id", "count").unionByName(lone_tx.select(*split, "transcript_id", "gene_id", "count")), split)
    rows = sinks.trace_rows(multi, compat, [*KEY, "chain"], [*split, *KEY, "read_id", "category"])
    trace = direct.select(*split, "read_id", "category", "transcript_id", "gene_id").unionByName(rows.select(*split, "read_id", "category", "transcript_id", F.lit(None).cast("string").alias("gene_id"))).unionByName(lone.select(*split, "read_id", F.lit("SE").alias("category"), "transcript_id", "gene_id"))

    exons_of = known.select("chrom", F.col("transcript_id").alias("node"), "exons")
    listed = true.join(exons_of, ["chrom", "node"], "left").withColumn("exons", F.when(F.col("known"), F.col("exons")).otherwise(sinks.rebuilt_exons(F.col("chain"), F.col("begin"), F.col("finish"))))
    listed = listed.select("chrom", "gene_id", F.col("node").alias("transcript_id"), F.coalesce("strand", F.lit(".")).alias("strand"), "known", "exons")
    only = lone.select("chrom", "transcript_id").distinct().join(listed.select("chrom", "transcript_id"), ["chrom", "transcript_id"], "left_anti").join(known, ["chrom", "transcript_id"]).select("chrom", "gene_id", "transcript_id", "strand", F.lit(True).alias("known"), "exons")
    return Result(true, sinks.thresholded(final, p.min_count, "barcode" in split, samples == 1 and "barcode" not in split), quantify.gene_counts(counts, single, split), trace, sinks.gtf_lines(listed.unionByName(only)), known)


def run(spark: SparkSession, sam_path: str, fasta_path: str, gtf_path: str, out: str, p: Params = Params(), cells: bool = False) -> Result:
    """Reads the inputs, analyses, and writes the annotation, the counts and the trace under out."""
    paths = text.inputs(spark, sam_path)
    alignments = text.sam(spark, paths, p.barcode_tag if cells else None, p.umi_tag if cells else None)
    r = analyse(alignments, text.fasta(spark, fasta_path), text.gtf(spark, gtf_path), p, samples=len(paths))
    r.annotation.orderBy("chrom", "transcript_id", "no").select("line").write.mode("overwrite").text(f"{out}/updated_annotations.gtf")
    tables = [("transcript", r.transcript_counts, ["transcript_id", "gene_id"]), ("gene", r.gene_counts, ["gene_id"])]
    for name, counts, ids in tables:
        if not cells:
            sinks.pivot_counts(counts, ids, "sample", "count").write.mode("overwrite").csv(f"{out}/counts_{name}", sep="\t", header=True)
        for k in range(len(paths) if cells else 0):  # a matrix for each file: a barcode of two files is two cells
            own = counts.filter(F.col("sample") == k)
            if name == "transcript":  # novel isoforms have no gene there
                known = r.isoforms.filter("known").select(F.col("node").alias("transcript_id")).unionByName(r.annotated.select("transcript_id")).distinct().withColumn("x", F.lit(True))
                own = own.join(known, "transcript_id", "left").withColumn("gene_id", F.when(F.col("x"), F.col("gene_id")).otherwise("NA")).drop("x")
            else:
                own = sinks.thresholded(own, p.min_count, True)
            sinks.pivot_counts(own, ids, "barcode", "count").write.mode("overwrite").csv(f"{out}/counts_{name}_{k}", sep="\t", header=True)
    r.trace.write.mode("overwrite").csv(f"{out}/compatible_isoform", sep="\t", header=True)
    spark.createDataFrame(list(enumerate(paths)), "sample int, path string").write.mode("overwrite").csv(f"{out}/file_explain", sep="\t")
    return r
