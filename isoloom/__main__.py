"""The command line: bulk, cells, demux, tags and sparse.

    python -m isoloom bulk -s reads.sam -f genome.fa -g genes.gtf -o out [-j -n -m -e -d -r]
    python -m isoloom cells ... [-u U8:Z: -b BC:Z: -k 1]
    python -m isoloom demux -r reads.fq -q visium -c barcodes.txt -w whitelist.txt -o out
    python -m isoloom tags -b possorted.bam [-f barcodes.txt] -o out
    python -m isoloom sparse -i counts_transcript_0 -g genes.gtf -o out -n 0

Threads are not an option: Spark's own configuration sets them. Files go through Spark's readers and writers.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import demux
from .params import Params
from .plans import isoforms
from .sources import bam, sinks, text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="isoloom")
    kinds = top.add_subparsers(dest="kind", required=True)
    d = Params()
    for kind in ("bulk", "cells"):
        p = kinds.add_parser(kind)
        p.add_argument("-s", "--sam", required=True, help="a SAM file, a list of them (.txt, .tsv) or a folder")
        p.add_argument("-f", "--fasta", required=True)
        p.add_argument("-g", "--gtf", required=True)
        p.add_argument("-o", "--output", required=True)
        p.add_argument("-j", "--min_intron", type=int, default=d.min_intron)
        p.add_argument("-n", "--support", type=int, default=d.support)
        p.add_argument("-m", "--mapq", type=int, default=d.min_mapq)
        p.add_argument("-e", "--single_exon_edge", type=int, default=500 if kind == "cells" else d.single_exon_edge)
        p.add_argument("-d", "--graph_distance", type=int, default=d.graph_distance)
        p.add_argument("-r", "--min_count", type=float, default=d.min_count)
        if kind == "cells":
            p.add_argument("-u", "--umi", default=d.umi_tag)
            p.add_argument("-b", "--barcode", default=d.barcode_tag)
            p.add_argument("-k", "--dedup_umi", type=int, choices=(0, 1), default=0)
    p = kinds.add_parser("demux")
    p.add_argument("-r", "--reads", required=True, help="FASTQ or FASTA")
    p.add_argument("-q", "--mode", default="visium", choices=sorted(demux.STRUCTURES))
    p.add_argument("-c", "--barcodes", help="a list of barcodes")
    p.add_argument("-w", "--whitelist", help="barcodes with their UMIs")
    for n in "xyz":
        p.add_argument(f"-{n}", help=f"a list of segments {n} (magicseq)")
    p.add_argument("-i", "--trim", type=int, choices=(0, 1), default=1)
    p.add_argument("-p", "--by_barcode", action="store_true", help="a folder for each barcode")
    p.add_argument("-o", "--output", required=True)
    p = kinds.add_parser("tags")
    p.add_argument("-b", "--bam", required=True, nargs="+", help="BAM files by their whole paths")
    p.add_argument("-f", "--filter", help="a list of barcodes")
    p.add_argument("-o", "--output", required=True)
    p = kinds.add_parser("sparse")
    p.add_argument("-i", "--input", required=True, help="a count matrix")
    p.add_argument("-g", "--gtf", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-n", "--number", type=int, default=0, help="the number behind each barcode")
    p.add_argument("-l", "--level", choices=("gene", "transcript"), default="gene")
    return top


def params(a: argparse.Namespace) -> Params:
    cells = {"umi_tag": a.umi, "barcode_tag": a.barcode, "dedup_umi": bool(a.dedup_umi)} if a.kind == "cells" else {}
    return Params(min_intron=a.min_intron, support=a.support, min_mapq=a.mapq, single_exon_edge=a.single_exon_edge, graph_distance=a.graph_distance, min_count=a.min_count, **cells)


def run_demux(spark: SparkSession, a: argparse.Namespace) -> None:
    """Demultiplexed reads, their statistics, and without a list of barcodes how often each was seen. The lists are kits' lists."""
    size = sum(len(s) for n, s in demux.structure(a.mode).parts if n in ("barcode", "x", "y", "z"))
    known = [r.barcode for r in text.barcodes(spark, a.barcodes, min(size, 16)).collect()] if a.barcodes else None
    umis = {r.barcode: r.umis for r in text.whitelist(spark, a.whitelist, size).collect()} if a.whitelist else {}
    known = sorted(umis) if known is None and umis else known
    lists = {n: [r.barcode for r in text.barcodes(spark, getattr(a, n)).collect()] for n in "xyz" if getattr(a, n)}
    hits = demux.demultiplex(text.reads(spark, a.reads), a.mode, known, umis, bool(a.trim), lists or None)
    sinks.write_demux(hits, f"{a.output}/reads", a.by_barcode)
    demux.stats(hits).write.mode("overwrite").csv(f"{a.output}/stats", sep="\t", header=True)
    if known is None:
        sinks.barcode_listing(hits).write.mode("overwrite").csv(f"{a.output}/barcodes_counts", sep="\t")
        sinks.barcode_histogram(hits).orderBy("n").write.mode("overwrite").csv(f"{a.output}/barcodes_histogram", sep="\t")


def run_tags(spark: SparkSession, a: argparse.Namespace) -> None:
    """The barcode and UMI of the records of BAM files, by a tab."""
    listed = text.barcodes(spark, a.filter, 1) if a.filter else None
    bam.barcode_umis(spark, a.bam, listed).select("barcode", "umi").write.mode("overwrite").csv(a.output, sep="\t")


def run_sparse(spark: SparkSession, a: argparse.Namespace) -> None:
    """The triplets of a matrix, and its features with the name, chromosome and span that the annotation has for them."""
    matrix = text.matrix(spark, a.input, 1 if a.level == "gene" else 2)
    key = matrix.columns[0]
    names = text.named(spark, a.gtf, a.level)
    if a.level == "gene":  # genes that the annotation has not are left out
        matrix = matrix.join(names.select(F.col("id").alias(key)), key, "left_semi")
    sinks.write_mtx(matrix, a.output, key, "column", "value", a.number, names)


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"isoloom {a.kind}").getOrCreate()
    if a.kind == "demux":
        run_demux(spark, a)
    elif a.kind == "tags":
        run_tags(spark, a)
    elif a.kind == "sparse":
        run_sparse(spark, a)
    else:
        isoforms.run(spark, a.sam, a.fasta, a.gtf, a.output, params(a), a.kind == "cells")


if __name__ == "__main__":
    main()
