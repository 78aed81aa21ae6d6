"""Clusters of reads with one chain, and their classes against known transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..params import Params
from .ranges import _equi

KEY = ["chrom", "group_id"]


def clusters(reads: DataFrame) -> DataFrame:
    """One row for each chain of a group: n_reads, begin, end, and by junction the trusted reads and the codes."""
    key = [*KEY, "chain"]
    multi = reads.filter(F.size("chain") > 0)
    size = multi.groupBy(*key).agg(F.count(F.lit(1)).alias("n_reads"), F.min("read_start").alias("begin"), F.max("read_end").alias("end"))
    codes = multi.select(*key, F.posexplode("sj_code").alias("k", "code")).groupBy(*key, "k").agg(F.count(F.when(F.col("code") > 0, 1)).alias("n"), F.min(F.when(F.col("code") > 0, F.col("code"))).alias("lo"), F.max(F.when(F.col("code") > 0, F.col("code"))).alias("hi"))
    codes = codes.groupBy(*key).agg(F.min("n").alias("least_trusted"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return size.join(codes, key)


def full_matches(c: DataFrame, known: DataFrame) -> DataFrame:
    """(cluster columns, transcript_id, gene_id, start, stop): clusters whose chain is a known one."""
    k = known.filter(F.size("chain") > 0).select("chrom", "chain", "transcript_id", "gene_id", F.col("start").alias("tx_start"), F.col("end").alias("tx_end"))
    return c.join(k, ["chrom", "chain"])


def nearest(reads: DataFrame, matches: DataFrame) -> DataFrame:
    """For each read of a full match the transcript with the nearest ends, then the first name.

    Reads of one chain with the same ends have the same transcript, and of transcripts with the same ends the first is
    nearest: different ends are compared, and only a read's own one is joined to it."""
    ends = ["read_start", "read_end"]
    m = matches.groupBy(*KEY, "chain", "tx_start", "tx_end").agg(F.min(F.struct("transcript_id", "gene_id")).alias("__t"))
    off = F.abs(F.col("read_start") - F.col("tx_start")) + F.abs(F.col("read_end") - F.col("tx_end"))
    met = reads.select(*KEY, "chain", *ends).distinct().join(m, [*KEY, "chain"]).withColumn("off", off)
    best = met.groupBy(*KEY, "chain", *ends).agg(F.min(F.struct("off", "__t", "tx_start", "tx_end")).alias("__b"))
    best = best.select(*KEY, "chain", *ends, "__b.__t.transcript_id", "__b.__t.gene_id", "__b.tx_start", "__b.tx_end", "__b.off")
    w = Window.partitionBy("sample", *KEY, "read_id").orderBy("off", "transcript_id")
    out = _equi(reads, best, [*KEY, "chain", *ends]).withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    rest = [c for c in reads.columns if c not in (*KEY, "chain")]
    return out.select(*KEY, "chain", *rest, "transcript_id", "gene_id", "tx_start", "tx_end", "off")


def partial_matches(c: DataFrame, known: DataFrame) -> DataFrame:
    """(cluster columns, transcript_id, gene_id): chains that lie contiguously in a longer known chain."""
    k = known.filter(F.size("chain") > 1).select("chrom", F.explode("chain").alias("first"), F.col("chain").alias("whole"), "transcript_id", "gene_id")
    met = c.withColumn("first", F.get("chain", F.lit(0))).join(k, ["chrom", "first"])
    return met.filter((F.size("whole") > F.size("chain")) & (I.position_of(F.col("whole"), F.col("chain")) > 0)).drop("first", "whole")


def classify(c: DataFrame, known: DataFrame) -> DataFrame:
    """c with category FSM, ISM or other; a full match wins."""
    full = full_matches(c, known).select(*KEY, "chain").distinct().withColumn("__f", F.lit(True))
    part = partial_matches(c, known).select(*KEY, "chain").distinct().withColumn("__p", F.lit(True))
    out = c.join(full, [*KEY, "chain"], "left").join(part, [*KEY, "chain"], "left")
    return out.withColumn("category", F.when(F.col("__f"), "FSM").when(F.col("__p"), "ISM").otherwise("other")).drop("__f", "__p")


def confidence(c: DataFrame, p: Params = Params()) -> DataFrame:
    """c with confidence (high or low for other clusters) and strand of the codes; contained chains are demoted."""
    high = (F.col("category") == "other") & (F.col("n_reads") >= 2) & (F.col("least_trusted") > p.support) & (F.col("lo") == F.col("hi"))
    out = c.withColumn("confidence", F.when(F.col("category") != "other", F.lit(None)).when(high, "high").otherwise("low"))
    top = out.filter("confidence = 'high'").select(*KEY, "chain")
    longer = top.select(*KEY, F.explode("chain").alias("first"), F.col("chain").alias("whole"))
    inside = top.withColumn("first", F.get("chain", F.lit(0))).join(longer, [*KEY, "first"]).filter((F.size("whole") > F.size("chain")) & (I.position_of(F.col("whole"), F.col("chain")) > 0))
    out = out.join(inside.select(*KEY, "chain").distinct().withColumn("__in", F.lit(True)), [*KEY, "chain"], "left")
    return out.withColumns({"confidence": F.when(F.col("__in"), "low").otherwise(F.col("confidence")), "sj_strand": F.when(F.col("hi") == 1, "+").when(F.col("hi") == 2, "-")}).drop("__in")


def near_full(c: DataFrame, known: DataFrame, seeds: DataFrame, p: Params = Params()) -> DataFrame:
    """(cluster columns, transcript_id, gene_id, distance): low clusters adopted by a known transcript with as many
    junctions at distance 1 .. near_full_distance - 1; of several the one with most full-match reads, then the nearest.

    seeds: (chrom, group_id, transcript_id, count)."""
    low = c.filter("confidence = 'low'").withColumn("size", F.size("chain"))
    # transcripts of one chain are one: the first by name, and in each group the first of those with most reads
    k = known.filter(F.size("chain") > 0).select("chrom", F.col("chain").alias("whole"), "transcript_id", "gene_id")
    first = k.groupBy("chrom", "whole").agg(F.min(F.struct("transcript_id", "gene_id")).alias("t"))
    counted = seeds.select(*KEY, "transcript_id", F.coalesce("count", F.lit(0)).alias("seed")).join(k, ["chrom", "transcript_id"])
    counted = counted.groupBy(*KEY, "whole").agg(F.min(F.struct((-F.col("seed")).alias("less"), "transcript_id", "gene_id")).alias("t"))
    # junctions that overlap share a bin of the first junction's place
    width = 1 << 14
    bins = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(c, lambda j: F.sequence(F.floor(j["s"] / width), F.floor(j["e"] / width))))))
    mine = low.select("chrom", "chain", "size").distinct().withColumn("bin", bins("chain"))
    theirs = first.select("chrom", F.size("whole").alias("size"), "whole").withColumn("bin", bins("whole"))
    met = mine.join(theirs, ["chrom", "size", "bin"]).select("chrom", "chain", "whole").distinct()
    met = met.withColumn("distance", I.chain_distance(F.col("chain"), F.col("whole"))).filter((F.col("distance") > 0) & (F.col("distance") < p.near_full_distance))
    met = low.select(*KEY, "chain").distinct().join(met, ["chrom", "chain"])
    plain = met.join(first, ["chrom", "whole"]).select(*KEY, "chain", "distance", F.lit(0).alias("seed"), "t.transcript_id", "t.gene_id")
    met = met.join(counted, [*KEY, "whole"]).select(*KEY, "chain", "distance", (-F.col("t.less")).alias("seed"), "t.transcript_id", "t.gene_id").unionByName(plain)
    w = Window.partitionBy(*KEY, "chain").orderBy(F.desc("seed"), "distance", "transcript_id")
    best = met.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(*KEY, "chain", "transcript_id", "gene_id", "distance")
    return c.join(best, [*KEY, "chain"])
