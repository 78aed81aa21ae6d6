"""Single-exon reads: to a gene, then to a transcript, by a cascade of tie-breaks.

What a read can belong to comes to it as one list, and the cascade works on that list: a read stays one row, so
that neither pairs nor windows over them are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..params import Params


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x worked out once however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _within(a: Column, value: Callable[[Column], Column], way: str, slack: float) -> Column:
    """The elements whose value is within slack of the best."""
    best = F.array_min if way == "min" else F.array_max
    near = (lambda x, b: x <= b + slack) if way == "min" else (lambda x, b: x >= b - slack)
    return _bound(F.transform(a, value), lambda v: _bound(best(v), lambda b: F.filter(a, lambda x, i: near(F.get(v, i), b))))


def _cascade(met: Column, exons: str, order: list[str], p: Params) -> Column:
    """The list of the one element of met that stays; empty if met is. Nearest ends within the slack, then most common
    bases within the slack, then the one of one exon if it is the only such, then the first by order. A stage is left out
    where one element is left, as for most reads."""
    s, e = F.col("read_start"), F.col("read_end")

    def first(a: Column) -> Column:
        lowest = lambda a: F.array(F.array_min(F.transform(a, lambda x: F.struct(*[x[c].alias(c) for c in order], x.alias("x"))))["x"])
        return _bound(F.filter(a, lambda x: F.size(x[exons]) == 1), lambda ones: F.when(F.size(ones) == 1, ones).otherwise(lowest(a)))

    stages = [
        lambda a: _within(a, lambda x: I.boundary_distance(x[exons], s, e), "min", p.cascade_slack),
        lambda a: _within(a, lambda x: I.common_length(x[exons], s, e), "max", p.cascade_slack),
        first,
    ]
    narrowed = lambda met, stage: _bound(met, lambda a: F.when(F.size(a) < 2, a).otherwise(stage(a)))
    for stage in stages:
        met = narrowed(met, stage)
    return met


def _meets(exons: Column) -> Column:
    """Whether the read shares a base with them."""
    return F.exists(exons, lambda x: F.least(x["e"], F.col("read_end")) >= F.greatest(x["s"], F.col("read_start")))


def to_genes(reads: DataFrame, genes: DataFrame, bin_width: int = 1 << 16, p: Params = Params()) -> DataFrame:
    """reads with gene_id: genes whose merged exons meet the read; nearest ends within the slack, then most
    common bases within the slack, then a one-exon gene if it is the only one, then the first by name.

    A read lies in the bin of its start, of a width above its length: bin_width, doubled as often as it needs. Genes are
    listed in each bin that they touch and in the one before it, by those widths that reads have."""
    length = F.col("read_end") - F.col("read_start")
    width = F.when(length < bin_width, F.lit(float(bin_width))).otherwise(F.pow(F.lit(2.0), F.length(F.bin(F.floor(length / bin_width)))) * bin_width)
    placed = reads.withColumn("__w", width).withColumn("__bin", F.floor(F.col("read_start") / F.col("__w")))
    at = lambda c: F.floor(F.col(c) / F.col("__w"))
    g = genes.select("chrom", "gene_id", F.col("start").alias("g_start"), F.col("end").alias("g_end"), "merged_exons").crossJoin(F.broadcast(placed.select("__w").distinct()))
    g = g.withColumn("__bin", F.explode(F.sequence(at("g_start") - 1, at("g_end"))))
    listed = g.groupBy("__bin", "__w", "chrom").agg(F.collect_list(F.struct("g_start", "g_end", "gene_id", "merged_exons")).alias("__g"))
    met = placed.join(listed.hint("merge"), ["__bin", "__w", "chrom"])  # lists grow with the annotation: never broadcast
    near = F.filter("__g", lambda x: (x["g_start"] <= F.col("read_end")) & (x["g_end"] >= F.col("read_start")) & _meets(x["merged_exons"]))
    return met.select(*reads.columns, F.explode(_cascade(near, "merged_exons", ["gene_id"], p)).alias("__c")).select(*reads.columns, "__c.gene_id")


def to_transcripts(reads: DataFrame, tx: DataFrame, seeds: DataFrame, p: Params = Params()) -> DataFrame:
    """reads with transcript_id and n_exons: in the read's gene the only transcript, else those that meet the read
    by the same cascade, a single-exon one if it is the only such, then the most full-match reads, then the name."""
    count = seeds.groupBy("chrom", "transcript_id").agg(F.sum("count").alias("__s"))
    t = tx.select("chrom", "gene_id", "transcript_id", "exons", "n_exons").join(count.hint("merge"), ["transcript_id", "chrom"], "left")
    t = t.withColumn("less", F.coalesce("__s", F.lit(0)) * -1)
    listed = t.groupBy("gene_id", "chrom").agg(F.collect_list(F.struct("transcript_id", "exons", "n_exons", "less")).alias("__t"))
    met = reads.join(listed.hint("merge"), ["gene_id", "chrom"])
    near = F.when(F.size("__t") == 1, F.col("__t")).otherwise(F.filter("__t", lambda x: _meets(x["exons"])))
    return met.select(*reads.columns, F.explode(_cascade(near, "exons", ["less", "transcript_id"], p)).alias("__c")).select(*reads.columns, "__c.transcript_id", "__c.n_exons")
