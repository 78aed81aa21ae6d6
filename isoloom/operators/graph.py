"""The graph of near chains: edges, maximal cliques and the verdict on its nodes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions import intervals as I
from ..params import Params

KEY = ["chrom", "group_id"]


def edges(nodes: DataFrame, p: Params = Params(), width: int = 1 << 14) -> DataFrame:
    """(chrom, group_id, a, b): pairs of nodes, one of them novel, at chain distance 1 .. graph_distance.

    nodes: (chrom, group_id, node, known, chain). Only chains with overlapping junctions can be that near, so
    pairs come from a join on bins of their junctions."""
    bins = F.explode(F.array_distinct(F.flatten(F.transform("chain", lambda j: F.sequence(F.floor(j["s"] / width), F.floor(j["e"] / width))))))
    spread = nodes.select(*KEY, "node", "known", "chain", bins.alias("bin"))
    other = spread.select(*KEY, "bin", F.col("node").alias("b"), F.col("known").alias("known_b"), F.col("chain").alias("chain_b"))
    met = spread.withColumnRenamed("node", "a").join(other, [*KEY, "bin"]).filter((F.col("a") < F.col("b")) & ~(F.col("known") & F.col("known_b")))
    met = met.drop("bin").dropDuplicates([*KEY, "a", "b"])
    return met.withColumn("distance", I.chain_distance(F.col("chain"), F.col("chain_b"))).filter((F.col("distance") > 0) & (F.col("distance") <= p.graph_distance)).select(*KEY, "a", "b", "distance")


def _grow(near: dict, clique: list, able: set, done: set) -> list[list]:
    """All maximal cliques that extend clique by nodes of able; a node of done that meets all of one makes it not maximal."""
    out, todo = [], [(clique, able, done)]
    while todo:
        clique, able, done = todo.pop()
        if not able and not done:
            if clique:
                out.append(sorted(clique))
            continue
        pivot = max(sorted(able | done), key=lambda n: len(near[n] & able))
        for n in sorted(able - near[pivot]):
            todo.append(([*clique, n], able & near[n], done & near[n]))
            able = able - {n}
            done = done | {n}
    return out


def maximal_cliques(nodes: Iterable, pairs: Iterable[tuple]) -> list[list]:
    """All maximal cliques, each sorted, in the order of their smallest node and size; a lone node is one."""
    near: dict = {n: set() for n in nodes}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    return sorted(_grow(near, [], set(near), set()), key=lambda c: (c[0], len(c), c))


def owned_cliques(node: Any, around: Iterable, links: Iterable[tuple]) -> list[list]:
    """The maximal cliques whose smallest node is node: around are its neighbours, links the edges between two of them,
    of which those between two smaller ones may be left out."""
    near: dict = {n: set() for n in around}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    return _grow(near, [node], {n for n in near if n > node}, {n for n in near if n < node})


def cliques(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chrom, group_id, clique, node), clique numbered in a group by smallest node, size and members.

    A row is a node with its neighbours and the edges between them, and gives the cliques whose smallest node it is.
    So a hot group is dealt to tasks by its nodes, and what a task holds at once grows with a node's neighbours alone."""
    edge = pairs.filter("a <> b").select(*KEY, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    both = edge.unionByName(edge.select(*KEY, F.col("b").alias("a"), F.col("a").alias("b")))
    around = both.groupBy(*KEY, F.col("a").alias("node")).agg(F.collect_set("b").alias("around"))
    # triangles u < v < w: u needs the edge of v and w, v that of u and w; w would only look at smaller nodes
    two = edge.select(*KEY, F.col("a").alias("u"), F.col("b").alias("v")).join(edge.select(*KEY, F.col("a").alias("u"), F.col("b").alias("w")), [*KEY, "u"]).filter("v < w")
    three = two.join(edge.select(*KEY, F.col("a").alias("v"), F.col("b").alias("w")), [*KEY, "v", "w"])
    owner = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("x"), F.col("w").alias("y")), F.struct(F.col("v").alias("node"), F.col("u").alias("x"), F.col("w").alias("y"))))
    links = three.select(*KEY, owner.alias("o")).groupBy(*KEY, F.col("o.node").alias("node")).agg(F.collect_list(F.array("o.x", "o.y")).alias("links"))
    rows = nodes.select(*KEY, "node").distinct().join(around, [*KEY, "node"], "left").join(links, [*KEY, "node"], "left")
    members = StructType([*rows.select(*KEY).schema.fields, StructField("members", ArrayType(rows.schema["node"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            kind = kind or pa.schema([*(batch.schema.field(k) for k in KEY), pa.field("members", pa.list_(batch.schema.field("node").type))])
            found = [{KEY[0]: r[KEY[0]], KEY[1]: r[KEY[1]], "members": c} for r in batch.to_pylist() for c in owned_cliques(r["node"], r["around"] or (), r["links"] or ())]
            yield pa.RecordBatch.from_pylist(found, schema=kind)

    found = rows.mapInArrow(run, members)
    order = Window.partitionBy(*KEY).orderBy(F.get("members", F.lit(0)), F.size("members"), "members")
    numbered = found.withColumn("clique", (F.row_number().over(order) - 1).cast("long"))
    return numbered.select(*KEY, "clique", F.explode("members").alias("node"))


def verdict(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with verdict: in each clique the known members set the bar; false in one clique is false.

    Known and other members: known are true, others if the least known count isn't 0 and theirs reaches it.
    Known only: true if the count is above 0. Others only: those with the largest count (a lone one if above 0)."""
    m = members.join(nodes.select(*KEY, "node", "known", "count"), [*KEY, "node"])
    bar = m.groupBy(*KEY, "clique").agg(F.min(F.when(F.col("known"), F.col("count"))).alias("bar"), F.max("count").alias("top"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("known"), 1)).alias("k"))
    m = m.join(bar, [*KEY, "clique"])
    mixed = F.col("known") | ((F.col("bar") != 0) & (F.col("count") >= F.col("bar")))
    good = F.when((F.col("k") > 0) & (F.col("k") < F.col("n")), mixed).when(F.col("k") > 0, F.col("count") > 0).when(F.col("n") == 1, F.col("count") > 0).otherwise(F.col("count") == F.col("top"))
    return nodes.join(m.groupBy(*KEY, "node").agg(F.min(good).alias("verdict")), [*KEY, "node"])
