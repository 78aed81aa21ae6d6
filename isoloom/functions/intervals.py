"""Columns over sorted lists of closed intervals, array<struct<s,e>>; two that share one base overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero() -> Column:
    return F.lit(0).cast("long")


def length(x: Column) -> Column:
    return (x["e"] - x["s"] + 1).cast("long")


def meets(x: Column, y: Column) -> Column:
    return (x["s"] <= y["e"]) & (y["s"] <= x["e"])


def total_length(a: Column) -> Column:
    return F.aggregate(a, zero(), lambda acc, x: acc + length(x))


def intersect_length(a: Column, b: Column) -> Column:
    """Bases in both lists, each of which is free of overlaps."""
    both = lambda x, y: F.greatest(zero(), (F.least(x["e"], y["e"]) - F.greatest(x["s"], y["s"]) + 1).cast("long"))
    return F.aggregate(a, zero(), lambda acc, x: acc + F.aggregate(b, zero(), lambda inner, y: inner + both(x, y)))


def common_length(a: Column, s: Column, e: Column) -> Column:
    """Bases of a list free of overlaps that lie in s to e."""
    return F.aggregate(a, zero(), lambda acc, x: acc + F.greatest(zero(), (F.least(x["e"], e) - F.greatest(x["s"], s) + 1).cast("long")))


def union_length(a: Column, b: Column) -> Column:
    """Bases in either list."""
    start = F.struct(F.lit(None).cast("long").alias("end"), zero().alias("n"))

    def add(acc: Column, x: Column) -> Column:
        begin = F.when(acc["end"].isNull(), x["s"].cast("long")).otherwise(F.greatest(x["s"].cast("long"), acc["end"] + 1))
        return F.struct(F.greatest(acc["end"], x["e"].cast("long")).alias("end"), (acc["n"] + F.greatest(zero(), x["e"].cast("long") - begin + 1)).alias("n"))

    return F.aggregate(F.array_sort(F.concat(a, b)), start, add, lambda acc: acc["n"])


def apart_length(a: Column, b: Column) -> Column:
    """Bases of the intervals in either list that meet none of the other list."""
    alone = lambda p, q: total_length(F.filter(p, lambda x: ~F.exists(q, lambda y: meets(x, y))))
    return alone(a, b) + alone(b, a)


def chain_distance(a: Column, b: Column) -> Column:
    """How far overlapping junctions disagree: 0 for equal chains, for skipped junctions and for disjoint ones."""
    return union_length(a, b) - intersect_length(a, b) - apart_length(a, b)


def merge(a: Column) -> Column:
    """The sorted list with overlapping intervals joined."""
    kind = F.array_sort(a)

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["s"] <= F.element_at(acc, F.when(F.size(acc) == 0, F.lit(None)).otherwise(-1))["e"], joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.slice(kind, 2, F.greatest(F.size(kind), F.lit(1))), F.slice(kind, 1, 1), add)


def boundary_distance(exons: Column, s: Column, e: Column) -> Column:
    """The smallest distance of a start to s, or of an end to e."""
    return F.least(F.array_min(F.transform(exons, lambda x: F.abs(x["s"] - s))), F.array_min(F.transform(exons, lambda x: F.abs(x["e"] - e))))


def gaps(blocks: Column) -> Column:
    """Intervals between consecutive ones."""
    return F.when(F.size(blocks) < 2, F.slice(F.transform(blocks, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))), 1, 0)).otherwise(
        F.zip_with(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), lambda x, y: F.struct((x["e"] + 1).alias("s"), (y["s"] - 1).alias("e")))
    )


def position_of(longer: Column, part: Column) -> Column:
    """Where part lies contiguously in longer, from 1; 0 if nowhere."""
    at = F.array_position(longer, F.get(part, F.lit(0))).cast("int")
    return F.when((at > 0) & (F.slice(longer, F.greatest(at, F.lit(1)), F.size(part)) == part), at).otherwise(0)


def render(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",")
