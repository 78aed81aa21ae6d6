"""UMI dedup: near pairs, and the greedy choice of centres."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import edit_distances


def near_pairs(rows: DataFrame, keys: list[str], read: str = "read_id", umi: str = "umi", size: str | None = None, most: int = 3) -> DataFrame:
    """(keys, a, b, distance) of reads a < b with one key, sizes within most and UMIs within most edits.

    UMIs within d edits share one of d + 1 parts of either up to a shift of d; pairs come from that join."""
    parts = most + 1
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(i.alias("i"), F.floor(F.length(umi) * i / parts).cast("int").alias("from"), F.floor(F.length(umi) * (i + 1) / parts).cast("int").alias("to")))
    one = rows.select(*keys, F.col(read).alias("a"), F.col(umi).alias("ua"), (F.col(size) if size else F.lit(0)).alias("la"), F.explode(pieces).alias("p"))
    one = one.select(*keys, "a", "ua", "la", F.col("p.to").alias("__to"), F.col("p.from").alias("__from"))
    one = one.withColumn("piece", F.expr("substring(ua, __from + 1, __to - __from)")).withColumn("at", F.explode(F.sequence(F.col("__from") - most, F.col("__from") + most)))
    # b is cut at every place with pieces of either size that a's can have
    lengths = F.array_distinct(F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda d: F.floor((F.length(umi) + d) / parts).cast("int")))
    two = rows.select(*keys, F.col(read).alias("b"), F.col(umi).alias("ub"), (F.col(size) if size else F.lit(0)).alias("lb"), F.explode(F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.array(n, n + 1))))).alias("n"))
    two = two.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("ub")))).withColumn("piece", F.expr("substring(ub, at + 1, n)")).filter((F.length("piece") == F.col("n")) & (F.col("n") >= 0))
    met = one.join(two, [*keys, "piece", "at"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("la") - F.col("lb")) <= most))
    met = met.select(*keys, "a", "b", "ua", "ub").distinct().withColumn("distance", F.levenshtein("ua", "ub", most))
    return met.filter("distance >= 0").select(*keys, "a", "b", "distance")


class Kept:
    """UMIs that were kept, by their pieces: a UMI cut into most + 1 pieces keeps one of them whole, moved by at most most
    letters, in any that is within most edits. So those near a new one are among those that share a piece with it."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.index: dict[tuple[int, int, str], list[str]] = {}
        self.sizes: set[int] = set()

    def _cuts(self, size: int) -> list[tuple[int, int]]:
        return [(size * i // (self.most + 1), size * (i + 1) // (self.most + 1)) for i in range(self.most + 1)]

    def add(self, umi: str) -> None:
        self.sizes.add(len(umi))
        for i, (s, e) in enumerate(self._cuts(len(umi))):
            self.index.setdefault((len(umi), i, umi[s:e]), []).append(umi)

    def sharing(self, umi: str) -> list[str]:
        out: set[str] = set()
        for size in self.sizes:
            if abs(size - len(umi)) > self.most:
                continue
            for i, (s, e) in enumerate(self._cuts(size)):
                for piece in {umi[at : at + e - s] for at in range(max(s - self.most, 0), s + self.most + 1)}:
                    out.update(self.index.get((size, i, piece), ()))
        return list(out)

    def near(self, umi: str) -> bool:
        among = self.sharing(umi)
        return bool(among) and bool((edit_distances([umi] * len(among), among) <= self.most).any())


def greedy(rows: DataFrame, keys: list[str], order: str = "read_id", umi: str = "umi", most: int = 3) -> DataFrame:
    """The rows that stay: in the order of `order`, each whose UMI is within most edits of no UMI kept before.

    A group holds the first row of each UMI only; each is compared with the kept ones that share a piece with it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").drop_duplicates(umi)
        kept, stays = Kept(most), []
        for u in pdf[umi]:
            stays.append(not kept.near(u))
            if stays[-1]:
                kept.add(u)
        return pdf[np.array(stays, bool)]

    w = Window.partitionBy(*keys, umi).orderBy(order)
    first = rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    # a number of tasks that is not lowered, as few bytes are much work
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return first.repartition(tasks, *keys).groupBy(*keys).applyInPandas(run, rows.schema)
