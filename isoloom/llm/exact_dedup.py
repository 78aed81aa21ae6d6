"""Exact dedup: a tree merge of sorted digest runs, in DataFrame operations only.

Every row gets the SHA-256 of its text, and beside it the text's length and a hash of another family. Rows are
dealt by the hash of their id into RUNS runs. A run is sorted by digest; rows of one text become one entry
(digest, length, check, keep, rows). The runs are cut into ZONES zones by digest, and meet in binomial rounds:
in each round the partitions exchange runs, so that FANIN neighbouring ones of a zone lie in one partition, in
order, and are merged to one run by a sorted aggregate. At every level entries are one text only if digest,
length and check all agree; of these the identifier that stays is kept and the rows are added up. After the
last round a zone is one run. As a run has one entry for a text before it is exchanged, a text that a third of
all rows share is RUNS rows in the first round; rows find their entry by `shared.spread_join`.

Of equal texts the row with the largest id stays (or the smallest). Ids are of any type that can be ordered;
null doc_id gives way to any other. Null text counts as empty, and empty texts are equal. Rows that agree in
doc_id and text all carry the same decision (`mark`); `dedup` keeps one of them. Very long texts take part as
digests. Extra columns pass through `dedup`, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Rows, materialize, spread_join

RUNS, FANIN, ZONES = 16, 4, 1024
TEXT = ["digest", "length", "check"]


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, digest, length, check): SHA-256 as 32 bytes, characters, and a 64-bit hash."""
    rows = Rows(docs)
    body = rows.body(text)
    return rows.frame.select(rows.col(doc_id).alias("id"), F.unhex(F.sha2(body, 256)).alias("digest"), F.length(body).alias("length"), F.xxhash64(body).alias("check"))


def final_run(entries: DataFrame, largest: bool = True, runs: int = RUNS, fanin: int = FANIN) -> DataFrame:
    """(digest, length, check, keep_id, group_size), one row for each different text."""
    # structs, as their aggregates go along a sort order; null is the smallest in one
    best, name = (F.max, F.struct(F.col("id"))) if largest else (F.min, F.struct(F.col("id").isNull().alias("none"), F.col("id")))
    key = ["run", "zone", *TEXT]
    run = entries.select(F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int").alias("run"), F.pmod(F.xxhash64("digest"), F.lit(ZONES)).cast("int").alias("zone"), *TEXT, name.alias("keep"))
    run = run.groupBy(*key).agg(best("keep").alias("keep"), F.count(F.lit(1)).alias("group_size"))
    while runs > 1:
        runs = -(-runs // fanin)
        met = run.withColumn("run", F.floor(F.col("run") / fanin).cast("int")).repartition("run", "zone").sortWithinPartitions(*key)
        run = met.groupBy(*key).agg(best("keep").alias("keep"), F.sum("group_size").alias("group_size"))
    return run.select(*TEXT, F.col("keep.id").alias("keep_id"), "group_size")


def mark(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", largest: bool = True) -> DataFrame:
    """For each row doc_id, keep_id, group_size, kept and the hexadecimal text_sha256."""
    entries = materialize(digests(docs, text, doc_id), "digests")
    run = materialize(final_run(entries, largest), "run")
    met = spread_join(entries, run, TEXT, by=["id"], counts=run.select(*TEXT, F.col("group_size").alias("x_n")))
    return met.select(F.col("id").alias(doc_id), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", largest: bool = True) -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each different text."""
    rows = Rows(docs)
    # rows that agree in id and text are one before the exchange of the texts
    once = rows.frame.withColumns({"x_d": F.unhex(F.sha2(rows.body(text), 256)), "x_h": F.xxhash64(rows.col(doc_id))}).dropDuplicates(["x_d", "x_h"])
    stay = final_run(digests(docs, text, doc_id), largest).select(F.col("digest").alias("x_d"), F.xxhash64("keep_id").alias("x_h"))
    return rows.out(once.join(stay, ["x_d", "x_h"], "left_semi"))
