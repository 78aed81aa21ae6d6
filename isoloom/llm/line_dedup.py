"""Line dedup: levelled sorted runs of line hashes, in DataFrame operations only.

A line's key is the line without ASCII white space at both ends and with A-Z lowered, held as two 64-bit
hashes of different seeds. Documents are dealt into batches by the hash of their id (a document lies in one
batch). A run is a table bucketed by key and sorted in its buckets, so that runs meet by merge joins without
an exchange or a sort. The batches pass one after another: a batch's keys, with the documents and lines that
hold them and the largest doc_id, are merge-anti-joined with the runs; those that no run holds form a new run,
and of the others the numbers and the id are added to what the runs hold. FANIN runs of one level, which share
no key, are compacted to one run of the next by a merging full join. At the end runs and additions give, for
each key found in min_docs documents, the document that keeps it. Lines find their key by
`shared.spread_join`, so that a line of a third of all documents is many tasks.

Null and empty text is one empty line. Lines are split at \\n alone. A document that repeats a key counts
once, and in the document that keeps the key all its lines stay. Ids are of any type that can be ordered; null
doc_id counts as one document, smaller than others; rows repeated with the same doc_id are one document. Work
on a text grows in proportion to it, however long its lines and their blanks. Extra columns pass, whatever
their names; those named kept_text, n_lines or n_dropped give way to the results. An empty table gives an
empty result.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BLANKS, Rows, ascii_lower, discard, materialize, new_path, spread_join

BATCHES, FANIN = 4, 2
MIN_CHARS, MIN_DOCS = 20, 3
KEY = ["h1", "h2"]
SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def keyed_lines(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    """(id, t, pos, h1, h2) of the lines that are long enough; t tells texts of one id apart."""
    rows = Rows(docs)
    body = rows.body(text)
    lines = rows.frame.select(rows.col(doc_id).alias("id"), F.xxhash64(body).alias("t"), F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))
    lines = lines.filter(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    return lines.select("id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


@contextmanager
def sorted_scans(spark: SparkSession):
    """Plans made inside rely on the order of bucketed tables that have one file a bucket."""
    before = spark.conf.get(SORTED)
    spark.conf.set(SORTED, "true")
    try:
        yield
    finally:
        spark.conf.set(SORTED, before)


class Run:
    """A table in the shared folder, bucketed and sorted by key. Its rows come from an exchange by key into as many
    partitions as it has buckets, or from merge joins of such tables, so that each bucket is one file."""

    def __init__(self, rows: DataFrame, buckets: int, level: int = 0):
        self.spark, self.level, self.buckets = rows.sparkSession, level, buckets
        self.name, self.path = f"isoloom_run_{uuid.uuid4().hex}", new_path(self.spark, "run")
        with sorted_scans(self.spark):
            rows.write.format("parquet").option("path", self.path).bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(self.name)

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Takes the table from the catalog and deletes its files."""
        self.spark.sql(f"drop table {self.name}")
        plain = self.spark.range(0)
        plain.isoloom_path = self.path
        discard(plain)


def compacted(runs: list[Run]) -> Run:
    """One run of the next level; no two of the runs share a key."""
    out = runs[0].rows
    for r in runs[1:]:
        other = r.rows.select(*KEY, *[F.col(c).alias(f"x_{c}") for c in ("keep", "docs", "n")])
        out = out.join(other, KEY, "full").select(*KEY, *[F.coalesce(c, f"x_{c}").alias(c) for c in ("keep", "docs", "n")])
    new = Run(out, runs[0].buckets, runs[0].level + 1)
    for r in runs:
        r.drop()
    return new


def run_index(lines: DataFrame, batches: int = BATCHES, fanin: int = FANIN) -> DataFrame:
    """(h1, h2, keep, docs, n): for each key the largest id of a document that holds it, and the numbers of documents and lines."""
    spark = lines.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs: list[Run] = []
    more: list[DataFrame] = []
    for b in range(batches):
        own = lines.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == b).groupBy(*KEY, "id").agg(F.count(F.lit(1)).alias("n"))
        own = own.groupBy(*KEY).agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))
        if runs:
            batch = Run(own, buckets)
            fresh, known = batch.rows, None
            for r in runs:
                fresh = fresh.join(r.rows.select(*KEY), KEY, "left_anti")
                again = batch.rows.join(r.rows.select(*KEY), KEY, "left_semi")
                known = again if known is None else known.unionByName(again)
            with sorted_scans(spark):
                more.append(materialize(known, "known"))
            runs.append(Run(fresh, buckets))
            batch.drop()
        else:
            runs.append(Run(own, buckets))
        while len(runs) >= fanin and len({r.level for r in runs[-fanin:]}) == 1:
            runs[-fanin:] = [compacted(runs[-fanin:])]
    out = None
    for rows in [*(r.rows for r in runs), *more]:
        out = rows if out is None else out.unionByName(rows)
    index = materialize(out.groupBy(*KEY).agg(F.max("keep").alias("keep"), F.sum("docs").alias("docs"), F.sum("n").alias("n")), "index")
    for r in runs:
        r.drop()
    discard(*more)
    return index


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs with kept_text (the lines that stay, joined by \\n), n_lines and n_dropped added."""
    lines = materialize(keyed_lines(docs, text, doc_id, min_chars), "lines")
    common = run_index(lines, batches).filter(F.col("docs") >= min_docs)
    met = spread_join(lines, common.select(*KEY, "keep"), KEY, by=["id", "pos"], counts=common.select(*KEY, F.col("n").alias("x_n")))
    lost = met.filter(~F.col("id").eqNullSafe(F.col("keep"))).groupBy(F.xxhash64("id").alias("x_id"), F.col("t").alias("x_t")).agg(F.collect_set("pos").alias("x_lost"))
    rows = Rows(docs, "kept_text", "n_lines", "n_dropped")
    body = rows.body(text)
    tagged = rows.frame.withColumns({"x_id": F.xxhash64(rows.col(doc_id)), "x_t": F.xxhash64(body)})
    split = F.split(body, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "x_lost")
    kept = F.when(F.col("x_lost").isNull(), body).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("x_lines"), i)), "\n"))
    out = tagged.join(lost, ["x_id", "x_t"], "left").withColumn("x_lines", split)
    return rows.out(out, kept_text=kept, n_lines=F.size("x_lines").cast("long"), n_dropped=F.coalesce(F.size("x_lost"), F.lit(0)).cast("long"))
