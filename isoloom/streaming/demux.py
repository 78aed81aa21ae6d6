"""Demultiplexing of reads that arrive as files in a folder. A read needs no other read, so that there is no state but
the counts of barcodes; the checkpoint folder of a query makes its files and counts survive a restart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import demux


def framed(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """(read_id, seq, qual) of a stream of lines, each a record: name, bases and, if there are any, qualities, by tabs.
    files: at most so many a batch. Lines are split over tasks, however large a file is."""
    source = spark.readStream if files is None else spark.readStream.option("maxFilesPerTrigger", files)
    f = F.split("value", "\t")
    rows = source.text(folder).select(f.alias("f")).filter(F.size("f") >= 2)
    name = F.split(F.get("f", F.lit(0)), " ")[0]
    return rows.select(name.alias("read_id"), F.get("f", F.lit(1)).alias("seq"), F.get("f", F.lit(2)).alias("qual"))


def fastq(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """(read_id, seq, qual) of a stream of FASTQ files of four lines a record. A file is one row at first, so that it
    must be of a sequencer's portion (far below 2 GB); larger ones go through framed."""
    source = spark.readStream if files is None else spark.readStream.option("maxFilesPerTrigger", files)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for text in pdf.value:
                lines = text.split("\n")
                names, seqs, quals = lines[0::4], lines[1::4], lines[3::4]
                out = [(n[1:].split(" ")[0].split("\t")[0], s, q) for n, s, q in zip(names, seqs, quals, strict=False) if n.startswith("@")]
                yield pd.DataFrame(out, columns=["read_id", "seq", "qual"])

    return source.text(folder, wholetext=True).mapInPandas(run, "read_id string, seq string, qual string")


def start(reads: DataFrame, output: str, checkpoint: str, mode: str = "visium", barcodes: list[str] | None = None, umis: dict[str, list[str]] | None = None, trim: bool = True, once: bool = True) -> StreamingQuery:
    """Write the pieces of a stream of reads as Parquet, all that is there now (once) or for ever."""
    writer = demux.demultiplex(reads, mode, barcodes, umis, trim).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(output)


def barcode_counts(hits: DataFrame) -> DataFrame:
    """(barcode, n) over a stream of pieces, for output modes update and complete."""
    return hits.groupBy("barcode").agg(F.count(F.lit(1)).alias("n"))
