"""Scan of the tags of BAM files.

A BAM file is a chain of gzip members; a record may begin anywhere in one and end in the next, so that a file is read
from its begin by one task, in pieces, and files are spread over tasks. Memory is bounded by a piece and one record.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 4 << 20
ROWS = 8192

#: Sizes of the tag types of one value.
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


def inflated(stream) -> Iterator[bytes]:
    """The bytes of all gzip members of a stream, in pieces; a file that ends inside a member raises."""
    member, rest = None, b""
    while True:
        rest = rest or stream.read(PIECE)
        if not rest:
            break
        member = member or zlib.decompressobj(wbits=31)
        out = member.decompress(rest, PIECE)
        ended = member.eof
        rest = member.unused_data if ended else member.unconsumed_tail
        if ended:
            member = None
        if out:
            yield out
    if member is not None:
        raise ValueError("a BAM file ends inside a block")


class Bytes:
    """Reads whole runs of bytes from pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, b"", 0

    def take(self, n: int) -> bytes:
        """n bytes; none at the end, fewer than n raise."""
        while len(self.held) - self.at < n:
            piece = next(self.pieces, None)
            if piece is None:
                if self.at == len(self.held):
                    return b""
                raise ValueError("a BAM file ends inside a record")
            self.held, self.at = self.held[self.at :] + piece, 0
        out = self.held[self.at : self.at + n]
        self.at += n
        return out

    def number(self) -> int:
        got = self.take(4)
        if not got:
            raise ValueError("a BAM file ends inside its header")
        return struct.unpack("<i", got)[0]


def texts(tags: bytes, wanted: tuple[str, ...]) -> dict[str, str]:
    """The wanted text tags of a record."""
    out, at = {}, 0
    while at + 3 <= len(tags):
        name, kind = tags[at : at + 2].decode("latin-1"), chr(tags[at + 2])
        at += 3
        if kind in "ZH":
            end = tags.index(0, at)
            if name in wanted:
                out[name] = tags[at:end].decode("latin-1")
            at = end + 1
        elif kind == "B":
            inner, n = chr(tags[at]), struct.unpack_from("<i", tags, at + 1)[0]
            at += 5 + n * SIZES[inner]
        else:
            at += SIZES[kind]
    return out


def records(stream, wanted: tuple[str, ...]) -> Iterator[tuple]:
    """(read name, flag, the wanted tags or None) of every record."""
    data = Bytes(inflated(stream))
    if data.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    data.take(data.number())
    for _ in range(data.number()):
        data.take(data.number() + 4)
    while size := data.take(4):
        body = data.take(struct.unpack("<i", size)[0])
        n_name, n_cigar, flag, n_seq = body[8], *struct.unpack_from("<HHi", body, 12)
        tags = 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq
        found = texts(body[tags:], wanted)
        yield (body[32 : 32 + n_name - 1].decode("latin-1"), flag, *(found.get(t) for t in wanted))


def bam_tags(spark: SparkSession, paths: list[str], tags: tuple[str, ...] = ("CB", "UB")) -> DataFrame:
    """(path, read_id, flag, a column for each tag) of the records of BAM files, unmapped and secondary ones too."""
    schema = ", ".join(["path string", "read_id string", "flag int", *(f"`{t}` string" for t in tags)])
    names = ["path", "read_id", "flag", *tags]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in frames:
            for path in pdf.path:
                system, inner = fs.FileSystem.from_uri(path)
                held = []
                with system.open_input_stream(inner, compression=None) as stream:
                    for row in records(stream, tags):
                        held.append((path, *row))
                        if len(held) == ROWS:
                            yield pd.DataFrame(held, columns=names)
                            held = []
                yield pd.DataFrame(held, columns=names)

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(len(paths), 1), "path")
    return listed.mapInPandas(run, schema)


def barcode_umis(spark: SparkSession, paths: list[str], barcodes: DataFrame | None = None) -> DataFrame:
    """(barcode, umi) of each record that has both tags, the barcode as far as its first -; with barcodes (barcode)
    only those listed. Records are not made distinct."""
    rows = bam_tags(spark, paths).filter("CB is not null and UB is not null")
    rows = rows.select(F.split("CB", "-")[0].alias("barcode"), F.col("UB").alias("umi"))
    return rows if barcodes is None else rows.join(barcodes.select("barcode"), "barcode", "left_semi")
