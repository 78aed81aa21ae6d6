"""Chat formatting by quotation linking.

A line's quote level is the number of `>` before its text (blanks and tabs between them allowed). Consecutive
lines of one level above 0 are a quoted passage; lines of level 0 are the message's own. Lines are normalised:
A-Z lowered, ASCII white space runs to one blank, ends stripped; lines that are then empty are left out.

1. `parse` reads each message once and hashes lines (BLAKE2b, 64 bits). Runs of 2, 4, 8, ... lines are hashed
   from the halves, so that a passage of k lines is known by its number of lines and two hashes: those of its
   first and its last run of the largest power of two up to k. All its lines are in them.
2. The runs of own lines of a conversation's messages, of the lengths that its passages need, are joined to the
   different passages by the first hash and then by the last one k lines on. So each message that holds a whole
   passage in consecutive own lines is found, and no pair of a passage and a message that share a line alone.
3. Each passage is linked to the latest message before its own that holds it, by an as-of merge: occurrences
   and holders of a passage in the order of turns, in bins of SPAN turns that carry the last holder on.
4. The first of a message's passages of the lowest level that are linked decides what it replies to. Threads
   are formed by pointer doubling. Keys with a large share of the rows are dealt over many tasks.

`link` has one row for each message: own (text without quotes), parent_turn (null without a link), root_turn
and depth of its thread, n_quoted lines and n_links passages linked. `conversations` orders the replies of each
thread: seq numbers a conversation's messages by (root_turn, turn); rows of one message follow each other in
the order of their texts. Columns of these names give way; others pass, whatever their names. Null text is
empty. Null conv_id or turn is linked with nothing and is its own root. Rows with the same conv_id and turn
share their links, and each stays. Quotes of later or unknown messages stay unlinked, and are removed. Work on
a text is in proportion to it, however many marks and lines it has, but for the runs (lines * log lines). An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import LOWER, UPPER, Rows, discard, materialize, spread_join

SPAN = 1024
PREFIX, BLANK = re.compile(r"[ \t>]*"), re.compile(r"[ \t\n\x0b\x0c\r]+")
ASCII = str.maketrans(UPPER, LOWER)
ADDED = ("own", "parent_turn", "root_turn", "depth", "n_quoted", "n_links")


def level_of(line: str) -> tuple[int, str]:
    """Quote level, and the line behind its marks."""
    head = PREFIX.match(line).group()
    marks = head.rfind(">") + 1
    return head.count(">"), line[marks:]


def normal(line: str) -> str:
    return BLANK.sub(" ", line.translate(ASCII)).strip(" ")


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def both(a: int, b: int) -> int:
    return int.from_bytes(hashlib.blake2b(a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True), digest_size=8).digest(), "little", signed=True)


def runs(lines: list[int]) -> list[list[int]]:
    """By j the hashes of all runs of 2^j lines."""
    out = [lines]
    while len(out[-1]) > 1 << (len(out) - 1):
        half, last = 1 << (len(out) - 1), out[-1]
        out.append([both(last[i], last[i + half]) for i in range(len(last) - half)])
    return out


def parsed(text: str) -> tuple[str, list[int], list[tuple[int, int, list[int]]], int]:
    """Own text, hashes of its normalised lines, passages (level, first line's number, hashes of lines) and the number of quoted lines."""
    own, plain, passages, quoted, before = [], [], [], 0, 0
    for no, line in enumerate(text.split("\n")):
        level, rest = level_of(line)
        shown = normal(rest if level else line)
        if not level:
            own.append(line)
            if shown:
                plain.append(digest(shown))
        else:
            quoted += 1
            if level != before:
                passages.append((level, no, []))
            if shown:
                passages[-1][2].append(digest(shown))
        before = level
    return "\n".join(own), plain, [p for p in passages if p[2]], quoted


def parse(rows: Rows, text: str) -> DataFrame:
    """The rows' frame with own, n_quoted, plain (hashes of own lines) and passages (level, no, k, j, first, last)."""
    at = rows.at(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parsed(t or "") for t in b.column(b.schema.get_field_index(at)).to_pylist()]
            keyed = []
            for _, _, passages, _ in found:
                keys = []
                for level, no, lines in passages:
                    table, k = runs(lines), len(lines)
                    keys.append({"level": level, "no": no, "k": k, "j": len(table) - 1, "first": table[-1][0], "last": table[-1][-1]})
                keyed.append(keys)
            kind = pa.list_(pa.struct([("level", pa.int32()), ("no", pa.int32()), ("k", pa.int32()), ("j", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[3] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64())), pa.array(keyed, kind)], [*b.schema.names, "own", "n_quoted", "plain", "passages"])

    added = StructType.fromDDL("own string, n_quoted long, plain array<long>, passages array<struct<level:int,no:int,k:int,j:int,first:long,last:long>>")
    return rows.frame.mapInArrow(run, StructType([*rows.frame.schema.fields, *added.fields]))


def grams(plain: DataFrame) -> DataFrame:
    """(conv, source, m, j, p, h): all runs of own lines up to 2^most lines; m tells messages of one turn apart. plain: (conv, source, m, most, plain)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "source", "m", "j", "p", "h"]
        for b in batches:
            for k in range(b.num_rows):
                table = runs(b.column(4)[k].as_py())[: b.column(3)[k].as_py() + 1]
                for j, hashes in enumerate(table):
                    n = len(hashes)
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(i)[k].as_py()] * n, b.schema.field(i).type) for i in (0, 1, 2)] + [pa.array([j] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(hashes, pa.int64())], names)

    schema = plain.schema
    return plain.mapInArrow(run, StructType([schema["conv"], schema["source"], schema["m"], *StructType.fromDDL("j int, p int, h long").fields]))


def holders(passages: DataFrame, own: DataFrame) -> DataFrame:
    """(conv, k, first, last, source): the messages that hold each passage. own: (conv, source, plain)."""
    wanted = materialize(passages.select("conv", "k", "j", "first", "last").distinct(), "wanted")
    most = wanted.groupBy("conv").agg(F.max("j").alias("most"))
    lines = materialize(own.filter(F.size("plain") > 0).join(most, "conv").select("conv", "source", F.xxhash64("plain").alias("m"), "most", "plain"), "plain")
    held = materialize(grams(lines), "grams")
    key = ["conv", "j", "h"]
    met = spread_join(held, wanted.withColumnRenamed("first", "h"), key, by=["source", "p"])
    met = met.select("conv", "source", "m", "j", "k", F.col("h").alias("first"), "last", (F.col("p") + F.col("k") - F.pow(F.lit(2), F.col("j")).cast("int")).alias("p"))
    # a passage of 2^j lines is its first run
    whole = met.filter(F.col("k") == F.pow(F.lit(2), F.col("j")).cast("int")).select("conv", "k", "first", "last", "source")
    rest = met.filter(F.col("k") > F.pow(F.lit(2), F.col("j")).cast("int")).join(held.withColumnRenamed("h", "last"), ["conv", "source", "m", "j", "p", "last"], "left_semi").select("conv", "k", "first", "last", "source")
    out = materialize(whole.unionByName(rest).distinct(), "holders")
    discard(wanted, lines, held)
    return out


def latest(passages: DataFrame, held: DataFrame) -> DataFrame:
    """passages with source, the latest holder before the passage's own turn; those without one are left out."""
    key = ["conv", "k", "first", "last"]
    asks = passages.select(*key, F.col("turn").alias("x_at"), F.lit(None).cast("long").alias("source")).distinct()
    marks = asks.unionByName(held.select(*key, F.col("source").alias("x_at"), "source")).withColumn("x_bin", F.floor(F.col("x_at") / SPAN))
    ends = marks.groupBy(*key, "x_bin").agg(F.max("source").alias("x_last"))
    carried = ends.withColumn("x_before", F.max("x_last").over(Window.partitionBy(*key).orderBy("x_bin").rowsBetween(Window.unboundedPreceding, -1))).drop("x_last")
    inside = Window.partitionBy(*key, "x_bin").orderBy("x_at").rangeBetween(Window.unboundedPreceding, -1)
    found = marks.join(carried, [*key, "x_bin"]).withColumn("x_s", F.coalesce(F.max("source").over(inside), "x_before"))
    found = found.filter("source is null and x_s is not null").select(*key, F.col("x_at").alias("turn"), F.col("x_s").alias("source"))
    return passages.join(found, [*key, "turn"])


def threads(parents: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) of messages with a parent, by pointer doubling."""
    jump = materialize(parents.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "roots")
    while True:
        up = jump.select("conv", F.col("turn").alias("root"), F.col("root").alias("x_r"), F.col("depth").alias("x_d"))
        met = spread_join(jump, up, ["conv", "root"], "left", by=["turn"])
        after = materialize(met.select("conv", "turn", F.coalesce("x_r", "root").alias("root"), (F.col("depth") + F.coalesce("x_d", F.lit(0))).alias("depth"), F.col("x_r").isNotNull().alias("moved")), "roots")
        discard(jump)
        jump = after
        if not jump.filter("moved").head(1):
            return jump.drop("moved")


def links_of(rows: Rows, text: str) -> tuple[DataFrame, DataFrame]:
    """(conv, turn) of all messages, and (x_c, x_t, parent, n_links, root, depth) of those with a link.

    Hashes of lines are written, texts aren't: the result parses them again."""
    read = parse(rows, text).select(rows.col("conv_id").alias("conv"), rows.col("turn").cast("long").alias("turn"), "plain", "passages")
    read = materialize(read, "messages")
    keyed = read.filter("conv is not null and turn is not null")
    passages = materialize(keyed.select("conv", "turn", F.explode("passages").alias("x")).select("conv", "turn", "x.*").distinct(), "passages")
    found = latest(passages, holders(passages, keyed.select("conv", F.col("turn").alias("source"), "plain")))
    parents = found.groupBy("conv", "turn").agg(F.min_by("source", F.struct("level", "no")).alias("parent"), F.countDistinct("level", "no").alias("n_links"))
    parents = materialize(parents, "parents")
    links = parents.join(threads(parents), ["conv", "turn"]).withColumnsRenamed({"conv": "x_c", "turn": "x_t"})
    return read.select("conv", "turn"), materialize(links, "links")


def placed(rows: Rows, text: str, links: DataFrame) -> DataFrame:
    """The rows' frame with own, n_quoted, parent, root, depth and n_links."""
    turn = rows.col("turn").cast("long")
    out = parse(rows, text).drop("plain", "passages").join(links, (rows.col("conv_id") == F.col("x_c")) & (turn == F.col("x_t")), "left")
    return out.withColumns({"root": F.coalesce("root", turn), "depth": F.coalesce("depth", F.lit(0)).cast("long"), "n_links": F.coalesce("n_links", F.lit(0)).cast("long")})


def results() -> dict[str, Column]:
    return dict(zip(ADDED, map(F.col, ("own", "parent", "root", "depth", "n_quoted", "n_links")), strict=True))


def link(messages: DataFrame, text: str = "text") -> DataFrame:
    """messages with own, parent_turn, root_turn, depth, n_quoted and n_links."""
    rows = Rows(messages, *ADDED)
    return rows.out(placed(rows, text, links_of(rows, text)[1]), **results())


def bins(frame: DataFrame, conv: Column, root: Column, turn: Column) -> DataFrame:
    """frame with the hashes that stand for its conversation (x_k), thread (x_h) and SPAN turns of it (x_b), null or not."""
    return frame.withColumns({"x_k": F.xxhash64(conv), "x_h": F.xxhash64(root), "x_b": F.xxhash64(F.floor(turn / SPAN))})


def conversations(messages: DataFrame, text: str = "text") -> DataFrame:
    """link()'s rows with seq, in reply order: sorted by conversation, thread and turn.

    seq is a message's place among its conversation's messages in this order, from 0, counted by bins of SPAN
    turns of a thread, so that a long conversation is many tasks."""
    rows = Rows(messages, *ADDED, "seq")
    keys, links = links_of(rows, text)
    key = ["x_k", "x_h", "x_b"]
    every = keys.join(links, (F.col("conv") == F.col("x_c")) & (F.col("turn") == F.col("x_t")), "left").select("conv", F.coalesce("root", "turn").alias("root"), "turn")
    sizes = bins(every, F.col("conv"), F.col("root"), F.col("turn")).groupBy(*key).agg(F.count(F.lit(1)).alias("x_n"), F.min("root").alias("x_r"), F.min("turn").alias("x_t"))
    before = Window.partitionBy("x_k").orderBy("x_r", "x_t").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*key, F.coalesce(F.sum("x_n").over(before), F.lit(0)).alias("x_s"))
    turn = rows.col("turn").cast("long")
    frame = bins(placed(rows, text, links).drop("x_c", "x_t"), rows.col("conv_id"), F.col("root"), turn).join(sizes, key)
    seq = F.col("x_s") + F.row_number().over(Window.partitionBy(*key).orderBy(turn, F.xxhash64("own"))) - 1
    return rows.out(frame, **results(), seq=seq.cast("long")).orderBy("conv_id", "seq")
