"""Tables in the shared folder, rows with any columns, joins with hot keys, and vectorised words and hashes of UTF-8 bytes."""

from __future__ import annotations

import atexit
import hashlib
import math
import pickle
import secrets
import sys
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space, as contracts name it: blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Separators of alphanumeric words: every ASCII character but 0-9 and a-z.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Name under which a Python worker keeps an operator's state from task to task.
HELD = "_isoloom_held"
#: A key is hot with more than 1 / HOT_SHARE of the rows (so that there are fewer than HOT_SHARE of them);
#: tables of up to FEW_ROWS rows have no hot keys.
HOT_SHARE, FEW_ROWS = 1000, 100_000
#: Folders that materialize() wrote and nothing has discarded yet.
_made: dict[str, SparkSession] = {}
_local: dict[str, str] = {}


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


class Rows:
    """The rows of a table under column names that can't clash: c0, c1, ... by place.

    Columns named like one of `added`, in any case, give way to it and are left out. Of several columns with a
    needed name the one in the same case counts, then the first."""

    def __init__(self, docs: DataFrame, *added: str):
        self.fields = docs.schema.fields
        self.frame = docs.toDF(*[f"c{i}" for i in range(len(self.fields))])
        gone = {a.lower() for a in added}
        self.kept = [i for i, f in enumerate(self.fields) if f.name.lower() not in gone]

    def at(self, name: str) -> str:
        same = [i for i, f in enumerate(self.fields) if f.name == name] or [i for i, f in enumerate(self.fields) if f.name.lower() == name.lower()]
        if not same:
            raise ValueError(f"no column {name}")
        return f"c{same[0]}"

    def col(self, name: str) -> Column:
        return F.col(self.at(name))

    def body(self, name: str) -> Column:
        """A text; null counts as empty."""
        return F.coalesce(self.col(name), F.lit(""))

    def own(self) -> list[Column]:
        """The columns that stay, under their names."""
        return [F.col(f"c{i}").alias(self.fields[i].name) for i in self.kept]

    def out(self, frame: DataFrame, **more: Column) -> DataFrame:
        return frame.select(*self.own(), *[c.alias(k) for k, c in more.items()])

    def mapped(self, run: Callable, added: list[StructField]) -> DataFrame:
        """The table with columns that mapInArrow adds: run takes batches of c0, c1, ... and gives those with the added ones behind."""
        whole = self.frame.mapInArrow(run, StructType([*self.frame.schema.fields, *added]))
        return self.out(whole, **{f.name: F.col(f.name) for f in added})


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """docs with these columns alone."""
    rows = Rows(docs)
    return rows.frame.select(*[rows.col(n).alias(n) for n in names])


def unused(docs: DataFrame, name: str) -> str:
    """name, with as many _ behind it as no column of docs has."""
    known = {c.lower() for c in docs.columns}
    while name.lower() in known:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only where one process does all
    (master local, as in tests) may it be unset; then it is a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _local:
        import tempfile

        _local[key] = tempfile.mkdtemp(prefix="isoloom-")
    return _local[key]


def new_path(spark: SparkSession, tag: str) -> str:
    if not _made:
        atexit.register(discard_all)
    path = f"{shared_dir(spark)}/isoloom-{tag}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it: later plans start from the files."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.isoloom_path = path
    return out


def _remove(path: str) -> None:
    context = _made.pop(path).sparkContext
    try:
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    except (Py4JError, AttributeError, OSError):
        return  # the JVM is gone, and with it the way to the folder


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that materialize() gave and no plan reads any more."""
    for t in tables:
        if t.isoloom_path in _made:
            _remove(t.isoloom_path)


def made() -> set[str]:
    """The folders that are there now, to give to discard_all() as those to keep."""
    return set(_made)


def discard_all(keep: set[str] = frozenset()) -> None:
    """Deletes all folders of materialize() but those to keep; at the end of the process, every one."""
    for path in [p for p in _made if p not in keep]:
        _remove(path)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", by: list[str] | None = None, counts: DataFrame | None = None, total: int | None = None, parts: int = 8) -> DataFrame:
    """left joined with right on keys that are not null.

    Keys that hold more than 1 / HOT_SHARE of left's rows, of which there are fewer than HOT_SHARE, are dealt
    out: left's rows over parts of 1 / parts of a partition each, by the hash of the columns `by`, and right's
    rows of these keys to each of them. No row is lost, and no task gets all rows of a key. The number of left's
    rows and (keys, x_n) of its keys can be given; else left is a materialized table, as it is read for them."""
    spark = left.sparkSession
    total = left.count() if total is None else total
    if total <= FEW_ROWS:
        return left.join(right, keys, how)
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("x_n")) if counts is None else counts
    most = counts.filter(F.col("x_n") * HOT_SHARE > total).select(*keys, "x_n").collect()
    if not most:
        return left.join(right, keys, how)
    share = parts * int(spark.conf.get("spark.sql.shuffle.partitions")) / total
    kinds = StructType([*[StructField(k, left.schema[k].dataType) for k in keys], StructField("x_parts", IntegerType())])
    hot = F.broadcast(spark.createDataFrame([(*r[: len(keys)], max(2, math.ceil(r.x_n * share))) for r in most], kinds))
    salt = F.pmod(F.xxhash64(*(by or [c for c in left.columns if c not in keys])), F.col("x_parts")).cast("int")
    one = left.join(hot, keys, "left").withColumn("x_part", F.coalesce(salt, F.lit(0))).drop("x_parts")
    two = right.join(hot, keys, "left").withColumn("x_part", F.explode(F.sequence(F.lit(0), F.coalesce("x_parts", F.lit(1)) - 1))).drop("x_parts")
    return one.join(two, [*keys, "x_part"], how).drop("x_part")


def send(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcasts a value of bounded size, by value like the package's functions; gives what reads it in a task."""
    sent = spark.sparkContext.broadcast(zlib.compress(cloudpickle.dumps(value), 1))  # a worker holds these bytes as long as it lives

    def read() -> object:
        sys.__dict__.get(HELD, {}).clear()  # what an operator before kept in this worker
        return pickle.loads(zlib.decompress(sent.value))

    return read


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files whose plans are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of a batch with about limit bytes of text each, one row at least; with bytes and offsets."""
    buf, off = bytes_of(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to
    pa.default_memory_pool().release_unused()


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: By byte: part of a word between ASCII white space; part of a word of digits, a-z and non-ASCII.
NOT_SPACE = ~_SPACE
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[0x41:0x5B] += 0x20


def words_of(buf: np.ndarray, off: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the number of its first word (one more at the end)."""
    inside = part[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[:-1][off[:-1] < off[1:]]
    first[edge] = inside[edge]
    edge = off[1:][off[:-1] < off[1:]] - 1
    last[edge] = inside[edge]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def joined(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words one after another, a blank behind each, and where each begins and ends."""
    size = end - start
    to = np.cumsum(size + 1)
    at = to - size - 1
    out = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1  # no two words touch but at the rows' edges, where both marks add up
    spot = np.ones(len(out), bool)
    spot[to - 1] = False
    out[spot] = buf[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    return out.tobytes(), at, at + size


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


PRIME = np.uint64((1 << 61) - 1)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**64 modulo 2**61 - 1."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Products modulo 2**61 - 1 of numbers below it."""
    ah, al, bh, bl = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    middle = al * bh + ah * bl
    return reduced(ah * bh * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31)) + al * bl)


def draw() -> tuple[int, int, bytes]:
    """What a run's hashes depend on: a base for bytes, one for words, and a key. The driver draws it and its
    tasks all use it, so that no text can be made to collide, and a task that runs again gives the same."""
    least, most = 1 << 32, (1 << 61) - 2
    return least + secrets.randbelow(most - least), least + secrets.randbelow(most - least), secrets.token_bytes(16)


#: Longer words than this many bytes are hashed by BLAKE2b; bytes that are hashed at once.
LONG_WORD, AT_ONCE = 4096, 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = np.uint64(base)
    while len(out) < n:
        out = np.concatenate([out, times(out, step)])
        step = times(np.array([step]), step)[0]
    return out[:n]


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: tuple[int, int, bytes]) -> np.ndarray:
    """Polynomials of the words' bytes modulo 2**61 - 1: different words agree with a probability of size / 2**61."""
    out = np.zeros(len(start), np.uint64)
    size = end - start
    power = powers(seed[0], min(int(size.max(initial=0)), LONG_WORD) or 1)
    low, high = power & _LOW31, power >> np.uint64(31)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + AT_ONCE, "right")))
        own, n = start[i:j] - start[i], size[i:j]
        part = buf[start[i] : min(end[j - 1], start[i] + AT_ONCE)]
        spot = np.arange(len(part), dtype=np.int64) - np.repeat(own, np.diff(np.append(own, len(part))))
        inside = spot < np.repeat(n, np.diff(np.append(own, len(part))))
        spot = np.minimum(spot, len(power) - 1)
        value = np.where(inside, part.astype(np.uint64) + np.uint64(1), np.uint64(0))
        a, b = np.add.reduceat(value * low[spot], own), np.add.reduceat(value * high[spot], own)
        out[i:j] = reduced(reduced(a) + (b >> np.uint64(30)) + ((b & _LOW30) << np.uint64(31)))
        i = j
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(buf[start[k] : end[k]].tobytes(), digest_size=8, key=seed[2]).digest(), "little") % int(PRIME)
    return out


def window_hashes(words: np.ndarray, size: int, seed: tuple[int, int, bytes]) -> np.ndarray:
    """Polynomials of every `size` consecutive word hashes, put together from windows of powers of two."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.array([seed[1]], np.uint64)
    block, width, out, done = words, 1, None, 0
    while True:
        if size & width:
            piece = block[done : done + n]
            out = piece if out is None else reduced(times(out, base[0]) + piece)
            done += width
        if 2 * width > size:
            return mix(out + np.uint64(size))
        block = reduced(times(block[:-width], base[0]) + block[width:])
        base = times(base, base[0])
        width *= 2


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words at which a window of size words of one row starts, and the window count by row."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    skip = np.cumsum(count) - count
    return np.arange(count.sum()) + np.repeat(first[:-1] - skip, count), count


def as_list(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the number of them by row."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
