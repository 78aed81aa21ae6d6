"""MinHash near-dedup: a multi-index Hamming join of b-bit signatures.

A document's set is its distinct shingles of `size` words (`[^\\x20\\x09-\\x0D]+`, A-Z lowered); with fewer
words the whole sequence is its one shingle; without words the set is empty and linked with nothing. Two
documents are linked if the Jaccard similarity of their sets is at least `percent` / 100.

1. Each document gets SYMBOLS minima of its shingles' hashes, cut to 16 bits each, and a 128-bit digest of
   its set. Documents with one set are a class, represented by the smallest id: copies go no further. Classes
   are numbered, as one id can be the smallest of several; from here to 4 ids are these numbers. Shingles are
   hashed by polynomials modulo 2^61 - 1 whose bases are drawn for the run.
2. Signatures are split into CHUNKS chunks. If two signatures differ in at most RADIUS = CHUNKS * (ERRORS +
   1) - 1 symbols, some chunk differs in at most ERRORS, so that the chunk without some ERRORS of its symbols
   agrees: all such choices are keys, and no pair within the radius is lost. At similarity 0.8 a pair is
   beyond it with probability 1.2e-5 (binomial, 25 symbols), and most of those meet all the same.
3. Representatives that share a key are candidates. Buckets aren't expanded to pairs. First every member is
   held against the bucket's pivot, the member that shares most keys with others; links are confirmed on the
   full sets and their components formed. Then only pairs of different components are left: buckets that hold
   more than one are dealt into blocks of BLOCK members, and pairs of blocks are compared in numpy by parity
   maps: bit k of a map tells whether the set has an odd number of shingles whose hash falls on k, so that two
   sets differ in at least as many shingles as their maps in bits. Pairs for which this bound allows a link
   are confirmed on the full sets. No bucket is capped and no pair skipped. Full sets hold BLAKE2b hashes of
   the shingles' own words, under a key drawn for the run.
4. Components of all links, by alternating star contraction; the smallest id of a component names it.

Keys, pivots and hubs that hold a large share of the rows are dealt over many tasks (`shared.spread_join`).

Ids are of any type that can be ordered. Rows with the same doc_id count as copies of one document where their
texts agree, else as documents that share an id; null doc_id forms no links and names nothing (component_id
null). Null text is empty. Wherever two rows' sets agree, they get the same component. A long text is one set
like others. Extra columns pass through `dedup`, whatever their names, and are not read by `link`. Empty tables
give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .shared import NOT_SPACE, TO_LOWER, Rows, as_list, chunks, discard, draw, free_shuffles, joined, materialize, mix, spread_join, window_hashes, word_hashes, words_of

SIZE, PERCENT = 5, 80
SYMBOLS, CHUNKS, ERRORS, BLOCK = 25, 5, 2, 256
#: Bits of a parity map for each shingle, and its smallest and largest size in bits.
MAP_BITS, MAP_LEAST, MAP_MOST = 8, 1024, 65_536
#: Ids of candidates up to this number are broadcast to read their texts (24 bytes each); more are joined.
MOST_BROADCAST = 1_000_000


def multipliers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(seed | 1)) | np.uint64(1)


def minima(hashes: np.ndarray, counts: np.ndarray, n: int, seed: int) -> np.ndarray:
    """By row n minima over its hashes, as 16-bit symbols; every row has a hash."""
    out = np.empty((len(counts), n), np.uint16)
    at = np.cumsum(counts) - counts
    for k, a in enumerate(multipliers(n, seed)):
        h = hashes * a
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC9B18F3D7A5E6B47)
        low = np.minimum.reduceat(h, at)
        out[:, k] = (mix(low) >> np.uint64(48)).astype(np.uint16)
    return out


def places(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and number of words of each shingle."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[:-1][row]
    return row, at, np.minimum(n, size)[row]


def distinct(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes, ordered by row and hash, and their number by row."""
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint16) if rows < 1 << 16 else row[order], kind="stable")]
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=rows)


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int, seed: tuple[int, int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ordered by row and hash, and their number by row."""
    buf = TO_LOWER[buf]
    start, end, first = words_of(buf, off, NOT_SPACE)
    words = word_hashes(buf, start, end, seed)
    row, at, width = places(first, size)
    h = np.empty(len(at), np.uint64)
    for m in np.unique(width).tolist():
        own = width == m
        h[own] = window_hashes(words, m, seed)[at[own]]
    return distinct(h, row, len(off) - 1)


def exact_sets(buf: np.ndarray, off: np.ndarray, size: int, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets by BLAKE2b of the shingles' words, joined by blanks."""
    buf = TO_LOWER[buf]
    start, end, first = words_of(buf, off, NOT_SPACE)
    row, at, width = places(first, size)
    text, begin, stop = joined(buf, start, end)
    text, blake = memoryview(text), hashlib.blake2b
    digests = [blake(text[x:y], digest_size=8, key=key).digest() for x, y in zip(begin[at].tolist(), stop[at + width - 1].tolist(), strict=True)]
    return distinct(np.frombuffer(b"".join(digests), np.uint64), row, len(off) - 1)


def signatures(texts: DataFrame, size: int, seed: tuple[int, int, bytes]) -> DataFrame:
    """(id, t, n, d1, d2, sig): n the size of the set, d1 and d2 its digest. texts: (id, t, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, buf, off in chunks(whole, "text"):
                h, n = shingle_sets(buf, off, size, seed)
                some = n > 0
                sums = [np.zeros(len(n), np.uint64) for _ in range(2)]
                sig = np.zeros((len(n), SYMBOLS), np.int32)
                if len(h):
                    at = (np.cumsum(n) - n)[some]
                    sums[0][some], sums[1][some] = np.add.reduceat(mix(h), at), np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), at)
                    sig[some] = minima(h, n[some], SYMBOLS, 0x2545F4914F6CDD1D)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), as_list(sig.ravel(), np.full(len(n), SYMBOLS), pa.int32())], ["id", "t", "n", "d1", "d2", "sig"])

    added = [StructField(x, LongType()) for x in ("t", "n", "d1", "d2")]
    return texts.mapInArrow(run, StructType([texts.schema["id"], *added, StructField("sig", ArrayType(IntegerType()))]))


WIDTH = SYMBOLS // CHUNKS
#: The symbols of each key: chunks without each choice of ERRORS symbols.
CHOICES = [held for c in range(CHUNKS) for held in combinations(range(c * WIDTH, (c + 1) * WIDTH), WIDTH - ERRORS)]


def keys(sig: Column) -> Column:
    return F.array(*[F.xxhash64(F.lit(number), *[F.get(sig, F.lit(k)) for k in held]) for number, held in enumerate(CHOICES)])


def parity_map(hashes: np.ndarray) -> bytes:
    bits = min(max(1 << int(MAP_BITS * len(hashes) - 1).bit_length(), MAP_LEAST), MAP_MOST)
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(maps: np.ndarray, size: int) -> np.ndarray:
    """Parity maps (rows of bytes) brought to size bytes."""
    while maps.shape[1] > size:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def sets_of(texts: DataFrame, ids: DataFrame, size: int, key: bytes) -> DataFrame:
    """(id, shingles sorted, map) of the representatives, which are given by (id, rep, t): number, doc_id, hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, buf, off in chunks(whole, "text"):
                h, n = exact_sets(buf, off, size, key)
                at = np.concatenate([[0], np.cumsum(n)])
                maps = [parity_map(h[at[k] : at[k + 1]]) for k in range(len(n))]
                yield pa.RecordBatch.from_arrays([b.column(0), as_list(h.view(np.int64), n, pa.int64()), pa.array(maps, pa.binary())], ["id", "shingles", "map"])

    few = ids.count() <= MOST_BROADCAST
    wanted = ids.select("id", F.col("rep").alias("x_i"), F.col("t").alias("x_t"))
    rows = texts.withColumnRenamed("id", "rep").join(F.broadcast(wanted) if few else wanted, (F.col("rep") == F.col("x_i")) & (F.col("t") == F.col("x_t")))
    # rows repeated with id and text are one
    return rows.select("id", "text").mapInArrow(run, "id long, shingles array<long>, map binary").dropDuplicates(["id"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), a materialized table, those linked on their full sets."""
    one, two = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    counts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("x_n"))
    met = spread_join(spread_join(pairs, one, ["a"], by=["b"]), two, ["b"], by=["a"], counts=counts, total=pairs.count(), parts=4)
    met = met.filter((100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb"))))
    both = F.size(F.array_intersect("sa", "sb"))
    return met.withColumn("x", both).filter(100 * F.col("x") >= percent * (F.size("sa") + F.size("sb") - F.col("x"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of all ends of edges (a, b): comp is the smallest id that can be reached."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    before, n = None, edges.count()
    while True:
        # large star: neighbours above a node go to the smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("x_n"))
        met = spread_join(both, low.select("a", F.least("a", "m").alias("m")), ["a"], by=["b"], counts=low, total=2 * n)
        large = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        # small star: neighbours below a node, and itself, go to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("x_n"))
        met = spread_join(large, least.select("a", "m"), ["a"], by=["b"], counts=least, total=n)
        after = materialize(met.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a > b").distinct(), "stars")
        discard(edges)
        edges = after
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())


def across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a key and may be linked as far as their parity maps
    tell; a pair comes from the first key that it shares.

    members: (key, number, c, id, comp, n, sig, map) of buckets with more than one component; c is the most that
    a bucket can have. A task gets pairs of blocks, not buckets."""
    dealt = members.withColumn("x_blocks", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("x_blocks")).cast("int"))
    blocks = dealt.groupBy("key", "number", "block", "x_blocks").agg(F.collect_list(F.struct("id", "comp", "n", "sig", "map")).alias("m"))
    first = blocks.select("key", "number", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("x_blocks") - 1)).alias("j"), F.col("m").alias("one"))
    second = blocks.select("key", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("m").alias("two"))
    choices = np.array(CHOICES)

    def side(x: pa.Scalar) -> tuple:
        """ids, components, sizes, signatures, and by size of map the rows and their maps."""
        v = x.values
        maps = v.field(4).to_pylist()
        width = np.array([len(m) for m in maps])
        by = {int(w): (rows := np.flatnonzero(width == w), np.frombuffer(b"".join(maps[k] for k in rows), np.uint8).reshape(-1, w)) for w in np.unique(width)}
        return *[v.field(k).to_numpy(zero_copy_only=False) for k in range(3)], np.array(v.field(3).to_pylist(), np.int32).reshape(-1, SYMBOLS), by

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for number, x, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                (i, c, n, s, maps), (j, d, m, r, others) = side(x), side(y)
                for own, (rows, own_maps) in maps.items():
                    for w, (columns, other_maps) in others.items():
                        least = min(own, w)
                        one, two = (np.ascontiguousarray(folded(z, least)).view(np.uint64) for z in (own_maps, other_maps))
                        for k, bits in zip(rows, one, strict=True):
                            o = columns
                            able = (d[o] != c[k]) & (100 * np.minimum(m[o], n[k]) >= percent * np.maximum(m[o], n[k]))
                            if not able.any():
                                continue
                            o = o[able]
                            apart = np.bitwise_count(two[able] ^ bits).sum(axis=1, dtype=np.int64)
                            total = n[k] + m[o]
                            # at most (total - apart) / 2 shingles are common
                            o = o[100 * (total - apart) >= percent * (total + apart)]
                            if len(o):
                                agree = (r[o] == s[k])[:, choices].all(axis=2)
                                found.update((max(int(i[k]), z), min(int(i[k]), z)) for z in j[o[agree.argmax(axis=1) == number]].tolist())
            pairs = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])

    return first.join(second, ["key", "i", "j"]).select("number", "one", "two").mapInArrow(run, "a long, b long").distinct()


def link(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """For each row doc_id, t (hash of the text), n_shingles and component_id."""
    spark, seed, rows = docs.sparkSession, draw(), Rows(docs)
    texts = rows.frame.select(rows.col(doc_id).alias("id"), F.xxhash64(rows.body(text)).alias("t"), rows.col(text).alias("text"))
    sigs = materialize(signatures(texts, size, seed), "signatures")
    some = sigs.filter("n > 0 and id is not null")
    reps = some.groupBy("n", "d1", "d2").agg(F.min(F.struct("id", "t")).alias("least"), F.first("sig").alias("sig"))
    reps = reps.select("n", "d1", "d2", F.col("least.id").alias("rep"), F.col("least.t").alias("t"), "sig", F.monotonically_increasing_id().alias("id"))
    reps = materialize(reps, "classes")
    free_shuffles(spark)
    every, total = reps.select("id", F.posexplode(keys(F.col("sig"))).alias("number", "key")), len(CHOICES) * reps.count()
    shared = materialize(every.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shared")
    hot = {"by": ["id"], "counts": shared.select("key", F.col("c").alias("x_n")), "total": total}
    buckets = materialize(spread_join(every, shared, ["key"], **hot), "buckets")
    free_shuffles(spark)
    mass = buckets.groupBy("id").agg(F.sum(F.log("c")).alias("mass"))
    able = materialize(mass.join(reps.select("id", "rep", "t"), "id"), "candidates")
    sets = materialize(sets_of(texts, able.select("id", "rep", "t"), size, seed[2]), "sets")
    pivots = buckets.join(able.select("id", "mass"), "id").groupBy("key").agg(F.max_by("id", "mass").alias("b"))
    hot["total"] = buckets.count()
    stars = materialize(spread_join(buckets.select("key", "id"), pivots, ["key"], **hot).filter("id <> b").select(F.col("id").alias("a"), "b").distinct(), "pairs")
    links = materialize(confirm(stars, sets, percent), "links")
    free_shuffles(spark)
    comps = components(links)
    held = materialize(buckets.select("key", "number", "id", "c").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "held")
    discard(buckets, stars)
    mixed = held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("x_c")).filter("lo <> hi and x_c > 2").select("key")
    maps = sets.select("id", F.size("shingles").alias("n"), "map").join(reps.select("id", "sig"), "id")
    members = spread_join(held, mixed, ["key"], **hot).join(maps, "id")
    near = materialize(across(members, percent), "pairs")
    more = materialize(confirm(near, sets, percent), "links")
    free_shuffles(spark)
    final = materialize(components(links.unionByName(more)), "components")
    discard(held, near, sets, able, shared)
    # every row finds its class, and the class its component
    found = reps.select("n", "d1", "d2", "rep", "id").join(final, "id", "left")
    names = found.filter("comp is not null").groupBy("comp").agg(F.min("rep").alias("name"))
    named = found.filter("comp is not null").join(names, "comp").select("n", "d1", "d2", F.col("name").alias("comp")).unionByName(found.filter("comp is null").select("n", "d1", "d2", F.col("rep").alias("comp")))
    named = materialize(named, "named")
    discard(final, links, more, reps)
    out = spread_join(some.select("id", "t", "n", "d1", "d2"), named, ["n", "d1", "d2"], by=["id", "t"])
    alone = sigs.filter("n = 0 or id is null").select("id", "t", "n", F.col("id").alias("comp"))
    return out.select("id", "t", "n", "comp").unionByName(alone).select(F.col("id").alias(doc_id), "t", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


def summary(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return link(docs, size, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedup(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose id names their component, with all their columns; empty texts all stay."""
    found, rows = link(docs, size, percent), Rows(docs)
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("x_i"), F.col("t").alias("x_t")).distinct()
    tagged = rows.frame.withColumn("x_h", F.xxhash64(rows.body("text")))
    return rows.out(tagged.join(gone, (rows.col("doc_id") == F.col("x_i")) & (F.col("x_h") == F.col("x_t")), "left_anti"))
