"""Scans of SAM, GTF, FASTA, FASTQ, sequence pairs, barcode lists and count matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 65_536


def numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, no, value): lines with their number in the file, in order; read as whole splits."""
    lines = spark.read.text(path).withColumns({"path": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "__id": F.monotonically_increasing_id()})
    first = lines.groupBy("path", "block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    first = first.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return lines.join(F.broadcast(first), ["path", "block"]).select("path", (F.col("__before") + F.col("__id") - F.col("__first")).alias("no"), "value")


def inputs(spark: SparkSession, path: str) -> list[str]:
    """The SAM files that a path names: itself, those of a list (.txt, .tsv; # comments), or those of a folder, sorted."""
    if path.endswith(".sam"):
        return [path]
    if path.endswith((".txt", ".tsv")):
        listed = [r.value.strip() for r in spark.read.text(path).collect()]  # a list of inputs, read by the driver
        return [x for x in listed if x and not x.startswith("#")]
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(f.getPath().toString() for f in files if f.getPath().getName().endswith(".sam"))


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The files that a path, folder or pattern names, as `_metadata.file_path` writes them, an empty authority left out."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = [f for found in fs.globStatus(at) or () for f in (fs.listStatus(found.getPath()) if found.isDirectory() else [found])]
    return [f.getPath().toUri().toString().replace(":///", ":/") for f in listed]


def tag(fields: Column, prefix: str) -> Column:
    """The value of the first field longer than 11 letters that begins with prefix."""
    found = F.get(F.filter(F.slice(fields, 12, F.greatest(F.size(fields), F.lit(1))), lambda x: x.startswith(prefix) & (F.length(x) > 11)), F.lit(0))
    return found.substr(F.lit(len(prefix) + 1), F.length(found))


def sam(spark: SparkSession, paths: list[str], barcode_tag: str | None = None, umi_tag: str | None = None) -> DataFrame:
    """Alignments. With tags, barcode and umi come from the name (`BC[-1]_UMI#...`) or else from the tags, rows
    without either are dropped, the read is named BC-UMI, and its length is that of the qualities."""
    # one scan of all files; a file that is named twice is two samples
    names = spark.createDataFrame([(f, k) for k, path in enumerate(paths) for f in files_of(spark, path)], "file string, sample int")
    lines = spark.read.text(sorted(set(paths))).filter(~F.col("value").startswith("@")).withColumn("file", F.regexp_replace("_metadata.file_path", ":///", ":/"))
    out = lines.join(F.broadcast(names), "file", "left")  # a row for each input that the driver listed
    out = out.withColumn("sample", F.coalesce("sample", F.raise_error(F.concat(F.lit("a file of no sample: "), "file")).cast("int")))
    f = F.split("value", "\t")
    out = out.select("sample", f.alias("f")).filter(F.size("f") >= 11)
    at = lambda i: F.get(F.col("f"), F.lit(i))
    cols = [F.col("sample"), at(0).alias("read_id"), at(1).cast("int").alias("flag"), at(2).alias("chrom"), at(3).cast("int").alias("pos"), at(4).cast("int").alias("mapq"), at(5).alias("cigar"), F.length(at(9 if barcode_tag is None else 10)).alias("seq_len")]
    if barcode_tag is None:
        return out.select(*cols)
    name = r"^([ACGTN]+)(?:-\d+)?_([ACGTN]+)#"
    by_name = lambda i: F.nullif(F.regexp_extract(at(0), name, i), F.lit(""))
    strip = lambda c: F.regexp_replace(c, r"-\d+$", "")
    out = out.select(*cols, F.coalesce(by_name(1), strip(tag(F.col("f"), barcode_tag))).alias("barcode"), F.coalesce(by_name(2), tag(F.col("f"), umi_tag or "U8:Z:")).alias("umi"))
    out = out.filter((F.length("barcode") > 0) & (F.length("umi") > 0))
    return out.withColumn("read_id", F.concat_ws("-", "barcode", "umi"))


def attribute(column: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(column, rf'{name} "?([^";]+)"?', 1), F.lit(""))


def gtf(spark: SparkSession, path: str, features: tuple[str, ...] = ("exon",)) -> DataFrame:
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).select(f.alias("f")).filter(F.size("f") >= 9)
    at = lambda i: F.get(F.col("f"), F.lit(i))
    rows = rows.filter(at(2).isin(*features))
    return rows.select(at(0).alias("chrom"), attribute(at(8), "gene_id").alias("gene_id"), attribute(at(8), "transcript_id").alias("transcript_id"), attribute(at(8), "gene_name").alias("gene_name"), at(2).alias("feature"), at(6).alias("strand"), at(3).cast("int").alias("s"), at(4).cast("int").alias("e"))


def named(spark: SparkSession, path: str, level: str = "gene") -> DataFrame:
    """(id, name, chrom, start, end) of the genes or transcripts that an annotation lists, one row an id; the name is the id where it has none."""
    rows = gtf(spark, path, (level,)).withColumn("id", F.col(f"{level}_id")).filter("id is not null")
    return rows.groupBy("id").agg(F.min(F.coalesce("gene_name", "id")).alias("name"), F.min("chrom").alias("chrom"), F.min("s").alias("start"), F.max("e").alias("end"))


def headed(lines: DataFrame, head: str, width: int = 1 << 14) -> DataFrame:
    """lines (path, no, ...) with x_head, the last head that is not null up to a line, and x_block, the block of lines.

    Heads run over a row for each block, then inside the blocks, so that a file is many tasks."""
    lines = lines.withColumn("x_block", F.floor(F.col("no") / width))
    ends = lines.groupBy("path", "x_block").agg(F.max_by(head, F.when(F.col(head).isNotNull(), F.col("no"))).alias("x_before"))
    over = Window.partitionBy("path").orderBy("x_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("x_before", F.last("x_before", True).over(over))
    inside = Window.partitionBy("path", "x_block").orderBy("no")
    return lines.join(ends, ["path", "x_block"]).withColumn("x_head", F.coalesce(F.last(head, True).over(inside), "x_before")).drop("x_before")


def fasta(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(chrom, chunk_no, seq): chunks of one base more than chunk, so that two neighbours are in one."""
    lines = numbered(spark, path).withColumn("head", F.when(F.col("value").startswith(">"), F.split(F.expr("substring(value, 2)"), "[ \t]")[0]))
    body = headed(lines, "head").withColumnRenamed("x_head", "chrom").filter("head is null and chrom is not null")
    body = body.withColumn("seq", F.trim("value"))
    sizes = body.groupBy("path", "chrom", "x_block").agg(F.sum(F.length("seq")).alias("x_n"))
    over = Window.partitionBy("path", "chrom").orderBy("x_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("x_at", F.coalesce(F.sum("x_n").over(over), F.lit(0))).drop("x_n")
    before = Window.partitionBy("path", "chrom", "x_block").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    body = body.join(sizes, ["path", "chrom", "x_block"]).withColumn("at", F.col("x_at") + F.coalesce(F.sum(F.length("seq")).over(before), F.lit(0)))
    parts = F.sequence(F.floor(F.greatest(F.col("at") - 1, F.lit(0)) / chunk), F.floor((F.col("at") + F.greatest(F.length("seq"), F.lit(1)) - 1) / chunk))
    parts = body.withColumn("chunk_no", F.explode(parts))
    lo = F.greatest(F.col("at"), F.col("chunk_no") * chunk)
    hi = F.least(F.col("at") + F.length("seq"), (F.col("chunk_no") + 1) * chunk + 1)
    parts = parts.withColumn("lo", lo).withColumn("piece", F.expr(f"substring(seq, cast(lo - at + 1 as int), cast(least(at + length(seq), (chunk_no + 1) * {chunk} + 1) - lo as int))")).filter(hi > lo)
    return parts.groupBy("chrom", "chunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "piece"))), lambda x: x["piece"]), "").alias("seq"))


def reads(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, seq, qual) of FASTQ (4 lines) or FASTA (any number of lines); qual null for FASTA."""
    lines = numbered(spark, path)
    first = lines.filter("no = 0").select(F.substring("value", 1, 1)).first()
    if first and first[0] == "@":
        record = lines.groupBy("path", F.floor(F.col("no") / 4).alias("r")).agg(*[F.max(F.when(F.col("no") % 4 == k, F.col("value"))).alias(f"l{k}") for k in (0, 1, 3)])
        return record.select(F.split(F.expr("substring(l0, 2)"), "[ \t]")[0].alias("read_id"), F.col("l1").alias("seq"), F.col("l3").alias("qual"))
    owned = headed(lines.withColumn("own", F.when(F.col("value").startswith(">"), F.col("no"))), "own").withColumnRenamed("x_head", "r").filter("r is not null")
    out = owned.groupBy("path", "r").agg(F.max(F.when(F.col("no") == F.col("r"), F.col("value"))).alias("h"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("no") > F.col("r"), F.struct("no", "value")))), lambda x: x["value"]), "").alias("seq"))
    return out.select(F.split(F.expr("substring(h, 2)"), "[ \t]")[0].alias("read_id"), "seq", F.lit(None).cast("string").alias("qual"))


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(pair_id, pattern, text) of files with a `>` line and a `<` line for each pair."""
    lines = numbered(spark, path)
    return lines.groupBy("path", F.floor(F.col("no") / 2).alias("pair_id")).agg(F.max(F.when(F.col("no") % 2 == 0, F.expr("substring(value, 2)"))).alias("pattern"), F.max(F.when(F.col("no") % 2 == 1, F.expr("substring(value, 2)"))).alias("text")).drop("path")


def barcodes(spark: SparkSession, path: str, least: int = 8) -> DataFrame:
    """Different tokens of at least so many letters, without a `-N` behind."""
    tokens = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("t"))
    return tokens.filter(F.length("t") >= least).select(F.regexp_replace("t", r"-\d+$", "").alias("barcode")).distinct()


def whitelist(spark: SparkSession, path: str, size: int = 16, umi: int = 12) -> DataFrame:
    """(barcode, umis sorted) of lines with a barcode, one separator and a UMI; UMIs with other letters are left out."""
    rows = spark.read.text(path).select(F.substring("value", 1, size).alias("barcode"), F.substring("value", size + 2, umi).alias("umi"))
    return rows.groupBy("barcode").agg(F.array_sort(F.collect_set(F.when(F.col("umi").rlike(f"^[ACGT]{{{umi}}}$"), F.col("umi")))).alias("umis"))


def matrix(spark: SparkSession, path: str, ids: int = 1) -> DataFrame:
    """(id, [gene_id,] column, value) of a tab-separated matrix with ids first columns."""
    wide = spark.read.csv(path, sep="\t", header=True)
    first = wide.columns[:ids]
    return wide.unpivot(first, wide.columns[ids:], "column", "value").withColumn("value", F.col("value").cast("double"))
