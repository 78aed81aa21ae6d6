"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the shared folder,
hands the next stage what it reads back, and deletes what the stage itself wrote and the input it read.

Null text, and text without a letter, goes in the first stage, as it has no language. Null doc_id forms no
near-duplicates; of rows with one text the second stage keeps the largest doc_id, of rows repeated with id and
text one. lang becomes the predicted language. Columns are picked by name, so that extra ones pass all stages but
the last, whatever their names. A long text is one document in every stage. An empty table, and one in which
nothing stays, gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoloom.llm import decontaminate, exact_dedup, language_id, near_dedup, sentence_pieces
from isoloom.llm.shared import Rows, discard_all, made, materialize, pick, unused


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language; lang becomes the predicted one, labels are what it learns from."""
    names = [unused(docs, x) for x in ("lang_pred", "score")]
    rows = Rows(language_id.predict(docs, language_id.fit(docs), names=names), *names)
    known = rows.frame.filter(rows.col(names[0]) != language_id.UNKNOWN)
    return rows.out(known.withColumn(rows.at("lang"), rows.col(names[0])))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return near_dedup.dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of any benchmark item occurs."""
    names = [unused(docs, x) for x in ("n_words", "hits", "items")]
    rows = Rows(decontaminate.search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names=names), *names)
    return rows.out(rows.frame.filter(F.size(rows.col(names[2])) == 0))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids, their number, and whether they decode to the text."""
    out = sentence_pieces.encode(pick(docs, "doc_id", "lang", "source", "text"), decoded="decoded")
    return out.select("doc_id", "lang", "source", "tokens", F.size("tokens").cast("long").alias("n_tokens"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [("language_id", identify_language), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontaminate", drop_leaks), ("sentence_pieces", encode)]

#: Language ID, signatures and merges of a tokenizer aren't SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard_all(keep=before | {docs.isoloom_path})
    return docs
