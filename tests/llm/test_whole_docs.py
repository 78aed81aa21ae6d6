"""Near copies that share an id, and the decision of the language stage."""

from pyspark.sql import functions as F

import corpus_pipeline
from isoloom.llm import language_id, near_dedup


def test_near_copies_of_texts_that_share_an_id(spark):
    one, two, three = (" ".join(f"{x}{k}" for k in range(80)) for x in "abc")
    docs = [(5, one), (5, two), (5, two), (6, one + " more"), (7, two + " more"), (8, two), (3, three), (9, three + " more"), (9, one), (4, "alone in its words")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = [5, 5, 5, 5, 5, 5, 3, 3, 5, 4]
    assert sorted((r.doc_id, r.component_id) for r in near_dedup.summary(d).collect()) == sorted((i, c) for (i, _), c in zip(docs, want))
    assert sorted(map(tuple, near_dedup.dedup(d).collect())) == sorted(x for x, c in zip(docs, want) if x[0] == c)


def test_language_stage_decides(spark):
    """A wrong or missing label gives way to the language of the text; a text without letters goes."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    sure = language_id.predict(docs, language_id.fit(docs)).filter((F.col("lang") == F.col("lang_pred")) & (F.col("score") > 0.2) & language_id.held_out())
    right = {r.doc_id: r.lang for r in sure.select("doc_id", "lang").orderBy("doc_id").limit(6).collect()}
    assert len(right) == 6
    ids = sorted(right)
    other = F.when(F.col("lang") == "en", "de").otherwise("en")
    spoilt = docs.withColumn("lang", F.when(F.col("doc_id").isin(ids[:4]), other).when(F.col("doc_id").isin(ids[4:]), None).otherwise(F.col("lang")))
    spoilt = spoilt.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit("12 !"), "lang": F.lit("en")}))
    got = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, spoilt, d).select("doc_id", "lang").collect()}
    assert {i: got[i] for i in ids} == right and -1 not in got
