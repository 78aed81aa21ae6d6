"""License scans: exact set-similarity join of text blocks with templates, in DataFrame operations only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lowered. Templates fall into classes by
their length: class c has blocks of BLOCK * 2^c words, of which a new one begins every half block, so that every
run of half a block and one word lies in a block; a template is in the first class in which it is such a run.
So notices and whole license texts are both found. A template matches a block of its class when the block holds
at least ceil(threshold * size) of the template's different words.

The join is the prefix join for containment. The words of the templates are ordered by their frequency in
the whole corpus, rarest first, and a template with size words of which need must be found is indexed under
its first size - need + 1 words. A block meets a template through any such word (prefix filter), and must
hold at least need words of the templates' vocabulary (length filter). At the first common word, at place
i of the template and j of the block's own ordered words, no more than 1 + min(words behind i, words
behind j) can be common (positional filter). What passes is verified on the whole sets. Each vocabulary word
of a text goes to its blocks once, so that the work grows in proportion to a text.

Phrases are templates that need all their words; of each place that the join finds, the words must then
stand consecutively, and the place counts in the block in whose first half it begins. Null text has no words.
Rows are kept apart by (doc_id, hash of the text); rows that agree in both get the same result. Ids are of any
type. Extra columns are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM_GAP, Rows, ascii_lower, materialize

BLOCK, THRESHOLD = 64, 0.8
#: The phrases of the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices and texts as their licenses word them.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
    "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties "
    "of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
    "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code "
    "must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this "
    "list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by": "cc",
    "creative commons attribution license": "cc",
}


def class_of(words: int, block: int = BLOCK) -> int:
    """The first class of which half a block and one word hold so many words."""
    c = 0
    while words > (block << c) // 2 + 1:
        c += 1
    return c


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """For each row doc_id, n_words, and the matches: array of (name, label, base, class, block, score, places)."""
    spark, docs = docs.sparkSession, Rows(docs)
    templates = [(k, label, base, sorted({*k.split()}), k.split()) for base, texts in ((True, phrases), (False, notices)) for k, label in texts.items()]
    vocabulary = sorted({w for *_, words, _ in templates for w in words})
    words = F.filter(F.split(ascii_lower(docs.body(text)), ALNUM_GAP), lambda w: w != "")
    known = F.array(*map(F.lit, vocabulary))
    rows = docs.frame.select(docs.col(doc_id).alias("id"), F.xxhash64(docs.body(text)).alias("t"), words.alias("words"))
    spots = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("at"), w.alias("w")))), lambda x: x.isNotNull())
    rows = rows.select("id", "t", F.size("words").cast("long").alias("n_words"), F.transform(spots, lambda x: F.struct(x["at"].alias("at"), F.array_position(known, x["w"]).cast("int").alias("w"))).alias("spots"))
    rows = materialize(rows, "spots")

    counted = dict(rows.select(F.explode("spots.w").alias("w")).groupBy("w").count().collect())  # a row for each word of the templates
    order = sorted(range(len(vocabulary)), key=lambda k: (counted.get(k + 1, 0), vocabulary[k]))
    rank = {vocabulary[k]: r for r, k in enumerate(order)}
    ranks = F.array(*[F.lit(rank[w]) for w in vocabulary])
    prefix, full = [], []
    for number, (name, label, base, distinct, seq) in enumerate(templates):
        own = sorted(rank[w] for w in distinct)
        need = len(own) if base else math.ceil(threshold * len(own) - 1e-9)
        c = class_of(len(seq), block)
        full.append((number, name, label, base, own, [rank[w] for w in seq]))
        prefix += [(c, r, number, i, len(own), need) for i, r in enumerate(own[: len(own) - need + 1])]
    index = F.broadcast(spark.createDataFrame(prefix, "class int, r int, template int, i int, size int, need int"))  # bounded by the list of templates
    listed = F.broadcast(spark.createDataFrame(full, "template int, name string, label string, base boolean, own array<int>, seq array<int>"))

    firsts = sorted({p[1] for p in prefix})
    ranked = rows.select("id", "t", F.transform("spots", lambda x: F.struct(x["at"].alias("at"), F.get(ranks, x["w"] - 1).alias("r"))).alias("spots"))
    ranked = ranked.filter(F.exists("spots", lambda x: x["r"].isin(firsts))).select("id", "t", F.explode("spots").alias("x")).select("id", "t", "x.at", "x.r")
    # a word lies in the block of the half that it is in, and in the one before
    halves = [(c, (block << c) // 2) for c in sorted({p[0] for p in prefix})]
    homes = F.array(*[F.struct(F.lit(c).alias("class"), (F.floor(F.col("at") / half) - back).cast("int").alias("block"), F.lit(half).alias("half")) for c, half in halves for back in (0, 1)])
    dealt = ranked.select("id", "t", F.struct("at", "r").alias("x"), F.explode(homes).alias("b")).select("id", "t", "b.class", "b.block", "b.half", "x").filter("block >= 0")
    # rows that agree in id and text give the same words
    blocks = dealt.groupBy("id", "t", "class", "block", "half").agg(F.collect_set("x").alias("spots")).withColumn("held", F.array_sort(F.array_distinct(F.col("spots.r"))))
    probes = blocks.select("id", "t", "class", "block", "half", "spots", "held", F.posexplode("held").alias("j", "r")).filter(F.col("r").isin(firsts))
    met = probes.join(index, ["class", "r"]).filter((F.size("held") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("i") - 1, F.size("held") - F.col("j") - 1) >= F.col("need")))
    met = met.join(listed, "template")
    # a block meets a template through its first common prefix word alone
    met = met.filter(F.array_min(F.array_intersect("own", "held")) == F.col("r"))
    met = met.withColumn("common", F.size(F.array_intersect("own", "held"))).filter(F.col("common") >= F.col("need"))
    by_place = lambda at: F.forall(F.transform("seq", lambda r, k: F.struct((at + k).alias("at"), r.alias("r"))), lambda x: F.array_contains(F.col("spots"), x))
    owned = F.filter("spots", lambda x: (x["r"] == F.get(F.col("seq"), F.lit(0))) & (x["at"] < (F.col("block") + 1) * F.col("half")))
    places = F.when(F.col("base"), F.filter(F.transform(owned, lambda x: x["at"]), by_place)).otherwise(F.array().cast("array<int>"))
    met = met.select("id", "t", F.struct("name", "label", "base", "class", "block", (F.col("common") / F.col("size")).alias("score"), places.alias("places")).alias("m")).filter(~F.col("m.base") | (F.size("m.places") > 0))
    met = met.groupBy("id", "t").agg(F.collect_set("m").alias("matches"))
    none = F.array().cast(met.schema["matches"].dataType)
    found = rows.select("id", "t", "n_words").join(met.withColumnsRenamed({"id": "i", "t": "u"}), F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("u")), "left")
    return found.select(F.col("id").alias(doc_id), "n_words", F.coalesce("matches", none).alias("matches"))


def summary(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row a document of what scan() finds: numbers, first and last place, labels, and the best score."""
    places = F.flatten(F.transform(F.filter("matches", lambda m: m["base"]), lambda m: m["places"]))
    label = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return found.withColumn("p", places).select(
        doc_id, "n_words", F.size("p").cast("long").alias("n_base"), F.array_min("p").cast("long").alias("first_word"), F.array_max("p").cast("long").alias("last_word"),
        label(F.filter("matches", lambda m: m["base"])).alias("base_labels"), label(F.col("matches")).alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
