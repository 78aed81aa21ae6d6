"""Queries over whole tables that apply each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, language_id, license_scan, line_dedup, near_dedup, quote_links, sentence_pieces, substring_dedup, token_counts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.summary(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.summary(decontaminate.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(documents(spark, sf_dir)))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(documents(spark, sf_dir))


def op7_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quote_links.conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "seq", "turn", "role", "parent_turn", "root_turn", "depth", "n_quoted", "n_links", F.sha2("own", 256).alias("own_sha256"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.summary(documents(spark, sf_dir), size=4)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_totals(documents(spark, sf_dir), token_counts.read_vocabulary(sentence_pieces.MODEL))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.mark_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sentence_pieces, op2_language_id, op3_decontaminate, op4_line_dedup, op5_license_scan, op6_exact_dedup, op7_quote_links, op8_near_dedup, op9_token_counts, op10_substring_dedup)
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = _LOW.format("coalesce(text, '')")
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORD = r"'[^\x20\x09-\x0D]+'"

ORACLES: dict[str, str] = {
    "op3_decontaminate": rf"""
with d as (select doc_id, regexp_extract_all({_TEXT}, {_ALNUM}) w from documents),
i as (select item_id, regexp_extract_all({_TEXT}, {_ALNUM}) w from benchmark where item_id is not null),
p as (select distinct item_id, least(8, len(w)) m, array_to_string(w[k:k + least(8, len(w)) - 1], ' ') s
      from (select item_id, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) k from i where len(w) > 0)),
s as (select distinct m from p),
x as (select doc_id, m, unnest(range(1, len(w) - m + 2)) k, w from d, s where len(w) >= m),
h as (select x.doc_id, x.k, x.m, p.item_id from x join p on p.m = x.m and p.s = array_to_string(x.w[x.k:x.k + x.m - 1], ' ')),
c as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(k, k + m)) q from h) group by 1),
n as (select doc_id, count(*) n_items, string_agg(id, ',' order by id) ids from (select distinct doc_id, cast(item_id as varchar) id from h) group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
from d left join c using (doc_id) left join n using (doc_id)""",
    "op4_line_dedup": rf"""
with l as (select doc_id, pos, line, {_LOW.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} k
           from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos from documents)),
c as (select k, max(doc_id) keep from l where length(k) >= 20 group by k having count(distinct doc_id) >= 3)
select doc_id, count(*) n_lines, count(*) filter (keep is not null and keep <> doc_id) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (keep is null or keep = doc_id), '')) kept_sha256
from l left join c using (k) group by doc_id""",
    "op6_exact_dedup": """
select doc_id, max(doc_id) over w keep_id, count(*) over w group_size, doc_id = max(doc_id) over w kept, sha256(coalesce(text, '')) text_sha256
from documents window w as (partition by coalesce(text, ''))""",
    "op8_near_dedup": rf"""
with recursive d as (select doc_id, regexp_extract_all({_TEXT}, {_WORD}) w from documents),
s as (select distinct doc_id, array_to_string(w[k:k + 3], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) k from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
j as (select a.doc_id a, b.doc_id b, count(*) x from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from j join n p on p.doc_id = a join n q on q.doc_id = b where 100 * x >= 80 * (p.n + q.n - x)),
r as (select doc_id, doc_id v from d union select r.doc_id, e.b from r join e on e.a = r.v)
select d.doc_id, coalesce(n, 0) n_shingles, c component_id, d.doc_id = c kept
from d left join n using (doc_id) join (select doc_id, min(v) c from r group by 1) using (doc_id)""",
    "op10_substring_dedup": rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) w from documents),
x as (select doc_id, k, array_to_string(w[k:k + 34], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 33)) k from d where len(w) >= 35)),
r as (select doc_id, k from (select doc_id, k, count(*) over (partition by g) n from x) where n > 1),
c as (select distinct doc_id, unnest(range(k, k + 35)) p from r),
g as (select doc_id, list(p) ps, count(*) n from c group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n, 0) n_removed,
       sha256(coalesce((select string_agg(t.v, ' ' order by t.i) from (select unnest(w) v, unnest(range(1, len(w) + 1)) i) t where not coalesce(list_contains(ps, t.i), false)), '')) kept_sha256
from d left join g using (doc_id)""",
}
