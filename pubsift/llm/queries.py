"""The registered queries of the training-data operators, at production settings."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pubsift.llm import (counting, decontam, licenses, neardup, packing, periodic, quality, quoting, sharding, toxicity,
                         warc, whitening, wrapper)
from pubsift.llm.common import table


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_texts(table(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.length("text").cast("long"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = toxicity.scorer(spark, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return (docs.select("doc_id", toxicity.held_out().alias("held_out"), score("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quoting.link_conversations(spark, table(spark, sf_dir, "conversations"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = decontam.scanner(spark, table(spark, sf_dir, "benchmark"), spans=False)
    found = table(spark, sf_dir, "documents").select("doc_id", scan("text").alias("r"))
    listed = F.array_join(F.array_sort(F.transform("r.items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "r.n_words", "r.n_hit", "r.n_items", F.sha2(listed, 256).alias("items_sha256"),
                        decontam.is_contaminated(F.col("r")).alias("contaminated"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judger(spark, quality.fit(docs, table(spark, sf_dir, "labels")))
    return docs.select("doc_id", judged("text").alias("r")).select("doc_id", "r.*")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), *packing.default_paths())
    return packing.pack(pieces)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(spark, table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = warc.archive_pages(spark, table(spark, sf_dir, "pages"))
    return warc.read_records(manifest, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_extract, op2_neardup, op3_toxicity, op4_quotes, op5_decontam, op6_licenses,
                                   op7_quality, op8_packing, op9_sharding, op10_warc, op11_tokens, op12_runs,
                                   op13_whitening)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op2_neardup": f"""
with recursive words as (select doc_id, {_TOKENS} as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by 1),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as shared
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select x, y from pairs p join sizes a on a.doc_id = p.x join sizes b on b.doc_id = p.y
  where 100 * shared >= 75 * (a.n + b.n - shared)),
reach as (
  select doc_id as root, doc_id as other from documents
  union select r.root, l.y from reach r join links l on l.x = r.other),
least as (select root as doc_id, min(other) as component_id from reach group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join least using (doc_id) left join sizes using (doc_id)""",
    "op5_decontam": f"""
with items as (select item_id, {_LETTERS} as w from benchmark),
windows as (
  select distinct item_id, least(13, len(w)) as k,
    unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) as s
  from items where len(w) > 0),
docs as (select doc_id, {_LETTERS} as w from documents),
places as (
  select doc_id, k, unnest(range(1, len(w) - k + 2)) as i, w from docs, (select distinct k from windows) where len(w) >= k),
found as (
  select p.doc_id, p.i, p.k, x.item_id from places p join windows x
  on x.k = p.k and x.s = array_to_string(p.w[p.i:p.i + p.k - 1], ' ')),
hits as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from found) group by 1),
named as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
  from found group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hits using (doc_id) left join named using (doc_id)""",
    "op10_warc": """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
  from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, p.payload_digest,
  case when first <> page_id then 'revisit' else 'response' end as record_type,
  case when first <> page_id then first end as refers_to
from p left join f on f.payload_digest = p.payload_digest and payload_bytes >= 100""",
}
