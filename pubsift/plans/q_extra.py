"""Registered queries: remaining sources, functions and extension points."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pubsift.api import Collection
from pubsift.functions.text import cosine
from pubsift.operators import associations as A
from pubsift.operators import embeddings as EM
from pubsift.operators import text as X
from pubsift.plans.catalog import query
from pubsift.plans.common import (ASSOC_PATTERN, SQL_SENTS, TOPIC_ALL, TOPIC_ANY, TOPIC_NONE,
                                  normalize, sql_str)
from pubsift.plans.q_embeddings import SQL_ALL_SIMS, _targets
from pubsift.plans.q_search import _joined_tokens_sql, _match_sql
from pubsift.plans.q_text import SQL_STOKS
from pubsift.session import scratch_path
from pubsift.sources import files as FS
from pubsift.sources import tables as T
from pubsift.sources import xml_articles as XA


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _recs(df):
    return df.select("xml", F.lit("rendered").alias("file"), F.lit(0).alias("rec_pos"),
                     F.lit(0).alias("start"), F.lit(0).alias("length"))


@query("accession_numbers", oracle="""
select doc_id as pmid, 'GSE' || cast(doc_id as varchar) as accession from labels where quality = 1""")
def q_accession_numbers(spark, sf_dir):
    lab = T.read_table(spark, sf_dir, "labels")
    acc = lab.select(F.col("doc_id").alias("pmid"),
                     F.concat(F.when(F.col("quality") == 1, F.lit("GSE")).otherwise(F.lit("PRJ")),
                              F.col("doc_id").cast("string")).alias("accession"))
    recs = XA.render_article_xml(T.articles(spark, sf_dir), accessions=acc)
    return XA.accession_numbers(_recs(recs))


@query("author_names", oracle="""
select g.hgnc_id as pmid,
       case when g.hgnc_id % 5 = 0 then 'Group ' || g.symbol
            else g.symbol || ' ' || upper(replace(substr(coalesce(g.name, g.symbol), 1, 1), 'ß', 'ss')) end as authors
from gene_names g join articles a on a.pmid = g.hgnc_id""")
def q_author_names(spark, sf_dir):
    g = T.gene_names(spark, sf_dir)
    au = g.select(F.col("hgnc_id").alias("pmid"), F.lit(0).alias("pos"),
                  F.when(F.col("hgnc_id") % 5 != 0, F.col("symbol")).alias("last_name"),
                  F.when(F.col("hgnc_id") % 5 != 0,
                         F.upper(F.substr(F.coalesce("name", "symbol"), F.lit(1), F.lit(1))))
                  .alias("initials"),
                  F.when(F.col("hgnc_id") % 5 == 0, F.concat(F.lit("Group "), F.col("symbol")))
                  .alias("collective"))
    recs = _recs(XA.render_article_xml(T.articles(spark, sf_dir), authors=au))
    out = recs.select(F.xpath_long("xml", F.lit(XA.P_PMID)).alias("pmid"),
                      XA.author_list(F.col("xml")).alias("a"))
    return out.where(F.size("a") > 0).select("pmid", F.array_join("a", ",").alias("authors"))


@query("month_number", oracle="""
select pmid, month(date) as month from articles""")
def q_month_number(spark, sf_dir):
    a = T.articles(spark, sf_dir)
    names = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    from pubsift.functions.text import MONTH_NAMES, month_number

    mon = F.month("date")
    text = (F.when(F.col("pmid") % 3 == 0, F.lpad(mon.cast("string"), 2, "0"))
            .when(F.col("pmid") % 3 == 1, F.initcap(F.element_at(F.array(*map(F.lit, names)), mon)))
            .otherwise(F.upper(F.element_at(F.array(*map(F.lit, MONTH_NAMES)), mon))))
    return normalize(a.select("pmid", month_number(text).alias("month")))


@query("read_mesh_descriptors", oracle="""
select distinct meshid as id,
       case substr(meshid, 1, 2) when 'L_' then 'language ' || substr(meshid, 3)
                                 when 'S_' then 'source ' || substr(meshid, 3)
                                 else 'quality ' || substr(meshid, 3) end as name
from mesh""")
def q_read_mesh_descriptors(spark, sf_dir):
    ids = T.mesh(spark, sf_dir).select("meshid").distinct()
    name = F.concat(F.when(F.col("meshid").startswith("L_"), F.lit("language "))
                    .when(F.col("meshid").startswith("S_"), F.lit("source "))
                    .otherwise(F.lit("quality ")), F.substr("meshid", F.lit(3)))
    rec = ids.select(F.concat(F.lit("<DescriptorRecord><DescriptorUI>"), F.col("meshid"),
                              F.lit("</DescriptorUI><DescriptorName><String>"), name,
                              F.lit("</String></DescriptorName></DescriptorRecord>")).alias("x"))
    path = _scratch(spark, "descriptors")
    rec.write.text(path)
    return XA.read_mesh_descriptors(spark, path)


@query("read_ontology_classes", oracle="""
select coalesce(name, symbol) as name,
       array_to_string([coalesce(name, symbol)] || list_filter(
           list_filter(s, lambda x, i: list_position(s, x) = i), lambda x: x <> coalesce(name, symbol)), ',')
       as alias,
       concat_ws(' ', symbol, name) as definition, cast(hgnc_id as varchar) as source
from (select hgnc_id, symbol, name,
             coalesce(string_split_regex(alias_symbol, '\\|'), []::varchar[]) || [lower(symbol)] as s
      from gene_names) g""")
def q_read_ontology_classes(spark, sf_dir):
    g = T.gene_names(spark, sf_dir)
    syn = F.concat(F.coalesce(F.split("alias_symbol", r"\|"), F.array().cast("array<string>")),
                   F.array(F.lower("symbol")))
    item = F.struct(F.coalesce("name", "symbol").alias("prefLabel"),
                    F.col("hgnc_id").cast("string").alias("@id"), syn.alias("synonym"),
                    F.filter(F.array("symbol", "name"), lambda x: x.isNotNull()).alias("definition"))
    pages = (g.groupBy((F.col("hgnc_id") / 10).cast("long").alias("_page"))
             .agg(F.collect_list(item).alias("collection"))
             .select(F.to_json(F.struct("collection")).alias("value")))
    path = _scratch(spark, "ontology")
    pages.write.text(path)
    out = FS.read_ontology_classes(spark, path, multi_line=False)
    return out.select("name", F.array_join("alias", ",").alias("alias"), "definition", "source")


@query("read_grid_results", oracle="""
with r as (select 'corpus_' || cast(label as varchar) as corpus, label,
                  cast(row_number() over (partition by label order by vec_id) as bigint) as rank_test_score,
                  vec_id from embeddings)
select corpus, vec_id, rank_test_score,
       case when label % 2 = 0 then cast(label * 100 as bigint) else cast(c.n as bigint) end as size
from r join (select label as l, count(*) as n from embeddings group by label) c on c.l = r.label
where rank_test_score = 1""")
def q_read_grid_results(spark, sf_dir):
    """Per-corpus result files '<corpus>/<corpus>[_<size>]_grid_results.csv'
    (size in the name for even corpora), read back keeping rank-1 rows."""
    e = T.read_table(spark, sf_dir, "embeddings").select("vec_id", "label")
    from pyspark.sql import Window

    r = e.withColumn("rank_test_score", F.row_number().over(
        Window.partitionBy("label").orderBy("vec_id")))
    root = _scratch(spark, "grid")
    labels = [row[0] for row in e.select("label").distinct().collect()]  # corpora: bounded list
    for lab in labels:
        name = f"corpus_{lab}" + (f"_{lab * 100}" if lab % 2 == 0 else "")
        (r.where(F.col("label") == lab).select("vec_id", "rank_test_score").coalesce(1)
         .write.option("header", "true").csv(f"{root}/corpus_{lab}/{name}_grid_results.csv"))
    sizes = e.groupBy(F.concat(F.lit("corpus_"), F.col("label").cast("string")).alias("corpus")) \
        .agg(F.count(F.lit(1)).alias("size"))
    out = FS.read_grid_results(spark, root, sizes)
    return out.select("corpus", F.col("vec_id").cast("long").alias("vec_id"),
                      F.col("rank_test_score").cast("long").alias("rank_test_score"), "size")


@query("verify_checksums")
def q_verify_checksums(spark, sf_dir):
    """md5 of written dump files against side files written from a separate
    read of the same bytes."""
    arts = T.articles(spark, sf_dir)
    path = _scratch(spark, "dumps")
    XA.render_article_xml(arts).select("xml").write.text(path + "/data")
    sums = (spark.read.format("binaryFile").load(path + "/data/*.txt")
            .select(F.col("path"), F.md5("content").alias("h")))
    side = sums.select(F.concat(F.lit("MD5("), F.element_at(F.split("path", "/"), -1), F.lit(")= "),
                                F.col("h")).alias("v"), F.element_at(F.split("path", "/"), -1).alias("f"))
    side.write.partitionBy("f").text(path + "/md5")
    return XA.verify_checksums(spark, path + "/data/*.txt", path + "/md5/*/*.txt",
                               manifest_key="partition").groupBy("status").count()


@query("gene_token_guard", oracle=f"""
with am as (select pmid, sent_pos, regexp_extract_all(sentence, {sql_str(A.FEATURE_TOKEN)}) as tk
            from sents where regexp_matches(sentence, {sql_str(ASSOC_PATTERN)})),
ft as (select pmid, sent_pos, unnest(tk) as token, unnest(range(len(tk))) as tok_pos from am)
select pmid, sent_pos, tok_pos, token,
       not (regexp_matches(token, {sql_str(A.LETTERS_ONLY)}) and (tok_pos = 0 or token = lower(token))) as may_be_gene
from ft""", ctes=SQL_SENTS)
def q_gene_token_guard(spark, sf_dir):
    s = A.sentences(T.articles(spark, sf_dir)).where(F.col("sentence").rlike(ASSOC_PATTERN))
    t = s.select("pmid", "sent_pos", F.posexplode(F.regexp_extract_all(
        "sentence", F.lit(A.FEATURE_TOKEN), 0)).alias("tok_pos", "token"))
    return normalize(t.withColumn("may_be_gene", A.gene_token_guard(raw="token")))


@query("polar_layout", oracle="""
select word, round(similarity, 6) as similarity,
       round(case when similarity > 0 then 1 - similarity else 1 + similarity end, 6) as radius,
       round(2 * pi() * (row_number() over (order by similarity desc, word) - 1) / count(*) over (), 6) as angle
from sims where target = 'w5'""", ctes=SQL_ALL_SIMS)
def q_polar_layout(spark, sf_dir):
    s = EM.pairwise_similarity(_targets(spark).where("word = 'w5'"), T.word_vectors(spark, sf_dir))
    return normalize(EM.polar_layout(s.select("word", "similarity"), "similarity",
                                     [F.desc("similarity"), F.asc("word")]))


@query("top_k", oracle="""
select token, doc_freq from vocab order by doc_freq desc, token limit 10""", ctes=SQL_STOKS)
def q_top_k(spark, sf_dir):
    v = X.vocabulary(X.sentence_token_table(T.articles(spark, sf_dir)))
    return v.select("token", "doc_freq").orderBy(F.desc("doc_freq"), "token").limit(10)


@query("cosine", oracle="""
select word, round(list_dot_product(vector::double[], list_reverse(vector)::double[])
                   / list_dot_product(vector::double[], vector::double[]), 6) as similarity
from word_vectors""")
def q_cosine(spark, sf_dir):
    a = T.word_vectors(spark, sf_dir)
    return normalize(a.select("word", cosine("vector", F.reverse("vector")).alias("similarity")))


@query("projection_quality", oracle="""
with c as (select a.word, a.vector as va, b.vector as vb from embedding_a a join embedding_b b using (word)),
o as (select *, row_number() over (order by word) as i from c),
ctl as (select x.word, x.va, y.vb from o x join o y on y.i = x.i + 1),
d as (select 'reference' as set, 1 - list_dot_product(list_reverse(va)::double[], vb::double[])
              / (sqrt(list_dot_product(va::double[], va::double[])) * sqrt(list_dot_product(vb::double[], vb::double[]))) as dist from c
      union all
      select 'control', 1 - list_dot_product(list_reverse(va)::double[], vb::double[])
              / (sqrt(list_dot_product(va::double[], va::double[])) * sqrt(list_dot_product(vb::double[], vb::double[]))) from ctl)
select set, round(avg(dist), 6) as mean_distance, round(stddev_pop(dist), 6) as std_distance, count(*) as n
from d group by set""")
def q_projection_quality(spark, sf_dir):
    """Quality of a given projection (the dimension reversal that maps model
    a onto model b): reference words vs a shifted control pairing."""
    import numpy as np

    a, b = T.embedding_a(spark, sf_dir), T.embedding_b(spark, sf_dir)
    model = {"rotation": np.eye(64)[::-1], "scale": 1.0, "shift": np.zeros(64)}
    proj = EM.apply_projection(a.select("word", "vector"), model)
    common = a.select("word").join(b.select("word"), "word")
    from pubsift.operators.ordinals import global_ordinal

    o = global_ordinal(common, ["word"], "_i")
    nxt = o.select((F.col("_i") - 1).alias("_i"), F.col("word").alias("_next"))
    control = (o.join(nxt, "_i").join(proj, "word").select(F.col("_next").alias("word"), "vector"))
    return normalize(EM.projection_quality(proj.join(common, "word"), b, control))


@query("collection_api", oracle=f"""
select pmid, date from (select pmid, date, {_joined_tokens_sql('content')} as j from articles) x
where {_match_sql(TOPIC_ALL, TOPIC_ANY, TOPIC_NONE)}""")
def q_collection_api(spark, sf_dir):
    c = Collection(T.articles(spark, sf_dir)).filter(TOPIC_ALL, TOPIC_ANY, TOPIC_NONE)
    return c.process(lambda df: df.select("pmid", "date")).df


@query("map_articles", oracle=r"""
select pmid, len(regexp_extract_all(title, '\S+')) as title_words from articles""")
def q_map_articles(spark, sf_dir):
    """A user callback in Python over article batches (mapInPandas)."""
    def words(pdf):
        import pandas as pd

        return pd.DataFrame({"pmid": pdf["pmid"],
                             "title_words": pdf["title"].fillna("").map(lambda t: len(t.split()))})

    return Collection(T.articles(spark, sf_dir)).map_articles(words, "pmid long, title_words long")


def _phrases_sql(name, source):
    """A phrase table from the sentences of ``source``."""
    return f"""
{name}_uni as (select token, count(*) as n from {source} group by token),
{name}_pairs as (
  select a, b, count(*) as n_ab from (
    select token as a, lead(token) over (partition by pmid, sent_pos order by tok_pos) as b from {source}) p
  where b is not null group by a, b having count(*) >= 30
),
{name} as (
  select a, b from {name}_pairs join {name}_uni ua on ua.token = a join {name}_uni ub on ub.token = b
  where (n_ab - 30) * (select count(*) from {name}_uni) / (ua.n * ub.n) > 10
)"""


def _merged_sql(name, source, phrases):
    """The sentences of ``source`` with pairs of ``phrases`` merged, first pair first."""
    return f"""
{name}_tk as (
  select s.*, p.a is not null as m
  from (select *, lead(token) over (partition by pmid, sent_pos order by tok_pos) as nxt from {source}) s
  left join {phrases} p on p.a = s.token and p.b = s.nxt
),
{name}_walk as (
  select pmid, sent_pos, 0 as pos, 0 as out_pos from {source} where tok_pos = 0
  union all
  select w.pmid, w.sent_pos, w.pos + case when t.m then 2 else 1 end, w.out_pos + 1
  from {name}_walk w join {name}_tk t on t.pmid = w.pmid and t.sent_pos = w.sent_pos and t.tok_pos = w.pos
),
{name} as (
  select w.pmid, w.sent_pos, cast(w.out_pos as bigint) as tok_pos,
         case when t.m then t.token || '·' || t.nxt else t.token end as token
  from {name}_walk w join {name}_tk t on t.pmid = w.pmid and t.sent_pos = w.sent_pos and t.tok_pos = w.pos
)"""


SQL_APPLY = SQL_STOKS + r""",
split as (
  select pmid, case when row_number() over (order by md5('42' || cast(pmid as varchar)), pmid)
                         <= ceil(count(*) over () * 0.25) then 'test' else 'train' end as split
  from articles
),
tr as (select s.* from stoks s join split p using (pmid) where p.split = 'train'),
te as (select s.* from stoks s join split p using (pmid) where p.split = 'test'),""" + ",".join([
    _phrases_sql("ph1", "tr"), _merged_sql("tr1", "tr", "ph1"), _phrases_sql("ph2", "tr1"),
    _merged_sql("te1", "te", "ph1"), _merged_sql("te2", "te1", "ph2")])


@query("apply_preprocessing", oracle="select pmid, sent_pos, tok_pos, token from te2",
       ctes=SQL_APPLY, recursive=True)
def q_apply_preprocessing(spark, sf_dir):
    """Two phrase models fitted in order on the training split, re-applied to the test split."""
    from pubsift.operators import corpus as C

    arts = T.articles(spark, sf_dir)
    split = C.train_test_split(arts.select("pmid"), 0.25, "42")
    lists = X.sentence_token_lists(arts)
    tr = lists.join(split.where("split = 'train'"), "pmid", "left_semi")
    te = lists.join(split.where("split = 'test'"), "pmid", "left_semi")
    _, models = X.preprocess(tr, 2, 30, 10.0)
    return normalize(X.apply_preprocessing(te, models))
