"""Registered queries: vocabulary, bag of words, tf-idf, phrases, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubsift.functions.text import TOKEN_RUN, english_stop_words
from pubsift.operators import corpus as C
from pubsift.operators import text as X
from pubsift.plans.catalog import query
from pubsift.plans.common import SQL_SENTS, normalize
from pubsift.plans.oracle import sql_list
from pubsift.sources import tables as T

MIN_COUNT, THRESHOLD = 30, 10.0

SQL_STOKS = SQL_SENTS + rf""",
psents as (
  select pmid, unnest(ss) as sentence, unnest(range(len(ss))) as sent_pos
  from (select pmid, string_split_regex(concat_ws(' ', title, content), '[.!?]+\s+') as ss from articles) a
),
stoks as (
  select pmid, sent_pos, unnest(t) as token, unnest(range(len(t))) as tok_pos
  from (select pmid, sent_pos,
               list_filter(list_filter(
                 regexp_extract_all(lower(sentence), '{TOKEN_RUN}'),
                 lambda x: not regexp_matches(x, '^[0-9]+$')),
                 lambda x: not list_contains({sql_list(english_stop_words())}, x)) as t
        from psents) s
),
vocab as (
  select token, row_number() over (order by token) - 1 as id,
         count(distinct pmid) as doc_freq, count(*) as term_freq
  from stoks group by token
),
bow as (select pmid, token, count(*) as n from stoks group by pmid, token),
uni as (select token, count(*) as n from stoks group by token),
pairs as (
  select a, b, count(*) as n_ab from (
    select token as a, lead(token) over (partition by pmid, sent_pos order by tok_pos) as b from stoks) p
  where b is not null group by a, b having count(*) >= {MIN_COUNT}
),
phrases as (
  select a, b, n_ab, (n_ab - {MIN_COUNT}) * (select count(*) from uni) / (ua.n * ub.n) as score
  from pairs join uni ua on ua.token = a join uni ub on ub.token = b
  where (n_ab - {MIN_COUNT}) * (select count(*) from uni) / (ua.n * ub.n) > {THRESHOLD}
)"""

# Greedy left-to-right merging written as a recursive walk over each sentence.
SQL_MERGED = SQL_STOKS + r""",
tk0 as (
  select s.*, lead(token) over (partition by pmid, sent_pos order by tok_pos) as nxt from stoks s
),
tk as (
  select tk0.*, p.a is not null as m
  from tk0 left join phrases p on p.a = tk0.token and p.b = tk0.nxt
),
walk as (
  select pmid, sent_pos, 0 as pos, 0 as out_pos from stoks where tok_pos = 0
  union all
  select w.pmid, w.sent_pos, w.pos + case when t.m then 2 else 1 end, w.out_pos + 1
  from walk w join tk t on t.pmid = w.pmid and t.sent_pos = w.sent_pos and t.tok_pos = w.pos
),
merged as (
  select w.pmid, w.sent_pos, cast(w.out_pos as bigint) as tok_pos,
         case when t.m then t.token || '·' || t.nxt else t.token end as token
  from walk w join tk t on t.pmid = w.pmid and t.sent_pos = w.sent_pos and t.tok_pos = w.pos
)"""


def _tokens(spark, sf_dir):
    return X.sentence_token_table(T.articles(spark, sf_dir))


@query("vocabulary", oracle="select token, id, doc_freq, term_freq from vocab", ctes=SQL_STOKS)
def q_vocabulary(spark, sf_dir):
    return X.vocabulary(_tokens(spark, sf_dir))


@query("bag_of_words", oracle="select pmid, token, n from bow", ctes=SQL_STOKS)
def q_bag_of_words(spark, sf_dir):
    return X.bag_of_words(_tokens(spark, sf_dir))


@query("tfidf", oracle="""
select b.pmid, b.token, round(b.n * i.idf / sqrt(sum((b.n * i.idf) * (b.n * i.idf)) over (partition by b.pmid)), 6) as tfidf
from bow b join (select token, ln((1 + (select count(distinct pmid) from bow)) / (1 + count(*))) + 1 as idf
                 from bow group by token) i on i.token = b.token""", ctes=SQL_STOKS)
def q_tfidf(spark, sf_dir):
    return normalize(X.tfidf(X.bag_of_words(_tokens(spark, sf_dir))))


@query("phrase_scores", oracle="select a, b, n_ab, round(score, 6) as score from phrases",
       ctes=SQL_STOKS)
def q_phrase_scores(spark, sf_dir):
    return normalize(X.phrase_scores(_tokens(spark, sf_dir), MIN_COUNT, THRESHOLD))


@query("merge_phrases", oracle="select pmid, sent_pos, tok_pos, token from merged",
       ctes=SQL_MERGED, recursive=True)
def q_merge_phrases(spark, sf_dir):
    lists = X.sentence_token_lists(T.articles(spark, sf_dir))
    merged, _ = X.preprocess(lists, 1, MIN_COUNT, THRESHOLD)
    return normalize(merged)


@query("pad_sequence", oracle="""
select pmid, array_to_string(case when len(v) > 500 then v[len(v) - 499:] else v end
                             || list_resize([0], 500 - least(len(v), 500), 0), ',') as seq
from (select a.pmid, coalesce(any_value(y.v), []) as v from articles a left join (
        select s.pmid, list(coalesce(vc.id + 1, (select count(*) from vocab) + 1)
                            order by s.sent_pos, s.tok_pos) as v
        from stoks s left join vocab vc on vc.token = s.token group by s.pmid) y using (pmid)
      group by a.pmid) x""", ctes=SQL_STOKS)
def q_pad_sequence(spark, sf_dir):
    arts = T.articles(spark, sf_dir)
    lists = X.document_token_lists(arts)
    seqs = X.pad_sequences(lists, X.vocabulary(lists), 500, docs=arts)
    return seqs.select("pmid", F.array_join("seq", ",").alias("seq"))


@query("normalise_tokens", oracle="""
select s.pmid, s.sent_pos, s.tok_pos, coalesce(l.lemma, s.token) as token
from stoks s left join (select v.token as form, substr(v.token, 1, length(v.token) - 1) as lemma
                        from vocab v join vocab w on w.token = substr(v.token, 1, length(v.token) - 1)
                        where v.token like '%s') l on l.form = s.token""", ctes=SQL_STOKS)
def q_normalise_tokens(spark, sf_dir):
    arts = T.articles(spark, sf_dir)
    toks = X.sentence_token_table(arts)
    v = X.vocabulary(X.document_token_lists(arts)).select("token")
    stems = v.where(F.col("token").endswith("s")).select(
        F.col("token").alias("form"), F.expr("substr(token, 1, length(token) - 1)").alias("lemma"))
    lemmas = stems.join(v.select(F.col("token").alias("lemma")), "lemma")
    return normalize(X.normalise_tokens(toks, lemmas).select("pmid", "sent_pos", "tok_pos", "token"))


@query("embedding_matrix", oracle="""
with words as (select word from embedding_a union select word from embedding_b),
v as (select word, row_number() over (order by word) - 1 as id from words),
m as (
  select v.id + 1 as "row", coalesce(a.vector, list_resize([0.0::float], 64, 0.0::float)) as vector
  from v left join embedding_a a on a.word = v.word
  union all select 0, list_resize([0.0::float], 64, 0.0::float)
  union all select count(*) + 1, list_resize([0.0::float], 64, 0.0::float) from v
)
select "row", unnest(range(64)) as dim, round(unnest(vector)::double, 6) as value from m""")
def q_embedding_matrix(spark, sf_dir):
    a = T.embedding_a(spark, sf_dir)
    words = a.select("word").union(T.embedding_b(spark, sf_dir).select("word")).distinct()
    from pubsift.operators.ordinals import global_ordinal

    vocab = global_ordinal(words, ["word"], "id", start=0).withColumnRenamed("word", "token")
    m = X.embedding_matrix(vocab, a, 64)
    return normalize(m.select("row", F.posexplode("vector").alias("dim", "value")))
