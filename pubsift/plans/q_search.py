"""Registered queries: search, sentences, tokens, term links (the flagship path)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubsift.functions.text import TOKEN_RUN, raw_tokens, tokenize, english_stop_words
from pubsift.operators import associations as A
from pubsift.operators import search as S
from pubsift.plans.catalog import query
from pubsift.plans.common import (ASSOC_PATTERN, REGEX_PATTERN, SQL_SENTS, SQL_TOKS,
                                  TOPIC_ALL, TOPIC_ANY, TOPIC_NONE, normalize, sql_str)
from pubsift.plans.oracle import sql_list
from pubsift.sources import tables as T


def _joined_tokens_sql(text_col: str) -> str:
    return f"' ' || array_to_string(regexp_extract_all(lower({text_col}), '{TOKEN_RUN}'), ' ') || ' '"


def _match_sql(all_of, any_of, none_of) -> str:
    conds = [f"contains(j, {sql_str(' ' + t + ' ')})" for t in all_of]
    if any_of:
        conds.append("(" + " or ".join(f"contains(j, {sql_str(' ' + t + ' ')})"
                                       for t in any_of) + ")")
    conds += [f"not contains(j, {sql_str(' ' + t + ' ')})" for t in none_of]
    return " and ".join(conds) or "true"


# ---------------------------------------------------------------- flagship
@query("gene_evidence", oracle=rf"""
select symbol, count(distinct pmid) as n_docs,
       count(distinct (pmid, sent_pos)) as n_sentences, count(*) as n_mentions,
       min(date) as first_date,
       arg_min(pmid, (date, pmid, sent_pos)) as first_pmid,
       arg_min(sent_pos, (date, pmid, sent_pos)) as first_sent
from (
  select t.pmid, t.date, t.sent_pos, d.symbol
  from toks t join dictionary d on t.token = d.alias
  where t.pmid in (select pmid from (select pmid, {_joined_tokens_sql('content')} as j
                                     from articles) x
                   where {_match_sql(TOPIC_ALL, TOPIC_ANY, TOPIC_NONE)})
    and regexp_matches(t.sentence, {sql_str(ASSOC_PATTERN)})
) l group by symbol""", ctes=SQL_SENTS + "," + SQL_TOKS)
def q_gene_evidence(spark, sf_dir):
    """Which dictionary terms occur in sentences matching a pattern, in
    documents on a topic, and when was each first seen?"""
    arts = T.articles(spark, sf_dir)
    topic = S.text_match(arts, TOPIC_ALL, TOPIC_ANY, TOPIC_NONE)
    links = A.keyword_associations(topic, T.dictionary(spark, sf_dir), ASSOC_PATTERN)
    return normalize(A.gene_evidence(links))


@query("first_mention", oracle=rf"""
select symbol, pmid, sent_pos, tok_pos,
       (date, pmid, sent_pos) = min((date, pmid, sent_pos)) over (partition by symbol) as first
from toks t join dictionary d on t.token = d.alias
where regexp_matches(t.sentence, {sql_str(ASSOC_PATTERN)})""", ctes=SQL_SENTS + "," + SQL_TOKS)
def q_first_mention(spark, sf_dir):
    links = A.keyword_associations(T.articles(spark, sf_dir), T.dictionary(spark, sf_dir),
                                   ASSOC_PATTERN)
    return normalize(A.first_mention(links).select("symbol", "pmid", "sent_pos", "tok_pos", "first"))


# ---------------------------------------------------------------- search
@query("text_match", oracle=f"""
select pmid, date from (select pmid, date, {_joined_tokens_sql('content')} as j from articles) x
where {_match_sql(TOPIC_ALL, TOPIC_ANY, TOPIC_NONE)}""")
def q_text_match(spark, sf_dir):
    arts = T.articles(spark, sf_dir)
    return S.text_match(arts, TOPIC_ALL, TOPIC_ANY, TOPIC_NONE).select("pmid", "date")


@query("search_sorted_by_date", oracle=f"""
select pmid, date, title from (select pmid, date, title, {_joined_tokens_sql('content')} as j
                               from articles) x
where {_match_sql(['of the'], [], [])} order by date, pmid""")
def q_search_sorted(spark, sf_dir):
    arts = T.articles(spark, sf_dir)
    return S.search_sorted_by_date(arts, all_of=["of the"]).select("pmid", "date", "title")


TAG_QUERIES = {
    "q_the_of": {"all_of": ["the of"]},
    "q_with_not_is": {"all_of": ["with"], "none_of": ["is"]},
    "q_rewh_or_th": {"any_of": ["rewh", "th"]},
    "q_and_of": {"all_of": ["and", "of"], "any_of": ["the", "is"]},
}


STORED_QUERIES = TAG_QUERIES | {"q_revised": {"all_of": ["revised"]}, "q_not_the": {"none_of": ["the", "no such word"]}}


@query("tag_documents_by_query", oracle="\nunion all\n".join(
    f"select '{q}' as query, pmid from (select pmid, {_joined_tokens_sql('content')} as j "
    f"from articles) x where "
    f"{_match_sql(s.get('all_of', []), s.get('any_of', []), s.get('none_of', []))}"
    for q, s in TAG_QUERIES.items()))
def q_tag_documents(spark, sf_dir):
    return S.tag_documents_by_query(T.articles(spark, sf_dir), TAG_QUERIES)


_LATEST = """
select pmid, content from articles_versions v
qualify row_number() over (partition by pmid order by version desc) = 1"""


@query("stored_postings", oracle="\nunion all\n".join(
    f"select '{q}' as query, pmid from (select pmid, {_joined_tokens_sql('content')} as j "
    f"from ({_LATEST}) l where pmid % 7 <> 3) x where "
    f"{_match_sql(s.get('all_of', []), s.get('any_of', []), s.get('none_of', []))}"
    for q, s in STORED_QUERIES.items()))
def q_stored_postings(spark, sf_dir):
    """Postings written for all articles, then for the revised ones, some articles
    removed; the questions read their tokens' buckets."""
    import uuid

    from pubsift.operators.postings import PostingsStore
    from pubsift.session import scratch_path

    store = PostingsStore(spark, scratch_path(spark, f"postings-{uuid.uuid4().hex[:12]}"))
    versions = T.articles_versions(spark, sf_dir)
    store.add(versions.where("version = 1"))
    store.add(versions.where("version = 2"))
    store.remove(versions.where("version = 1 and pmid % 7 = 3"))
    return store.tag(STORED_QUERIES)


@query("filter_regex", oracle=f"""
select pmid from articles
where coalesce(regexp_matches(title, {sql_str('(?i)' + REGEX_PATTERN)}), false)
   or coalesce(regexp_matches(content, {sql_str('(?i)' + REGEX_PATTERN)}), false)""")
def q_filter_regex(spark, sf_dir):
    return S.filter_regex(T.articles(spark, sf_dir), REGEX_PATTERN).select("pmid")


@query("filter_association", oracle=f"""
select pmid, sent_pos from sents where regexp_matches(sentence, {sql_str(ASSOC_PATTERN)})""",
       ctes=SQL_SENTS)
def q_filter_association(spark, sf_dir):
    s = A.sentences(T.articles(spark, sf_dir))
    return normalize(S.filter_association(s, ASSOC_PATTERN, "sentence").select("pmid", "sent_pos"))


# ---------------------------------------------------------------- text
@query("split_sentences", oracle="""
select pmid, sent_pos, sentence, length(sentence) as n_chars from sents""", ctes=SQL_SENTS)
def q_split_sentences(spark, sf_dir):
    s = A.sentences(T.articles(spark, sf_dir))
    return normalize(s.select("pmid", "sent_pos", "sentence",
                              F.length("sentence").alias("n_chars")))


_STOPS = sql_list(english_stop_words())


@query("tokenize", oracle=rf"""
select pmid, len(t) as n_tokens, array_to_string(t, ' ') as tokens from (
  select pmid, list_filter(list_filter(
           regexp_extract_all(lower(content), '{TOKEN_RUN}'),
           lambda x: not regexp_matches(x, '^[0-9]+$')),
           lambda x: not list_contains({_STOPS}, x)) as t
  from articles) a""")
def q_tokenize(spark, sf_dir):
    t = T.articles(spark, sf_dir).select("pmid", tokenize("content").alias("t"))
    return normalize(t.select("pmid", F.size("t").alias("n_tokens"),
                              F.array_join("t", " ").alias("tokens")))


@query("link_terms", oracle="""
select t.pmid, t.sent_pos, t.tok_pos, d.symbol
from toks t join dictionary d on t.token = lower(d.alias)""", ctes=SQL_SENTS + "," + SQL_TOKS)
def q_link_terms(spark, sf_dir):
    s = A.sentence_tokens(A.sentences(T.articles(spark, sf_dir)))
    links = A.link_terms(s, T.dictionary(spark, sf_dir))
    return normalize(links.select("pmid", "sent_pos", "tok_pos", "symbol"))


@query("sentence_key", oracle="""
select pmid, sent_pos, md5(sentence) as sent_key from sents""", ctes=SQL_SENTS)
def q_sentence_key(spark, sf_dir):
    s = A.sentences(T.articles(spark, sf_dir))
    return normalize(s.select("pmid", "sent_pos", F.md5("sentence").alias("sent_key")))
