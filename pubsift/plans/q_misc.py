"""Registered queries: dictionaries, annotations, statistics on results."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubsift.functions.text import alias_set, join_definition
from pubsift.operators import annotations as AN
from pubsift.operators import associations as A
from pubsift.operators import dictionary as D
from pubsift.operators import ranking as R
from pubsift.operators import stats as ST
from pubsift.operators import text as X
from pubsift.plans.catalog import query
from pubsift.plans.common import ASSOC_PATTERN, SQL_SENTS, SQL_TOKS, normalize, sql_str
from pubsift.plans.q_ranking import SQL_LINKS
from pubsift.plans.q_text import SQL_STOKS
from pubsift.sources import tables as T

SQL_LISTS = """
lists as (
  select hgnc_id, symbol,
         [symbol, name] || coalesce(string_split_regex(alias_symbol, '\\|'), []::varchar[]) as aliases
  from gene_names
)"""


def _lists(spark, sf_dir):
    return D.gene_alias_lists(T.gene_names(spark, sf_dir))


@query("alias_list", oracle="select hgnc_id, symbol, array_to_string(aliases, ',') as aliases from lists",
       ctes=SQL_LISTS)
def q_alias_list(spark, sf_dir):
    return _lists(spark, sf_dir).select("hgnc_id", "symbol", F.array_join("aliases", ",").alias("aliases"))


@query("concept_ids", oracle="""
with ex as (select hgnc_id, symbol, unnest(aliases) as alias, unnest(range(len(aliases))) as p from lists),
t as (select *, row_number() over (order by hgnc_id, p) - 1 as tid from ex)
select tid, min(tid) over (partition by symbol) as cid, symbol, alias, hgnc_id from t""", ctes=SQL_LISTS)
def q_concept_ids(spark, sf_dir):
    return D.concept_ids(_lists(spark, sf_dir))


@query("aliases_of", oracle="""
with ex as (select symbol, unnest(aliases) as alias from lists)
select symbol, array_to_string(list_sort(list(distinct alias)), ',') as aliases
from ex where alias is not null group by symbol""", ctes=SQL_LISTS)
def q_aliases_of(spark, sf_dir):
    ex = _lists(spark, sf_dir).select("symbol", F.explode("aliases").alias("alias"))
    out = D.aliases_of(ex, None)
    return out.select("symbol", F.array_join("aliases", ",").alias("aliases"))


@query("attach_aliases_by_symbol", oracle="""
select g.hgnc_id, g.symbol, e.alias
from gene_names g left join (select symbol, unnest(aliases) as alias from lists) e on e.symbol = g.symbol""",
       ctes=SQL_LISTS)
def q_attach_aliases(spark, sf_dir):
    ids = T.gene_names(spark, sf_dir).select("hgnc_id", "symbol")
    return D.attach_aliases_by_symbol(ids, _lists(spark, sf_dir)).select("hgnc_id", "symbol", "alias")


@query("filter_in_set", oracle="""
select hgnc_id, symbol from gene_names where lower(symbol) in (select token from vocab)""",
       ctes=SQL_STOKS)
def q_filter_in_set(spark, sf_dir):
    vocab = X.vocabulary(X.sentence_token_table(T.articles(spark, sf_dir))).select(
        F.col("token").alias("value"))
    return D.filter_in_set(T.gene_names(spark, sf_dir), vocab).select("hgnc_id", "symbol")


@query("rename_select", oracle="""
select hgnc_id as "HGNC ID", symbol as "Approved Symbol" from gene_names""")
def q_rename_select(spark, sf_dir):
    return D.rename_select(T.gene_names(spark, sf_dir),
                           {"hgnc_id": "HGNC ID", "symbol": "Approved Symbol", "name": "Approved Name"},
                           ["HGNC ID", "Approved Symbol"])


@query("alias_set", oracle="""
select hgnc_id,
       array_to_string([coalesce(name, symbol)] || list_filter(
           list_filter(s, lambda x, i: list_position(s, x) = i), lambda x: x <> coalesce(name, symbol)), ',')
       as labels
from (select hgnc_id, symbol, name,
             coalesce(string_split_regex(alias_symbol, '\\|'), []::varchar[]) || [lower(symbol)] as s
      from gene_names) g""")
def q_alias_set(spark, sf_dir):
    g = T.gene_names(spark, sf_dir)
    syn = F.concat(F.coalesce(F.split("alias_symbol", r"\|"), F.array().cast("array<string>")),
                   F.array(F.lower("symbol")))
    return g.select("hgnc_id", F.array_join(alias_set(F.coalesce("name", "symbol"), syn), ",")
                    .alias("labels"))


@query("join_definition", oracle="""
select hgnc_id, array_to_string(aliases, ' ') as definition from lists""", ctes=SQL_LISTS)
def q_join_definition(spark, sf_dir):
    return _lists(spark, sf_dir).select("hgnc_id", join_definition("aliases").alias("definition"))


# ------------------------------------------------------------------ annotations
SQL_STATE = """
state as (
  select cast(gid as bigint) as gid, cast(docid as bigint) as docid, cast(annot_id as bigint) as annot_id,
         ts, event_id, type, tag, value from (
    select *, row_number() over (partition by gid, docid, annot_id order by ts desc, event_id desc) as rn
    from annotation_events) e
  where rn = 1 and type <> 'delete'
),
labelled as (
  select *, case tag when 'click' then '+' when 'error' then '-' when 'purchase' then 'x'
                     when 'signup' then '+-' when 'view' then '-+' end as label
  from state
)"""


def _state(spark, sf_dir):
    return AN.annotation_state(T.annotation_events(spark, sf_dir))


def _labelled(spark, sf_dir):
    m = F.create_map(*[F.lit(x) for x in ("click", "+", "error", "-", "purchase", "x",
                                          "signup", "+-", "view", "-+")])
    return _state(spark, sf_dir).withColumn("label", F.element_at(m, F.col("tag")))


@query("annotation_state", oracle="""
select gid, docid, annot_id, ts, event_id, type, tag, round(value, 6) as value from state""",
       ctes=SQL_STATE)
def q_annotation_state(spark, sf_dir):
    return normalize(_state(spark, sf_dir))


@query("strongest_label", oracle="""
select docid, label, weight from (
  select docid, label, cast(w as bigint) as weight,
         row_number() over (partition by docid order by abs(w) desc, w desc, annot_id asc) as rn
  from (select *, case label when '+' then 2 when '+-' then 1 when '-' then -2 when '-+' then -1
                             when 'x' then 0 end as w
        from labelled where label is not null and label <> 'invalid') l) t
where rn = 1""", ctes=SQL_STATE)
def q_strongest_label(spark, sf_dir):
    return normalize(AN.strongest_label(_labelled(spark, sf_dir), "docid", "label"))


@query("distinct_tags", oracle="select distinct tag from annotation_events where tag is not null order by tag")
def q_distinct_tags(spark, sf_dir):
    return AN.distinct_tags(T.annotation_events(spark, sf_dir))


@query("attach_annotations", oracle=f"""
select l.pmid, l.sent_pos, l.symbol, s.annot_id, s.label
from links l left join (select * from labelled where type = 'doc_annotation') s on s.docid = l.pmid""",
       ctes=SQL_LINKS + "," + SQL_STATE)
def q_attach_annotations(spark, sf_dir):
    links = A.keyword_associations(T.articles(spark, sf_dir), T.dictionary(spark, sf_dir),
                                   ASSOC_PATTERN)
    st = _labelled(spark, sf_dir).where("type = 'doc_annotation'")
    out = AN.attach_annotations(links, st, [("pmid", "docid")])
    return normalize(out.select("pmid", "sent_pos", "symbol", "annot_id", "label"))


_SPAN_LINKS = SQL_SENTS + "," + SQL_TOKS + f""",
sl as (
  select t.pmid, t.sent_pos, t.tok_pos, lower(t.sentence) as s, t.token,
         count(*) over (partition by t.pmid, t.sent_pos, t.token order by t.tok_pos
                        rows between unbounded preceding and 1 preceding) as n
  from toks t join dictionary d on t.token = d.alias
  where regexp_matches(t.sentence, {sql_str(ASSOC_PATTERN)})
)"""


@query("annotation_spans", oracle="""
select pmid, sent_pos, tok_pos, token,
       list_filter(range(1, length(s) + 1), lambda i: substr(s, i, length(token)) = token)[n + 1] - 1 as span_start
from sl""", ctes=_SPAN_LINKS)
def q_annotation_spans(spark, sf_dir):
    from pyspark.sql import Window

    links = A.keyword_associations(T.articles(spark, sf_dir), T.dictionary(spark, sf_dir),
                                   ASSOC_PATTERN)
    w = Window.partitionBy("pmid", "sent_pos", "token").orderBy("tok_pos").rowsBetween(
        Window.unboundedPreceding, -1)
    sl = (links.withColumn("n", F.coalesce(F.count(F.lit(1)).over(w), F.lit(0)))
          .withColumn("s", F.lower("sentence")))
    return normalize(AN.spans(sl, "s", "token", "n").select("pmid", "sent_pos", "tok_pos", "token",
                                                            "span_start"))


@query("count_preceding_matches", oracle="""
select pmid, sent_pos, tok_pos, token,
       len(list_filter(list_filter(range(1, length(s) + 1), lambda i: substr(s, i, length(token)) = token),
                       lambda x: x - 1 < length(s) // 2)) as preceding
from sl""", ctes=_SPAN_LINKS)
def q_count_preceding(spark, sf_dir):
    links = A.keyword_associations(T.articles(spark, sf_dir), T.dictionary(spark, sf_dir),
                                   ASSOC_PATTERN)
    sl = links.withColumn("s", F.lower("sentence")).withColumn("_mid", F.floor(F.length("s") / 2))
    return normalize(AN.preceding_matches(sl, "s", "token", "_mid")
                     .select("pmid", "sent_pos", "tok_pos", "token", "preceding"))


@query("render_annotations")
def q_render_annotations(spark, sf_dir):
    links = A.keyword_associations(T.articles(spark, sf_dir), T.dictionary(spark, sf_dir),
                                   ASSOC_PATTERN)
    from pyspark.sql import Window

    w = Window.partitionBy("pmid", "sent_pos", "token").orderBy("tok_pos").rowsBetween(
        Window.unboundedPreceding, -1)
    sl = AN.spans(links.withColumn("n", F.coalesce(F.count(F.lit(1)).over(w), F.lit(0)))
                  .withColumn("s", F.lower("sentence")), "s", "token", "n")
    per = sl.groupBy("pmid", "sent_pos", "s").agg(F.collect_set(F.struct(
        F.col("span_start").alias("start"), F.col("span_end").alias("end"),
        F.col("symbol").alias("tag"))).alias("spans"))
    return AN.render_annotations(per, "s", "spans").select("pmid", "sent_pos", "marked")


# ------------------------------------------------------------------ statistics
@query("group_stats_anova", oracle="""
with g as (select event_type, count(*) as n, sum(value) as s, sum(value * value) as q from events group by event_type),
t as (select count(*) as k, sum(n) as nn, sum(s) as ss, sum(q) as qq, sum(s * s / n) as b from g)
select k, cast(nn as bigint) as "N", round(((b - ss * ss / nn) / (k - 1)) / ((qq - b) / (nn - k)), 6) as "F" from t""")
def q_group_stats_anova(spark, sf_dir):
    ev = T.read_table(spark, sf_dir, "events")
    return normalize(ST.anova_oneway(ev, "event_type", "value"))


@query("group_stats", oracle="""
select event_type, count(*) as n, round(avg(value), 6) as mean, round(var_pop(value), 6) as var_pop
from events group by event_type""")
def q_group_stats(spark, sf_dir):
    return normalize(ST.group_stats(T.read_table(spark, sf_dir, "events"), "event_type", "value"))


@query("anova_p")
def q_anova_p(spark, sf_dir):
    ev = T.read_table(spark, sf_dir, "events")
    return normalize(ST.anova_oneway(ev, "event_type", "value", with_p=True))


@query("significance_filter", oracle="""
select stratum_date, rank, round(p, 6) as p from tested where p < 0.05 order by p""", ctes=SQL_LINKS)
def q_significance_filter(spark, sf_dir):
    from pubsift.plans import q_ranking as QR

    t = R.prefix_tests(QR._firsts_ranked(spark, sf_dir), QR._nulls(spark, sf_dir))
    return normalize(ST.significance_filter(t.select("stratum_date", "rank", "p")))
