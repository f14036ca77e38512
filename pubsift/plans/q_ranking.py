"""Registered queries: association features, ranks, null sums, enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubsift.operators import associations as A
from pubsift.operators import ranking as R
from pubsift.plans.catalog import query
from pubsift.plans.common import ASSOC_PATTERN, SQL_SENTS, SQL_TOKS, normalize, sql_str
from pubsift.sources import tables as T

N_PERMS = 1000
ALPHA = 0.05
SEED = "42"

# Shared SQL: links in association sentences, first mentions with ranks, nulls.
SQL_LINKS = SQL_SENTS + "," + SQL_TOKS + rf""",
links as (
  select t.pmid, t.date, t.sent_pos, d.symbol
  from toks t join dictionary d on t.token = lower(d.alias)
  where regexp_matches(t.sentence, {sql_str(ASSOC_PATTERN)})
),
firsts as (
  select symbol, min(date) as date, arg_min(pmid, (date, pmid, sent_pos)) as pmid
  from links group by symbol
),
fr as (select f.symbol, f.date, f.pmid, r.rank from firsts f join ranked r on f.symbol = r.symbol),
nulls as (
  select perm, row_number() over w as n, sum(rank) over (w rows between unbounded preceding and current row) as null_sum
  from (select r.symbol, r.rank, p.perm,
               md5('{SEED}' || ':' || cast(p.perm as varchar) || ':' || r.symbol) as h
        from ranked r, (select range as perm from range({N_PERMS})) p) x
  window w as (partition by perm order by h, symbol)
),
strata as (
  select d.stratum_date, fr.symbol, fr.rank
  from fr join (select distinct date as stratum_date from fr) d on fr.date <= d.stratum_date
),
prefixes as (
  select distinct stratum_date, rank,
         count(*) over w as size, sum(rank) over w as ranksum
  from strata
  window w as (partition by stratum_date order by rank range between unbounded preceding and current row)
),
tested as (
  select p.stratum_date, p.rank, p.size, p.ranksum,
         count(*) filter (where n.null_sum <= p.ranksum) / count(*) as p
  from prefixes p join nulls n on n.n = p.size
  group by p.stratum_date, p.rank, p.size, p.ranksum
),
best as (
  select stratum_date, max(size) as size from (
    select *, max(case when p > {ALPHA} then 1 else 0 end)
                over (partition by stratum_date order by rank rows between unbounded preceding and current row) as failed
    from tested) t
  where failed = 0 group by stratum_date
),
prefix_result as (
  select b.stratum_date, b.size, t.ranksum, t.p, s.symbol as known_gene
  from best b
  join tested t on t.stratum_date = b.stratum_date and t.size = b.size
  join (select stratum_date, symbol,
               row_number() over (partition by stratum_date order by rank, symbol) as i
        from strata) s on s.stratum_date = b.stratum_date and s.i = b.size
)"""


def _links(spark, sf_dir):
    return A.keyword_associations(T.articles(spark, sf_dir), T.dictionary(spark, sf_dir),
                                  ASSOC_PATTERN)


def _firsts_ranked(spark, sf_dir):
    firsts = R.first_mentions(_links(spark, sf_dir))
    return firsts.join(T.ranked(spark, sf_dir).select("symbol", "rank"), "symbol")


def _nulls(spark, sf_dir):
    from pubsift.session import materialize

    return materialize(R.null_rank_sums(T.ranked(spark, sf_dir), N_PERMS, SEED))


def _prefix(spark, sf_dir):
    return R.stratum_prefix_test(_firsts_ranked(spark, sf_dir), _nulls(spark, sf_dir), ALPHA)


@query("attach_rank", oracle="""
select f.symbol, f.date, f.pmid, r.rank from firsts f
left join (select symbol, arg_min(rank, pos) as rank from ranked where symbol is not null group by symbol) r
on f.symbol = r.symbol""", ctes=SQL_LINKS)
def q_attach_rank(spark, sf_dir):
    firsts = R.first_mentions(_links(spark, sf_dir))
    return normalize(R.attach_rank(firsts, T.ranked(spark, sf_dir)))


@query("custom_aggregate", oracle="""
select l.symbol, count(*) as n_links, r.rank from links l
left join (select symbol, max(rank) as rank from ranked where symbol is not null group by symbol) r
on l.symbol = r.symbol group by l.symbol, r.rank""", ctes=SQL_LINKS)
def q_custom_aggregate(spark, sf_dir):
    per = _links(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_links"))
    return normalize(R.attach_rank(per, T.ranked(spark, sf_dir), aggregate=F.max))


@query("cumulative_discoveries", oracle="""
select date, cast(sum(n) over (order by date rows between unbounded preceding and current row) as bigint) as n_known
from (select date, count(*) as n from firsts group by date) d""", ctes=SQL_LINKS)
def q_cumulative(spark, sf_dir):
    firsts = R.first_mentions(_links(spark, sf_dir))
    return normalize(R.cumulative_discoveries(firsts))


@query("null_rank_sums", oracle="select perm, n, null_sum from nulls", ctes=SQL_LINKS)
def q_null_rank_sums(spark, sf_dir):
    return normalize(_nulls(spark, sf_dir))


@query("stratum_join", oracle="select stratum_date, symbol, rank from strata", ctes=SQL_LINKS)
def q_stratum_join(spark, sf_dir):
    return normalize(R.stratum_ranks(_firsts_ranked(spark, sf_dir))
                     .select("stratum_date", "symbol", "rank"))


@query("stratum_prefix_test", oracle="select * from prefix_result", ctes=SQL_LINKS)
def q_stratum_prefix_test(spark, sf_dir):
    return normalize(_prefix(spark, sf_dir))


@query("enrichment_frontier", oracle=f"""
with cand as (
  select pr.stratum_date, c.pos,
         count(*) filter (where n.null_sum <= pr.ranksum + c.rank) / count(*) as pc
  from prefix_result pr join ranked k on k.symbol = pr.known_gene
  join ranked c on c.pos > k.pos
  join nulls n on n.n = pr.size + 1
  group by pr.stratum_date, c.pos
),
ff as (select stratum_date, min(pos) as ff from cand where pc > {ALPHA} group by stratum_date)
select d.stratum_date, pr.known_gene, r.symbol as frontier_gene
from (select distinct date as stratum_date from fr) d left join prefix_result pr on pr.stratum_date = d.stratum_date
left join ff on ff.stratum_date = pr.stratum_date
left join ranked r on pr.known_gene is not null and r.pos = coalesce(ff.ff - 1, (select max(pos) from ranked))""",
       ctes=SQL_LINKS)
def q_enrichment_frontier(spark, sf_dir):
    return R.enrichment_by_date(_firsts_ranked(spark, sf_dir), T.ranked(spark, sf_dir), _nulls(spark, sf_dir), ALPHA,
                                use_leading_edge=False)


@query("enrichment_leading_edge", oracle="""
with es as (
  select s.stratum_date, r.symbol, r.pos,
         count(*) over (partition by s.stratum_date order by r.pos) as c,
         count(*) over (partition by s.stratum_date) as n, (select count(*) from ranked) as total
  from strata s join ranked r on r.symbol = s.symbol
),
edge as (
  select stratum_date, arg_max(symbol, (case when total = n then c else c * (total - n) - (pos - c) * n end, -pos)) as gene
  from es group by stratum_date
)
select d.stratum_date, pr.known_gene, case when pr.known_gene is not null then e.gene end as frontier_gene
from (select distinct date as stratum_date from fr) d join edge e on e.stratum_date = d.stratum_date
left join prefix_result pr on pr.stratum_date = d.stratum_date""", ctes=SQL_LINKS)
def q_enrichment_leading_edge(spark, sf_dir):
    return R.enrichment_by_date(_firsts_ranked(spark, sf_dir), T.ranked(spark, sf_dir), _nulls(spark, sf_dir), ALPHA)


@query("enrichment_score", oracle="""
select symbol, pos, in_set,
       round(sum(case when in_set then 1 else 0 end) over w / sum(case when in_set then 1 else 0 end) over ()
             - sum(case when in_set then 0 else 1 end) over w / sum(case when in_set then 0 else 1 end) over (), 6) as es
from (select r.symbol, r.pos, r.symbol in (select symbol from firsts) as in_set from ranked r) x
window w as (order by pos rows between unbounded preceding and current row)""", ctes=SQL_LINKS)
def q_enrichment_score(spark, sf_dir):
    firsts = R.first_mentions(_links(spark, sf_dir))
    return normalize(R.enrichment_score(T.ranked(spark, sf_dir), firsts))


@query("leading_edge", oracle="""
select arg_min(symbol, pos) as symbol, min(pos) as pos, round(max(es), 6) as es from (
  select symbol, pos, es, max(es) over () as m from (
    select symbol, pos,
       sum(case when in_set then 1 else 0 end) over w / sum(case when in_set then 1 else 0 end) over ()
             - sum(case when in_set then 0 else 1 end) over w / sum(case when in_set then 0 else 1 end) over () as es
    from (select r.symbol, r.pos, r.symbol in (select symbol from firsts) as in_set from ranked r) x
    window w as (order by pos rows between unbounded preceding and current row)) y) z
where es = m""", ctes=SQL_LINKS)
def q_leading_edge(spark, sf_dir):
    firsts = R.first_mentions(_links(spark, sf_dir))
    return normalize(R.leading_edge(R.enrichment_score(T.ranked(spark, sf_dir), firsts)))


@query("year_fraction", oracle="""
select date, round((epoch(date) - min(epoch(date)) over ()) / max(epoch(date)) over (), 6) as t
from (select distinct date from firsts) d""", ctes=SQL_LINKS)
def q_year_fraction(spark, sf_dir):
    firsts = R.first_mentions(_links(spark, sf_dir)).select("date").distinct()
    return normalize(R.year_fraction(firsts))


def _grid_sql() -> str:
    rows = ", ".join(f"({b}::double, {m}::double, {v}::double)"
                     for b, m, v in R.logistic_grid(**R.DEFAULT_GRID))
    return f"(values {rows}) as grid(B, M, v)"


@query("discovery_curve", oracle=f"""
with pts as (
  select (epoch(date) - min(epoch(date)) over ()) / max(epoch(date)) over () as t, cast(n_known as double) as y
  from (select date, sum(n) over (order by date rows between unbounded preceding and current row) as n_known
        from (select date, count(*) as n from firsts group by date) d) c
),
s as (
  select B, M, v, sum((1-g)*(1-g)) as suu, sum((1-g)*g) as sug, sum(g*g) as sgg,
         sum((1-g)*y) as suy, sum(g*y) as sgy, sum(y*y) as syy
  from (select p.*, grid.*, pow(1 + exp(-grid.B * (p.t - grid.M)), -1 / grid.v) as g
        from pts p, {_grid_sql()}) x
  group by B, M, v
),
fit as (
  select B, M, v, A, K,
         syy - 2*A*suy - 2*K*sgy + A*A*suu + 2*A*K*sug + K*K*sgg as sse
  from (select *, (suy*sgg - sgy*sug) / (suu*sgg - sug*sug) as A,
                  (sgy*suu - suy*sug) / (suu*sgg - sug*sug) as K
        from s where abs(suu*sgg - sug*sug) > 1e-12) q
)
select round(A, 6) as A, round(K, 6) as K, round(B, 6) as B, round(M, 6) as M, round(v, 6) as v,
       round(sse, 6) as sse, round(A + K, 6) as total
from fit order by sse, B, M, v limit 1""", ctes=SQL_LINKS)
def q_discovery_curve(spark, sf_dir):
    firsts = R.first_mentions(_links(spark, sf_dir))
    cum = R.cumulative_discoveries(firsts)
    pts = R.year_fraction(cum).select("t", F.col("n_known").alias("y"))
    return normalize(R.discovery_curve(pts))


_PAIRS = (("uu", "u", "u"), ("ug", "u", "g"), ("gg", "g", "g"), ("uy", "u", "y"), ("gy", "g", "y"), ("yy", "y", "y"))


def _sums_sql() -> str:
    return ", ".join(f"sum({a} * {b}) as {n}" for n, a, b in _PAIRS)


@query("discovery_surges", oracle=f"""
with tl as (
  select a.lang as topic, l.symbol, min(l.date) as date from links l join articles a using (pmid) group by 1, 2
),
pts as (
  select topic, t, cast(n_known as double) as y from (
    select topic, date, sum(n) over (partition by topic order by date rows between unbounded preceding and current row) as n_known,
           (epoch(date) - (select min(epoch(date)) from tl)) / (select max(epoch(date)) from tl) as t
    from (select topic, date, count(*) as n from tl group by 1, 2) d) c
),
cuts(brk) as (values {", ".join(f"({b}::double)" for b in R.DEFAULT_BREAKS)}),
seconds(B2, v2) as (values {", ".join(f"({b}::double, {v}::double)" for b, v in R.DEFAULT_SECONDS)}),
first_part as (
  select topic, brk, B, M, v, {_sums_sql()} from (
    select *, 1 - g as u from (
      select p.topic, p.y, c.brk, grid.*, pow(1 + exp(-grid.B * (p.t - grid.M)), -1 / grid.v) as g
      from pts p join cuts c on p.t < c.brk, {_grid_sql()}) a) b group by all
),
second_part as (
  select topic, brk, B2, v2, {_sums_sql()} from (
    select *, 1 - g as u from (
      select p.topic, p.y, c.brk, s.*, pow(1 + exp(-s.B2 * (p.t - c.brk)), -1 / s.v2) as g
      from pts p join cuts c on p.t >= c.brk, seconds s) a) b group by all
),
both_parts as (
  select topic, brk, B, M, v, B2, v2, f.uu as p, f.ug as q, f.gg + s.uu as r, s.ug as s, s.gg as w,
         f.uy as x, f.gy + s.uy as y, s.gy as z, f.yy + s.yy as yy
  from first_part f join second_part s using (topic, brk)
),
solved as (
  select *, {", ".join(f"{e} as {n}" for n, e in R.SURGE_SOLUTION.items())}
  from (select *, {R.SURGE_DET} as det from both_parts) d where abs(det) > 1e-9
),
fits as (select *, yy - A * x - K * y - L * z as sse from solved where A >= 0 and K >= 0 and L >= 0)
select topic, brk, round(total, 2) as total, round(sse, 2) as sse from (
  select *, A + K + L as total,
         row_number() over (partition by topic order by round(sse, 4), brk, B, M, v, B2, v2) as i from fits) o
where i = 1""", ctes=SQL_LINKS)
def q_discovery_surges(spark, sf_dir):
    """Two linked surges of the terms first seen in each language's articles."""
    from pyspark.sql import Window

    langs = T.articles(spark, sf_dir).select("pmid", F.col("lang").alias("topic"))
    firsts = _links(spark, sf_dir).join(langs, "pmid").groupBy("topic", "symbol").agg(F.min("date").alias("date"))
    per_day = R.year_fraction(firsts.groupBy("topic", "date").agg(F.count(F.lit(1)).alias("n")))
    days = Window.partitionBy("topic").orderBy("date")      # a row a day
    points = per_day.select("topic", "t", F.sum("n").over(days).alias("y"))
    out = R.surge_curve(points)
    return normalize(out.select("topic", "brk", F.round("total", 2).alias("total"), F.round("sse", 2).alias("sse")))


# --------------------------------------------------------- association features
_TOKRE = A.FEATURE_TOKEN
_LEX = ", ".join([f"('{w}', 'ADP')" for w in A.ADPOSITIONS] + [f"('{w}', 'VERB')" for w in A.VERBS])
_COUNTS = ",\n  ".join(f"count(t.cls) filter (where t.cls = '{c}') as {c}" for c in A.CLASSES)


_AF_SQL = rf"""
with am as (
  select pmid, date, sent_pos, sentence,
         length(regexp_extract(sentence, {sql_str('(?s)^(.*?)' + ASSOC_PATTERN)}, 1)) as match_start
  from sents where regexp_matches(sentence, {sql_str(ASSOC_PATTERN)})
),
am2 as (
  select *, len(regexp_extract_all(substr(sentence, 1, match_start + 1), {sql_str(_TOKRE)})) as flip,
         regexp_extract_all(sentence, {sql_str(_TOKRE)}) as tk
  from am
),
ft as (
  select pmid, date, sent_pos, match_start, flip, len(tk) as n_tokens,
         unnest(tk) as token, unnest(range(len(tk))) as tok_pos
  from am2
),
genes as (
  select ft.pmid, ft.sent_pos, ft.tok_pos, d.symbol
  from ft join (select distinct lower(alias) as a, symbol from dictionary) d on lower(ft.token) = d.a
  where not (regexp_matches(ft.token, {sql_str(A.LETTERS_ONLY)}) and (ft.tok_pos = 0 or ft.token = lower(ft.token)))
),
lex(word, cls) as (values {_LEX}),
t as (
  select ft.*, case when ft.tok_pos in (select tok_pos from genes g where g.pmid = ft.pmid and g.sent_pos = ft.sent_pos)
                    then 'GENE'
                    when regexp_matches(ft.token, {sql_str(A.PUNCT_TOKEN)}) then 'PUNCT'
                    else lex.cls end as cls
  from ft left join lex on lower(ft.token) = lex.word
),
g as (
  select genes.symbol, ft.*, genes.tok_pos < ft.flip as before
  from genes join ft on ft.pmid = genes.pmid and ft.sent_pos = genes.sent_pos and ft.tok_pos = genes.tok_pos
),
f as (
  select g.pmid, g.date, g.sent_pos, g.tok_pos, g.token, g.symbol, g.match_start, g.flip, g.before,
         g.n_tokens,
  {_COUNTS}
  from g left join t on t.pmid = g.pmid and t.sent_pos = g.sent_pos
     and ((g.before and t.tok_pos > g.tok_pos and t.tok_pos < g.flip)
          or (not g.before and t.tok_pos >= g.flip and t.tok_pos < g.tok_pos))
  group by all
)
select pmid, date, sent_pos, tok_pos, token, symbol, match_start, flip, before,
       {", ".join(A.CLASSES)}
from f
where not before
   or (flip < n_tokens and tok_pos = (select max(g2.tok_pos) from g g2 where g2.pmid = f.pmid
                                      and g2.sent_pos = f.sent_pos and g2.symbol = f.symbol and g2.before))
"""


@query("association_features", oracle=_AF_SQL, ctes=SQL_SENTS)
def q_association_features(spark, sf_dir):
    s = A.sentences(T.articles(spark, sf_dir))
    return normalize(A.association_features(s, T.dictionary(spark, sf_dir), ASSOC_PATTERN))


# Every second sentence in capitals: terms pass the guard, accented ones too.
CASED_PATTERN = r"(?i)\b(the|der|die|les|los|de|und|of)\b"


@query("association_features_cased", oracle=_AF_SQL.replace(sql_str(ASSOC_PATTERN), sql_str(CASED_PATTERN)).replace(
    sql_str("(?s)^(.*?)" + ASSOC_PATTERN), sql_str("(?s)^(.*?)" + CASED_PATTERN)).replace(
    "from sents where", "from cased where"), ctes=SQL_SENTS + """,
cased as (select pmid, date, sent_pos,
                 case when sent_pos % 2 = 1 then upper(replace(sentence, 'ß', 'ss')) else sentence end as sentence
          from sents)""")
def q_association_features_cased(spark, sf_dir):
    s = A.sentences(T.articles(spark, sf_dir))
    s = s.withColumn("sentence", F.when(F.col("sent_pos") % 2 == 1, F.upper(F.replace("sentence", F.lit("ß"), F.lit("ss"))))
                     .otherwise(F.col("sentence")))
    return normalize(A.association_features(s, T.dictionary(spark, sf_dir), CASED_PATTERN))
