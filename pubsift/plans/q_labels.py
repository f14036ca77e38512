"""Registered queries: labels, label matrix, naive Bayes, metrics, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubsift.operators import corpus as C
from pubsift.operators import labels as L
from pubsift.operators import text as X
from pubsift.plans.catalog import query
from pubsift.plans.common import normalize
from pubsift.plans.q_text import SQL_STOKS
from pubsift.sources import tables as T

SEED = "42"
K_LABELS = 20
K_FEATURES = 100

SQL_LABELS = SQL_STOKS + f""",
split as (
  select pmid, case when row_number() over (order by md5('{SEED}' || cast(pmid as varchar)), pmid)
                         <= ceil(count(*) over () * 0.25) then 'test' else 'train' end as split
  from articles
),
top as (select meshid, count(*) as n from mesh group by meshid order by count(*) desc, meshid limit {K_LABELS}),
lm as (
  select a.pmid, t.meshid, m.pmid is not null as present
  from (select distinct pmid from articles) a cross join top t
  left join (select distinct pmid, meshid from mesh) m on m.pmid = a.pmid and m.meshid = t.meshid
),
ys as (select pmid, meshid, cast(present as bigint) as y from lm),
ys_tr as (select * from ys where pmid in (select pmid from split where split = 'train')),
bow_tr as (select * from bow where pmid in (select pmid from split where split = 'train')),
vocab_tr as (select distinct token from bow_tr),
nd as (select meshid, y, count(*) as n_c from ys_tr group by meshid, y),
tot as (select meshid, count(*) as n from ys_tr group by meshid),
tc as (select meshid, y, token, sum(n) as n_tc from bow_tr join ys_tr using (pmid) group by meshid, y, token),
ct as (select meshid, y, sum(n_tc) as n_tot from tc group by meshid, y),
model as (
  select nd.meshid, nd.y, v.token,
         ln((coalesce(tc.n_tc, 0) + 1) / (coalesce(ct.n_tot, 0) + (select count(*) from vocab_tr))) as log_prob
  from nd cross join vocab_tr v
  left join tc on tc.meshid = nd.meshid and tc.y = nd.y and tc.token = v.token
  left join ct on ct.meshid = nd.meshid and ct.y = nd.y
),
sc as (
  select s.pmid, nd.meshid, nd.y, any_value(ln(nd.n_c / tot.n)) + coalesce(sum(x.lp), 0) as score
  from split s cross join nd join tot on tot.meshid = nd.meshid
  left join (select b.pmid, m.meshid, m.y, b.n * m.log_prob as lp from bow b join model m using (token)) x
    on x.pmid = s.pmid and x.meshid = nd.meshid and x.y = nd.y
  where s.split = 'test'
  group by s.pmid, nd.meshid, nd.y
),
pred as (
  select pmid, meshid,
         cast(case when max(case when y = 0 then score end) is null
                   or max(case when y = 1 then score end) > max(case when y = 0 then score end)
              then 1 else 0 end as bigint) as y_pred
  from sc group by pmid, meshid
)"""


def _setup(spark, sf_dir):
    arts = T.articles(spark, sf_dir)
    mesh = T.mesh(spark, sf_dir)
    top = L.top_labels(mesh, K_LABELS)
    ys = L.class_rows(L.label_matrix(arts, mesh, top))
    return arts, mesh, top, ys


def _nb(spark, sf_dir):
    from pubsift.session import materialize

    arts, mesh = T.articles(spark, sf_dir), T.mesh(spark, sf_dir)
    top = materialize(L.top_labels(mesh, K_LABELS))
    split = materialize(C.train_test_split(arts.select("pmid"), 0.25, SEED))
    tr = split.where("split = 'train'").select("pmid")
    te = split.where("split = 'test'").select("pmid")
    # Train and test read it; its rows know their split and labels, so none is joined by its document.
    bow = materialize(L.labelled_bag(arts, mesh, top, split.select("pmid", "split").distinct()))
    model = L.naive_bayes_fit(bow.where("split = 'train'"), L.class_rows(L.label_matrix(tr, mesh, top)),
                              materialize_input=False)
    pred = L.naive_bayes_predict(model, bow.where("split = 'test'"), docs=te)
    return pred, L.class_rows(L.label_matrix(te, mesh, top))


@query("top_labels", oracle="select meshid, n from top", ctes=SQL_LABELS)
def q_top_labels(spark, sf_dir):
    return L.top_labels(T.mesh(spark, sf_dir), K_LABELS)


@query("label_matrix", oracle="select pmid, meshid, present from lm", ctes=SQL_LABELS)
def q_label_matrix(spark, sf_dir):
    arts, mesh, top, _ = _setup(spark, sf_dir)
    return L.label_matrix(arts, mesh, top)


@query("sort_documents_by_label_count", oracle="""
select pmid, count(*) filter (where present) as n_labels from lm group by pmid
order by n_labels desc, pmid""", ctes=SQL_LABELS)
def q_sort_by_label_count(spark, sf_dir):
    arts, mesh, top, _ = _setup(spark, sf_dir)
    return L.label_counts(L.label_matrix(arts, mesh, top))


@query("attach_mesh", oracle="""
select a.pmid, a.title, array_to_string(list_sort(list(distinct m.meshid)), ',') as labels
from articles a join mesh m on m.pmid = a.pmid group by a.pmid, a.title""")
def q_attach_mesh(spark, sf_dir):
    a = T.articles(spark, sf_dir).select("pmid", "title")
    out = L.attach_labels(a, T.mesh(spark, sf_dir))
    return out.where(F.col("labels").isNotNull()).select(
        "pmid", "title", F.array_join("labels", ",").alias("labels"))


@query("label_names", oracle="""
select m.pmid, m.meshid,
       case substr(m.meshid, 1, 2) when 'L_' then 'language ' || substr(m.meshid, 3)
                                   when 'S_' then 'source ' || substr(m.meshid, 3)
                                   else 'quality ' || substr(m.meshid, 3) end as name
from mesh m""")
def q_label_names(spark, sf_dir):
    mesh = T.mesh(spark, sf_dir)
    ids = mesh.select("meshid").distinct()
    names = ids.select("meshid", F.concat(
        F.when(F.col("meshid").startswith("L_"), F.lit("language "))
        .when(F.col("meshid").startswith("S_"), F.lit("source "))
        .otherwise(F.lit("quality ")), F.substr("meshid", F.lit(3))).alias("name"))
    return L.label_names(mesh, names)


@query("naive_bayes", oracle="select pmid, meshid, y_pred from pred", ctes=SQL_LABELS)
def q_naive_bayes(spark, sf_dir):
    pred, _ = _nb(spark, sf_dir)
    return normalize(pred.select("pmid", "meshid", "y_pred"))


@query("classification_metrics", oracle="""
select meshid, round((tp + tn) / n, 6) as accuracy,
       round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision,
       round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall,
       round(case when tp + fp > 0 and tp + fn > 0 and tp > 0
                  then 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn)))
                  else 0 end, 6) as f1,
       tp + fn as support
from (select p.meshid, count(*) as n,
             count(*) filter (where y = 1 and y_pred = 1) as tp,
             count(*) filter (where y = 0 and y_pred = 1) as fp,
             count(*) filter (where y = 1 and y_pred = 0) as fn,
             count(*) filter (where y = 0 and y_pred = 0) as tn
      from pred p join ys using (pmid, meshid) group by p.meshid) c""", ctes=SQL_LABELS)
def q_classification_metrics(spark, sf_dir):
    pred, ys = _nb(spark, sf_dir)
    return normalize(L.classification_metrics(pred.join(ys, ["pmid", "meshid"])))


@query("select_k_best", oracle=f"""
with f as (
  select s.meshid, s.token,
         case when ssw > 0 then ssb / (ssw / (n0 + n1 - 2)) end as f
  from (
    select x.meshid, x.token, w.n0, w.n1,
           w.n1 * pow(x.s1 / w.n1 - (x.s0 + x.s1) / (w.n0 + w.n1), 2)
             + w.n0 * pow(x.s0 / w.n0 - (x.s0 + x.s1) / (w.n0 + w.n1), 2) as ssb,
           x.q1 - x.s1 * x.s1 / w.n1 + x.q0 - x.s0 * x.s0 / w.n0 as ssw
    from (select meshid, token,
                 sum(case when y = 1 then n else 0 end)::double as s1,
                 sum(case when y = 1 then n * n else 0 end)::double as q1,
                 sum(case when y = 0 then n else 0 end)::double as s0,
                 sum(case when y = 0 then n * n else 0 end)::double as q0
          from bow join ys using (pmid) group by meshid, token) x
    join (select meshid, sum(case when y = 1 then 1 else 0 end) as n1,
                 sum(case when y = 0 then 1 else 0 end) as n0 from ys group by meshid) w
      using (meshid)) s
)
select meshid, token, round(f, 6) as f from (
  select *, row_number() over (partition by meshid order by f desc nulls last, token) as r from f) t
where r <= {K_FEATURES}""", ctes=SQL_LABELS)
def q_select_k_best(spark, sf_dir):
    arts, mesh, top, ys = _setup(spark, sf_dir)
    bow = X.bag_of_words(X.sentence_token_table(arts))
    return normalize(L.select_k_best(L.anova_f(bow, ys), K_FEATURES))


@query("rebalance_undersample", oracle=f"""
select pmid, meshid, y from (
  select ys.*, row_number() over (partition by meshid, y order by md5('{SEED}' || cast(pmid as varchar)), pmid) as o,
         min(c) over (partition by meshid) as keep
  from ys join (select meshid, y, count(*) as c from ys group by meshid, y) k using (meshid, y)) t
where o <= keep""", ctes=SQL_LABELS)
def q_rebalance_undersample(spark, sf_dir):
    _, _, _, ys = _setup(spark, sf_dir)
    return normalize(L.rebalance_undersample(ys, SEED))
