"""Registered queries: Spark ML models (rows-only checks), grid results,
sinks with read-back, weighted word-vector features."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from pubsift.operators import corpus as C
from pubsift.operators import embeddings as EM
from pubsift.operators import labels as L
from pubsift.operators import linear as LN
from pubsift.operators import models as M
from pubsift.operators import ranking as R
from pubsift.operators import stats as ST
from pubsift.operators import text as X
from pubsift.plans.catalog import query
from pubsift.plans.common import normalize
from pubsift.plans.q_labels import K_FEATURES, K_LABELS, SQL_LABELS
from pubsift.plans.q_ranking import SQL_LINKS
from pubsift.plans.q_text import SQL_STOKS
from pubsift.session import materialize, scratch_path
from pubsift.sources import sinks as SK
from pubsift.sources import tables as T

SEED = "42"
N_FEATURES = 1 << 16
N_NETWORK_INPUTS = 1 << 12  # every input has a weight per hidden unit


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _label_data(spark, sf_dir, k=K_LABELS, num_features=N_FEATURES):
    arts = T.articles(spark, sf_dir)
    mesh = T.mesh(spark, sf_dir)
    top = L.top_labels(mesh, k)
    ys = L.class_rows(L.label_matrix(arts, mesh, top))
    feats = M.hashed_features(X.document_token_lists(arts), num_features, docs=arts)
    split = C.train_test_split(arts.select("pmid"), 0.25, SEED)
    labels = [r[0] for r in top.select("meshid").collect()]  # k label ids
    return feats, ys, split, labels


def _per_label(spark, sf_dir, fit, num_features=N_FEATURES):
    return normalize(L.classification_metrics(fit(*_label_data(spark, sf_dir, num_features=num_features))))


def _linear_rows(spark, sf_dir):
    """One row per document and top label, with the counts of the label's own
    ``K_FEATURES`` best tokens of the training documents."""
    arts, mesh = T.articles(spark, sf_dir), T.mesh(spark, sf_dir)
    top = materialize(L.top_labels(mesh, K_LABELS))
    ys = materialize(L.class_rows(L.label_matrix(arts, mesh, top)))
    split = materialize(C.train_test_split(arts.select("pmid"), 0.25, SEED))
    bag = materialize(L.labelled_bag(arts, mesh, top, split))
    per_label = ys.join(split.where("split = 'train'").select("pmid"), "pmid", "left_semi").groupBy("meshid").agg(
        F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0"))
    best = materialize(L.select_k_best(L.anova_f_labelled(bag.where("split = 'train'"), per_label), K_FEATURES))
    return materialize(LN.label_rows(bag.select("pmid", "token", "n"), ys, best, split))


def _linear_metrics(spark, sf_dir, setting):
    return normalize(L.classification_metrics(
        LN.labels_by_linear(_linear_rows(spark, sf_dir), setting, K_FEATURES)))


@query("logistic_labels")
def q_logistic_labels(spark, sf_dir):
    """Logistic regression per label on its best features, C = 1e5."""
    return _linear_metrics(spark, sf_dir, LN.Setting("logistic", c=1e5))


@query("linear_svm_labels")
def q_linear_svm_labels(spark, sf_dir):
    """Hinge loss per label on its best features, balanced classes."""
    return _linear_metrics(spark, sf_dir, LN.Setting("hinge", 1e-3, balanced=True))


@query("mlp_labels")
def q_mlp_labels(spark, sf_dir):
    """A perceptron with one hidden layer per label, classes weighted, all fitted in the same passes."""
    return _per_label(spark, sf_dir, lambda *data: M.networks_per_label(*data, N_NETWORK_INPUTS, hidden=16, max_iter=50,
                                                                        balanced=True), N_NETWORK_INPUTS)


@query("predict_labels", oracle=f"""
with us as (
  select pmid, meshid, y from (
    select t.*, row_number() over (partition by meshid, y order by md5('{SEED}' || cast(pmid as varchar)), pmid) as o,
           min(c) over (partition by meshid) as keep
    from ys_tr t join (select meshid, y, count(*) as c from ys_tr group by meshid, y) k using (meshid, y)) t
  where o <= keep
),
sums as (
  select meshid, token, sum(case when y = 1 then n else 0 end)::double as s1,
         sum(case when y = 1 then n * n else 0 end)::double as q1,
         sum(case when y = 0 then n else 0 end)::double as s0,
         sum(case when y = 0 then n * n else 0 end)::double as q0
  from bow join us using (pmid) group by meshid, token
),
w as (select meshid, sum(y) as n1, sum(1 - y) as n0 from us group by meshid),
ss as (
  select x.*, w.n0, w.n1,
         w.n1 * pow(x.s1 / w.n1 - (x.s0 + x.s1) / (w.n0 + w.n1), 2)
           + w.n0 * pow(x.s0 / w.n0 - (x.s0 + x.s1) / (w.n0 + w.n1), 2) as ssb,
         x.q1 - x.s1 * x.s1 / w.n1 + x.q0 - x.s0 * x.s0 / w.n0 as ssw
  from sums x join w using (meshid)
),
best as (
  select meshid, token, s1, s0 from (
    select ss.*, row_number() over (partition by meshid
             order by case when ssw > 0 then ssb / (ssw / (n0 + n1 - 2)) end desc nulls last, token) as r
    from ss) t where r <= {K_FEATURES}
),
cls as (
  select meshid, n1, n0, sum(s1) as t1, sum(s0) as t0, count(*) as v
  from w join best using (meshid) group by meshid, n1, n0
),
gains as (
  select meshid, token, ln((s1 + 1) / (t1 + v)) - ln((s0 + 1) / (t0 + v)) as g
  from best join cls using (meshid)
),
guess as (
  select s.pmid, c.meshid,
         case when round(ln(c.n1 / c.n0) + coalesce(sum(x.d), 0), 9) > 0 then 1 else 0 end as y_pred
  from split s cross join cls c
  left join (select b.pmid, g.meshid, b.n * g.g as d from bow b join gains g using (token)) x
    on x.pmid = s.pmid and x.meshid = c.meshid
  where s.split = 'test' group by s.pmid, c.meshid, c.n1, c.n0
)
select meshid, round((tp + tn) / n, 6) as accuracy,
       round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision,
       round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall,
       round(case when tp > 0 then 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn)))
                  else 0 end, 6) as f1,
       tp + fn as support
from (select p.meshid, count(*) as n,
             count(*) filter (where y = 1 and y_pred = 1) as tp,
             count(*) filter (where y = 0 and y_pred = 1) as fp,
             count(*) filter (where y = 1 and y_pred = 0) as fn,
             count(*) filter (where y = 0 and y_pred = 0) as tn
      from guess p join ys using (pmid, meshid) group by p.meshid) c""", ctes=SQL_LABELS)
def q_predict_labels(spark, sf_dir):
    """Per label: undersample, select its k best features (ANOVA F), fit naive
    Bayes on its own documents and features, predict every test document."""
    arts = T.articles(spark, sf_dir)
    mesh = T.mesh(spark, sf_dir)
    ys = materialize(L.class_rows(L.label_matrix(arts, mesh, L.top_labels(mesh, K_LABELS))))
    bow = materialize(X.bag_of_words(X.document_bag(arts)))
    split = materialize(C.train_test_split(arts.select("pmid"), 0.25, SEED))
    tr = split.where("split = 'train'").select("pmid")
    te = split.where("split = 'test'").select("pmid")
    ys_tr = materialize(L.rebalance_undersample(ys.join(tr, "pmid", "left_semi"), SEED))
    best = L.select_k_best(L.anova_f(bow, ys_tr, sampled=True), K_FEATURES)
    pred = L.naive_bayes_per_label(bow, ys_tr, best, bow.join(te, "pmid", "left_semi"), te)
    return normalize(L.classification_metrics(pred.join(ys, ["pmid", "meshid"])))


@query("topics")
def q_topics(spark, sf_dir):
    arts = T.articles(spark, sf_dir)
    _, dist = M.topics(X.document_token_lists(arts), k=10, max_iter=100, docs=arts)
    return normalize(dist)


GRID = [LN.Setting("logistic", reg) for reg in (1e-4, 1e-2, 1.0)]


@query("grid_search")
def q_grid_search(spark, sf_dir):
    """Every top label x regularisation: mean accuracy over 4 folds, its spread and
    the rank within the label."""
    table, tried = LN.grid_search(_linear_rows(spark, sf_dir), GRID, K_FEATURES, folds=4)
    named = F.array(*[F.struct(F.lit(s.loss).alias("loss"), F.lit(s.reg).alias("reg"),
                               F.lit(s.balanced).alias("balanced")) for s in tried])
    return normalize(table.withColumn("_s", F.element_at(named, F.col("setting") + 1)).select(
        F.col("key").alias("meshid"), "_s.*", "score", "spread", "rank"))


@query("sentence_classifier")
def q_sentence_classifier(spark, sf_dir):
    """Sentences of annotated documents labelled with the document's strongest
    annotation weight; counts + multinomial logistic regression; accuracy."""
    from pubsift.operators import annotations as AN
    from pubsift.operators import associations as A
    from pubsift.plans.q_misc import _labelled

    strongest = AN.strongest_label(_labelled(spark, sf_dir), "docid", "label")
    s = A.sentences(T.articles(spark, sf_dir)).join(
        strongest.select(F.col("docid").cast("long").alias("pmid"),
                         F.col("weight").cast("string").alias("weight")), "pmid")
    _, acc = M.sentence_classifier(s, "sentence", "weight")
    return normalize(acc)


@query("rebalance_oversample", oracle="""
with d as (select l.toxic as label from labels l join embeddings e on e.vec_id = l.doc_id),
c as (select label, count(*) as n from d group by label)
select label, (select max(n) from c) as count from c""")
def q_rebalance_oversample(spark, sf_dir):
    arts = T.articles(spark, sf_dir)
    lab = T.read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pmid"),
                                                       F.col("toxic").alias("label"))
    from pyspark.ml.functions import array_to_vector

    e = T.read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pmid"),
        array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    data = lab.join(e, "pmid")
    out = M.rebalance_oversample(data, "label", "pmid", k=5)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("count"))


# The reference's settings.
WALK_LENGTH, WALKS_PER_NODE, WALK_VECTOR = 30, 200, 100


@query("random_walk_embedding")
def q_random_walk_embedding(spark, sf_dir):
    e = T.read_table(spark, sf_dir, "embeddings")
    expr = e.select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("gene"),
                    F.posexplode("embedding").alias("sample", "value")) \
        .withColumn("value", F.col("value").cast("double"))
    edges = EM.correlation_edges(expr, 0.3).select(F.col("gene_a").alias("src"),
                                                  F.col("gene_b").alias("dst"))
    walks = M.walk_paths(edges, WALK_LENGTH, WALKS_PER_NODE).select(F.col("path").alias("tokens"))
    _, vecs = EM.word2vec(walks, "tokens", size=WALK_VECTOR, min_count=1, window=10)
    return vecs.select("word", F.size("vector").alias("dims"))


@query("corpus_workflow", oracle="""
with ct as (select a.source as corpus, s.pmid, s.token, count(*) as n
            from stoks s join articles a using (pmid) group by 1, 2, 3),
nd as (select corpus, count(distinct pmid) as n_docs from ct group by 1),
df as (select corpus, token, count(*) as df from ct group by 1, 2),
ft as (select ct.corpus, count(distinct ct.token) as n_features,
              sum(ct.n * (ln((1 + nd.n_docs) / (1 + df.df)) + 1)) as total_weight
       from ct join df on df.corpus = ct.corpus and df.token = ct.token join nd on nd.corpus = ct.corpus group by 1),
tl as (select corpus, arg_max(meshid, (n, meshid)) as top_label
       from (select a.source as corpus, m.meshid, count(*) as n from mesh m join articles a using (pmid) group by 1, 2) c
       group by 1)
select corpus, n_docs, n_features, round(total_weight, 6) as total_weight, top_label
from nd join ft using (corpus) join tl using (corpus)""", ctes=SQL_STOKS)
def q_corpus_workflow(spark, sf_dir):
    """Per corpus (source): tf-idf with the corpus's own document
    frequencies, top labels inside the corpus, label matrix size."""
    arts = T.articles(spark, sf_dir)
    toks = X.document_bag(arts).join(arts.select("pmid", F.col("source").alias("corpus")), "pmid")
    bow = materialize(toks.groupBy("corpus", "pmid", "token").agg(F.sum("n").alias("n")))  # read three times
    n_docs = bow.groupBy("corpus").agg(F.count_distinct("pmid").alias("n_docs"))
    df = bow.groupBy("corpus", "token").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(n_docs, "corpus").select("corpus", "token",
                                            (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)
                                            .alias("idf"))
    w = bow.join(idf, ["corpus", "token"]).withColumn("w", F.col("n") * F.col("idf"))
    feats = w.groupBy("corpus").agg(F.count_distinct("token").alias("n_features"),
                                    F.sum("w").alias("total_weight"))
    mesh = T.mesh(spark, sf_dir).join(arts.select("pmid", F.col("source").alias("corpus")), "pmid")
    labs = mesh.groupBy("corpus", "meshid").agg(F.count(F.lit(1)).alias("n"))
    top = labs.groupBy("corpus").agg(F.max(F.struct("n", "meshid")).alias("_t"))
    return normalize(n_docs.join(feats, "corpus").join(top, "corpus").select(
        "corpus", "n_docs", "n_features", "total_weight", F.col("_t.meshid").alias("top_label")))


WORKFLOW_GRID = [LN.Setting("logistic", reg) for reg in (1e-4, 1e-2, 1.0)]


@query("corpus_workflow_models")
def q_corpus_workflow_models(spark, sf_dir):
    """The other stages of the workflow, per corpus (source): the search over all
    (label, setting, fold) models of the corpus's five top labels, its mean score,
    accuracy and F1 of the chosen models on the test documents, word vectors."""
    from pubsift.operators import workflow as W

    arts = T.articles(spark, sf_dir).withColumn("corpus", F.col("source"))
    toks = materialize(X.sentence_token_table(arts).join(arts.select("pmid", "corpus"), "pmid"))
    split = materialize(C.train_test_split(arts.select("pmid"), 0.25, SEED))
    ys = W.corpus_labels(arts.select("corpus", "pmid"), T.mesh(spark, sf_dir))
    models = W.corpus_models(X.bag_of_words(toks), ys, split, WORKFLOW_GRID, K_FEATURES)
    per = models.groupBy("corpus").agg(F.count(F.lit(1)).alias("n_labels"), F.avg("score").alias("score"),
                                       F.avg("accuracy").alias("accuracy"), F.avg("f1").alias("f1"))
    lines = X.sentence_token_lists(arts).join(arts.select("pmid", "corpus"), "pmid")
    vectors = W.corpus_vectors(lines, ["pmid", "sent_pos"], num_partitions=4, max_iter=4)
    words = vectors.groupBy("corpus").agg(F.count(F.lit(1)).alias("n_vectors"))
    return normalize(per.join(words, "corpus", "left"))


# --------------------------------------------------------------- grid results
_FITS_SQL = """
with pts as (
  select (epoch(date) - min(epoch(date)) over ()) / max(epoch(date)) over () as t, cast(n_known as double) as y
  from (select date, sum(n) over (order by date rows between unbounded preceding and current row) as n_known
        from (select date, count(*) as n from firsts group by date) d) c
),
s as (
  select B, M, v, sum((1-g)*(1-g)) as suu, sum((1-g)*g) as sug, sum(g*g) as sgg,
         sum((1-g)*y) as suy, sum(g*y) as sgy, sum(y*y) as syy
  from (select p.*, grid.*, pow(1 + exp(-grid.B * (p.t - grid.M)), -1 / grid.v) as g
        from pts p, GRID) x
  group by B, M, v
),
fits as (
  select B, M, v, -(syy - 2*A*suy - 2*K*sgy + A*A*suu + 2*A*K*sug + K*K*sgg) as score
  from (select *, (suy*sgg - sgy*sug) / (suu*sgg - sug*sug) as A,
                  (sgy*suu - suy*sug) / (suu*sgg - sug*sug) as K
        from s where abs(suu*sgg - sug*sug) > 1e-12) q
)"""


def _grid_sql():
    from pubsift.plans.q_ranking import _grid_sql as g

    return g()


def _fits(spark, sf_dir):
    from pubsift.plans.q_ranking import _links

    firsts = R.first_mentions(_links(spark, sf_dir))
    pts = R.year_fraction(R.cumulative_discoveries(firsts)).select("t", F.col("n_known").alias("y"))
    return R.logistic_fits(pts).withColumn("score", -F.col("sse"))


@query("best_params", oracle=_FITS_SQL.replace("GRID", _grid_sql()) + """
select v, round(max(score), 6) as score, arg_max(B, (score, B, M)) as B, arg_max(M, (score, B, M)) as M
from fits group by v""", ctes=SQL_LINKS)
def q_best_params(spark, sf_dir):
    return normalize(ST.best_params(_fits(spark, sf_dir), "v", "score", ["B", "M"]))


@query("score_spread", oracle=_FITS_SQL.replace("GRID", _grid_sql()) + """,
bestm as (select v, arg_max(M, (score, B, M)) as bm from fits group by v)
select f.v, round(stddev_pop(f.score), 6) as spread, count(*) as n
from fits f join bestm b on b.v = f.v and f.M = b.bm group by f.v""", ctes=SQL_LINKS)
def q_score_spread(spark, sf_dir):
    return normalize(ST.score_spread(_fits(spark, sf_dir), "v", "score", "B", ["M"]))


# ---------------------------------------------------------- weighted vectors
_VEC_OF = "(cast(('0x' || substr(md5(token), 1, 4))::int as bigint) % (select count(*) from embeddings))"


@query("tfidf_word_vectors", oracle=f"""
with tf as (
  select b.pmid, b.token, b.n * i.idf / sqrt(sum((b.n * i.idf) * (b.n * i.idf)) over (partition by b.pmid)) as w
  from bow b join (select token, ln((1 + (select count(distinct pmid) from bow)) / (1 + count(*))) + 1 as idf
                   from bow group by token) i on i.token = b.token
),
ev as (select row_number() over (order by vec_id) - 1 as k, embedding from embeddings),
j as (select tf.pmid, tf.w, ev.embedding from tf join ev on ev.k = {_VEC_OF})
select pmid, dim, round(sum(w * x) / sum(w), 6) as value from (
  select pmid, w, unnest(range(len(embedding))) as dim, unnest(embedding)::double as x from j) u
group by pmid, dim""", ctes=SQL_STOKS)
def q_tfidf_word_vectors(spark, sf_dir):
    from pubsift.operators.ordinals import global_ordinal

    bow = materialize(X.bag_of_words(X.sentence_token_table(T.articles(spark, sf_dir))))
    weights = X.tfidf(bow, X.idf_table(bow))
    e = global_ordinal(T.read_table(spark, sf_dir, "embeddings"), ["vec_id"], "k", start=0)
    n = e.count()
    vocab = bow.select("token").distinct()
    vectors = vocab.select(F.col("token").alias("word"),
                           (F.conv(F.substr(F.md5("token"), F.lit(1), F.lit(4)), 16, 10).cast("long")
                            % n).alias("k")).join(e.select("k", F.col("embedding").alias("vector")), "k")
    return normalize(L.tfidf_word_vectors(weights, vectors.select("word", "vector")))


# ------------------------------------------------------------------ sinks
@query("append_articles", oracle="""
select conv_id, turn, (select max(pmid) from articles)
       + row_number() over (order by conv_id, turn) as pmid
from conversations where role <> 'system'""")
def q_append_articles(spark, sf_dir):
    conv = T.read_table(spark, sf_dir, "conversations")
    excluded = conv.where("role = 'system'").select(
        F.concat_ws(":", "conv_id", "turn").alias("pmid"))
    new = conv.select(F.concat_ws(":", "conv_id", "turn").alias("pmid"), "conv_id", "turn", "text")
    path = _scratch(spark, "append")
    rows = SK.append_articles(new, T.articles(spark, sf_dir), excluded, path, ["conv_id", "turn"])
    return spark.read.parquet(path).select("conv_id", "turn", "pmid")


@query("delete_articles", oracle="""
select pmid from articles where pmid not in (select doc_id from labels where toxic = 1)""")
def q_delete_articles(spark, sf_dir):
    ids = T.read_table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("pmid"))
    path = _scratch(spark, "delete")
    SK.delete_articles(T.articles(spark, sf_dir).select("pmid", "title"), ids, path)
    return spark.read.parquet(path).select("pmid")


@query("id_registry", oracle="""
select doc_id as pmid from labels union select pmid from articles where lang = 'en'""")
def q_id_registry(spark, sf_dir):
    path = _scratch(spark, "registry")
    first = T.read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pmid"))
    SK.id_registry_update(spark, path, first)
    return SK.id_registry_update(spark, path, T.articles(spark, sf_dir).where("lang = 'en'"))


@query("write_dictionary", oracle="select symbol, alias from dictionary")
def q_write_dictionary(spark, sf_dir):
    target = SK.write_dictionary(T.dictionary(spark, sf_dir), _scratch(spark, "dictionary"), "2024-01-01")
    return spark.read.option("header", "true").csv(target)


@query("write_results", oracle="""
select symbol, count(distinct pmid) as n_docs from links group by symbol""", ctes=SQL_LINKS)
def q_write_results(spark, sf_dir):
    from pubsift.plans.q_ranking import _links

    res = _links(spark, sf_dir).groupBy("symbol").agg(F.count_distinct("pmid").alias("n_docs"))
    path = _scratch(spark, "results")
    SK.write_results(res, path, "json")
    return spark.read.schema("symbol string, n_docs long").json(path)
