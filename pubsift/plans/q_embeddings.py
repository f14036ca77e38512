"""Registered queries: embeddings, similarities, statistics over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubsift.functions.text import cosine
from pubsift.operators import embeddings as EM
from pubsift.operators import stats as ST
from pubsift.operators import text as X
from pubsift.plans.catalog import query
from pubsift.plans.common import normalize
from pubsift.plans.oracle import sql_in
from pubsift.plans.q_ranking import SQL_LINKS
from pubsift.plans.q_text import SQL_STOKS
from pubsift.sources import tables as T

# Fixed query parameters: target words present in both models.
TARGETS = ["w2", "w5", "w8", "w11", "w14"]
K = 10
EDGE_THRESHOLD = 0.3
N_CLUSTERS = 10             # of the token buckets below, in the SQL too
N_MEANS = 100


def _targets(spark):
    return spark.createDataFrame([(t,) for t in TARGETS], "word string")


def _cos_sql(a: str, b: str) -> str:
    return (f"(list_dot_product({a}::double[], {b}::double[]) / "
            f"(sqrt(list_dot_product({a}::double[], {a}::double[])) * "
            f"sqrt(list_dot_product({b}::double[], {b}::double[]))))")


SQL_SIMS = f"""
sims as (
  select 'a' as model, t.word as target, e.word, {_cos_sql('t.vector', 'e.vector')} as similarity
  from embedding_a e, (select * from embedding_a where word in {sql_in(TARGETS)}) t
  union all
  select 'b', t.word, e.word, {_cos_sql('t.vector', 'e.vector')}
  from embedding_b e, (select * from embedding_b where word in {sql_in(TARGETS)}) t
)"""


# One model: all vectors.
SQL_ALL_SIMS = f"""
sims as (
  select t.word as target, e.word, {_cos_sql('t.vector', 'e.vector')} as similarity
  from word_vectors e, (select * from word_vectors where word in {sql_in(TARGETS)}) t
)"""


@query("pairwise_similarity", oracle="select model, target, word, round(similarity, 6) as similarity from sims",
       ctes=SQL_SIMS)
def q_pairwise_similarity(spark, sf_dir):
    a = EM.pairwise_similarity(_targets(spark), T.embedding_a(spark, sf_dir), "a")
    b = EM.pairwise_similarity(_targets(spark), T.embedding_b(spark, sf_dir), "b")
    return normalize(a.unionByName(b).select("model", "target", "word", "similarity"))


@query("nearest_words", oracle=f"""
select target, word, round(similarity, 6) as similarity, rank from (
  select *, row_number() over (partition by target order by similarity desc, word) as rank
  from sims where word <> target) s
where rank <= {K}""", ctes=SQL_ALL_SIMS)
def q_nearest_words(spark, sf_dir):
    s = EM.pairwise_similarity(_targets(spark), T.word_vectors(spark, sf_dir))
    return normalize(EM.nearest_words(s, K).select("target", "word", "similarity", "rank"))


@query("analogy", oracle=f"""
with q as (
  select list_transform(range(64), lambda i: (r.vector[i + 1] - m.vector[i + 1] + p.vector[i + 1])::double) as qv
  from word_vectors r, word_vectors m, word_vectors p
  where r.word = 'w2' and m.word = 'w5' and p.word = 'w8'
)
select word, round({_cos_sql('q.qv', 'e.vector')}, 6) as similarity
from word_vectors e, q where e.word not in ('w2', 'w5', 'w8')
order by {_cos_sql('q.qv', 'e.vector')} desc, word limit {K}""")
def q_analogy(spark, sf_dir):
    return normalize(EM.analogy(T.word_vectors(spark, sf_dir), "w2", "w5", "w8", K))


@query("common_vocabulary", oracle=f"""
select a.word, round({_cos_sql('a.vector', 'b.vector')}, 6) as similarity
from embedding_a a join embedding_b b on lower(a.word) = lower(b.word)""")
def q_common_vocabulary(spark, sf_dir):
    c = EM.common_vocabulary(T.embedding_a(spark, sf_dir), T.embedding_b(spark, sf_dir),
                             casefold=True)
    return normalize(c.select("word", cosine("vector_a", "vector_b").alias("similarity")))


@query("vocab_substring", oracle="select word from word_vectors where contains(lower(word), '12')")
def q_vocab_substring(spark, sf_dir):
    return EM.vocab_substring(T.word_vectors(spark, sf_dir), "12")


@query("top_dims_by_variance", oracle="""
select dim, round(var_samp(x), 6) as variance from (
  select unnest(range(len(vector))) as dim, unnest(vector)::double as x from word_vectors) d
group by dim order by var_samp(x) desc, dim limit 2""")
def q_top_dims(spark, sf_dir):
    return normalize(EM.top_dims_by_variance(T.word_vectors(spark, sf_dir)))


@query("rank_correlation", oracle="""
with j as (
  select a.target, a.word, a.similarity as sa, b.similarity as sb
  from sims a join sims b on a.target = b.target and a.word = b.word and a.model = 'a' and b.model = 'b'
),
r as (
  select *, rank() over (partition by target order by sa) + (count(*) over (partition by target, sa) - 1) / 2.0 as ra,
            rank() over (partition by target order by sb) + (count(*) over (partition by target, sb) - 1) / 2.0 as rb
  from j
)
select target, count(*) as n, round(corr(ra, rb), 6) as rho from r group by target""", ctes=SQL_SIMS)
def q_rank_correlation(spark, sf_dir):
    a = EM.pairwise_similarity(_targets(spark), T.embedding_a(spark, sf_dir))
    b = EM.pairwise_similarity(_targets(spark), T.embedding_b(spark, sf_dir))
    return normalize(ST.rank_correlation(a, b))


@query("embedding_agreement")
def q_embedding_agreement(spark, sf_dir):
    """Text model vs second model: similarities in both, Spearman rho, p, FDR."""
    a = EM.pairwise_similarity(_targets(spark), T.embedding_a(spark, sf_dir))
    b = EM.pairwise_similarity(_targets(spark), T.embedding_b(spark, sf_dir))
    rc = ST.correlation_p(ST.rank_correlation(a, b))
    return normalize(ST.fdr_adjust(rc, "p", "target"))


@query("fdr_adjust", oracle="""
with t as (select stratum_date, cast(rank as bigint) as rank, p,
                  cast(stratum_date as varchar) || ':' || cast(cast(rank as bigint) as varchar) as key
           from tested),
o as (select *, row_number() over (order by p, key) as j, count(*) over () as n from t)
select stratum_date, rank, round(p, 6) as p,
       round(least(1.0, min(p * n / j) over (order by j desc rows between unbounded preceding and current row)), 6) as fdr
from o""", ctes=SQL_LINKS)
def q_fdr_adjust(spark, sf_dir):
    from pubsift.operators import ranking as R
    from pubsift.plans import q_ranking as QR

    tested = R.prefix_tests(QR._firsts_ranked(spark, sf_dir), QR._nulls(spark, sf_dir)) \
        .select("stratum_date", F.col("rank").cast("bigint").alias("rank"), "p")
    tested = tested.withColumn("key", F.concat_ws(":", F.col("stratum_date").cast("string"),
                                                  F.col("rank").cast("string")))
    return normalize(ST.fdr_adjust(tested, "p", "key").select("stratum_date", "rank", "p", "fdr"))


@query("gene_disease_map", oracle=f"""
select word, round(similarity, 6) as similarity,
       round(case when similarity > 0 then 1 - similarity else 1 + similarity end, 6) as radius,
       round(2 * pi() * (row_number() over (order by similarity desc, word) - 1) / count(*) over (), 6) as angle
from sims where target = 'w2' and word <> 'w2'""", ctes=SQL_ALL_SIMS)
def q_gene_disease_map(spark, sf_dir):
    s = EM.pairwise_similarity(_targets(spark).where("word = 'w2'"), T.word_vectors(spark, sf_dir))
    s = s.where("word <> 'w2'").select("word", "similarity")
    return normalize(EM.polar_layout(s, "similarity", [F.desc("similarity"), F.asc("word")]))


@query("gene_disease_groups")
def q_gene_disease_groups(spark, sf_dir):
    """Every word as a gene, in the order of a bisecting k-means tree."""
    v = T.word_vectors(spark, sf_dir)
    genes = v.where("word <> 'w2'").select(F.upper("word").alias("gene"))
    return normalize(EM.gene_disease_map(v, genes, "w2"))


@query("correlation_edges", oracle=f"""
with l as (select 'w' || cast(vec_id as varchar) as gene, unnest(range(len(embedding))) as sample,
                  unnest(embedding)::double as value from embeddings)
select a.gene as gene_a, b.gene as gene_b, round(corr(a.value, b.value), 6) as correlation
from l a join l b on a.sample = b.sample and a.gene < b.gene
group by a.gene, b.gene having corr(a.value, b.value) >= {EDGE_THRESHOLD}""")
def q_correlation_edges(spark, sf_dir):
    e = T.read_table(spark, sf_dir, "embeddings")
    expr = e.select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("gene"),
                    F.posexplode("embedding").alias("sample", "value")) \
        .withColumn("value", F.col("value").cast("double"))
    return normalize(EM.correlation_edges(expr, EDGE_THRESHOLD))


@query("mean_vector_per_cluster", oracle="""
select cast(label as bigint) as label, dim, round(avg(x), 6) as mean from (
  select label, unnest(range(len(vector))) as dim, unnest(vector)::double as x from word_vectors) v
group by label, dim""")
def q_mean_vector(spark, sf_dir):
    a = T.word_vectors(spark, sf_dir)
    return normalize(EM.mean_vector_per_cluster(a.select("word", "vector"), a.select("word", "label")))


# Token clusters for idcf / profiles: a deterministic md5 bucket of the token
# (the trained pipeline uses kmeans_words over word2vec vectors instead).
_CLUSTER_SQL = f"(cast(('0x' || substr(md5(token), 1, 2))::int as bigint) % {N_CLUSTERS})"


def _token_clusters(vocab):
    return vocab.select(F.col("token").alias("word"),
                        (F.conv(F.substr(F.md5("token"), F.lit(1), F.lit(2)), 16, 10).cast("long")
                         % N_CLUSTERS).alias("label"))


@query("idcf", oracle=f"""
select {_CLUSTER_SQL} as label, round(1.0 / count(distinct pmid), 6) as idcf
from stoks group by 1""", ctes=SQL_STOKS)
def q_idcf(spark, sf_dir):
    toks = X.sentence_token_table(T.articles(spark, sf_dir))
    cl = _token_clusters(toks.select("token").distinct())
    return normalize(EM.idcf(toks, cl))


_PROFILE_SQL = f"""
with c as (select pmid, {_CLUSTER_SQL} as label, count(*) as n from stoks group by 1, 2),
w as (select {_CLUSTER_SQL} as label, 1.0 / count(distinct pmid) as idcf from stoks group by 1),
g as (select d.pmid, l.label from (select distinct pmid from articles) d,
                                 (select distinct {_CLUSTER_SQL} as label from stoks) l)
"""


@query("cluster_profile", oracle=_PROFILE_SQL + """
select g.pmid, g.label, round(coalesce(c.n, 0) * coalesce(w.idcf, 0), 6) as value
from g left join c using (pmid, label) left join w using (label)""", ctes=SQL_STOKS)
def q_cluster_profile(spark, sf_dir):
    from pubsift.session import materialize

    arts = T.articles(spark, sf_dir)
    toks = materialize(X.document_bag(arts))
    cl = materialize(_token_clusters(toks.select("token").distinct()))     # read by the labels and the counts
    labels = cl.select("label").distinct()
    counts = materialize(EM.cluster_counts(toks, cl))
    return normalize(EM.cluster_profile(toks, cl, EM.idcf(toks, cl, counts=counts), labels, docs=arts, counts=counts))


@query("cluster_profile_normalised", oracle=_PROFILE_SQL + """
select g.pmid, g.label, round(coalesce(c.n / sum(c.n) over (partition by g.pmid), 0), 6) as value
from g left join c using (pmid, label)""", ctes=SQL_STOKS)
def q_cluster_profile_norm(spark, sf_dir):
    from pubsift.session import materialize

    arts = T.articles(spark, sf_dir)
    toks = materialize(X.document_bag(arts))
    cl = materialize(_token_clusters(toks.select("token").distinct()))     # read by the labels and the counts
    labels = cl.select("label").distinct()
    counts = materialize(EM.cluster_counts(toks, cl))
    return normalize(EM.cluster_profile(toks, cl, None, labels, normalise=True, docs=arts, counts=counts))


# ------------------------------------------------------- model-based (rows only)
@query("embedding_projection")
def q_embedding_projection(spark, sf_dir):
    """Fit a -> b over common words, project a, report distances against b
    for the common words and for a shifted control pairing."""
    a, b = T.embedding_a(spark, sf_dir), T.embedding_b(spark, sf_dir)
    model = EM.embedding_projection(a, b)
    proj = EM.apply_projection(a.select("word", "vector"), model)
    common = a.select("word").join(b.select("word"), "word")
    from pubsift.operators.ordinals import global_ordinal

    o = global_ordinal(common, ["word"], "_i")
    nxt = o.select((F.col("_i") - 1).alias("_i"), F.col("word").alias("_other"))
    control = (o.join(nxt, "_i").join(proj, "word")
               .select(F.col("_other").alias("word"), "vector"))
    return normalize(EM.projection_quality(proj.join(common, "word"), b, control))


@query("embedding_projection_linear")
def q_embedding_projection_linear(spark, sf_dir):
    """The least-squares map a -> b: distances over the common words."""
    a, b = T.embedding_a(spark, sf_dir), T.embedding_b(spark, sf_dir)
    proj = EM.apply_projection(a.select("word", "vector"), EM.linear_projection(a, b))
    return normalize(EM.projection_quality(proj, b))


@query("kmeans_words")
def q_kmeans_words(spark, sf_dir):
    _, labels = EM.kmeans_words(T.word_vectors(spark, sf_dir), k=N_MEANS)
    return labels


@query("pca_words")
def q_pca_words(spark, sf_dir):
    out = EM.pca_words(T.word_vectors(spark, sf_dir), 50)
    return out.select("word", F.size("vector").alias("dims"))


@query("word2vec")
def q_word2vec(spark, sf_dir):
    arts = T.articles(spark, sf_dir)
    sents = X.sentence_token_lists(arts).select("tokens")
    _, vecs = EM.word2vec(sents, "tokens", size=100, min_count=5, window=5)
    return vecs.select("word", F.size("vector").alias("dims"))
