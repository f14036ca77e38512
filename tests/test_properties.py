"""Properties from the survey's test strategy."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from places import SF_SMALL
from pubsift.operators import corpus as C
from pubsift.operators import embeddings as EM
from pubsift.operators import ordinals as O
from pubsift.operators import ranking as R
from pubsift.operators import stats as ST
from pubsift.operators import text as X
from pubsift.sources import tables as T


def test_global_ordinal_is_a_deterministic_row_number(spark):
    toks = X.sentence_token_table(T.articles(spark, SF_SMALL))
    v = X.vocabulary(toks)
    w = v.withColumn("rn", F.row_number().over(Window.orderBy("token")) - 1)
    assert w.where("rn <> id").count() == 0
    a = {r.token: r.id for r in v.collect()}
    b = {r.token: r.id for r in v.collect()}
    assert a == b


def test_running_sums_match_window(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 13).alias("v"))
    out = O.running_sums(df, ["k"], {"s": F.col("v")})
    ref = df.withColumn("r", F.sum("v").over(Window.orderBy("k")))
    j = out.join(ref, "k")
    assert j.where("s <> r").count() == 0
    mn = O.running_sums(df, [F.desc("k")], {"m": F.col("v")}, how="min")
    ref2 = df.withColumn("r", F.min("v").over(Window.orderBy(F.desc("k"))))
    assert mn.join(ref2, "k").where("m <> r").count() == 0


def test_enrichment_score_ends_at_zero(spark):
    ranked = T.ranked(spark, SF_SMALL)
    geneset = ranked.where("pos % 3 = 0").select("symbol")
    es = R.enrichment_score(ranked, geneset)
    last = es.orderBy(F.desc("pos")).first()
    assert abs(last.es) < 1e-12


def test_null_rank_sums_full_size_is_total(spark):
    ranked = T.ranked(spark, SF_SMALL)
    n = ranked.count()
    total = ranked.agg(F.sum("rank")).first()[0]
    nulls = R.null_rank_sums(ranked, 20, "7")
    full = nulls.where(F.col("n") == n).select("null_sum").distinct().collect()
    assert len(full) == 1 and abs(full[0][0] - total) < 1e-9


def test_fdr_is_monotone_in_p(spark):
    rows = [(f"k{i}", float(p)) for i, p in enumerate(np.random.default_rng(1).uniform(0, 1, 200))]
    df = spark.createDataFrame(rows, "target string, p double")
    q = ST.fdr_adjust(df, "p", "target").orderBy("p", "target").collect()
    fdr = [r.fdr for r in q]
    assert all(a <= b + 1e-12 for a, b in zip(fdr, fdr[1:]))
    assert all(r.fdr >= r.p - 1e-12 and r.fdr <= 1.0 for r in q)


def test_projection_recovers_known_similarity_transform(spark):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(8, 8)))
    if np.linalg.det(q) < 0:  # a proper rotation (the fit excludes reflections)
        q[:, 0] = -q[:, 0]
    scale, shift = 1.7, rng.normal(size=8)
    xs = rng.normal(size=(200, 8))
    ys = scale * xs @ q.T + shift
    a = spark.createDataFrame([(f"w{i}", [float(v) for v in x]) for i, x in enumerate(xs)],
                              "word string, vector array<double>")
    b = spark.createDataFrame([(f"w{i}", [float(v) for v in y]) for i, y in enumerate(ys)],
                              "word string, vector array<double>")
    m = EM.embedding_projection(a, b)
    assert np.allclose(m["rotation"], q, atol=1e-6)
    assert abs(m["scale"] - scale) < 1e-6
    assert np.allclose(m["shift"], shift, atol=1e-6)


def test_merge_phrases_keeps_base_words(spark):
    toks = X.sentence_token_table(T.articles(spark, SF_SMALL))
    phrases = X.phrase_scores(toks, min_count=3, threshold=0.0)
    merged = X.merge_phrases(toks, phrases)
    n_base = toks.count()
    n_merged = merged.select(F.size(F.split("token", "·")).alias("k")).agg(F.sum("k")).first()[0]
    assert n_merged == n_base
    assert merged.count() <= n_base


def test_greedy_merging_matches_python(spark):
    sent = ["a", "b", "c", "d", "b", "c", "a", "b"]
    toks = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(sent)],
                                 "pmid long, sent_pos int, tok_pos int, token string")
    phrases = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    out = [r.token for r in X.merge_phrases(toks, phrases).orderBy("tok_pos").collect()]
    pairs = {("a", "b"), ("b", "c"), ("c", "d")}
    ref, i = [], 0
    while i < len(sent):
        if i + 1 < len(sent) and (sent[i], sent[i + 1]) in pairs:
            ref.append(sent[i] + "·" + sent[i + 1])
            i += 2
        else:
            ref.append(sent[i])
            i += 1
    assert out == ref


def test_train_test_disjoint_and_sized(spark):
    ids = T.articles(spark, SF_SMALL).select("pmid")
    s = C.train_test_split(ids, 0.25, "42")
    n = ids.count()
    test = s.where("split = 'test'").count()
    assert test == int(np.ceil(0.25 * n))
    assert s.select("pmid").distinct().count() == n


def test_same_result_with_1_and_200_partitions(spark):
    import __spark_entry__ as E

    out = {}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for p in ("1", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", p)
        rows = E.queries()["gene_evidence"](spark, SF_SMALL).collect()
        out[p] = sorted(tuple(r) for r in rows)
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out["1"] == out["200"]


def test_p_values_of_t_and_f():
    import pandas as pd

    p = ST.t_test_p(pd.Series([2.0, 0.0]), pd.Series([10.0, 5.0]))
    assert abs(p[0] - 0.07338803) < 1e-6 and abs(p[1] - 1.0) < 1e-9
    f = ST.f_test_p(pd.Series([3.0]), pd.Series([2.0]), pd.Series([20.0]))
    assert abs(f[0] - 0.07253748) < 1e-6


def test_correlation_edges_exact_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 12))
    base[10:20] = base[0:10] + 0.3 * rng.normal(size=(10, 12))
    rows = [(f"g{i}", j, float(base[i, j])) for i in range(30) for j in range(12)]
    expr = spark.createDataFrame(rows, "gene string, sample int, value double")
    got = {(r.gene_a, r.gene_b) for r in EM.correlation_edges(expr, 0.7, block_rows=7).collect()}
    c = np.corrcoef(base)
    want = {(f"g{i}", f"g{j}") for i in range(30) for j in range(30)
            if f"g{i}" < f"g{j}" and c[i, j] >= 0.7}
    assert got == want and want


def test_incremental_upsert_equals_batch_latest_version(spark, tmp_path):
    """Any split of the dump files into micro-batches gives the batch result."""
    import os

    from pubsift.plans.q_stream import _versioned_dumps
    from pubsift.streaming import incremental as INC

    src = _versioned_dumps(spark, SF_SMALL, str(tmp_path))
    batch = {r.pmid: (r.version if r.n_copies > 1 else None, r.title, r.n_copies)
             for r in C.latest_version(T.articles_versions(spark, SF_SMALL)).collect()}
    for k in (2, 6):
        base = os.path.join(str(tmp_path), f"run{k}")
        out = INC.incremental_upsert(spark, src, os.path.join(base, "state"),
                                     os.path.join(base, "ckpt"), max_files_per_trigger=k)
        got = {r.pmid: (r.version, r.title, r.n_copies) for r in out.collect()}
        assert got == batch


@pytest.mark.parametrize("name", ["kmeans_words", "pca_words"])
def test_one_model_queries_return_every_word(spark, name):
    from pubsift.plans import catalog

    catalog.load_all()
    want = {f"w{r[0]}" for r in T.read_table(spark, SF_SMALL, "embeddings").select("vec_id").collect()}
    assert {r["word"] for r in catalog.QUERIES[name](spark, SF_SMALL).select("word").collect()} == want


def test_grid_search_covers_every_label(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    from pubsift.operators import models as M

    feats = spark.createDataFrame([(i, Vectors.dense([float(i % 2), float(i % 3 == 0)])) for i in range(40)], ["pmid", "features"])
    ys = spark.createDataFrame([(i, m, int(y)) for i in range(40) for m, y in (("even", i % 2 == 0), ("third", i % 3 == 0))],
                               "pmid long, meshid string, y int")
    split = spark.createDataFrame([(i, "test" if i % 10 == 9 else "train") for i in range(40)], "pmid long, split string")
    got = M.grid_search_per_label(feats, ys, split, ["even", "third"], LogisticRegression(maxIter=5),
                                  {"regParam": [1e-4, 1.0]}, folds=2).collect()
    assert sorted((r["meshid"], r["regParam"]) for r in got) == [(m, x) for m in ("even", "third") for x in (1e-4, 1.0)]
    assert all(r["score"] == 1.0 for r in got)
