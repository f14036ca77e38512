"""The networks of all labels: Spark ML's network and first weights, its quality, no dense rows kept."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from pubsift.operators import models as M
from pubsift.operators import network as N


def data(spark, n=240):
    rng = np.random.default_rng(3)
    rows, ys = [], []
    for i in range(n):
        x = rng.integers(0, 3, 6) * (rng.random(6) < 0.6)
        rows.append((i, Vectors.sparse(6, [(j, float(v)) for j, v in enumerate(x) if v])))
        ys += [(i, "xor", int((x[0] > 0) != (x[1] > 0))), (i, "sum", int(x[2] + x[3] > 2)), (i, "always", 1)]
        ys += [(i, "part", int(x[4] > 0))] * (i % 3 > 0)
    split = [(i, "test" if i % 4 == 0 else "train") for i in range(n)]
    return (spark.createDataFrame(rows, ["pmid", "features"]),
            spark.createDataFrame(ys, "pmid long, meshid string, y int"),
            spark.createDataFrame(split, "pmid long, split string"), ["xor", "sum", "always", "part", "never"])


def test_networks_learn_as_spark_ml_does(spark):
    feats, ys, split, labels = data(spark)
    ours = M.networks_per_label(feats, ys, split, labels, 6, hidden=5, max_iter=80).collect()
    theirs = M.fit_per_label(feats, ys, split, labels, M.mlp_factory(6, hidden=5, max_iter=80)).collect()
    assert sorted((r.pmid, r.meshid, r.y) for r in ours) == sorted((r.pmid, r.meshid, r.y) for r in theirs)
    hit = lambda rows, lab: np.mean([r.y == r.y_pred for r in rows if r.meshid == lab])
    for lab in ("xor", "sum", "always", "part"):
        assert hit(ours, lab) >= hit(theirs, lab) - 0.05


def test_gradient_is_the_slope_of_the_loss(spark):
    given = [([0, 2], [1.0, 2.0], [1, 0]), ([1], [1.0], [0, -1]), ([], [], [1, 1])]
    rows = spark.createDataFrame(given, "slots array<int>, counts array<double>, ys array<int>")
    w = np.stack([N.first_weights(spark, 3, 2, 42)] * 2) + np.arange(14) / 50
    x = np.array([[1.0, 0, 2], [0, 1, 0], [0, 0, 0]])

    def loss(at, k):
        margin = N._forward(x, at, 3, 2)[1][:, k]
        return sum(np.log1p(np.exp(-m if ys[k] else m)) for m, (_, _, ys) in zip(margin, given) if ys[k] >= 0)

    found = N._losses(rows, w, np.array([0, 1]), 3, 2, 2)
    for k in (0, 1):
        assert found[k][0] == pytest.approx(loss(w, k))
        for i in range(14):
            step = np.zeros_like(w)
            step[k, i] = 1e-5
            assert found[k][1][i] == pytest.approx((loss(w + step, k) - loss(w - step, k)) / 2e-5, abs=1e-6)


def test_rows_stay_sparse(spark):
    """Every fit held its training rows dense, 32 kB a document: a pass sums them up instead."""
    x = next(N._dense(next(iter(spark.createDataFrame([([0, 4095], [1.0, 2.0])], "slots array<int>, counts array<double>")
                                .toArrow().to_batches())), 4096))[1]
    assert x.shape == (1, 4096) and x.sum() == 3
    feats, ys, split, labels = data(spark, 40)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    M.networks_per_label(feats, ys, split, labels, 6, hidden=2, max_iter=3).agg(F.count(F.lit(1))).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_classes_weigh_the_same(spark):
    """one row in ten is of the class that its input only makes likelier.  Without weights no row
    is given that class; with them the rows that have the input are."""
    rows = [(i, Vectors.sparse(2, {0: 1.0} if i % 10 < 3 else {1: 1.0})) for i in range(400)]
    feats = spark.createDataFrame(rows, ["pmid", "features"])
    ys = spark.createDataFrame([(i, "rare", int(i % 10 == 0)) for i in range(400)], "pmid long, meshid string, y int")
    split = spark.createDataFrame([(i, "test" if i >= 300 else "train") for i in range(400)], "pmid long, split string")

    def given(**kw):
        out = M.networks_per_label(feats, ys, split, ["rare"], 2, hidden=3, max_iter=60, **kw).collect()
        return {r.pmid % 10 for r in out if r.y_pred == 1}

    assert given() == set()
    assert given(balanced=True) == {0, 1, 2}


def test_weights_scale_loss_and_gradient(spark):
    given = [([0], [1.0], [1]), ([1], [2.0], [0]), ([], [], [-1])]
    make = lambda rows: spark.createDataFrame(rows, "slots array<int>, counts array<double>, ys array<int>")
    w = N.first_weights(spark, 2, 2, 42)[None] + np.arange(12) / 50
    live = np.array([0])
    (loss, slope), = N._losses(make(given), w, live, 2, 2, 1, np.array([[1.0, 3.0]])).values()
    (again, other), = N._losses(make(given[:1] * 3 + given[1:]), w, live, 2, 2, 1).values()
    assert loss == pytest.approx(again) and slope == pytest.approx(other, abs=1e-6)


def test_dense_vectors_have_all_their_places(spark):
    feats, ys, split, labels = data(spark, 60)
    thick = feats.rdd.map(lambda r: (r.pmid, Vectors.dense(r.features.toArray()))).toDF(["pmid", "features"])
    one, two = (sorted(M.networks_per_label(f, ys, split, labels, 6, hidden=2, max_iter=5).collect()) for f in (feats, thick))
    assert one == two
