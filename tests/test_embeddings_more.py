"""Projections, correlations over complete pairs, genes in group order."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from pubsift.operators import embeddings as EM

VECTORS = "word string, vector array<double>"


def test_linear_projection_recovers_a_planted_map(spark):
    rng = np.random.default_rng(1)
    m, shift = rng.normal(size=(5, 5)), rng.normal(size=5)
    x = rng.normal(size=(80, 5)) + 3
    a = spark.createDataFrame([(f"w{i}", v.tolist()) for i, v in enumerate(x)], VECTORS)
    b = spark.createDataFrame([(f"w{i}", (m @ v + shift).tolist()) for i, v in enumerate(x[:60])] + [("z", [0.0] * 5)], VECTORS)
    model = EM.linear_projection(a, b)
    assert model["n"] == 60
    assert np.allclose(model["rotation"], m, atol=1e-8) and np.allclose(model["shift"], shift, atol=1e-8)
    got = {r.word: r.vector for r in EM.apply_projection(a, model).collect()}
    assert np.allclose(got["w70"], m @ x[70] + shift, atol=1e-7)
    with pytest.raises(ValueError):
        EM.linear_projection(a, spark.createDataFrame([("other", [0.0] * 5)], VECTORS))


def test_linear_projection_of_noisy_words_is_least_squares(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 3)), rng.normal(size=(50, 4))
    frames = [spark.createDataFrame([(f"w{i}", v.tolist()) for i, v in enumerate(z)], VECTORS).repartition(6) for z in (x, y)]
    model = EM.linear_projection(*frames)
    w, *_ = np.linalg.lstsq(np.hstack([np.ones((50, 1)), x]), y, rcond=None)
    assert np.allclose(model["shift"], w[0]) and np.allclose(model["rotation"], w[1:].T)


@pytest.mark.parametrize("block", [512, 4])
def test_correlations_over_complete_pairs(spark, block):
    rng = random.Random(3)
    rows = [(f"g{g}", s, rng.choice([rng.random(), s * 0.3 + rng.random() * 0.1]))
            for g in range(14) for s in range(9) if rng.random() < 0.7]
    rows += [("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("a", 3, 10.0), ("b", 0, 1.0), ("b", 1, 2.0), ("b", 2, 3.0)]
    rows += [("flat", s, 2.0) for s in range(9)] + [("gap", 0, None), ("gap", 1, float("nan")), ("gap", 2, 4.0)]
    out = EM.correlation_edges(spark.createDataFrame(rows, "gene string, sample int, value double"), 0.2, block_rows=block)
    got = {(r.gene_a, r.gene_b): r.correlation for r in out.collect()}
    wide = pd.DataFrame(rows, columns=["gene", "sample", "value"]).dropna().pivot(index="sample", columns="gene", values="value")
    corr = wide.corr(min_periods=2)
    expect = {(p, q): corr.loc[p, q] for p in corr for q in corr if p < q and corr.loc[p, q] >= 0.2}
    assert got.keys() == expect.keys() and got["a", "b"] == pytest.approx(1.0)
    assert all(got[k] == pytest.approx(expect[k]) for k in got)


def test_genes_of_a_group_stand_together(spark):
    rng = np.random.default_rng(5)
    centres = {"P": [9, 0, 0], "Q": [0, 9, 0], "R": [0, 0, 9], "S": [-9, -9, 0]}
    rows = [(f"{c}{i}".lower(), (np.array(v) + rng.normal(size=3) * 0.1).tolist()) for c, v in centres.items() for i in range(6)]
    rows += [("flu", [9.0, 1.0, 0.0])]
    genes = [(f"{c}{i}",) for c in centres for i in range(6)] + [("ABSENT",)]
    out = EM.gene_disease_map(spark.createDataFrame(rows, VECTORS), spark.createDataFrame(genes, "gene string"), "flu", 8)
    got = sorted(out.collect(), key=lambda r: r.group_pos)
    assert [r.group_pos for r in got] == list(range(24))
    # The leaves of one branch are neighbours, so are the genes of one centre.
    assert sum(p.gene[0] != q.gene[0] for p, q in zip(got, got[1:])) == 3
    assert [(r.group, r.similarity) for r in got] == sorted((r.group, r.similarity) for r in got)
    for r in got:
        x = r.similarity
        assert r.radius == pytest.approx(1 - x if x > 0 else 1 + x)
        assert r.angle == pytest.approx(r.group_pos * (2 * math.pi - 1) / 24 + 0.5)
