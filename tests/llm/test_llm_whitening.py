"""Whitening against a direct eigenvalue solution in exact integers and numpy."""

import math

import numpy as np
import pytest

from pubsift.llm import queries, whitening
from pubsift.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, n string"


def usable(data):
    return [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, *_ in data
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def compare(out, data, k=4):
    keep = usable(data)
    fit = sorted({tuple(x) for _, x in keep})
    n, dim = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(dim)]
    y = np.array(fit, float) - np.array(sums) / n
    cov = y.T @ y / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(k, int((values > 1e-9 * max(values.max(), 1e-300)).sum()))
    assert len(out) == k * len(keep)
    assert {(r.n, r.identity_error < 1e-4) for r in out} <= {(n, True)}
    by = {}
    for r in out:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    for c in range(k):
        mine, direct = [], []
        for i, x in keep:
            r = by[i][c + 1][0]
            assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums)) == int(r.deviation_text)
            assert abs(r.explained / (values[c] / np.trace(cov)) - 1) < 1e-9
            mine.append(r.whitened)
            direct.append((np.array(x) - np.array(sums) / n) @ axes[:, c] / math.sqrt(values[c]))
        mine, direct = np.array(mine), np.array(direct)
        assert min(abs(mine - direct).max(), abs(mine + direct).max()) < 1e-7


def test_op13_whole_table(spark):
    data = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    compare(queries.op13_whitening(spark, SF).collect(), data)


def test_unusable_and_repeated_rows(spark, rows):
    rng = np.random.default_rng(1)
    data = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * [9, 5, 3, 2, 1, 0.5]], 1, "q") for i in range(90)]
    data += [(100 + i, data[0][1], None, None) for i in range(40)]          # copies count once in the fit
    bad = [(200, None, 1, ""), (201, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1, ""), (202, [float("nan")] + [1.0] * 5, 1, ""),
           (203, [float("inf")] + [1.0] * 5, 1, "")]
    compare(whitening.whiten(rows(data + bad, SCHEMA)).collect(), data)
    short = [(300, [1.0, 2.0], 1, ""), (301, [], 1, "")]                    # not the commonest length
    out = whitening.whiten(rows(data + short, SCHEMA)).collect()
    assert {r.vec_id for r in out} == {i for i, *_ in data}
    again = whitening.whiten(rows(data + [data[1], (None, data[2][1], 1, "")], SCHEMA)).collect()
    assert len(again) == 4 * (len(data) + 2) and sum(r.vec_id is None for r in again) == 4


def test_few_directions(spark, rows):
    flat = [(i, [float(i), 2.0 * i, 0.5], 1, "") for i in range(10)]
    compare(whitening.whiten(rows(flat, SCHEMA)).collect(), flat)           # one component
    assert whitening.whiten(rows([(1, [1.0, 2.0], 1, ""), (2, [1.0, 2.0], 1, "")], SCHEMA)).collect() == []
    for nothing in ([], [(1, None, 1, "")], [(1, [], 1, "")]):
        out = whitening.whiten(rows(nothing, SCHEMA))
        assert out.collect() == [] and out.columns[:3] == ["vec_id", "component", "n"]


def test_large_entries(spark, rows):
    data = [(i, [float(np.float32(1e9 * (i % 7))), float(i), 1.0 / (i + 1)], 1, "") for i in range(60)]
    out = whitening.whiten(rows(data, SCHEMA)).collect()
    keep = usable(data)
    fit = {tuple(x) for _, x in keep}
    sums = [sum(x[j] for x in fit) for j in range(3)]
    exact = {i: sum((len(fit) * a - s) ** 2 for a, s in zip(x, sums)) for i, x in keep}
    for r in out:
        assert int(r.deviation_text) == exact[r.vec_id]
        assert r.deviation == (exact[r.vec_id] if exact[r.vec_id] < 1 << 63 else None)
    assert whitening.quantize(np.array([1e300, -1e300])).tolist() == [2 ** 63 - 1, -2 ** 63]
    mixed = [[0, -1], [40000, 1], [1 << 40, -5], [7, 8]]
    assert whitening.unpack_vectors([whitening.pack_vector(np.array(x, np.int64)) for x in mixed]).tolist() == mixed


@pytest.mark.parametrize("condition", [1.0, 1e6, 1e12])
def test_axes_of_graded_matrices(condition):
    """Small eigenvalues of a graded matrix keep their relative accuracy."""
    rng = np.random.default_rng(4)
    scale = np.geomspace(1, 1 / condition, 12)
    base = rng.normal(size=(200, 12))
    core = base.T @ base
    values, axes = whitening.principal_axes(core * np.outer(scale, scale), 1)
    assert np.allclose(axes.T @ axes, np.eye(12), atol=1e-10)
    back = axes @ np.diag(values) @ axes.T
    assert np.allclose(back / np.outer(scale, scale), core, rtol=1e-9, atol=1e-8)


def test_pivoted_cholesky():
    rng = np.random.default_rng(8)
    low = rng.normal(size=(9, 4))
    factor, order = whitening.pivoted_cholesky(low @ low.T)
    assert factor.shape == (9, 4) and np.allclose(np.triu(factor, 1)[:4, :4], 0)
    assert np.allclose(factor @ factor.T, (low @ low.T)[order][:, order])
    assert (np.diff(np.diag(factor)) <= 1e-12).all()
