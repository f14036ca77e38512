"""Two-surge discovery curves against planted ones."""

import math
import random

import numpy as np
import pytest

from pubsift.operators import ranking as R


def curve(t, a, k, b, m, v, brk, l, b2, v2):
    if t < brk:
        return a + (k - a) / (1 + math.exp(-b * (t - m))) ** (1 / v)
    return k + (l - k) / (1 + math.exp(-b2 * (t - brk))) ** (1 / v2)


PLANTED = {"x": (5.0, 120.0, 20.0, 0.3, 1.0, 0.6, 400.0, 10.0, 0.5), "y": (0.0, 60.0, 50.0, 0.2, 2.0, 0.45, 90.0, 20.0, 2.0),
           "z": (30.0, 35.0, 10.0, 0.1, 0.5, 0.75, 1000.0, 50.0, 1.0)}


def test_planted_curves_of_many_topics(spark):
    rows = [(topic, i / 160, curve(i / 160, *p)) for topic, p in PLANTED.items() for i in range(161)]
    got = {r.topic: r for r in R.surge_curve(spark.createDataFrame(rows, "topic string, t double, y double")).collect()}
    for topic, (a, k, b, m, v, brk, top, b2, v2) in PLANTED.items():
        r = got[topic]
        assert r.sse < 1e-3 and r.brk == brk and (r.B2, r.v2) == (b2, v2)
        assert (r.A, r.K, r.L) == pytest.approx((a, k, top), abs=1e-3)
        assert r.total == pytest.approx(a + k + top, abs=1e-3)


def test_fits_equal_direct_least_squares(spark):
    rng = random.Random(2)
    rows = [("a", rng.random(), 50 * rng.random()) for _ in range(60)]
    grid, breaks, seconds = [(5.0, 0.3, 1.0), (20.0, 0.5, 2.0)], [0.3, 0.7], [(5.0, 1.0), (50.0, 0.5)]
    fits = R.surge_fits(spark.createDataFrame(rows, "topic string, t double, y double"), grid=grid, breaks=breaks,
                        seconds=seconds).collect()
    t, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for f in fits:
        g = (1 + np.exp(-f.B * (t - f.M))) ** (-1 / f.v)
        h = (1 + np.exp(-f.B2 * (t - f.brk))) ** (-1 / f.v2)
        one = t < f.brk
        x = np.stack([np.where(one, 1 - g, 0), np.where(one, g, 1 - h), np.where(one, 0, h)], axis=1)
        w, *_ = np.linalg.lstsq(x, y, rcond=None)
        assert (f.A, f.K, f.L) == pytest.approx(tuple(w), rel=1e-6)
        assert f.sse == pytest.approx(((x @ w - y) ** 2).sum(), rel=1e-6)
    assert len(fits) > 0
    assert R.surge_curve(spark.createDataFrame([], "topic string, t double, y double")).collect() == []
