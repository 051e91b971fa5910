"""Pooled adjacent violators: merged stacks against a fit of all points at once."""

import random

import numpy as np
import pytest

from gradeworks.operators import isotonic


def brute(points):
    """Means of the min-max formula, point by point (Barlow and others)."""
    xs = sorted({x for x, _ in points})
    t = [sum(y for x, y in points if x == v) for v in xs]
    w = [sum(1 for x, _ in points if x == v) for v in xs]
    n = len(xs)
    return {xs[i]: max(min(sum(t[a:b + 1]) / sum(w[a:b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)}


@pytest.mark.parametrize("seed", range(4))
def test_curves_against_the_formula(spark, seed):
    rng = random.Random(seed)
    points = [(c, round(rng.random(), 1 if seed % 2 else 3), float(rng.random() < 0.5)) for c in range(3) for _ in range(60)]
    got = isotonic.curves_of(spark.createDataFrame(points, "c int, v double, t double").repartition(5), "c", "v", "t")
    for c in range(3):
        want = brute([(v, t) for k, v, t in points if k == c])
        assert sorted(got) == [0, 1, 2] and got[c][0] == sorted(got[c][0]) and got[c][1] == sorted(got[c][1])
        assert np.allclose([np.interp(x, *got[c]) for x in want], list(want.values()))


def test_stacks_merge_anywhere():
    rng = random.Random(9)
    points = [(i, i, rng.random(), 1.0 + rng.randint(0, 3)) for i in range(200)]
    whole = isotonic.pooled(points)
    for cut in (1, 50, 133, 199):
        merged = isotonic.pooled(isotonic.pooled(points[:cut]) + isotonic.pooled(points[cut:]))
        assert [b[:2] for b in merged] == [b[:2] for b in whole] and np.allclose(merged, whole)


def test_no_points(spark):
    assert isotonic.curves_of(spark.createDataFrame([], "c int, v double, t double"), "c", "v", "t") == {}
