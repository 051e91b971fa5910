"""Metrics on hand-computed pairs, decision rules, calibration, bootstrap."""

import pytest
from pyspark.sql import functions as F

from gradeworks.functions import probability as prob
from gradeworks.operators import metrics

Y = [0, 0, 0, 1, 2, 2, 3, 4, 5, 5]
P = [0, 2, 0, 1, 1, 2, 3, 5, 5, 3]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(list(zip(Y, P)), "y int, pred int")


def test_hand_values(pairs):
    """Six of ten hit, two more are one off; errors 2, 1, 1, 2, whose squares sum to 10."""
    r = metrics.all_metrics(pairs).first()
    assert r["acc"] == pytest.approx(0.6) and r["within_one"] == pytest.approx(0.8) and r["ordinal_mae"] == pytest.approx(0.6)
    # hits, rated and predicted per grade: 2 of 3 and 2; 1 of 1 and 2; 1 of 2 and 2; 1 of 1 and 2; 0 of 1 and 0; 1 of 2 and 2
    want = {0: 4 / 5, 1: 2 / 3, 2: 1 / 2, 3: 2 / 3, 4: 0.0, 5: 1 / 2}
    assert r["macro_f1"] == pytest.approx(sum(want.values()) / 6)
    assert {x["grade"]: x["f1"] for x in metrics.per_class_f1(pairs).collect()} == pytest.approx(want)
    # squared errors expected by chance: sum over pairs of (y - p)^2, over ten
    chance = sum((y - p) ** 2 for y in Y for p in P) / 10
    assert r["qwk"] == pytest.approx(1 - 10 / chance)


def test_absent_class_scores_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 1)], "y int, pred int")
    assert metrics.all_metrics(df).first()["macro_f1"] == pytest.approx(2 / 6)


def test_bootstrap_brackets_the_point(pairs):
    for r in metrics.bootstrap_ci(pairs, n_boot=200, seed=1).collect():
        assert r["ci_lo"] <= r["point"] <= r["ci_hi"]
    one, two = (metrics.bootstrap_ci(pairs, n_boot=50, seed=1).orderBy("metric").collect() for _ in range(2))
    assert one == two


def _apply(spark, rule, p):
    return spark.createDataFrame([(p,)], "p array<double>").select(rule(F.col("p"))).first()[0]


@pytest.mark.parametrize("p,grade", [([.5, .5, 0., 0., 0., 0.], 0), ([0., 0., 0., 0., .2, .8], 5), ([0., .5, .5, 0., 0., 0.], 2)])
def test_half_rounds_to_even(spark, p, grade):
    assert _apply(spark, prob.expected_round, p) == grade


def test_rules(spark):
    assert _apply(spark, prob.argmax, [.1, .4, .4, .1]) == 1
    soft = _apply(spark, prob.softmax, [1000., 1000., -1000.])
    assert soft == pytest.approx([.5, .5, 0])
    got = _apply(spark, prob.cumulative_to_class, [.9, .5, .6, .2, .1])
    assert sum(got) == pytest.approx(1) and got == pytest.approx([.1, .4, 1e-9, .3, .1, .1], abs=1e-6)


def test_calibration_edges(spark):
    rows = [(0, [0.2, 0.1]), (0, [0.2, 0.1]), (1, [0.2, 0.1]), (0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "y int, p array<double>")
    assert metrics.ece(df).first()["ece"] == pytest.approx(abs(2 - 0.6) / 4)
    got = {r["bin"]: r["accuracy"] for r in metrics.reliability(df).collect()}
    assert len(got) == 10 and got[2] == 0.667 and got[3] is None


def test_holdout_needs_more_than_ten(spark):
    df = spark.createDataFrame([(0, 0, i < 10) for i in range(20)], "y int, pred int, temporal_holdout boolean")
    assert metrics.holdout_f1(df).first()["temporal_holdout_f1"] is None
    df = spark.createDataFrame([(0, 0, i < 11) for i in range(20)], "y int, pred int, temporal_holdout boolean")
    assert metrics.holdout_f1(df).first()["temporal_holdout_f1"] == pytest.approx(1 / 6)


def test_soft_targets(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0, 1.0])], "y int, p array<double>")
    got = {r["target"]: r["weight"] for r in prob.soft_target_rows(df, "p", "y", 0.7).collect()}
    assert got == pytest.approx({1: 0.3, 2: 0.7})
