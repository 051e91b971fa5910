"""Staleness ranking, p-values, curves and profiling properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeworks.operators import explain, profile, staleness


def test_distance(spark):
    df = spark.createDataFrame([(2, [.5, 0., .25, .25, 0., 0.])], "y int, p array<double>")
    assert staleness.with_distance(df).first()["d"] == pytest.approx(1.25)


@pytest.mark.parametrize("per_range", [9, 10**6])
def test_buckets_split_ties_by_key(spark, per_range):
    df = spark.range(100).select(F.col("id").alias("pageid"), F.when(F.col("id") < 40, 1.0).otherwise(F.col("id") / 100).alias("d"))
    order = sorted(((-(1.0 if i < 40 else i / 100), i) for i in range(100)))
    got = {b: sorted(r["pageid"] for r in staleness.review_buckets(df, per_range=per_range).filter(F.col("bucket") == b).collect())
           for b in ("high", "mid", "low")}
    ids = [i for _, i in order]
    assert got == {"high": sorted(ids[:20]), "mid": sorted(ids[40:60]), "low": sorted(ids[-20:])}


@pytest.mark.parametrize("rho,n,p", [(0.5, 20, 0.0247 / 2), (-0.5, 20, 0.0247 / 2), (0.0, 50, 0.5), (1.0, 9, 0.0)])
def test_p_value(rho, n, p):
    assert staleness.one_sided_p(rho, n) == pytest.approx(p, abs=2e-4)


def test_partial_spearman_removes_the_given(spark):
    rng = np.random.default_rng(0)
    age = rng.random(300)
    rows = [(i, float(a + 0.01 * rng.random()), float(a + 0.01 * rng.random()), float(a)) for i, a in enumerate(age)]
    df = spark.createDataFrame(rows, "pageid long, d double, days_since_edit double, age_days double")
    assert abs(staleness.partial_spearman(df).first()["spearman"]) < 0.3


def test_model_preference(spark):
    def pick(kinds):
        return staleness.preferred_model(spark.createDataFrame([(k,) for k in kinds], "kind string"), "catboost").first()[0]
    assert pick(["xgboost", "catboost", "ordinal_cumulative"]) == "ordinal_cumulative"
    assert pick(["xgboost", "catboost"]) == "catboost" and pick(["xgboost", "lightgbm"]) == "lightgbm"


def test_curve_auc(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 0.5), (2, 0.0)], "step int, macro_f1 double")
    assert explain.curve_auc(df).first()["auc"] == pytest.approx(1 / 3)


def test_single_seed_is_stable(spark):
    df = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2)], "seed int, feature string, importance double")
    assert tuple(explain.stability(df).first()) == (0, 1.0)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    rows = [(i, ["Stub", "Start", "C", "B", "GA", "FA"][i % 6], i % 6, float(i % 6), float(rng.random()), None if i % 4 == 0 else float(i))
            for i in range(600)]
    return spark.createDataFrame(rows, "pageid long, label string, grade_rank int, copy double, noise double, gaps double")


@pytest.mark.parametrize("per_range", [50, 10**6])
def test_mutual_information(labelled, per_range):
    mi = dict(profile.mutual_information(labelled, ["copy", "noise"], per_range=per_range).collect())
    assert mi["copy"] == pytest.approx(np.log(6)) and mi["noise"] < 0.15


def test_suspects_and_missing(labelled):
    acc = profile.single_feature_accuracy(labelled, ["copy", "noise", "gaps"])
    assert [r["feature"] for r in profile.leakage_suspects(acc).collect()] == ["copy"]
    missing = dict(profile.missing_fraction(labelled, ["copy", "gaps"]).collect())
    assert missing == {"copy": 0.0, "gaps": 0.25}


def greedy_tree_hits(rows, depth):
    """Rows that the Gini tree of (value, class) rows gets right; every cut is tried."""
    def gini(part):
        return sum(part.count(k) ** 2 for k in set(part)) / len(part)
    classes = [k for _, k in rows]
    values = sorted({v for v, _ in rows})
    if depth == 0 or len(set(classes)) == 1 or len(values) == 1:
        return max(classes.count(k) for k in set(classes))
    tried = [(gini([k for v, k in rows if v <= c]) + gini([k for v, k in rows if v > c]),
              -abs(len(rows) - 2 * sum(v <= c for v, _ in rows)), -c) for c in values[:-1]]
    cut = -max(tried)[2]
    return greedy_tree_hits([r for r in rows if r[0] <= cut], depth - 1) + greedy_tree_hits([r for r in rows if r[0] > cut], depth - 1)


@pytest.mark.parametrize("per_range", [20, 10**6])
def test_single_feature_trees(spark, per_range):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 6)), float(rng.integers(0, 12)), float(rng.random()), 1.0) for i in range(150)]
    rows = [(i, k, x + k // 2, v, c) for i, k, x, v, c in rows]
    df = spark.createDataFrame(rows, "pageid long, grade_rank int, x double, v double, flat double")
    got = dict(profile.single_feature_accuracy(df, ["x", "v", "flat"], per_range=per_range).collect())
    for at, name in ((2, "x"), (3, "v"), (4, "flat")):
        assert got[name] == pytest.approx(greedy_tree_hits([(r[at], r[1]) for r in rows], 3) / len(rows))


@pytest.mark.parametrize("per_range", [50, 10**6])
def test_corr_matrix_pairs_complete_rows(labelled, per_range):
    got = {(r["x"], r["y"]): r["spearman"] for r in profile.corr_matrix(labelled, ["copy", "noise", "gaps"], per_range=per_range).collect()}
    pdf = labelled.toPandas()
    for (x, y), v in got.items():
        both = pdf.dropna(subset=[x, y])
        want = np.corrcoef(both[x].rank(), both[y].rank())[0, 1]
        assert v == pytest.approx(round(want, 3), abs=1.1e-3)
    assert len(got) == 9
