"""Ranks against brute force, with ranges small enough to split every group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeworks.operators import ranking

SIZES = [7, ranking.PER_RANGE]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 1200
    hot = np.where(rng.random(n) < 0.35, 0.0, np.round(rng.normal(size=n), 2))
    return pd.DataFrame({"k": rng.integers(0, 2, n), "v": hot, "w": np.round(hot + rng.normal(size=n), 1),
                         "id": rng.permutation(n)})


@pytest.fixture(scope="module")
def rows(spark, frame):
    return spark.createDataFrame(frame)


@pytest.mark.parametrize("per_range", SIZES)
def test_row_numbers(rows, frame, per_range):
    got = ranking.row_numbers(rows, ["k"], "v", "id", per_range=per_range).toPandas().sort_values(["k", "rn"])
    want = frame.sort_values(["k", "v", "id"])
    assert got["id"].tolist() == want["id"].tolist()
    assert got["rn"].tolist() == (want.groupby("k").cumcount() + 1).tolist()
    assert got["total"].tolist() == want.groupby("k")["id"].transform("count").tolist()


@pytest.mark.parametrize("per_range", SIZES)
def test_middle_rows_only(rows, frame, per_range):
    got = ranking.row_numbers(rows, [], "v", "id", per_range=per_range,
                              only=(F.col("total") / 2 - 4, F.col("total") / 2 + 5)).toPandas()
    want = frame.sort_values(["v", "id"]).iloc[595:605]
    assert sorted(got["id"]) == sorted(want["id"])


@pytest.mark.parametrize("per_range", SIZES)
def test_null_key_stays_a_group(spark, per_range):
    df = spark.createDataFrame([(None, float(i), i) for i in range(30)] + [("a", 1.0, 99)], "k string, v double, id long")
    got = ranking.row_numbers(df, ["k"], "v", "id", per_range=per_range)
    assert got.count() == 31 and got.filter("k is null").agg(F.max("rn")).first()[0] == 30


@pytest.mark.parametrize("per_range", SIZES)
def test_average_ranks(rows, frame, per_range):
    cc = ranking.cumulative_counts(rows, ["k"], "v", per_range=per_range)
    got = cc.select("k", "v", ranking.average_rank().alias("r")).toPandas().sort_values(["k", "v"])
    want = frame.assign(r=frame.groupby("k")["v"].rank()).drop_duplicates(["k", "v"]).sort_values(["k", "v"])
    assert got["r"].tolist() == want["r"].tolist()


@pytest.mark.parametrize("per_range", SIZES)
def test_quantiles(rows, frame, per_range):
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
    got = ranking.exact_quantiles(rows, ["k"], "v", probs, per_range=per_range).toPandas().sort_values("k")
    want = frame.groupby("k")["v"].quantile(list(probs.values())).unstack()
    assert np.allclose(got[list(probs)].to_numpy(), want.to_numpy())


@pytest.mark.parametrize("per_range", SIZES)
def test_spearman(rows, frame, per_range):
    got = {r["k"]: r["spearman"] for r in ranking.spearman(rows, ["k"], "v", "w", per_range=per_range).collect()}
    for k, g in frame.groupby("k"):
        assert got[k] == pytest.approx(np.corrcoef(g["v"].rank(), g["w"].rank())[0, 1])


def test_top_per_group(rows, frame):
    got = ranking.top_per_group(rows, ["k"], [F.col("v").desc(), F.col("id")], 5, spread=F.col("id"), salts=4).toPandas()
    want = frame.sort_values(["v", "id"], ascending=[False, True]).groupby("k").head(5)
    assert sorted(got["id"]) == sorted(want["id"])


def test_first_per_key(rows, frame):
    got = ranking.first_per_key(rows, ["k"], F.col("id")).toPandas()
    assert sorted(got["id"]) == sorted(frame.groupby("k")["id"].min())
