"""Random forests: splits against brute force, trees that hang on seed and number only, folds left out, deep trees stored whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeworks.operators import bagging, boosting, explain, learners
from gradeworks.operators.bagging import Bag

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    y = (F.col("id") * 7 % 6).cast("int")
    noise = [F.rand(seed=s) for s in (1, 2, 3)]
    return spark.range(600).select(F.col("id").alias("pageid"), y.alias("y"), (y + noise[0]).alias("a"), (noise[1] - y * 0.5).alias("b"), noise[2].alias("c")).persist()


@pytest.mark.parametrize("nodes", [1, 300])
def test_cuts_are_the_best(nodes):
    rng = np.random.default_rng(nodes)
    n, k, least = 400, 3, 2
    node, b, y, w = np.sort(np.append(np.arange(nodes), rng.integers(0, nodes, n - nodes))), rng.integers(0, 9, n), rng.integers(0, k, n), rng.integers(1, 4, n).astype(float)
    total = np.zeros((nodes, k))
    np.add.at(total, (node, y), w)
    top, last, left = bagging._cuts(node * 256 + b, y, w, total, least)
    for x in range(nodes):
        best = (-np.inf, None, None)
        for cut in range(256):
            sums = [np.bincount(y[m], w[m], k) for m in ((node == x) & (b <= cut), (node == x) & (b > cut))]
            if min(s.sum() for s in sums) >= least and (score := sum((s * s).sum() / s.sum() for s in sums)) > best[0] + 1e-9:
                best = (score, cut, sums[0])
        assert top[x] == pytest.approx(best[0])
        if best[1] is not None:
            assert last[x] == best[1] and left[x].tolist() == best[2].tolist()


def test_no_hang_on_partitions(table):
    """Spark's draws differ by partition, so the same rows in other partitions gave another forest."""
    one, two = (learners.fit("random_forest", df, COLS, {"trees": 9, "depth": 8}, 7).parts["forest"].trees for df in (table.coalesce(1), table.repartition(7)))
    assert len(one) == 9 and all(np.array_equal(a, b) for s, t in zip(one, two, strict=True) for a, b in zip(s, t, strict=True))


def test_fold_is_left_out(table):
    folded = learners.with_fold(table, 3, 1, name="_fold0")
    binned = boosting.binned(folded, COLS, 6, folds=["_fold0"])
    rest = boosting.binned(folded.withColumn("y", F.when(F.col("_fold0") == 1, 0).otherwise(F.col("y"))), COLS, 6, folds=["_fold0"])
    for held, same in (((0, 1), True), (None, False)):
        one, two = (bagging.bagged(b, [Bag(trees=4, held=held)])[0].trees for b in (binned, rest))
        assert all(np.array_equal(s[3], t[3]) for s, t in zip(one, two, strict=True)) == same  # what fold 1 says does not count


def test_deep_trees_learn_all_rows(spark, table, tmp_path):
    fitted = learners.fit("random_forest", table.withColumn("c", F.col("pageid").cast("double")), COLS, {"trees": 40, "depth": 30})
    learners.save(fitted, str(tmp_path / "deep"), spark)
    again = learners.load(str(tmp_path / "deep"), spark)
    df = table.withColumn("c", F.col("pageid").cast("double"))
    right = again.score(df).agg(F.avg((F.array_position("p", F.array_max("p")) - 1 == F.col("y")).cast("double"))).first()[0]
    assert right > 0.99
    shares = {r["feature"]: r["importance"] for r in explain.tree_importance(again, spark).collect()}
    assert shares["a"] > shares["c"] and sum(shares.values()) == pytest.approx(1)


def test_no_rows(table):
    p = learners.fit("random_forest", table.limit(0), COLS, {"trees": 3})
    assert p.parts["forest"].trees == []


def test_cuts_sort_values_once(monkeypatch):
    """Many nodes, weights of any size: class sums of a plain count, without the places that sorting by ``unique`` costs."""
    monkeypatch.setattr(np, "unique", lambda *a, **b: pytest.fail("sorted by places"))
    rng = np.random.default_rng(3)
    nodes, n, k = 500, 2000, 5
    node, b, y, w = np.append(np.arange(nodes), rng.integers(0, nodes, n - nodes)), rng.integers(0, 255, n), rng.integers(0, k, n), rng.integers(1, 300, n).astype(float)
    total = np.zeros((nodes, k))
    np.add.at(total, (node, y), w)
    top, last, left = bagging._cuts(node * 256 + b, y, w, total, 1)
    for x in np.flatnonzero(top > -np.inf).tolist():
        mine = (node == x) & (b <= last[x])
        sums = np.bincount(y[mine], w[mine], k)
        rest = total[x] - sums
        assert left[x].tolist() == sums.tolist()
        assert top[x] == pytest.approx((sums * sums).sum() / sums.sum() + (rest * rest).sum() / rest.sum())
