"""Boosting on histograms: both ways of adding up give the same trees, splits are the best ones, leaves add up."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeworks.operators import boosting as b

COLS = ["x", "z", "w"]
RULES = {"depth": b.Lane(rounds=4, depth=3), "leaves": b.Lane(rounds=4, growth="leaves", leaves=11, depth=99, min_rows=5),
         "levels": b.Lane(rounds=4, growth="levels", depth=3, l2=3.0), "thresholds": b.Lane(rounds=3, thresholds=True, sample=0.7),
         "fold": b.Lane(rounds=3, held=(0, 1), features=(0, 2))}


@pytest.fixture(scope="module")
def rows(spark):
    y = (F.col("id") * 7 % 4).cast("int")
    noise = [F.rand(seed=s) for s in (1, 2)]
    return spark.range(700).select(F.col("id").alias("pageid"), y.alias("y"), (y + 2 * noise[0]).alias("x"), F.round(noise[1] * 9).alias("z"),
                                   F.when(F.col("id") % 5 == 0, None).otherwise(y % 2 + noise[1]).alias("w"), (F.col("id") % 3).cast("int").alias("f0")).persist()


def trained(spark, rows, lanes, block_rows):
    table = b.binned(rows, COLS, 4, folds=["f0"], block_rows=block_rows)
    return b.train(table, lanes)


def test_blocks_and_waves_give_the_same_trees(spark, rows):
    lanes = list(RULES.values())
    one, many = trained(spark, rows, lanes, 1 << 16), trained(spark, rows, lanes, 200)
    for name, p, q in zip(RULES, one, many, strict=True):
        assert len(p.trees) == len(q.trees) == p.lane.rounds * (3 if name == "thresholds" else 4)
        for s, t in zip(p.trees, q.trees, strict=True):
            assert s[0] == t[0] and all(np.array_equal(x, y) for x, y in zip(s[1:], t[1:], strict=True)), name
    again = trained(spark, rows, lanes[3:4], 1 << 16)[0]
    assert [t[0] for t in again.trees] == [t[0] for t in one[3].trees] and np.array_equal(again.trees[-1][5], one[3].trees[-1][5])


def test_scores_stored_between_rounds_change_nothing(spark, rows, monkeypatch):
    lanes = [b.Lane(rounds=5, depth=2)]
    one = trained(spark, rows, lanes, 1 << 16)[0]
    monkeypatch.setattr(b, "SCORES_EVERY", 2)
    many = trained(spark, rows, lanes, 300)[0]
    assert all(np.array_equal(s[5], t[5]) for s, t in zip(one.trees, many.trees, strict=True))


def test_first_split_is_the_best_of_all(spark, rows):
    """Every cut of every feature, tried one after another."""
    forest = trained(spark, rows, [b.Lane(rounds=1, depth=1, l2=1.0)], 1 << 16)[0]
    data = rows.toPandas().fillna(0.0)
    for output, feature, cut, _, gain, value in forest.trees:
        g = 0.25 - (data["y"].to_numpy() == output)
        tried = []
        for f, name in enumerate(COLS):
            for c, edge in enumerate(forest.edges[f]):
                low = data[name].to_numpy() <= edge
                parts = [(g[s].sum(), s.sum() * 0.1875) for s in (low, ~low, low | True)]
                worth = [p[0] ** 2 / (p[1] + 1.0) for p in parts]
                if low.any() and not low.all():
                    tried.append((worth[0] + worth[1] - worth[2], -f, -c))
        best = max(tried)
        assert abs(best[0] - gain[0]) < 1e-5 and (feature[0], cut[0]) == (-best[1], -best[2])
        low = data[COLS[feature[0]]].to_numpy() <= forest.edges[feature[0]][cut[0]]
        assert abs(value[1] + 0.1 * g[low].sum() / (low.sum() * 0.1875 + 1)) < 1e-6


def test_growth_rules(spark, rows):
    depth, leaves, levels = trained(spark, rows, [RULES[k] for k in ("depth", "leaves", "levels")], 1 << 16)
    assert all(len(t[1]) <= 15 for t in depth.trees) and max(len(t[1]) for t in depth.trees) > 7
    assert max((len(t[1]) + 1) // 2 for t in leaves.trees) == 11
    for t in levels.trees:  # one split for all nodes of a level
        nodes = [0]
        while split := [x for x in nodes if t[1][x] >= 0]:  # a node without rows stays a leaf
            assert len({(t[1][x], t[2][x]) for x in split}) == 1
            nodes = [c for x in split for c in (t[3][x], t[3][x] + 1)]


def test_a_held_fold_and_left_out_features_are_not_read(spark, rows):
    changed = rows.withColumn("y", F.when(F.col("f0") == 1, 0).otherwise(F.col("y"))).withColumn("z", F.rand(seed=9))
    one, two = (trained(spark, df, [RULES["fold"]], 1 << 16)[0] for df in (rows, changed))
    assert all(1 not in t[1] for t in one.trees)
    assert all(np.array_equal(s[5], t[5]) for s, t in zip(one.trees, two.trees, strict=True))


@pytest.mark.parametrize("leaves", [3, 40, 200])
def test_scores_follow_the_trees(leaves):
    """Leaf bits against a walk from the root, with trees of one to several words."""
    rng = np.random.default_rng(leaves)
    edges = [np.arange(1.0, 30.0), np.arange(1.0, 9.0)]
    trees, walked = [], []
    columns = [rng.integers(0, 32, 400).astype(float), rng.integers(0, 10, 400).astype(float)]
    bins = b.to_bins(columns, edges)
    for k in range(5):
        tree = b.Tree()
        tree.sums[0] = (0.0, 1.0, 1.0)
        for _ in range(rng.integers(0, leaves)):
            x = int(rng.choice([i for i, f in enumerate(tree.feature) if f < 0]))
            f = int(rng.integers(0, 2))
            tree.best[x] = (1.0, f, int(rng.integers(0, len(edges[f]))), (0.0, 1.0, 1.0))
            tree.split(x)
        value = np.where(np.array(tree.feature) < 0, rng.random(len(tree.feature)), 0.0)
        trees.append((k % 2, np.array(tree.feature, "int32"), np.array(tree.cut, "int32"), np.array(tree.left, "int32"), np.array(tree.gain), value))
        walked.append(value[tree.placed(bins)])
    got = b.Forest(b.Lane(), edges, 2, trees).scores(columns)
    want = np.stack([walked[0] + walked[2] + walked[4], walked[1] + walked[3]], axis=1)
    assert np.allclose(got, want)


def test_no_rows_and_one_value(spark, rows):
    assert trained(spark, rows.limit(0), [b.Lane(rounds=1)], 1 << 16)[0].trees == []
    flat = rows.select("pageid", "y", F.lit(1.0).alias("x"), F.lit(None).cast("double").alias("z"), F.lit(0).alias("w"), "f0")
    forest = trained(spark, flat, [b.Lane(rounds=2)], 1 << 16)[0]
    assert all(len(t[1]) == 1 for t in forest.trees) and forest.probabilities([np.ones(3)] * 3).shape == (3, 4)


@pytest.mark.parametrize("block_rows", [1 << 16, 300])
def test_more_rounds_from_stored_trees(spark, rows, tmp_path, block_rows):
    table = b.binned(rows, COLS, 4, folds=["f0"], block_rows=block_rows)
    lane = b.Lane(rounds=4, depth=2, sample=0.8)
    whole = b.train(table, [lane])[0]
    half = b.train(table, [b.Lane(rounds=2, depth=2, sample=0.8)])[0]
    half.save(spark, str(tmp_path / "f"))
    again = b.Forest.load(spark, str(tmp_path / "f"))
    assert again.lane == half.lane
    longer = b.train(table, [lane], [again])[0]
    assert len(longer.trees) == 16
    assert all(np.allclose(s[5], t[5], atol=1e-9) for s, t in zip(whole.trees, longer.trees, strict=True))


def test_equal_lanes_are_grown_once(spark, rows, monkeypatch):
    table = b.binned(rows, COLS, 4, folds=["f0"])
    grown = []
    monkeypatch.setattr(b, "train", lambda t, lanes: grown.extend(lanes) or [("forest", lane) for lane in lanes])
    lane = b.Lane(rounds=1)
    first = b.forests(table, [lane, b.Lane(rounds=1, seed=7), b.Lane(rounds=1, sample=0.5, seed=7), b.Lane(rounds=1, sample=0.5, seed=8)])
    assert first[0] == first[1] and first[2] != first[3] and len(grown) == 3
    assert b.forests(table, [lane]) == first[:1] and len(grown) == 3
    def broken(t, lanes):
        raise ValueError("no")
    monkeypatch.setattr(b, "train", broken)
    with pytest.raises(ValueError):
        b.forests(table, [b.Lane(rounds=2)])
    monkeypatch.setattr(b, "train", lambda t, lanes: ["again"])
    assert b.forests(table, [b.Lane(rounds=2)]) == ["again"]


def test_scores_of_trees_with_many_leaves():
    """A complete tree of 512 leaves: its leaf bits take more words than fit one byte's counts."""
    edges = [np.arange(0.5, 255.0) for _ in range(3)]
    tree = b.Tree()
    tree.sums[0] = (0.0, 1.0, 1.0)
    level = [(0, [0, 0, 0], [256, 256, 256])]
    for depth in range(9):
        following = []
        for x, low, high in level:
            f = depth % 3
            cut = (low[f] + high[f]) // 2 - 1
            tree.best[x] = (1.0, f, cut, (0.0, 1.0, 1.0))
            a, c = tree.split(x)
            following += [(a, low, [cut + 1 if i == f else h for i, h in enumerate(high)]),
                          (c, [cut + 1 if i == f else v for i, v in enumerate(low)], high)]
        level = following
    assert tree.n_leaves() == 512
    value = np.where(np.array(tree.feature) < 0, np.arange(len(tree.feature)) / 7, 0.0)
    stored = (0, np.array(tree.feature, "int32"), np.array(tree.cut, "int32"), np.array(tree.left, "int32"), np.array(tree.gain), value)
    columns = [np.random.default_rng(f).integers(0, 255, 3000).astype(float) for f in range(3)]
    got = b.Forest(b.Lane(), edges, 1, [stored]).scores(columns)[:, 0]
    assert np.allclose(got, value[tree.placed(b.to_bins(columns, edges))])


def test_whole_tables_shared_outputs_and_waves_give_the_same_trees(spark, rows, monkeypatch):
    """One task per lane, a lane's outputs in several tasks, and sums of blocks, the lanes with different rounds."""
    lanes = [b.Lane(rounds=4, depth=3, sample=0.8), b.Lane(rounds=2, growth="leaves", leaves=9, depth=99, min_rows=5)]
    whole = trained(spark, rows, lanes, 200)
    monkeypatch.setattr(b, "SHARED_ROWS", 1)
    shared = trained(spark, rows, lanes, 200)
    monkeypatch.setattr(b, "WHOLE_BLOCKS", 1)
    waves = trained(spark, rows, lanes, 200)
    for other in (shared, waves):
        for p, q in zip(whole, other, strict=True):
            assert len(p.trees) == len(q.trees) == 4 * p.lane.rounds
            assert all(s[0] == t[0] and all(np.array_equal(x, y) for x, y in zip(s[1:], t[1:], strict=True)) for s, t in zip(p.trees, q.trees, strict=True))


def test_a_table_of_several_blocks_takes_one_job(spark, rows, monkeypatch):
    """Jobs do not grow with rounds and levels."""
    monkeypatch.setattr(b, "_by_waves", lambda *a: pytest.fail("a job per wave"))
    assert len(trained(spark, rows, [b.Lane(rounds=6, depth=2)], 100)[0].trees) == 24


def test_features_of_few_bins_and_equal_features_share_a_column():
    """Sums are those of a plain count; a column holds several small features, and equal ones are counted once."""
    rng = np.random.default_rng(5)
    sizes = [255, 1, 2, 3, 17, 255, 2]
    bins = np.stack([rng.integers(0, s, 900) for s in sizes]).astype("uint8")
    bins[5] = bins[0]
    block = b.Block(np.arange(900), bins, np.zeros((900, 2)), np.empty((0, 900), "int32"), np.append(0, np.cumsum(sizes)))
    _, groups, same = block.columns
    assert same == {5: 0} and sorted(f for g in groups for f, _ in g) == [0, 2, 3, 4, 6] and len(groups) == 2
    rows = np.flatnonzero(rng.random(900) < 0.6)
    node, g, h = rng.integers(0, 3, len(rows)), np.rint(rng.normal(size=900) * b.UNIT), np.rint(rng.random(900) * b.UNIT / 4)
    got = block.sums(rows, node, 3, g, h)
    for f, (start, size) in enumerate(zip(block.starts, sizes)):
        for x in range(3):
            for k in range(size):
                mine = rows[(node == x) & (bins[f, rows] == k)]
                assert got[:, x, start + k].tolist() == [g[mine].sum(), h[mine].sum(), len(mine)]


def test_thresholds_are_dealt_to_tasks_that_do_not_meet(spark, rows, monkeypatch):
    """Each output of an ordinal lane has a task of its own, also in a small table, and the trees are those of one task."""
    lane = b.Lane(rounds=3, thresholds=True, sample=0.7)
    dealt, whole = [], b._whole
    monkeypatch.setattr(b, "_whole", lambda *a: dealt.append(a[2:]) or whole(*a))
    apart = trained(spark, rows, [lane], 200)[0]
    assert dealt == [(3, False)]
    monkeypatch.setattr(b, "WHOLE_BLOCKS", 1)
    waves = trained(spark, rows, [lane], 200)[0]
    assert len(apart.trees) == len(waves.trees) == 9
    assert all(np.array_equal(s[5], t[5]) for s, t in zip(apart.trees, waves.trees, strict=True))


def test_tasks_of_a_lane_meet_by_files_in_far_less_than_a_second(spark, rows, monkeypatch):
    """Rounds of outputs in several tasks, passed as files; without a common folder Spark's messages give the same trees."""
    monkeypatch.setattr(b, "SHARED_ROWS", 1)
    lane = b.Lane(rounds=30, growth="levels", depth=2)
    start = time.monotonic()
    by_file = trained(spark, rows, [lane], 1 << 16)[0]
    assert time.monotonic() - start < 20
    short = [b.Lane(rounds=3, growth="levels", depth=2), b.Lane(rounds=2, depth=2)]
    monkeypatch.setattr(b, "local_shared_dir", lambda spark: "")
    told = trained(spark, rows, short, 1 << 16)
    assert len(by_file.trees) == 120 and [len(f.trees) for f in told] == [12, 8]
    for s, t in zip(by_file.trees, told[0].trees):
        assert s[0] == t[0] and all(np.array_equal(x, y) for x, y in zip(s[1:], t[1:], strict=True))


def test_rows_are_placed_by_the_bits_of_the_levels(spark, rows):
    """With one split per level a row's leaf is read off its bits; the walk from the root says the same."""
    forest = trained(spark, rows, [RULES["levels"]], 1 << 16)[0]
    bins = b.to_bins([np.random.default_rng(f).random(500) * 9 for f in range(3)], forest.edges)
    for _, feature, cut, left, _, _ in forest.trees:
        tree = b.Tree(feature.tolist(), cut.tolist(), left.tolist())
        assert tree._levels() and np.array_equal(tree.placed(bins), b._leaves(bins, feature, cut, left))


def test_the_dearest_lanes_get_the_tasks_left_over(spark, rows, monkeypatch):
    """Eight cores: a lane of many rounds and deep trees is dealt to more tasks than a short one, which had as many before."""
    table = b.binned(rows, COLS, 4, folds=["f0"])
    long, short = b.Lane(rounds=600, depth=9), b.Lane(rounds=20, depth=2)
    assert b._shares(table, [short, long, short], [4] * 3, [20, 600, 20]) == [1, 4, 1]
    assert b._shares(table, [short] * 3, [4] * 3, [20] * 3) == [1, 1, 1]  # not worth a meeting
    monkeypatch.setattr(b, "SHARED_ROWS", 1)
    assert b._shares(table, [long] * 9, [4] * 9, [600] * 9) == [1] * 9
    with b.in_flight(6), b.in_flight(1) as others:  # tasks that must start at once would wait for these
        assert others == 6 and b._shares(table, [long], [4], [600], others) == [2] and b._shares(table, [long], [4], [600], 7) == [1]
