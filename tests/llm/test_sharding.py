import zlib
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from gradeworks.llm import sharding


@given(st.lists(st.integers(1, 100), max_size=80), st.integers(100, 150))
def test_best_fit_takes_the_tightest_bin(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    left, want = [], []
    for s in sizes:
        fits = [(space, i) for i, space in enumerate(left) if space >= s]
        if not fits:
            left.append(capacity)
            fits = [(capacity, len(left) - 1)]
        i = min(fits)[1]
        left[i] -= s
        want.append(min(fits)[0])
    fit, got = sharding.BestFit(capacity), []
    space = defaultdict(lambda: capacity)
    for s in sizes:
        b = fit.place(s)
        got.append(space[b])
        space[b] -= s
    assert got == want and all(v >= 0 for v in space.values()) and len(space) == len(left)


def test_tree_splits_and_empties():
    tree = sharding.SpaceTree()
    for i in range(5000):
        tree.add(i * 7 % 5003, i)
    assert len(tree.leaves) > 4
    assert [tree.take(1000)[0] for _ in range(3)] == [1000, 1001, 1002]
    assert tree.take(6000) is None
    for _ in range(4997):
        assert tree.take(0) is not None
    assert tree.take(0) is None and tree.leaves == []


def test_least_capacity():
    capacity, placed = sharding.least_capacity([9, 8, 7, 6, 5, 4, 3, 2, 1], 3)
    assert capacity == 15 and max(placed) == 2
    assert sharding.least_capacity([], 3)[1] == []


def check(docs, shards=4, **options):
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    rows = sharding.shard(docs, shards=shards, **options).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    by_shard, homes = defaultdict(list), defaultdict(set)
    for r in rows:
        by_shard[r["shard"]].append(r)
        homes[r["text_crc32"], r["size"]].add(r["shard"])
    for found in by_shard.values():
        assert sorted(r["slot"] for r in found) == list(range(len(found)))
    assert set(by_shard) <= set(range(shards))
    return {s: sum(r["size"] for r in found) for s, found in by_shard.items()}, homes


def test_shards_of_the_tables(edge, nothing, tables):
    sizes, homes = check(tables["documents"])
    assert max(sizes.values()) < 1.02 * min(sizes.values()) and all(len(h) == 1 for h in homes.values())
    check(edge)
    assert sharding.shard(nothing).collect() == []


def test_a_group_larger_than_a_shard_is_cut(spark):
    rows = [(i, "copy " * 20) for i in range(900)] + [(i, f"text {i} " * 5) for i in range(900, 1200)]
    sizes, homes = check(spark.createDataFrame(rows, "doc_id long, text string"), bundles_per_shard=16)
    assert max(sizes.values()) < 1.1 * min(sizes.values())
    assert sorted(len(h) for h in homes.values())[:300] == [1] * 300
