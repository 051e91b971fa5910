"""Random forests over the table of bins that the boosters use, for all forests that share the table at once.

Spark's own forest sends sums of (node, feature, bin, class) from every partition at each level; with hundreds of trees
these outweigh a small table many times over. Trees do not hang on each other, so here they are dealt to tasks: a task holds
the bins of the table (up to ``boosting.WHOLE_BLOCKS`` blocks, 33 bytes a row, about 400 with targets and sums, an estimate)
and grows some trees of one forest, level by level. Larger tables are left to Spark's forest.

A tree counts each row as often as a Poisson draw says (mean 1); each node looks at its own draw of about the root of the
number of features and takes the split of the least Gini impurity. Draws hang on the forest's seed and the number of the tree
only, so neither tasks nor partitions change a forest.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gradeworks.operators.boosting import _NONE, Batches, Binned, Block, _batch, _leaves, in_flight, to_bins

_CELLS = 1 << 18  # cells of (node, bin) that are counted without sorting


@dataclass(frozen=True)
class Bag:
    """Settings of one forest. ``held`` (position among the table's folds, fold) leaves a fold out."""

    trees: int = 100
    depth: int = 10
    min_leaf: int = 1
    seed: int = 42
    held: tuple[int, int] | None = None


def _cuts(code: np.ndarray, y: np.ndarray, w: np.ndarray, total: np.ndarray, min_leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best split of each node by one feature of its own: score, last bin to the left, class sums of the left child.
    ``code`` is node * 256 + bin of each row."""
    n, k = total.shape
    size, square = total.sum(axis=1), np.einsum("ij,ij->i", total, total)
    if n * 256 <= min(len(code), _CELLS):
        left = np.bincount(y * (n * 256) + code, w, k * n * 256).reshape(k, n, 256).cumsum(axis=2)
        score = _scores(left, total.T[:, :, None], size[:, None], square[:, None], min_leaf)
        last = score.argmax(axis=1)  # the lowest bin on ties
        at = np.arange(n)
        return score[at, last], last, left[:, at, last].T
    # rows in the order of node, bin and class; these and the weight are parts of one number, so that values are sorted, not places
    counted = int(w.max()).bit_length()
    class_bits = (k - 1).bit_length()
    rows = np.sort((((code << class_bits) | y) << counted) | w.astype("int64"))
    of = rows >> (class_bits + counted)
    begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    cells, m = of[begins], len(begins)
    cell = np.repeat(np.arange(m), np.diff(np.append(begins, len(of))))
    sums = np.bincount(((rows >> counted) & ((1 << class_bits) - 1)) * m + cell, rows & ((1 << counted) - 1), k * m).reshape(k, m)
    starts = np.searchsorted(cells, np.arange(n) << 8)
    wide = np.diff(np.append(starts, m))  # cells of each node
    sums[:, starts[1:]] -= total[:-1].T  # whole numbers: sums begin anew at each node
    left = sums.cumsum(axis=1)
    score = _scores(left, np.repeat(total.T, wide, axis=1), np.repeat(size, wide), np.repeat(square, wide), min_leaf)
    top = np.maximum.reduceat(score, starts)
    found, first = np.flatnonzero(score == np.repeat(top, wide))[::-1], np.empty(n, "int64")
    first[cells[found] >> 8] = found  # the lowest bin on ties
    return top, cells[first] & 255, left[:, first].T


def _scores(left: np.ndarray, total: np.ndarray, size: np.ndarray, square: np.ndarray, min_leaf: int) -> np.ndarray:
    """What the splits leave pure, from class sums [class, ...] of the left child and the node. All are whole numbers, so the right
    child's squares follow exactly from the others'."""
    n_left = left.sum(axis=0)
    n_right = size - n_left
    squares = (left * left).sum(axis=0)
    both = (left * total).sum(axis=0)
    score = squares / np.maximum(n_left, 1)
    score += (square - 2 * both + squares) / np.maximum(n_right, 1)
    score[(n_left < min_leaf) | (n_right < min_leaf)] = -np.inf
    return score


def grown(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, bag: Bag, rng: np.random.Generator) -> tuple:
    """One tree from rows (``bins`` has a row each) that count ``weight`` times: feature, cut, left, value, importance. A leaf
    has no feature; its ``left`` is its place in ``value``, class shares."""
    wide = bins.shape[1]
    flat, tries = bins.reshape(-1), math.ceil(math.sqrt(wide))
    rows = np.flatnonzero(weight)
    base, y, w = rows * wide, y[rows], weight[rows].astype(float)
    node, ids = np.zeros(len(rows), "int64"), np.zeros(1, "int64")
    total = np.bincount(y, w, classes)[None]
    feature, cut, left, sums, gains = np.full(1, _NONE, "int16"), np.zeros(1, "uint8"), np.zeros(1, "int32"), total, np.zeros(wide)
    for _ in range(bag.depth):
        size = total.sum(axis=1)
        grows = (size >= 2 * bag.min_leaf) & (total.max(axis=1) < size)
        stay = grows[node]
        base, y, w, node = base[stay], y[stay], w[stay], (np.cumsum(grows) - 1)[node[stay]]
        ids, total, size = ids[grows], total[grows], size[grows]
        if not len(ids):
            break
        tried = rng.random((len(ids), wide)).argsort(axis=1)[:, :tries]
        best, by, at, kept = np.full(len(ids), -np.inf), np.zeros(len(ids), "int64"), np.zeros(len(ids), "int64"), np.zeros_like(total)
        first = node << 8
        for f in tried.T:
            top, last, lefts = _cuts(first + flat.take(base + f.take(node)), y, w, total, bag.min_leaf)
            better = top > best
            best[better], by[better], at[better], kept[better] = top[better], f[better], last[better], lefts[better]
        gain = best - np.einsum("ij,ij->i", total, total) / size
        split = gain > 1e-9
        if not split.any():
            break
        np.add.at(gains, by[split], gain[split])
        n = 2 * int(split.sum())
        feature[ids[split]], cut[ids[split]], left[ids[split]] = by[split], at[split], len(feature) + np.arange(0, n, 2)
        ids = len(feature) + np.arange(n)
        stay = split[node]
        base, y, w, node = base[stay], y[stay], w[stay], node[stay]
        node = 2 * (np.cumsum(split) - 1)[node] + (flat.take(base + by[node]) > at[node])
        total = np.stack([kept[split], total[split] - kept[split]], axis=1).reshape(n, classes)
        feature, cut, left = (np.concatenate([a, np.full(n, v, a.dtype)]) for a, v in ((feature, _NONE), (cut, 0), (left, 0)))
        sums = np.concatenate([sums, total])
    leaf = feature == _NONE
    left[leaf] = np.arange(leaf.sum())
    value = sums[leaf] / np.maximum(sums[leaf].sum(axis=1, keepdims=True), 1e-300)
    return feature, cut, left, value.astype("float32"), gains / max(gains.sum(), 1e-300)


_STORED = {"feature": "int16", "cut": "uint8", "left": "int32", "value": "float32", "gain": "float64"}
_TREE = ["bag", "tree", *_STORED]
_TREE_TYPES = "bag int, tree int, " + ", ".join(f"{c} binary" for c in _STORED)


def _some_trees(bags: Sequence[Bag], classes: int, shares: int):
    """Every ``shares``-th tree of a forest from its whole table."""

    def read(batches: Batches) -> Batches:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:  # an empty table
            return
        mine, share, block = rows[0]["bag"], rows[0]["share"], Block.joined(rows)
        del rows
        bag, bins, y = bags[mine], np.ascontiguousarray(block.bins.T), block.target.argmax(axis=1)
        active = block.weights(bag) > 0
        for tree in range(share, bag.trees, shares):
            rng = np.random.default_rng([bag.seed, tree])
            made = grown(bins, y, rng.poisson(1.0, len(y)) * active, classes, bag, rng)
            yield _batch([(mine, tree, *(a.tobytes() for a in made))], _TREE, [pa.int32()] * 2 + [pa.binary()] * 5)

    return read


@dataclass
class Bagged:
    """A random forest: the mean of its trees' leaf shares."""

    edges: list[np.ndarray]
    classes: int
    trees: list[tuple]  # feature, cut, left, value, gain

    def probabilities(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        bins = to_bins(columns, self.edges)
        total = np.zeros((bins.shape[1], self.classes))
        for feature, cut, left, value, _ in self.trees:
            total += value.reshape(-1, self.classes)[left[_leaves(bins, feature, cut, left)]]
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)

    def importance(self) -> np.ndarray:
        """Mean over the trees of the impurity that each feature takes away, as shares."""
        gains = np.sum([t[4] for t in self.trees], axis=0)
        return (gains / max(gains.sum(), 1e-300))[None]

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, *(bytes(a.tobytes()) for a in t)) for i, t in enumerate(self.trees)]
        types = "place int, " + ", ".join(f"{c} binary" for c in _STORED)
        spark.createDataFrame(rows, types).write.parquet(f"{path}/trees")
        about = json.dumps({"edges": [e.tolist() for e in self.edges], "classes": self.classes})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/forest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bagged:
        about = json.loads(spark.read.text(f"{path}/forest").first()["value"])
        rows = sorted(spark.read.parquet(f"{path}/trees").collect(), key=lambda r: r["place"])
        return cls([np.array(e) for e in about["edges"]], about["classes"], [tuple(np.frombuffer(bytes(r[c]), k) for c, k in _STORED.items()) for r in rows])


def bagged(table: Binned, bags: Sequence[Bag]) -> list[Bagged]:
    """One forest per bag; the trees of all are grown side by side."""
    slots = table.blocks.sparkSession.sparkContext.defaultParallelism
    shares = max(1, min(-(-slots // len(bags)), max(b.trees for b in bags)))
    dealt = table.blocks.select("*", F.explode(F.lit(list(range(len(bags))))).alias("bag")).select("*", F.explode(F.lit(list(range(shares)))).alias("share"))
    dealt = dealt.repartitionById(len(bags) * shares, (F.col("bag") * shares + F.col("share")).cast("int"))
    trees: list[list[tuple]] = [[] for _ in bags]
    with in_flight(len(bags) * shares):
        rows = dealt.mapInArrow(_some_trees(bags, table.classes, shares), _TREE_TYPES).collect()
    for r in sorted(rows, key=lambda r: (r["bag"], r["tree"])):
        trees[r["bag"]].append(tuple(np.frombuffer(bytes(r[c]), k) for c, k in _STORED.items()))
    return [Bagged(table.edges, table.classes, t) for t in trees]
