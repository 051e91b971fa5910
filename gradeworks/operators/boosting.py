"""Gradient boosting on histograms, for all models that share a table at once.

Features become bins of at most 255 values, kept in blocks of rows (one row of ``blocks`` is one block). A *lane* is one
model: its objective, growth rule, fold and seed. Every lane reads the same blocks; a fold is a weight of its rows, and
the ordinal thresholds are outputs of one lane.

A round grows the trees of all outputs in waves: the gradient sums per (lane, output, feature, node, bin) are added up,
each open leaf gets its best split, and the growth rule picks the leaves to split:

* ``depth``: all leaves of a level;  ``leaves``: the best leaves first, at most half of what is left of the leaf
  budget in one wave;  ``levels``: one split for all leaves of a level.

Up to ``WHOLE_BLOCKS`` blocks, sums of all bins would outweigh the rows (33 bytes each), so work is dealt by model instead:
a task holds the bins of one lane and grows the trees of some of its outputs, in which only the smaller of two
siblings is counted and the larger one is subtracted. Thresholds do not hang on each other, so each has a task. Where cores
are left over, the classes of other lanes are dealt to several tasks, a barrier stage in which the finished trees of each
round, a few KB, are passed around: as files of the shared folder if all tasks see them, else by Spark's own messages, which
take a second each.

Larger tables take one Spark job per wave, whatever the number of lanes and classes: tasks emit partial sums of their
blocks, an exchange adds them up and finds the best split per feature, and only splits come to the driver. Scores are
written back every few rounds. Gradients are whole multiples of 2**-20, so sums do not depend on the order of rows or
blocks and all ways give the same trees.
"""

from __future__ import annotations

import json
import math
import os
import shutil
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future
from contextlib import contextmanager, suppress
from dataclasses import asdict, dataclass, field, replace
from functools import cached_property
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.session import local_shared_dir, write_table

MAX_BINS = 255
BLOCK_ROWS = 1 << 16
WHOLE_BLOCKS = 40  # largest table that a task holds the bins of: 2.6 million rows, about 300 bytes a row with its scores
SHARED_ROWS = 1 << 22  # rows times rounds from which on a lane's outputs are worth several tasks: to start a meeting takes some seconds
NODE_ROWS, TREE_ROWS = 200, 20_000  # rows that cost as much as a node of a tree does by itself, and a tree, about
SCORES_EVERY = 10  # rounds after which the scores of several blocks are written
UNIT = float(1 << 20)
ROW = float(1 << 36)  # above the curvatures of a block, so that one sum holds both these and the rows
_NONE = -1

Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Lane:
    """Settings of one model. ``held`` (position among the table's folds, fold) leaves a fold out."""

    rounds: int = 100
    rate: float = 0.1
    growth: str = "depth"
    depth: int = 6
    leaves: int = 1 << 20
    l2: float = 1.0
    min_rows: int = 1
    min_weight: float = 1e-3
    sample: float = 1.0
    seed: int = 42
    thresholds: bool = False
    held: tuple[int, int] | None = None
    features: tuple[int, ...] | None = None


# trees

@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has no feature. Rows of a bin up to ``cut`` go to ``left``, others to
    the node after it. ``best`` has the open leaves' splits: gain, feature, cut, sums of the left child."""

    feature: list[int] = field(default_factory=lambda: [_NONE])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    sums: list[tuple] = field(default_factory=lambda: [None])
    level: list[int] = field(default_factory=lambda: [0])
    best: dict[int, tuple] = field(default_factory=dict)

    def n_leaves(self) -> int:
        return (len(self.feature) + 1) // 2

    def choose(self, lane: Lane) -> list[int]:
        """The leaves that the growth rule splits next."""
        open_ = [x for x, b in self.best.items() if b[0] > 0]
        room = lane.leaves - self.n_leaves()
        if lane.growth == "leaves":
            open_ = sorted(open_, key=lambda x: (-self.best[x][0], x))[:max(1, room // 2)]
        return sorted(open_) if room >= len(open_) else []

    def split(self, x: int) -> tuple[int, int]:
        gain, feature, cut, left = self.best.pop(x)
        self.feature[x], self.cut[x], self.left[x], self.gain[x] = feature, cut, len(self.feature), gain
        right = tuple(a - b for a, b in zip(self.sums[x], left, strict=True))
        for sums in (left, right):
            for values, value in ((self.feature, _NONE), (self.cut, 0), (self.left, 0), (self.gain, 0.0), (self.sums, sums), (self.level, self.level[x] + 1)):
                values.append(value)
        return self.left[x], self.left[x] + 1

    def may_grow(self, x: int, lane: Lane) -> bool:
        return self.level[x] < lane.depth and (self.sums[x][2] >= (1 if lane.growth == "levels" else 2 * lane.min_rows))

    def parted(self, bins: np.ndarray, x: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of a split node by child. ``bins`` has a row per feature."""
        right = bins[self.feature[x]].take(rows) > self.cut[x]
        return rows.take(np.flatnonzero(~right)), rows.take(np.flatnonzero(right))

    def _levels(self) -> list[tuple[int, int]] | None:
        """Feature and cut of each level if all its splits are the same, as they are with growth by levels."""
        level, splits = [0] * len(self.feature), []
        for x, f in enumerate(self.feature):
            if f != _NONE:
                level[self.left[x]] = level[self.left[x] + 1] = level[x] + 1
                if level[x] == len(splits):
                    splits.append((f, self.cut[x]))
                elif splits[level[x]] != (f, self.cut[x]):
                    return None
        return splits if len(splits) <= 16 else None

    def placed(self, bins: np.ndarray) -> np.ndarray:
        """Leaves of all rows."""
        if splits := self._levels():  # a row's way is one bit per level
            way, leaf = np.zeros(bins.shape[1], "uint16"), [0]
            for f, cut in splits:
                way <<= 1
                way |= bins[f] > cut
                leaf = [c for x in leaf for c in ((x, x) if self.feature[x] == _NONE else (self.left[x], self.left[x] + 1))]
            return np.array(leaf)[way]
        node, open_ = np.zeros(bins.shape[1], "int64"), [(0, np.arange(bins.shape[1]))]
        while open_:
            x, rows = open_.pop()
            if self.feature[x] == _NONE:
                node[rows] = x
            elif len(rows):
                open_ += zip((self.left[x], self.left[x] + 1), self.parted(bins, x, rows), strict=True)
        return node

    def values(self, lane: Lane) -> np.ndarray:
        """What each leaf adds to a score; zero inside the tree."""
        return np.array([-lane.rate * s[0] / (s[1] + lane.l2 * UNIT + 1e-9) if f == _NONE else 0.0 for f, s in zip(self.feature, self.sums, strict=True)])


def split_gains(sums: np.ndarray, lane: Lane, starts: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Gain of each split [node, bin] from sums [gradient, curvature, rows][node, bin]. The bins of a feature stand between
    two ``starts``; a split sends its bin and those before it to the left."""
    left = np.cumsum(sums, axis=-1)
    total = left[..., starts[1] - 1][..., None]
    if len(starts) > 2:
        left[..., starts[1]:] -= np.repeat(left[..., starts[1:-1] - 1], np.diff(starts[1:]), axis=-1)
    l2 = lane.l2 * UNIT + 1e-9
    gain = left[0] * left[0]
    gain /= left[1] + l2
    rest = total[0] - left[0]
    rest *= rest
    rest /= total[1] - left[1] + l2
    gain += rest
    gain -= total[0] * total[0] / (total[1] + l2)
    gain /= UNIT
    if lane.growth != "levels":
        gain[(left[2] < lane.min_rows) | (total[2] - left[2] < lane.min_rows)] = -np.inf
        gain[(left[1] < lane.min_weight * UNIT) | (total[1] - left[1] < lane.min_weight * UNIT)] = -np.inf
    gain[:, starts[1:] - 1] = -np.inf  # nothing would go right
    if lane.features is not None:
        gain[:, np.repeat(~np.isin(features, lane.features), np.diff(starts))] = -np.inf
    return gain


def best_splits(sums: np.ndarray, lane: Lane, starts: np.ndarray, features: np.ndarray) -> list[tuple]:
    """Per node (gain, feature, cut, left sums); with growth by levels the same split for all nodes."""
    gain = split_gains(sums, lane, starts, features)
    if lane.growth == "levels":
        gain = np.broadcast_to(gain.sum(axis=0), gain.shape)
    at = gain.argmax(axis=1)
    f = np.searchsorted(starts, at, side="right") - 1
    out = []
    for x in range(len(gain)):
        left = sums[:, x, starts[f[x]]:at[x] + 1].sum(axis=-1)
        out.append((float(gain[x, at[x]]), int(features[f[x]]), int(at[x] - starts[f[x]]), tuple(left.tolist())))
    return out


# rows of one block

@dataclass
class Block:
    """Rows of one block: ids, bins by feature, class targets and folds."""

    key: np.ndarray
    bins: np.ndarray
    target: np.ndarray
    folds: np.ndarray
    starts: np.ndarray  # where the bins of each feature begin if all stand in one row

    @classmethod
    def of(cls, row: dict) -> Block:
        key = np.frombuffer(row["key"], "int64")
        shape = (-1, len(key))
        return cls(key, np.frombuffer(row["bins"], "uint8").reshape(shape), np.frombuffer(row["target"], "float64").reshape(len(key), -1),
                   np.frombuffer(row["folds"], "int32").reshape(shape) if row["folds"] else np.empty((0, len(key)), "int32"),
                   np.append(0, np.cumsum(np.frombuffer(row["sizes"], "int32"))))

    @classmethod
    def joined(cls, rows: Sequence[dict]) -> Block:
        """All blocks of a table as one."""
        parts = [cls.of(r) for r in sorted(rows, key=lambda r: r["block"])]
        if len(parts) == 1:
            return parts[0]
        return cls(np.concatenate([x.key for x in parts]), np.concatenate([x.bins for x in parts], axis=1),
                   np.concatenate([x.target for x in parts]), np.concatenate([x.folds for x in parts], axis=1), parts[0].starts)

    def weights(self, lane: Lane) -> np.ndarray:
        if lane.held is None:
            return np.ones(len(self.key))
        return (self.folds[lane.held[0]] != lane.held[1]).astype(float)

    def drawn(self, lane: Lane, turn: int) -> np.ndarray:
        """Rows that take part in a round."""
        if lane.sample >= 1:
            return np.ones(len(self.key), bool)
        x = self.key.astype("uint64") * np.uint64(0x9E3779B97F4A7C15) + np.uint64((lane.seed * 1_000_003 + turn + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
        for _ in range(2):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(11)).astype(float) < lane.sample * (1 << 53)

    def outputs(self, lane: Lane) -> int:
        return self.target.shape[1] - lane.thresholds

    def chances(self, scores: np.ndarray, lane: Lane) -> np.ndarray:
        """What the scores say of each output."""
        return 1 / (1 + np.exp(-scores)) if lane.thresholds else softmax(scores)

    def gradients(self, p: np.ndarray, lane: Lane, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of each row for output ``k``, in units of 2**-20, from the chances of all."""
        p = np.ascontiguousarray(p[:, k])
        wanted = self.target[:, k + 1:].sum(axis=1) if lane.thresholds else self.target[:, k]
        return np.rint((p - wanted) * UNIT), np.rint(np.maximum(p * (1 - p), 1e-6) * UNIT)

    @cached_property
    def columns(self) -> tuple[np.ndarray, list[list[tuple[int, int]]], dict[int, int]]:
        """What is counted per row: features of few bins share a column, in which each combination of theirs is a code. Also the
        (feature, bins) of each column, and the features whose bins are those of an earlier one."""
        sizes, same, groups = np.diff(self.starts).tolist(), {}, []
        for f in sorted((f for f, size in enumerate(sizes) if size > 1), key=lambda f: (-sizes[f], f)):
            twin = next((e for x in groups for e, size in x if size == sizes[f] and np.array_equal(self.bins[e], self.bins[f])), None)
            if twin is not None:
                same[f] = twin
                continue
            group = next((x for x in groups if math.prod(size for _, size in x) * sizes[f] <= _CODES), None)
            if group is None:
                groups.append(group := [])
            group.append((f, sizes[f]))
        codes = np.zeros((len(self.key), len(groups)), "uint8")
        for i, group in enumerate(groups):
            for f, size in group:
                codes[:, i] = codes[:, i] * size + self.bins[f]
        return codes, groups, same

    def sums(self, rows: np.ndarray, node: np.ndarray, n: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Sums [gradient, curvature, rows][node, bin] of ``rows``, which lie in nodes 0 .. n-1. Column by column and some
        rows at a time, which stay in the processor's cache; one complex sum holds the gradient and, in its other part, the
        curvature with the rows counted in the high bits."""
        codes, groups, same = self.columns
        spans = [slice(a, b) for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)]
        out = np.zeros((3, n, int(self.starts[-1])))
        both, found = np.empty((n, int(self.starts[-1])), complex), np.empty(n * _CODES, complex)
        for first in range(0, len(rows), _ROWS_SUMMED):
            some, base = rows[first:first + _ROWS_SUMMED], node[first:first + _ROWS_SUMMED] * _CODES
            weights = np.empty(len(some), complex)
            weights.real, weights.imag = g.take(some), h.take(some) + ROW
            coded = np.ascontiguousarray(codes.take(some, axis=0).T)
            if len(groups) + len(same) < len(spans):
                whole = np.zeros(n * _CODES, complex)
                np.add.at(whole, base, weights)
                both[:] = whole[::_CODES, None]  # stays where a feature has one bin
            for code, group in zip(coded, groups, strict=True):
                found.fill(0)
                np.add.at(found, base + code, weights)
                shape = [size for _, size in group]
                cells = found.reshape(n, _CODES)[:, :math.prod(shape)].reshape(n, *shape)
                for i, (f, _) in enumerate(group):
                    both[:, spans[f]] = cells if len(group) == 1 else cells.sum(axis=tuple(j + 1 for j in range(len(group)) if j != i))
            for f, twin in same.items():
                both[:, spans[f]] = both[:, spans[twin]]
            count = np.floor(both.imag * (1 / ROW))
            out[0] += both.real
            out[2] += count
            count *= ROW
            out[1] += both.imag - count
        return out


_CODES = 256  # codes of a column that features share
_ROWS_SUMMED = 1 << 16


def softmax(scores: np.ndarray) -> np.ndarray:
    e = scores - scores.max(axis=1, keepdims=True)
    np.exp(e, out=e)
    e /= e.sum(axis=1, keepdims=True)
    return e


def grown(block: Block, rows: np.ndarray, g: np.ndarray, h: np.ndarray, lane: Lane) -> tuple[Tree, np.ndarray]:
    """One tree from the rows of a block, and the leaves of all rows."""
    features = np.arange(block.bins.shape[0])
    tree, of = Tree(), {0: np.arange(len(block.key))}  # the rows of each leaf
    counts = None
    if len(rows) < len(block.key):
        counts = np.zeros(len(block.key), bool)
        counts[rows] = True
    root = block.sums(rows, np.zeros(len(rows), "int64"), 1, g, h)
    tree.sums[0] = tuple(root[:, 0, :block.starts[1]].sum(axis=-1).tolist())
    held: dict[int, np.ndarray] = {}

    def offer(nodes: list[int], sums: np.ndarray) -> None:
        if nodes:
            for i, (x, b) in enumerate(zip(nodes, best_splits(sums, lane, block.starts, features), strict=True)):
                if b[0] > 0:
                    tree.best[x], held[x] = b, sums[:, i]

    if tree.may_grow(0, lane):
        offer([0], root)
    while chosen := tree.choose(lane):
        pairs = {x: tree.split(x) for x in chosen}
        for x, p in pairs.items():
            of.update(zip(p, tree.parted(block.bins, x, of.pop(x)), strict=True))
        if tree.n_leaves() >= lane.leaves:
            break
        pairs = {x: p for x, p in pairs.items() if any(tree.may_grow(c, lane) for c in p)}
        if not pairs:
            continue
        small = [min(p, key=lambda c: tree.sums[c][2]) for p in pairs.values()]
        mine = [of[x] if counts is None else of[x].take(np.flatnonzero(counts.take(of[x]))) for x in small]
        counted = block.sums(np.concatenate(mine), np.repeat(np.arange(len(small)), [len(m) for m in mine]), len(small), g, h)
        children, parts = [], []
        for i, (x, p) in enumerate(pairs.items()):
            for c in p:
                if tree.may_grow(c, lane):
                    children.append(c)
                    parts.append(counted[:, i] if c == small[i] else held[x] - counted[:, i])
        for x in chosen:
            held.pop(x, None)
        if lane.growth == "levels":
            tree.best.clear()
        offer(children, np.stack(parts, axis=1))
    node = np.empty(len(block.key), "int64")
    for x, mine in of.items():
        node[mine] = x
    return tree, node


def _tree_row(lane: int, turn: int, output: int, tree: Tree, values: np.ndarray) -> tuple:
    return (lane, turn, output, np.array(tree.feature, "int32").tobytes(), np.array(tree.cut, "int32").tobytes(), np.array(tree.left, "int32").tobytes(),
            np.array(tree.gain).tobytes(), values.tobytes())


_TREE = ["lane", "turn", "output", "feature", "cut", "left", "gain", "value"]
TREE_TYPES = "lane int, turn int, output int, feature binary, cut binary, left binary, gain binary, value binary"


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


class Meeting:
    """Tasks of a barrier stage that tell each other what they made. Each adds lines to a file of its own in ``folder`` and reads
    what the tasks of its lane have added; without a folder that all tasks see, Spark passes the messages of all tasks."""

    def __init__(self, folder: str, lane: int, share: int, shares: int):
        self.lane, self.share = lane, share
        self.read = {k: 0 for k in range(shares) if k != share}
        self.paths, seen, until = {k: f"{folder}/{lane}-{k}" for k in self.read}, False, time.monotonic() + _SEEN_S
        if folder:
            with suppress(OSError):  # this machine may not have the folder
                os.makedirs(folder, exist_ok=True)
                self.mine = open(f"{folder}/{lane}-{share}", "wb")
                while not (seen := all(map(os.path.exists, self.paths.values()))) and time.monotonic() < until:
                    time.sleep(0.01)
        self.by_file = all(map(json.loads, BarrierTaskContext.get().allGather(json.dumps(seen))))

    def told(self, made: list) -> Iterator[list]:
        """What the lane's other tasks made in the same round."""
        if not self.by_file:
            for lane, share, theirs in map(json.loads, BarrierTaskContext.get().allGather(json.dumps([self.lane, self.share, made]))):
                if lane == self.lane and share != self.share:
                    yield theirs
            return
        self.mine.write(json.dumps(made).encode() + b"\n")
        self.mine.flush()
        waiting, pause = set(self.paths), _PAUSE_S
        while waiting:
            found = {k: line for k in waiting if (line := self._line(k))}
            yield from map(json.loads, found.values())
            waiting -= set(found)
            if found:
                pause = _PAUSE_S
            elif waiting:
                time.sleep(pause)
                pause = min(2 * pause, _LONGEST_PAUSE_S)

    def _line(self, k: int) -> bytes:
        """The next line of a task, nothing while it is not whole."""
        with open(self.paths[k], "rb") as f:
            f.seek(self.read[k])
            line = f.readline()
        if not line.endswith(b"\n"):
            return b""
        self.read[k] += len(line)
        return line

    def close(self) -> None:
        if self.by_file:
            self.mine.close()


_SEEN_S = 10  # for so long a task looks for the files of the others
_PAUSE_S, _LONGEST_PAUSE_S = 0.0005, 0.002  # what a look costs is a small part of it


def _whole(lanes: Sequence[Lane], start: Sequence[list[tuple]], shares: int | list[int], meet: str | bool):
    """The rounds that follow the trees in ``start``; a task has a lane's whole table and every ``shares``-th output (by lane, if these differ). If an output's
    gradients hang on the scores of all, tasks ``meet`` after each round; it names the folder of a :class:`Meeting`, or none."""

    shares_of = shares if isinstance(shares, list) else [shares] * len(lanes)

    def read(batches: Batches) -> Batches:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:  # an empty table
            return
        mine, share, block = rows[0]["lane"], rows[0]["share"], Block.joined(rows)
        del rows
        lane, n, shares = lanes[mine], block.outputs(lanes[mine]), shares_of[mine]
        active = block.weights(lane) > 0
        scores, told_of = _started(block, start[mine], n), list(range(n) if meet is not False or shares == 1 else range(share, n, shares))
        p = np.empty_like(scores)
        done = len(start[mine]) // n
        meeting = Meeting(meet, mine, share, shares_of[mine]) if meet is not False else None
        # tasks that Spark's messages join meet after each round of any lane, also once their own lane is done
        all_meet = meeting is not None and not meeting.by_file
        first = min(len(t) // block.outputs(x) for t, x in zip(start, lanes, strict=True)) if all_meet else done
        for turn in range(first, max(other.rounds for other in lanes) if all_meet else lane.rounds):
            made = []
            if done <= turn < lane.rounds:
                if len(told_of) == n:
                    p = block.chances(scores, lane)
                else:
                    p[:, told_of] = block.chances(scores[:, told_of], lane)
                drawn = np.flatnonzero(active & block.drawn(lane, turn))
                for k in range(share, n, shares):
                    tree, node = grown(block, drawn, *block.gradients(p, lane, k), lane)
                    values = tree.values(lane)
                    scores[:, k] += values[node]
                    made.append((k, tree, values))
                yield _batch([_tree_row(mine, turn, k, tree, values) for k, tree, values in made], _TREE, [pa.int32()] * 3 + [pa.binary()] * 5)
            if meeting:
                for trees in meeting.told([(k, t.feature, t.cut, t.left, v.tolist()) for k, t, v in made]):
                    for k, feature, cut, left, values in trees:
                        scores[:, k] += np.array(values)[Tree(feature, cut, left).placed(block.bins)]
        if meeting:
            meeting.close()

    return read


def _leaves(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf of each row, some rows at a time."""
    out = np.zeros(bins.shape[1], "int64")
    for first in range(0, len(out), _ROWS_SUMMED):
        some, at = bins[:, first:first + _ROWS_SUMMED], out[first:first + _ROWS_SUMMED]
        rows = np.arange(len(at))
        while len(rows):
            x = at[rows]
            inner = feature[x] != _NONE
            rows, x = rows[inner], x[inner]
            at[rows] = left[x] + (some[feature[x], rows] > cut[x])
    return out


def _started(block: Block, trees: list[tuple], outputs: int) -> np.ndarray:
    """Scores after some trees."""
    scores = np.zeros((len(block.key), outputs), order="F")
    for first in range(0, len(trees), _TREES_AT_ONCE):
        _add_scores(trees[first:first + _TREES_AT_ONCE], block.bins, int(np.diff(block.starts).max()), scores)
    return scores


# several blocks: a job per wave

_SUMS = ["lane", "output", "feature", "node", "sums"]


def _partial(lanes: Sequence[Lane], open_: dict[int, list[tuple[Tree, list[int]]]], done: dict[int, list[list[tuple[Tree, np.ndarray]]]], turn: int):
    """Sums of the open leaves of a block, for every output of its lane."""

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                if row["lane"] not in open_:
                    continue
                block, lane = Block.of(row), lanes[row["lane"]]
                scores = _scores(block, row, lane, done[row["lane"]])
                p, active = block.chances(scores, lane), (block.weights(lane) > 0) & block.drawn(lane, turn)
                for k, (tree, nodes) in enumerate(open_[row["lane"]]):
                    if not nodes:
                        continue
                    node = tree.placed(block.bins)
                    place = np.full(len(tree.feature), _NONE)
                    place[nodes] = np.arange(len(nodes))
                    rows = np.flatnonzero(active & (place[node] != _NONE))
                    sums = block.sums(rows, place[node[rows]], len(nodes), *block.gradients(p, lane, k))
                    out = [(row["lane"], k, f, x, sums[:, i, a:b].tobytes()) for i, x in enumerate(nodes)
                           for f, (a, b) in enumerate(zip(block.starts[:-1], block.starts[1:], strict=True))]
                    yield _batch(out, _SUMS, [pa.int32()] * 4 + [pa.binary()])

    return read


def _scores(block: Block, row: dict, lane: Lane, done: list[list[tuple[Tree, np.ndarray]]]) -> np.ndarray:
    """Stored scores and what the trees since then add."""
    n = block.outputs(lane)
    scores = np.frombuffer(row["scores"], "float64").reshape(-1, n).copy() if row["scores"] else np.zeros((len(block.key), n))
    for trees in done:
        for k, (tree, values) in enumerate(trees):
            scores[:, k] += values[tree.placed(block.bins)]
    return scores


def _added(lanes: Sequence[Lane]):
    """Best split per leaf and feature (per feature, with growth by levels) from rows sorted by lane, output, feature, node."""
    names = ["lane", "output", "node", "gain", "feature", "cut", "g", "h", "rows", "all_g", "all_h", "all_rows"]
    kinds = [pa.int32()] * 3 + [pa.float64(), pa.int32(), pa.int32()] + [pa.float64()] * 6

    def settled(key: tuple, nodes: list[int], sums: list[np.ndarray]) -> pa.RecordBatch:
        together = np.stack(sums, axis=1)
        splits = best_splits(together, lanes[key[0]], np.array([0, together.shape[2]]), np.array([key[2]]))
        totals = together.sum(axis=-1).T.tolist()
        return _batch([(*key[:2], x, gain, f, c, *left, *all_) for x, (gain, f, c, left), all_ in zip(nodes, splits, totals, strict=True)], names, kinds)

    def read(batches: Batches) -> Batches:
        key, nodes, sums = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                now = (row["lane"], row["output"], row["feature"])
                part = np.frombuffer(row["sums"], "float64").reshape(3, -1)
                if now != key:
                    if nodes:
                        yield settled(key, nodes, sums)
                    key, nodes, sums = now, [], []
                if nodes and nodes[-1] == row["node"]:
                    sums[-1] = sums[-1] + part
                else:
                    nodes.append(row["node"])
                    sums.append(part)
        if nodes:
            yield settled(key, nodes, sums)

    return read


_SPLIT_TYPES = ("lane int, output int, node int, gain double, feature int, cut int, g double, h double, rows double, "
                "all_g double, all_h double, all_rows double")


def _by_waves(blocks: DataFrame, lanes: Sequence[Lane], outputs: list[int], first: list[int]) -> list[tuple]:
    """Trees of all lanes from round ``first`` on, one job per wave."""
    out, done = [], {i: [] for i in range(len(lanes))}
    for turn in range(min(first), max(lane.rounds for lane in lanes)):
        live = [i for i, lane in enumerate(lanes) if first[i] <= turn < lane.rounds]
        trees = {i: [Tree() for _ in range(outputs[i])] for i in live}
        wanted = {(i, k): [0] for i in live for k in range(outputs[i])}
        while any(wanted.values()):
            open_ = {i: [(t, wanted.get((i, k), [])) for k, t in enumerate(trees[i])] for i in live if any(wanted.get((i, k)) for k in range(outputs[i]))}
            partial = blocks.mapInArrow(_partial(lanes, open_, done, turn), "lane int, output int, feature int, node int, sums binary")
            merged = partial.repartition("lane", "output", "feature").sortWithinPartitions("lane", "output", "feature", "node").mapInArrow(
                _added(lanes), _SPLIT_TYPES)
            best: dict[tuple, tuple] = {}
            for r in merged.groupBy("lane", "output", "node").agg(
                    F.max_by(F.struct("gain", "feature", "cut", "g", "h", "rows", "all_g", "all_h", "all_rows"),
                             F.struct("gain", -F.col("feature"))).alias("s")).collect():
                best[r["lane"], r["output"], r["node"]] = tuple(r["s"])
            wanted = {}
            for i in live:
                for k, tree in enumerate(trees[i]):
                    for (a, b, x), (gain, f, c, g, h, n, *total) in best.items():
                        if (a, b) == (i, k):
                            tree.sums[x] = tuple(total)
                            if gain > 0 and tree.may_grow(x, lanes[i]):
                                tree.best[x] = (gain, f, c, (g, h, n))
                    if (i, k) not in {key[:2] for key in best}:
                        continue
                    chosen = tree.choose(lanes[i])
                    pairs = [tree.split(x) for x in chosen]
                    if lanes[i].growth == "levels":
                        tree.best.clear()
                    if tree.n_leaves() < lanes[i].leaves:
                        # leaves left open from earlier waves need no new sums; a wave without new ones ends the tree
                        wanted[i, k] = [c for p in pairs for c in p if tree.may_grow(c, lanes[i])]
                        while not wanted[i, k] and (chosen := tree.choose(lanes[i])):
                            wanted[i, k] = [c for x in chosen for c in tree.split(x) if tree.may_grow(c, lanes[i])]
        for i in live:
            finished = [(t, t.values(lanes[i])) for t in trees[i]]
            done[i].append(finished)
            out += [_tree_row(i, turn, k, t, v) for k, (t, v) in enumerate(finished)]
        if turn % SCORES_EVERY == SCORES_EVERY - 1:
            added = _stored(lambda block, row, done=done: _scores(block, row, lanes[row["lane"]], done[row["lane"]]))
            blocks = write_table(blocks.mapInArrow(added, blocks.schema), "boosting-scores")
            done = {i: [] for i in done}
    return out


def _stored(scores: Callable[[Block, dict], np.ndarray]):
    """Blocks with new scores."""

    def read(batches: Batches) -> Batches:
        for batch in batches:
            at = batch.schema.get_field_index("scores")
            yield batch.set_column(at, "scores", pa.array([scores(Block.of(r), r).tobytes() for r in batch.to_pylist()], pa.binary()))

    return read


# tables

@dataclass
class Binned:
    """Blocks of one table with the edges of its bins."""

    blocks: DataFrame
    n_blocks: int
    edges: list[np.ndarray]
    classes: int
    rows: int = 0
    known: dict[Lane, Future] = field(default_factory=dict)
    lock: Lock = field(default_factory=Lock)


def bin_edges(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Upper ends of all but the last bin of each feature, one aggregate over all of them."""
    probs = ", ".join(f"{(i + 1) / MAX_BINS!r}D" for i in range(MAX_BINS - 1))  # as text: thousands of literal columns take many seconds to plan
    values = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)])
    found = values.agg(*[F.expr(f"percentile_approx(x{i}, array({probs}), {20 * MAX_BINS}) AS q{i}") for i in range(len(features))],
                       *[F.max(f"x{i}").alias(f"m{i}") for i in range(len(features))]).first()
    out = []
    for i in range(len(features)):
        ends = np.unique(np.array(found[f"q{i}"] or [], float))
        out.append(ends[ends < found[f"m{i}"]] if len(ends) else ends)
    return out


def to_bins(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, np.nan_to_num(c, nan=0.0)) for c, e in zip(columns, edges, strict=True)]).astype("uint8")


def binned(df: DataFrame, features: Sequence[str], classes: int, key: str = "pageid", y: str = "y", target: str | None = None,
           folds: Sequence[str] = (), block_rows: int = BLOCK_ROWS, edges: list[np.ndarray] | None = None) -> Binned:
    """``df`` in blocks, written once: ids, bins, class targets (one of ``y``, or the array ``target``) and the integer
    columns ``folds``. Missing values count as 0. ``edges`` are those of an earlier table of the same rows."""
    edges = bin_edges(df, features) if edges is None else edges
    n = df.count()
    n_blocks = max(1, -(-n // block_rows))
    sizes = np.array([len(e) + 1 for e in edges], "int32").tobytes()
    wanted = F.col(target) if target else F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (k == F.col(y)).cast("double"))
    rows = df.select(F.col(key).cast("long").alias("key"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("x"),
                     wanted.alias("target"), F.array(*[F.col(c).cast("int") for c in folds]).cast("array<int>").alias("folds"),
                     F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block"))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        made = {"block": table.column("block")[0].as_py(), "key": table.column("key").to_numpy().tobytes(), "bins": to_bins(list(x.T), edges).tobytes(),
                "target": table.column("target").combine_chunks().flatten().to_numpy().tobytes(),
                "folds": np.ascontiguousarray(table.column("folds").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).T).tobytes(), "sizes": sizes}
        kinds = [pa.int64()] + [pa.binary()] * 5
        return pa.table({c: pa.array([v], k) for (c, v), k in zip(made.items(), kinds, strict=True)})

    blocks = rows.groupBy("block").applyInArrow(packed, "block long, key binary, bins binary, target binary, folds binary, sizes binary")
    return Binned(write_table(blocks, "boosting-blocks"), n_blocks, edges, classes, n)


@dataclass
class Forest:
    """Trees of one lane by round and output."""

    lane: Lane
    edges: list[np.ndarray]
    outputs: int
    trees: list[tuple]  # output, feature, cut, left, gain, value

    def scores(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """Sums of the trees' values per row and output."""
        bins = to_bins(columns, self.edges)
        total = np.zeros((bins.shape[1], self.outputs))
        for first in range(0, len(self.trees), _TREES_AT_ONCE):
            _add_scores(self.trees[first:first + _TREES_AT_ONCE], bins, max([2, *(len(e) + 1 for e in self.edges)]), total)
        return total

    def probabilities(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        scores = self.scores(columns)
        return 1 / (1 + np.exp(-scores)) if self.lane.thresholds else softmax(scores)

    def importance(self) -> np.ndarray:
        """Summed gain by output and feature, as shares of an output."""
        gains = np.zeros((self.outputs, len(self.edges)))
        for k, feature, _, _, gain, _ in self.trees:
            np.add.at(gains[k], feature[feature != _NONE], gain[feature != _NONE])
        return gains / np.maximum(gains.sum(axis=1, keepdims=True), 1e-300)


    def save(self, spark: SparkSession, path: str) -> None:
        """One row per tree, and one line with the settings."""
        rows = [(i, t[0], *(bytes(a.tobytes()) for a in t[1:])) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, _STORED_TYPES).write.parquet(f"{path}/trees")
        about = json.dumps({"lane": asdict(self.lane), "edges": [e.tolist() for e in self.edges], "outputs": self.outputs})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/forest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        about = json.loads(spark.read.text(f"{path}/forest").first()["value"])
        lane = Lane(**{k: tuple(v) if isinstance(v, list) else v for k, v in about["lane"].items()})
        rows = sorted(spark.read.parquet(f"{path}/trees").collect(), key=lambda r: r["place"])
        trees = [(r["output"], *(np.frombuffer(bytes(r[c]), k) for c, k in _STORED.items())) for r in rows]
        return cls(lane, [np.array(e) for e in about["edges"]], about["outputs"], trees)


_STORED = {"feature": "int32", "cut": "int32", "left": "int32", "gain": "float64", "value": "float64"}
_STORED_TYPES = "place int, output int, feature binary, cut binary, left binary, gain binary, value binary"
_TREES_AT_ONCE = 128
_ROWS_AT_ONCE = 512


def _add_scores(trees: list[tuple], bins: np.ndarray, size: int, total: np.ndarray) -> None:
    """Add the values of a few trees. Leaves are bits from left to right; for a feature's bin, the leaves that
    it rules out are known per tree, so a row's leaf is the first bit left over all features."""
    words = -(-max((len(t[1]) + 1) // 2 for t in trees) // 64)
    leaf_value = np.zeros((len(trees), words * 64))
    at, masks = [[], [], []], []
    ones = (1 << (64 * words)) - 1
    for t, (_, feature, cut, left, _, value) in enumerate(trees):
        spans, n = {}, 0
        stack = [(0, False)]
        while stack:  # leaves from left to right; a node's span once its right side is done
            x, done = stack.pop()
            if feature[x] == _NONE:
                leaf_value[t, n] = value[x]
                spans[x] = (n, n + 1)
                n += 1
            elif done:
                spans[x] = (spans[left[x]][0], spans[left[x] + 1][1])
            else:
                stack += [(x, True), (left[x] + 1, False), (left[x], False)]
        for x in np.flatnonzero(feature != _NONE).tolist():
            a, b = spans[left[x]]
            for place, v in zip(at, (feature[x], cut[x] + 1, t), strict=True):
                place.append(v)
            masks.append(ones ^ (((1 << (b - a)) - 1) << a))
    used = sorted(set(at[0]))
    row_of = {f: i for i, f in enumerate(used)}
    left_over = np.full((len(used), size + 1, len(trees), words), np.uint64((1 << 64) - 1))
    if masks:
        packed = np.frombuffer(b"".join(m.to_bytes(8 * words, "little") for m in masks), "<u8").reshape(-1, words)
        np.bitwise_and.at(left_over, (np.array([row_of[f] for f in at[0]]), np.array(at[1]), np.array(at[2])), packed)
        np.bitwise_and.accumulate(left_over, axis=1, out=left_over)
    outputs = np.array([t[0] for t in trees])
    grid = np.arange(len(trees))
    for first in range(0, bins.shape[1], _ROWS_AT_ONCE):
        some = bins[:, first:first + _ROWS_AT_ONCE]
        bits = np.full((some.shape[1], len(trees), words), np.uint64((1 << 64) - 1))
        for i, f in enumerate(used):
            bits &= left_over[i, some[f]]
        leaf = np.zeros(bits.shape[:2], "int64")
        open_ = np.ones(bits.shape[:2], bool)
        for w in range(words):
            word = bits[:, :, w]
            here = open_ & (word != 0)
            low = np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)).astype("int64")  # trees of over 256 leaves
            leaf[here] = 64 * w + low[here]
            open_ &= ~here
        values = leaf_value[grid, leaf]
        for k in range(total.shape[1]):
            total[first:first + _ROWS_AT_ONCE, k] += values[:, outputs == k].sum(axis=1)


_in_flight, _counting = [0], Lock()


@contextmanager
def in_flight(tasks: int) -> Iterator[int]:
    """Counts long tasks of this driver while they run or wait; gives how many there were before. Those that must start at once
    would wait for the others, with idle cores."""
    with _counting:
        before, _in_flight[0] = _in_flight[0], _in_flight[0] + tasks
    try:
        yield before
    finally:
        with _counting:
            _in_flight[0] -= tasks


def _shares(table: Binned, lanes: Sequence[Lane], outputs: Sequence[int], rounds: Sequence[int], others: int = 0) -> list[int]:
    """Tasks of each lane: as many as run side by side with ``others``, the dearest lanes first; one for small tables and where the
    number of cores may change."""
    context = table.blocks.sparkSession.sparkContext
    told, shares = context.getConf(), [1] * len(lanes)
    cost = [n * (table.rows + TREE_ROWS + NODE_ROWS * min(1 << min(lane.depth, 12), lane.leaves, table.rows)) for lane, n in zip(lanes, rounds, strict=True)]
    if max(cost, default=0) < SHARED_ROWS or told.get("spark.dynamicAllocation.enabled", "false") == "true" or told.get("spark.default.parallelism"):
        return shares
    left = context.defaultParallelism // int(told.get("spark.task.cpus", "1")) - len(lanes) - others
    while True:
        i = max(range(len(lanes)), key=lambda i: cost[i] * -(-outputs[i] // shares[i]))
        more = next((s for s in range(shares[i] + 1, outputs[i] + 1) if -(-outputs[i] // s) < -(-outputs[i] // shares[i])), None)
        if more is None or more - shares[i] > left:
            return shares
        left, shares[i] = left - more + shares[i], more


def train(table: Binned, lanes: Sequence[Lane], start: Sequence[Forest] | None = None) -> list[Forest]:
    """One forest per lane; with ``start``, the forests of the same lanes with more rounds."""
    with in_flight(len(lanes)) as others:
        return _trained(table, lanes, start, others)


def _trained(table: Binned, lanes: Sequence[Lane], start: Sequence[Forest] | None, others: int) -> list[Forest]:
    outputs = [table.classes - lane.thresholds for lane in lanes]
    trees = [list(f.trees) for f in start] if start else [[] for _ in lanes]
    apart = all(lane.thresholds for lane in lanes)  # each threshold has gradients of its own
    rounds = [lane.rounds - len(t) // n for lane, t, n in zip(lanes, trees, outputs, strict=True)]
    shares = [max(outputs, default=1)] * len(lanes) if apart else _shares(table, lanes, outputs, rounds, others) if table.n_blocks <= WHOLE_BLOCKS else [1] * len(lanes)
    meet = max(shares, default=1) > 1 and not apart
    unscored = table.blocks.select("*", F.lit(None).cast("binary").alias("scores"))
    if table.n_blocks <= WHOLE_BLOCKS:
        tasks = [F.struct(F.lit(i).alias("lane"), F.lit(k).alias("share"), F.lit(at).alias("task")) for at, (i, k) in enumerate(
            (i, k) for i, n in enumerate(shares) for k in range(n))]
        dealt = unscored.select("*", F.inline(F.array(*tasks))).repartitionById(len(tasks), F.col("task"))
        folder = meet and (f"{common}/meeting-{uuid.uuid4().hex}" if (common := local_shared_dir(table.blocks.sparkSession)) else "")
        try:
            rows = [tuple(r) for r in dealt.mapInArrow(_whole(lanes, trees, shares if meet else max(shares, default=1), folder), TREE_TYPES, barrier=meet).collect()]
        finally:
            if folder:
                shutil.rmtree(folder, ignore_errors=True)
    else:
        dealt = unscored.select("*", F.explode(F.lit(list(range(len(lanes))))).alias("lane"))
        dealt = dealt.repartitionById(len(lanes) * table.n_blocks, (F.col("lane") * table.n_blocks + F.col("block")).cast("int"))
        started = _stored(lambda block, row: _started(block, trees[row["lane"]], outputs[row["lane"]]))
        blocks = write_table(dealt.mapInArrow(started, dealt.schema), "boosting-lanes")
        rows = _by_waves(blocks, lanes, outputs, [len(t) // n for t, n in zip(trees, outputs, strict=True)])
    for lane, _, output, *arrays in sorted(rows, key=lambda r: r[:3]):
        trees[lane].append((output, *(np.frombuffer(bytes(a), k) for a, k in zip(arrays, _STORED.values(), strict=True))))
    return [Forest(lane, table.edges, n, t) for lane, n, t in zip(lanes, outputs, trees, strict=True)]


def forests(table: Binned, lanes: Sequence[Lane]) -> list[Forest]:
    """``train`` with a memory: lanes that were grown on this table, or are being grown, are not grown again. A seed only
    counts where rows are drawn."""
    lanes = [lane if lane.sample < 1 else replace(lane, seed=0) for lane in lanes]
    with table.lock:
        new = [lane for lane in dict.fromkeys(lanes) if lane not in table.known]
        table.known.update({lane: Future() for lane in new})
    try:
        for lane, forest in zip(new, train(table, new) if new else [], strict=True):
            table.known[lane].set_result(forest)
    except BaseException as e:
        for lane in new:
            if not table.known[lane].done():
                table.known.pop(lane).set_exception(e)
        raise
    return [table.known[lane].result() for lane in lanes]
