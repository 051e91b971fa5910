"""Isotonic regression by pooling adjacent violators, with stacks of blocks that can be merged.

A stack is a list of blocks (lowest value, highest value, sum of targets, weight) with rising means. Pooling the
concatenation of two neighbouring stacks gives the stack of their points, so each range of values is pooled where it
lies and only stacks travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Blocks = list[tuple[float, float, float, float]]


def pooled(blocks: Blocks) -> Blocks:
    """Blocks in the order of their values, merged until their means rise."""
    out: Blocks = []
    for block in blocks:
        out.append(block)
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, high, t, w = out.pop()
            low, _, s, v = out.pop()
            out.append((low, high, s + t, v + w))
    return out


_NAMES = ["curve", "low", "high", "total", "weight"]
_TYPES = "curve long, low double, high double, total double, weight double"


def _made(curve: int, blocks: Blocks) -> pa.RecordBatch:
    columns = list(zip(*blocks, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array([curve] * len(blocks), pa.int64()), *(pa.array(c, pa.float64()) for c in columns)], names=_NAMES)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stacks of the curves of a range, from rows in the order of curve and value."""
    now, stack = None, []
    for batch in batches:
        curves = batch.column("curve").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(curves)) + 1).tolist(), len(curves)]
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("v", "v", "t", "w")), strict=True))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if curves[a] != now:
                if stack:
                    yield _made(now, stack)
                now, stack = int(curves[a]), []
            stack = pooled(stack + rows[a:b])
    if stack:
        yield _made(now, stack)


def _merged(table: pa.Table) -> pa.Table:
    rows = table.sort_by("low")
    blocks = pooled(list(zip(*(rows.column(c).to_pylist() for c in _NAMES[1:]), strict=True)))
    return pa.Table.from_batches([_made(rows.column("curve")[0].as_py(), blocks)])


def stacks(points: DataFrame, curve: str, value: str, target: str) -> DataFrame:
    """Blocks of each curve. Points of one value count as one of their mean."""
    folded = points.groupBy(F.col(curve).cast("long").alias("curve"), F.col(value).alias("v")).agg(
        F.sum(target).alias("t"), F.count("*").cast("double").alias("w"))
    ranges = folded.repartitionByRange("curve", "v").sortWithinPartitions("curve", "v").mapInArrow(_ranges, _TYPES)
    return ranges.groupBy("curve").applyInArrow(_merged, _TYPES)


def curves_of(points: DataFrame, curve: str, value: str, target: str) -> dict[int, list[list[float]]]:
    """Per curve its corners: values and means, to be joined by straight lines and cut off at both ends."""
    out: dict[int, list[list[float]]] = {}
    for r in sorted(stacks(points, curve, value, target).collect(), key=lambda r: (r["curve"], r["low"])):
        xs, ys = out.setdefault(r["curve"], [[], []])
        mean = r["total"] / r["weight"]
        for x in dict.fromkeys((r["low"], r["high"])):
            xs.append(x)
            ys.append(mean)
    return out
