"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.lean import lean
from gradeworks.session import write_table


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of the nodes 0 .. n-1 by the links a-b."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars around the smallest node of each of its components."""
    links = [np.stack([batch.column(c).to_numpy() for c in ("a", "b")]) for batch in batches if batch.num_rows]
    if links:
        a, b = np.concatenate(links, axis=1)
        links.clear()
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = _roots(place[:len(a)], place[len(a):], len(nodes))
        leaf = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[root[leaf]])], names=["a", "b"])


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every node of ``links``.

    Links are first contracted where they lie. Each round then hangs all larger neighbours of a node on its
    smallest one (large star), and after that all smaller ones (small star), until no large star moves a link. A
    node with many links costs a partial minimum and a join that adaptive execution can split; rounds are
    cut by written tables. Null ends and loops are dropped; an empty table gives an empty table.
    """
    edges = links.select(F.greatest(u, v).cast("long").alias("a"), F.least(u, v).cast("long").alias("b")).filter("a > b")
    edges = write_table(edges.mapInArrow(lean(_contracted), "a long, b long").distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = write_table(both.join(low, "a").filter("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b"), (F.col("m") != F.col("a")).alias("moved")), "large-star")
        if not large.filter("moved").limit(1).count():
            break
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = write_table(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
    leaves = large.groupBy("a").agg(F.min("b").alias("b"))
    roots = large.select(F.col("b").alias("node")).distinct()
    return leaves.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
