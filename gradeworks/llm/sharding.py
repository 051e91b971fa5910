"""Shards of near equal bytes by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group that is never split, unless the group alone is larger than a shard;
then it is cut by the hash of its keys into parts of bundle size. Packing runs on two levels: each
task sorts its groups by size and puts each into the tightest open bundle (a small bin), and the bundles,
whose number is bounded by ``shards * bundles_per_shard``, are packed in the same way into the least shard
capacity that needs no more than ``shards`` bins. Texts never move: rows travel as id, size, checksum
and digest.

Defined results: a null text has no bytes (size 1) and shares the group of the empty text; repeated rows
and null ids are rows like all others and get slots of their own; ties are broken by digest, and slots of
equal ids are arbitrary; an empty table gives an empty table. Only ``key`` and ``text`` are read, so other
columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.numbering import number_rows
from gradeworks.session import write_table

SHARDS = 16
BUNDLES_PER_SHARD = 1024
_BLOCK = 512


class SpaceTree:
    """Open bins by remaining capacity: a two-level balanced tree whose leaves are split in halves when
    full, so that finding, taking and adding a bin touch one short leaf."""

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = []
        self.firsts: list[tuple[int, int]] = []

    def add(self, space: int, bin_id: int) -> None:
        entry = (space, bin_id)
        if not self.leaves:
            self.leaves, self.firsts = [[entry]], [entry]
            return
        at = max(0, bisect_left(self.firsts, entry) - 1)
        leaf = self.leaves[at]
        insort(leaf, entry)
        self.firsts[at] = leaf[0]
        if len(leaf) > _BLOCK:
            half = len(leaf) // 2
            self.leaves.insert(at + 1, leaf[half:])
            self.firsts.insert(at + 1, leaf[half])
            del leaf[half:]

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least space that still holds ``size``."""
        at = max(0, bisect_left(self.firsts, (size, -1)) - 1)
        while at < len(self.leaves):
            leaf = self.leaves[at]
            i = bisect_left(leaf, (size, -1))
            if i < len(leaf):
                entry = leaf.pop(i)
                if leaf:
                    self.firsts[at] = leaf[0]
                else:
                    del self.leaves[at], self.firsts[at]
                return entry
            at += 1
        return None


class BestFit:
    """Best fit for sizes that arrive in descending order; a size above the capacity fills its own bin."""

    def __init__(self, capacity: int, first_bin: int = 0) -> None:
        self.capacity, self.next_bin, self.tree = capacity, first_bin, SpaceTree()

    def place(self, size: int) -> int:
        found = self.tree.take(size)
        if found is None:
            found = (max(self.capacity, size), self.next_bin)
            self.next_bin += 1
        space, bin_id = found
        if space > size:
            self.tree.add(space - size, bin_id)
        return bin_id


def best_fit_decreasing(sizes: Iterable[int], capacity: int) -> list[int]:
    """Bins 0, 1, ... of ``sizes``, which must be sorted from large to small."""
    fit = BestFit(capacity)
    return [fit.place(s) for s in sizes]


def least_capacity(sizes: list[int], bins: int) -> tuple[int, list[int]]:
    """The least capacity found by bisection at which ``bins`` bins suffice, and the placing."""
    total, largest = sum(sizes), max(sizes, default=1)
    low = max(largest, -(-total // bins))
    high = max(largest, -(-2 * total // bins))
    best = best_fit_decreasing(sizes, high)
    while max(best, default=0) >= bins:
        high *= 2
        best = best_fit_decreasing(sizes, high)
    while low < high:
        mid = (low + high) // 2
        tried = best_fit_decreasing(sizes, mid)
        if max(tried, default=0) < bins:
            high, best = mid, tried
        else:
            low = mid + 1
    return high, best


def _bundles(capacity: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit = BestFit(capacity, TaskContext.get().partitionId() << 32)
        for batch in batches:
            yield batch.assign(bundle=[fit.place(int(s)) for s in batch["bytes"]])

    return pack


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS,
          bundles_per_shard: int = BUNDLES_PER_SHARD) -> DataFrame:
    """Key, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = write_table(docs.select(
        F.col(key).alias("key"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body).alias("crc"), F.unhex(F.md5(body)).alias("digest")), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    bundle = max(1, -(-total // (shards * bundles_per_shard)))
    # At most ``shards`` groups can be larger than a shard.
    huge = rows.groupBy("digest").agg(F.sum("size").alias("b")).filter(F.col("b") > -(-total // shards)).select(
        "digest", F.ceil(F.col("b") / bundle).cast("long").alias("parts"))
    rows = rows.join(F.broadcast(huge), "digest", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("key"), F.col("parts")), F.lit(0).cast("long"))).drop("parts")
    groups = rows.groupBy("digest", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    ordered = groups.sortWithinPartitions(F.desc("bytes"), "digest", "part")
    placed = write_table(ordered.mapInPandas(
        _bundles(bundle), "digest binary, part long, bytes long, n long, bundle long"), "shard-groups")
    bins = placed.groupBy("bundle").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).toPandas()
    bins = bins.sort_values(["bytes", "bundle"], ascending=[False, True])
    bins["shard"] = least_capacity([int(b) for b in bins["bytes"]], shards)[1]
    bins["base"] = bins.groupby("shard")["n"].cumsum() - bins["n"]
    table = spark.createDataFrame(
        bins[["bundle", "shard", "base", "n"]], "bundle long, shard int, base long, group_rows long")
    located = rows.join(placed.select("digest", "part", "bundle"), ["digest", "part"]).drop("digest", "part")
    ranked = number_rows(located, "bundle", "key", table.select("bundle", "group_rows"))
    return ranked.join(F.broadcast(table.drop("group_rows")), "bundle").select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("base") + F.col("rank")).alias("slot"))
