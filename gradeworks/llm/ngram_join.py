"""Similarity join of documents on the Jaccard coefficient of their word n-grams.

T-occurrence search, with the search space cut into families first; every step is exact:

1. Documents with equal shingle sets form a class, and classes are joined instead of documents.
2. Families. Two sets of the required similarity differ in at most d shingles. Their shingles are dealt by
   hash into more than d groups, so one group is equal in both. Sizes have classes of ratio sqrt(2), each with its
   d; a set near its class's end is also dealt for the next. Hashes of whole groups go, packed, to buckets, which
   keep those that occur twice. Sets with an equal group are then compared by their parity sketches (one bit
   for each shingle or so): two sketches differ in no more bits than the sets differ in shingles, so a pair with
   more differing bits than that cannot be similar. What remains connected is a family.
3. Inside a family DivideSkip: for each set the short inverted lists are merged and counted, the longest ``L``
   are set aside, what occurs ``T - L`` times is probed in them by binary search, and a pair is kept if its
   exact overlap reaches the bound. Pairs that already hang together are not looked at again. Lists of
   equal groups and families are cut into blocks by hash, and each pair of blocks is one task's work, so none
   has to fit in one task.

The links found span every component; ``components`` follows them. Shingles and groups are compared by 64-bit
hashes and classes by 128 bits. ``percent`` must be 71 or more (one size class to the next).

Defined results: a text without words, also null or empty, has no shingles and links with nothing; a text
with fewer words than a shingle is one shingle; repeated rows are members of one class and null ids count as
absent when a component takes its smallest id (a component of null ids only has a null id); an empty table
gives an empty table. Only ``key`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.components import components
from gradeworks.llm.lean import lean, small_batches
from gradeworks.session import write_table

BLOCK = 96
LIST_BLOCK = 256
BUCKET_BYTES = 32 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[1]
    return (x ^ (x >> np.uint64(29))) * _MIX[0]


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words, A-Z folded."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, "uint64")
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=width)], "uint64")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))
    n = len(words) - width + 1
    out = _mixed(h[:n])
    for k in range(1, width):
        out = _mixed(out + h[k:k + n])
    return np.unique(out)


def size_classes(n: int, percent: int) -> list[int]:
    """The size classes in which a set of ``n`` shingles can meet a partner."""
    j = math.ceil(2 * math.log2(n) - 1e-9)
    return [j, j + 1] if n * 100 > percent * 2 ** (j / 2) * (1 - 1e-9) else [j]


def group_hashes(s: np.ndarray, size_class: int, percent: int) -> np.ndarray:
    """Hashes of the groups of sorted set ``s``. Similar sets of the class have at least one in common."""
    apart = int(2 * 2 ** (size_class / 2) * (100 - percent) / (100 + percent) + 1e-9)
    groups = apart + 1 + -(-(apart + 1) // 12)
    dealt = ((s >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
    heads = np.flatnonzero(np.append(True, dealt[1:] != dealt[:-1]))
    sums = np.add.reduceat(_mixed(s), heads)
    names = dealt[heads]
    if groups - len(heads) > groups - apart - 1:  # else one of the equal groups is not empty
        empty = np.setdiff1d(np.arange(groups, dtype="uint64"), names)
        names, sums = np.append(names, empty), np.append(sums, np.zeros(len(empty), "uint64"))
    return _mixed(sums + _mixed(names * np.uint64(64) + np.uint64(size_class)))


def sketch(s: np.ndarray) -> bytes:
    """Parities of the shingles in as many cells as the power of two from their number on, 64 at least."""
    cells = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount(((s * _MIX[1]) >> np.uint64(20)).astype("int64") & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype("uint8"), bitorder="little").tobytes()


def _planes(values: np.ndarray, width: int) -> bytes:
    """Numbers as byte planes, low bytes first, which compress well."""
    return values.astype("<u8").view("uint8").reshape(-1, 8)[:, :width].T.tobytes()


def _unplaned(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, "uint8").reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), "uint8")
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


_ROW = ["key", "body_hash", "n", "high", "low", "sketch"]
_SENT = ["bucket", *_ROW, "nodes", "owners", "groups"]


def _index(width: int, percent: int, buckets: int):
    """A row for each document, and the group hashes of each batch's distinct sets packed by bucket."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, high, low, sketches, owners, hashes = [], [], [], [], [], []
            nodes: dict[int, int] = {}
            for text in batch.column("body").to_pylist():
                s = shingles(text, width)
                n = len(s)
                signature = xxhash.xxh3_128_intdigest(s.tobytes())
                node = (signature >> 64) - (1 << 63)
                sizes.append(n)
                high.append(node)
                low.append((signature & ((1 << 64) - 1)) - (1 << 63))
                joins = n * (100 - percent) >= percent  # a smaller set can reach the similarity with its equals only
                sketches.append(sketch(s) if joins else None)
                if joins and node not in nodes:
                    nodes[node] = len(nodes)
                    for j in size_classes(n, percent):
                        found = group_hashes(s, j, percent)
                        hashes.append(found)
                        owners.append(np.full(len(found), nodes[node]))
            rows = batch.num_rows
            numbers = pa.array(high, pa.int64())
            spread = (np.arange(rows) + low[0] % buckets if rows else np.empty(0, "int64")) % buckets  # any bucket will do
            yield pa.RecordBatch.from_arrays(
                [pa.array(spread, pa.int64()), batch.column("key"), batch.column("body_hash"),
                 pa.array(sizes, pa.int64()), numbers, pa.array(low, pa.int64()), pa.array(sketches, pa.binary()),
                 *(pa.nulls(rows, pa.binary()) for _ in range(3))], names=_SENT)
            if not hashes:
                continue
            hashes, owners = np.concatenate(hashes), np.concatenate(owners)
            names = np.array(list(nodes), "int64")
            bucket = ((hashes >> np.uint64(16)) % np.uint64(buckets)).astype("int64")
            order = np.argsort(bucket, kind="stable")
            out = []
            for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                mine, at = np.unique(owners[some], return_inverse=True)
                out.append((int(bucket[some[0]]), names[mine].tobytes(), _planes(at, 4), _planes(hashes[some], 6)))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), *(pa.nulls(len(out), batch.schema.field("key").type if c == "key" else (
                    pa.binary() if c == "sketch" else pa.int64())) for c in _ROW), *(pa.array(c, pa.binary()) for c in columns[1:])],
                names=_SENT)

    return read


def _equal_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents' rows, and (``group``, ``high``) of every group hash that different sets have."""

    def lists(bucket: int, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        nodes = np.concatenate([np.frombuffer(r[0], "int64")[_unplaned(r[1], 4).astype("int64")] for r in rows])
        group = np.concatenate([_unplaned(r[2], 6) for r in rows])
        order = np.argsort(group)
        new = np.append(True, np.diff(group[order]) != 0)
        order = order[~(new & np.append(new[1:], True))]
        order = order[np.lexsort((nodes[order], group[order]))]
        nodes, group = nodes[order], group[order]
        fresh = np.append(True, (np.diff(nodes) != 0) | (np.diff(group) != 0))[:len(nodes)]
        nodes, group = nodes[fresh], group[fresh]
        new = np.append(True, np.diff(group) != 0)[:len(group)]
        several = ~(new & np.append(new[1:], True)[:len(group)])
        return _mixed(group[several] + np.uint64(bucket * 0x9E3779B97F4A7C15 % (1 << 64))).view("int64"), nodes[several]

    def made(schema: pa.Schema, bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        group, nodes = lists(bucket, rows)
        by_name = {"group": pa.array(group), "high": pa.array(nodes)}
        return pa.RecordBatch.from_arrays(
            [by_name.get(c, pa.nulls(len(nodes), schema.field(c).type if c != "group" else pa.int64())) for c in ["group", *_ROW]],
            names=["group", *_ROW])

    now, rows, schema = None, [], None
    for batch in batches:
        schema = batch.schema
        plain = batch.filter(batch.column("nodes").is_null())
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(plain.num_rows, pa.int64()), *(plain.column(c) for c in _ROW)], names=["group", *_ROW])
        packed = batch.filter(batch.column("nodes").is_valid())
        for at in range(packed.num_rows):  # row by row: what is packed in one row is a few MB
            bucket, *row = (packed.column(c)[at].as_py() for c in ("bucket", "nodes", "owners", "groups"))
            if bucket != now and rows:
                yield made(schema, now, rows)
                rows = []
            now = bucket
            rows.append(tuple(row))
    if rows:
        yield made(schema, now, rows)


def compatible_links(nodes: np.ndarray, sides: np.ndarray, sizes: np.ndarray, sketches: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links that span the pairs whose sketches do not rule them out."""
    least = min(map(len, sketches))
    bits = np.zeros((len(sketches), least), "uint8")
    for i, raw in enumerate(sketches):  # a longer sketch folds to the parities of fewer cells
        bits[i] = np.bitwise_xor.reduce(np.frombuffer(raw, "uint8").reshape(-1, least), axis=0)
    bits = bits.view("uint64")
    crossing = sides.min() != sides.max()
    root, found = np.arange(len(nodes)), []
    for x in range(len(nodes) - 1):
        others = np.flatnonzero(root != root[x])
        others = others[others > x]
        if crossing:
            others = others[sides[others] != sides[x]]
        apart = np.bitwise_count(bits[others] ^ bits[x]).sum(axis=1, dtype="int64")
        for y in others[apart * (100 + percent) <= (sizes[others] + sizes[x]) * (100 - percent)].tolist():
            if root[y] != root[x]:
                found.append((int(nodes[x]), int(nodes[y])))
                root[root == root[y]] = root[x]
    return found


def _whole_sets(width: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, width).tobytes() for t in batch.column("body").to_pylist()]
            kept = [c for c in batch.schema.names if c != "body"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sets, pa.binary())], names=[*kept, "shingles"])

    return read


def divide_skip(nodes: list[int], sides: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span the components of ``sets``. With two ``sides`` only pairs across them are tried."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), nodes[i]))
    nodes, sides, sets = ([x[i] for i in order] for x in (nodes, sides, sets))
    lengths = np.array([len(s) for s in sets])
    side = np.array(sides)
    crossing = side.min() != side.max()
    tokens = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), lengths)
    by_token = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[by_token], owners[by_token]
    names, starts = np.unique(tokens, return_index=True)
    ends = np.append(starts[1:], len(tokens))
    root = np.arange(len(sets))
    found = []
    for x in range(1, len(sets)):
        own = sets[x]
        n = len(own)
        need = (n * percent + 99) // 100  # the overlap with any set of this size or less
        first = int(np.searchsorted(lengths, need))
        if first >= x or (root[first:x] == root[x]).all():
            continue
        at = np.searchsorted(names, own)
        long = np.argsort(ends[at] - starts[at], kind="stable")
        widest = int(ends[at[long[-1]]] - starts[at[long[-1]]])
        apart = min(need - 1, int(need / (0.0085 * np.log2(max(2, widest)) + 1)))
        short, probed = at[long[:n - apart]], own[long[n - apart:]]
        merged = np.concatenate([owners[starts[k]:ends[k]] for k in short])
        merged = merged[(merged >= first) & (merged < x)]
        if not len(merged):
            continue
        seen, counts = np.unique(merged, return_counts=True)
        likely = np.flatnonzero((counts >= need - apart) & (root[seen] != root[x]))
        if crossing:
            likely = likely[side[seen[likely]] != side[x]]
        for k in likely[np.argsort(-counts[likely], kind="stable")]:
            y = int(seen[k])
            if root[y] == root[x]:
                continue
            other = sets[y]
            places = np.minimum(np.searchsorted(other, probed), len(other) - 1)
            overlap = int(counts[k]) + int((other[places] == probed).sum())
            if overlap * 100 >= percent * (n + len(other) - overlap):
                found.append((nodes[x], nodes[y]))
                root[root == root[y]] = root[x]
    return found


def _by_cell(names: list[str], columns: list[str], links):
    """Links of each cell (rows with equal ``names``, sorted)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            found = []
            cells = zip(*(batch.column(c).to_pylist() for c in names), strict=True)
            for cell, *row in zip(cells, *(batch.column(c).to_pylist() for c in columns), strict=True):
                if cell != now:
                    found += links(rows) if len(rows) > 1 else []
                    now, rows = cell, []
                rows.append(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])
        found = links(rows) if len(rows) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return read


def _sketched(percent: int):
    def links(rows: list) -> list[tuple[int, int]]:
        nodes, sides, sizes, sketches = zip(*rows, strict=True)
        return compatible_links(np.array(nodes), np.array(sides), np.array(sizes), list(sketches), percent)

    return _by_cell(["group", "i", "j"], ["high", "block", "n", "sketch"], links)


def _searched(percent: int):
    def links(rows: list) -> list[tuple[int, int]]:
        rows = list({r[0]: r for r in rows}.values())  # repeated rows of one id and text
        if len(rows) < 2:
            return []
        nodes, sides, sets = zip(*rows, strict=True)
        return divide_skip(list(nodes), list(sides), [np.frombuffer(s, "uint64") for s in sets], percent)

    return _by_cell(["family", "i", "j"], ["row", "block", "shingles"], links)


def _cells(rows: DataFrame, group: str, name: str, block: int) -> DataFrame:
    """Each row in the cells of its block: a group of b blocks has a cell for each pair of them."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / block).alias("blocks")).filter("blocks > 1")
    split = rows.join(sizes, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    split = split.withColumn("block", F.pmod(F.xxhash64(name), "blocks"))
    return split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn(
        "i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")


def _families(made: DataFrame, percent: int, block: int) -> DataFrame:
    """``node`` and ``component`` of every set that may be similar to another."""
    sketches = made.filter("group is null and sketch is not null").groupBy("high").agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    cells = _cells(made.filter("group is not null").select("group", "high"), "group", "high", block).join(sketches, "high")
    return components(cells.select("group", "i", "j", "high", "block", "n", "sketch").repartition("group", "i", "j").sortWithinPartitions(
        "group", "i", "j").mapInArrow(lean(_sketched(percent)), "u long, v long"))


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90,
                    block: int = BLOCK, list_block: int = LIST_BLOCK) -> DataFrame:
    """Key, ``n_shingles`` and ``component_id`` (the smallest key reachable by links) of every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    bodies = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("body_hash"), F.col(text).alias("body"))
    row = f"key {kind}, body_hash long, n long, high long, low long, sketch binary"
    sent = bodies.mapInArrow(
        lean(_index(width, percent, buckets)), f"bucket long, {row}, nodes binary, owners binary, groups binary")
    made = write_table(sent.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(
        lean(_equal_groups), f"group long, {row}"), "ngram-index")
    index = made.filter("group is null").select("key", "body_hash", "n", "high", "low")
    classes = index.filter("n > 0").groupBy("high", "low").agg(
        F.min("key").alias("least"), F.min(F.struct("key", "body_hash")).alias("at"))
    classes = write_table(classes.withColumn("row", F.monotonically_increasing_id()), "ngram-classes")
    families = write_table(_families(made, percent, list_block), "ngram-families")
    members = families.join(classes, F.col("node") == F.col("high")).select(
        F.col("at.key").alias("m_key"), F.col("at.body_hash").alias("m_hash"), "row", F.col("component").alias("family"))
    members = write_table(_cells(members, "family", "row", block), "ngram-members")
    wanted = members.select("m_key", "m_hash", "row").distinct()
    sets = bodies.join(wanted, F.col("key").eqNullSafe(F.col("m_key")) & (F.col("body_hash") == F.col("m_hash"))).select(
        "row", "body").mapInArrow(lean(_whole_sets(width)), "row long, shingles binary")
    cells = members.select("family", "i", "j", "row", "block").join(sets, "row").select(
        "family", "i", "j", "row", "block", "shingles")
    links = write_table(cells.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(
        lean(_searched(percent)), "u long, v long"), "ngram-links")
    rooted = classes.select("row", "high", "low", "least").join(
        components(links).withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("component", "row"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("high", "low", "component_id")
    full = index.filter("n > 0").join(named, ["high", "low"]).select("key", "n", "component_id")
    none = index.filter("n = 0").select("key", "n", F.col("key").alias("component_id"))
    return full.union(none).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of the smallest key of each component, with all columns; rows without shingles stay, and so do
    all rows of null key. Rows that repeat a kept key are one document and stay together."""
    found = join_components(docs, key, text, width, percent)
    gone = found.filter(~F.col(key).eqNullSafe(F.col("component_id")) & F.col(key).isNotNull())
    gone = write_table(gone.select(F.col(key).alias("gone_key")).distinct(), "near-copies")
    return docs.join(gone, docs[key] == gone["gone_key"], "left_anti")
