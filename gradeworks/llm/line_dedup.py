"""Removal of lines that many documents share, by probing a sharded minimal perfect hash instead of joining lines.

A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of at least ``least`` code points that
stand in at least ``min_docs`` documents lose all their lines but those of the document with the largest id.

1. Tasks hash the keys of their documents to 128 bits, fold equal ones, and Spark adds up documents and the
   largest id per hash. Only hashes of enough documents go on: a probe that finds nothing means fewer.
2. These hashes are dealt to shards of about ``SHARD_KEYS``. Each shard becomes one row: a minimal perfect hash
   (``perfect_hash``) whose slots index an array of fingerprints, one of counts and one of keepers.
3. Documents probe the arrays. Shards of the most frequent keys, as many as ``head_bytes`` holds, are sent to every
   task. If there are more keys, the hashes that the head does not know go, packed, to the shard that holds the
   others, and only the numbers of the lines that go come back. The very frequent lines are all in the head, so
   that no shard is asked by a large part of all documents.

Defined results: a null or empty text is one empty line; each row is a document of its own; a null id is smaller than
all others; rows that share the largest id all keep the line; several equal lines of the keeping document all
stay; an empty table gives an empty table. Only ``key`` (an integer column) and ``text`` are read, other columns
travel in the struct ``row``, so names cannot clash. Lines are told apart by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.llm.lean import lean
from gradeworks.llm.perfect_hash import SHARD_TYPES, Shard, shard_row
from gradeworks.session import write_table

LEAST_CHARS = 40
MIN_DOCS = 5
SHARD_KEYS = 1 << 16
HEAD_BYTES = 32 << 20
_KEY_BYTES = 26  # of one key in a shard, at most: bits, fingerprint, count, keeper
_LOWEST = -(1 << 63)

Batches = Iterator[pa.RecordBatch]


def _line_keys(data: bytes, least: int) -> tuple[list[int], list[bytes]]:
    """Numbers and hashes of the lines whose keys are long enough."""
    numbers, hashes = [], []
    for i, line in enumerate(data.split(b"\n")):
        if len(line) >= least:
            key = line.strip().lower()  # of bytes: blanks \x09-\x0D and \x20, letters A-Z
            if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
                numbers.append(i)
                hashes.append(xxhash.xxh3_128_digest(key))
    return numbers, hashes


def _words(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def _counted(least: int):
    """Each slice's distinct key hashes with their documents and largest id."""

    def read(batches: Batches) -> Batches:
        for batch in batches:
            owners, hashes = [], []
            for key, data in zip(batch.column("key").to_pylist(), _texts(batch.column("body")), strict=True):
                own = set(_line_keys(data, least)[1])
                hashes += own
                owners += [key] * len(own)
            words, owner = _words(hashes), np.array(owners, "int64")
            order = np.lexsort((words[:, 1], words[:, 0]))
            words, owner = words[order], owner[order]
            heads = np.flatnonzero(np.append(True, np.any(words[1:] != words[:-1], axis=1))[:len(words)])
            docs = np.diff(np.append(heads, len(words)))
            keeper = np.maximum.reduceat(owner, heads) if len(heads) else owner
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[heads, k].view("int64")) for k in (0, 1)] + [pa.array(docs), pa.array(keeper)],
                names=["h0", "h1", "docs", "keeper"])

    return read


def frequent_lines(bodies: DataFrame, least: int = LEAST_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``h0``, ``h1``, ``docs`` and ``keeper`` of the line keys of at least ``min_docs`` rows of (key, body)."""
    counted = bodies.mapInArrow(lean(_counted(least)), "h0 long, h1 long, docs long, keeper long")
    total = counted.groupBy("h0", "h1").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))
    return write_table(total.filter(F.col("docs") >= min_docs), "line-counts")


def build_shards(lines: DataFrame, n_keys: int) -> DataFrame:
    """One row per shard of about SHARD_KEYS keys."""
    shards = max(1, -(-n_keys // SHARD_KEYS))
    dealt = lines.withColumn("shard", F.pmod("h0", F.lit(shards)))
    return write_table(dealt.groupBy("shard").applyInArrow(shard_row, SHARD_TYPES), "line-shards")


class Index:
    """Shards in memory; a word's shard follows from its first half and their number."""

    def __init__(self, rows: list[dict], shards: int) -> None:
        self.shards = shards
        self.by_number = {r["shard"]: Shard(r) for r in rows}

    def keepers(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is known, and its keeper."""
        known, keeper = np.zeros(len(words), bool), np.zeros(len(words), "int64")
        number = words[:, 0].view("int64") % self.shards
        for n in np.unique(number).tolist():
            if shard := self.by_number.get(n):
                mine = np.flatnonzero(number == n)
                slots = shard.probe(words[mine])
                known[mine[slots >= 0]] = True
                keeper[mine[slots >= 0]] = shard.keepers[slots[slots >= 0]]
        return known, keeper


class Head:
    """The shards that every task gets; unpacked once per worker."""

    def __init__(self, spark: SparkSession, shards: DataFrame, n_keys: int) -> None:
        self.n = max(1, -(-n_keys // SHARD_KEYS))
        self.sent = spark.sparkContext.broadcast([r.asDict() for r in shards.collect()])  # HEAD_BYTES at most

    def index(self) -> Index:
        return Index([{k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.items()} for r in self.sent.value], self.n)


def _probes(least: int, head: Head, shards: int):
    """Hashes that the head does not know, packed by shard: owner, place and hash of each."""

    def read(batches: Batches) -> Batches:
        index = head.index()
        for batch in batches:
            owners, places, hashes = [], [], []
            for row, data in enumerate(_texts(batch.column("body"))):
                numbers, own = _line_keys(data, least)
                owners += [row] * len(own)
                places += numbers
                hashes += own
            words = _words(hashes)
            owner, place = np.array(owners, "int64"), np.array(places, "int64")
            left = np.flatnonzero(~index.keepers(words)[0])
            number = words[left, 0].view("int64") % shards
            left, number = left[np.argsort(number, kind="stable")], np.sort(number, kind="stable")
            keys, bodies = batch.column("key").to_numpy(), batch.column("body_hash").to_numpy()
            out = [(int(number[some[0]]), keys[owner[left[some]]].tobytes(), bodies[owner[left[some]]].tobytes(),
                    place[left[some]].tobytes(), words[left[some]].tobytes())
                   for some in np.split(np.arange(len(left)), np.flatnonzero(np.diff(number)) + 1) if len(some)]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                                             names=["shard", "keys", "bodies", "places", "words"])

    return read


def _answered(batches: Batches) -> Batches:
    """Lines that go, from rows in the order of shard, index row first."""
    now, shard = None, None
    for batch in batches:
        for r in batch.to_pylist():
            if r["shard"] != now:
                now, shard = r["shard"], None
            if r["bits"] is not None:
                shard = Shard(r)
            elif shard is not None:
                slots = shard.probe(np.frombuffer(r["words"], "<u8").reshape(-1, 2))
                keys = np.frombuffer(r["keys"], "int64")
                gone = np.flatnonzero(slots >= 0)
                gone = gone[shard.keepers[slots[gone]] != keys[gone]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[gone]), pa.array(np.frombuffer(r["bodies"], "int64")[gone]),
                     pa.array(np.frombuffer(r["places"], "int64")[gone])], names=["key", "body_hash", "line"])


def _exchanged(bodies: DataFrame, tail: DataFrame, n_keys: int, head: Head, least: int) -> DataFrame:
    """``key``, ``body_hash`` and the lines that go because of keys outside the head."""
    shards = max(1, -(-n_keys // SHARD_KEYS))
    index = build_shards(tail, n_keys)
    probes = bodies.mapInArrow(lean(_probes(least, head, shards)), "shard long, keys binary, bodies binary, places binary, words binary")
    both = index.unionByName(probes, allowMissingColumns=True)
    asked = both.repartition("shard").sortWithinPartitions("shard", F.col("bits").isNull())
    return asked.mapInArrow(lean(_answered), "key long, body_hash long, line long").groupBy("key", "body_hash").agg(
        F.collect_set("line").alias("found"))


def _cut(least: int, head: Head, digest: Callable[[bytes], str]):
    """What is left of each text."""

    def read(batches: Batches) -> Batches:
        index = head.index()
        for batch in batches:
            numbers, hashes, ends = [], [], []
            texts = _texts(batch.column("body"))
            for data in texts:
                some, own = _line_keys(data, least)
                numbers += some
                hashes += own
                ends.append(len(numbers))
            known, keeper = index.keepers(_words(hashes))
            sizes = np.diff(np.array([0, *ends]))
            gone = known & (keeper != np.repeat(batch.column("key").to_numpy(), sizes))
            made, first = [], 0
            found = batch.column("found").to_pylist()
            for data, end, more in zip(texts, ends, found, strict=True):
                lines = data.split(b"\n")
                drop = {numbers[i] for i in range(first, end) if gone[i]} if gone[first:end].any() else set()
                drop.update(more or ())
                first = end
                kept = [line for i, line in enumerate(lines) if i not in drop] if drop else None
                made.append((len(lines), len(drop), digest(data if kept is None else b"\n".join(kept))))
            columns = list(zip(*made, strict=True)) if made else [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("has_text"), *(pa.array(c, pa.int64()) for c in columns[:2]), pa.array(columns[2], pa.string())],
                names=["row", "has_text", "n_lines", "n_dropped", "kept"])

    return read


def drop_lines(docs: DataFrame, digest: Callable[[bytes], str], key: str = "doc_id", text: str = "text",
               least: int = LEAST_CHARS, min_docs: int = MIN_DOCS, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """Every row (as struct ``row``, without its text) with ``has_text``, ``n_lines``, ``n_dropped`` and ``kept``, what
    ``digest`` makes of the lines that stay."""
    spark = docs.sparkSession
    bodies = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LOWEST)).alias("key"),
                         F.xxhash64(text).alias("body_hash"), F.col(text).alias("body"))
    lines = frequent_lines(bodies.select("key", "body"), least, min_docs)
    # how many keys there are by the binary logarithm of their documents: 64 rows at most
    ladder = sorted((r["step"], r["n"]) for r in lines.groupBy(F.floor(F.log2("docs")).alias("step")).agg(F.count("*").alias("n")).collect())
    cut, in_head, n_keys = 64, 0, sum(n for _, n in ladder)
    for step, n in reversed(ladder):
        if (in_head + n) * _KEY_BYTES > head_bytes:
            break
        cut, in_head = step, in_head + n
    is_head = F.floor(F.log2("docs")) >= cut
    head = Head(spark, build_shards(lines.filter(is_head), in_head), in_head)
    rows = docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("row"), F.isnotnull(text).alias("has_text"),
                       F.col(text).alias("body"), F.coalesce(F.col(key).cast("long"), F.lit(_LOWEST)).alias("key"),
                       F.xxhash64(text).alias("body_hash"))
    if in_head < n_keys:
        found = _exchanged(bodies, lines.filter(~is_head), n_keys - in_head, head, least)
        rows = rows.join(found, ["key", "body_hash"], "left")
    else:
        rows = rows.withColumn("found", F.lit(None).cast("array<long>"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", "has_text", "body", "key", "found").mapInArrow(
        lean(_cut(least, head, digest)), f"row {kind}, has_text boolean, n_lines long, n_dropped long, kept string")


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """All rows and columns with the lines that stay in ``text`` and its length in ``chars`` (where there is such a
    column); null texts stay null."""
    done = drop_lines(docs, lambda data: data.decode("utf-8"), key, text)
    left = F.when(F.col("has_text"), F.col("kept"))
    new = {text: left, chars: F.char_length(left).cast("long")}
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
