"""Removal of long byte strings that already occur in an earlier document.

Every string of ``length`` bytes that also starts in a document with a smaller id is removed, judged on the
input. A suffix array answers this, and it is built by external induced sorting in the sense that
only a sample of the suffixes is exchanged and the rest follows from it:

1. The sample: each window of ``length`` bytes has one anchor, its least ``gram`` by hash, so equal windows
   have equal anchors. Consecutive windows with one anchor make a run. Tasks fold the runs that occur
   twice among their own documents and send hash and place of the others, packed, to hash buckets.
2. Buckets split the runs. A run whose anchor is found in one document only holds nothing; of equal runs
   all but the first document's are removed; only unequal runs around one anchor are left open.
3. Open runs are gathered by anchor, and each gathering is put in suffix order with its common prefixes by
   induced sorting (``induced``). An anchor with very many open runs is cut by the hash of each window.
   Spark's shuffle and sort, which use disk, hold what waits between the steps; a task holds one bounded
   gathering of strings at a time, whatever the size of the corpus.
4. The removed ranges are merged per document.

Defined results: a null text counts as empty; texts shorter than ``length`` lose nothing; rows that repeat
an id never make each other lose text; a null id comes after all others, and rows of null id are one
document in this sense; an empty table gives an empty table. Only ``key`` (an integer column) and ``text``
are read, so other columns cannot clash. Runs around one anchor are compared by 128 bits of a hash of their
bytes, open runs by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.induced import common_runs, suffix_order
from gradeworks.llm.lean import give_back, lean, small_batches
from gradeworks.session import write_table

LENGTH = 50
GRAM = 24
SEGMENT = 1 << 18
BUCKET_BYTES = 16 << 20
MANY_RUNS = 64
_FLUSH = 4 << 20  # bytes of text whose runs are folded and packed at once
_GATHER = 1 << 20  # bytes put in suffix order at once
_ROWS = 20_000  # rows handed on at once
_LAST = (1 << 63) - 1
_POSITION = np.uint64((1 << 24) - 1)

_table = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype="uint64") * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every run of ``gram`` bytes, by doubling."""
    base = 0x9E3779B97F4A7C15
    power = lambda k: np.uint64(pow(base, k, 1 << 64))
    part, size = _table[data], 1
    total, done = None, 0
    left = gram
    while left:
        if left & 1:
            total = part if total is None else total[:len(data) - done - size + 1] * power(size) + part[done:]
            done += size
        left >>= 1
        if left:
            part = part[:len(part) - size] * power(size) + part[size:]
            size *= 2
    return _mixed(total[:len(data) - gram + 1])


def runs(raw: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, window counts and anchor hashes of the runs of the texts that stand one after another in
    ``raw`` (at most 2**24 bytes) and end at ``ends``. No window crosses an end."""
    hashes = _gram_hashes(raw, gram)
    least = (hashes & ~_POSITION) | np.arange(len(hashes), dtype="uint64")
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:len(least) - step], least[step:])
        have += step
    anchors = (least & _POSITION).astype("int64")
    for k in range(1, length):  # no window starts so near to an end
        at = ends - k
        anchors[at[(at >= 0) & (at < len(anchors))]] = -1
    starts = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
    counts = np.diff(np.append(starts, len(anchors)))
    real = anchors[starts] >= 0
    return starts[real], counts[real], hashes[anchors[starts[real]]]


def gathered(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The bytes of ``texts`` in stretches of about SEGMENT: bytes, ends of the parts, their rows and their
    offsets. A text longer than that is cut into parts that overlap, so each window is in one part."""
    parts, size = [], 0

    def joined() -> tuple:
        raw = np.frombuffer(b"".join(p[2] for p in parts), "uint8")
        return raw, np.cumsum([len(p[2]) for p in parts]), np.array([p[0] for p in parts]), np.array([p[1] for p in parts])

    for row, data in enumerate(_bytes(texts)):
        for offset in range(0, len(data) - length + 1, SEGMENT):
            parts.append((row, offset, data[offset:offset + SEGMENT + length - 1]))
            size += len(parts[-1][2])
            if size >= SEGMENT:
                yield joined()
                parts, size = [], 0
    if parts:
        yield joined()


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def _repeats(first: np.ndarray) -> np.ndarray:
    """Places of the values that occur twice or more, ordered by value."""
    order = np.argsort(first)
    value = first[order]
    new = np.append(True, value[1:] != value[:-1])
    return order[~(new & np.append(new[1:], True))]


_RANGES = ["key", "body_hash", "start", "windows"]
_RANGE_TYPES = "key long, body_hash long, start long, windows long"
_PACKED = ["bucket", "known", "docs", "bodies", "doc", "places", "counts", "anchors", "contents", "seconds"]
_PACKED_TYPES = ("bucket long, known boolean, docs binary, bodies binary, doc binary, places binary, counts binary, "
                 "anchors binary, contents binary, seconds binary")

_HASHES = [("anchor", 6), ("content", 8), ("second", 8)]  # bytes kept of each; the two words of the content together tell runs apart


def _planes(values: np.ndarray, width: int) -> bytes:
    """Numbers as byte planes, low bytes first, which compress well."""
    return values.astype("<u8").view("uint8").reshape(-1, 8)[:, :width].T.tobytes()


def _unplaned(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, "uint8").reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), "uint8")
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def _sampled(length: int, gram: int, buckets: int):
    """The runs of each batch, packed by bucket; apart from them the ranges already known to go."""

    def packed(some: np.ndarray, bucket: int, known: bool, c: dict[str, np.ndarray]) -> tuple:
        mine, at = np.unique(c["row"][some], return_inverse=True)
        return (bucket, known, c["keys"][mine].tobytes(), c["bodies"][mine].tobytes(), _planes(at, 4),
                _planes(c["start"][some], 5), _planes(c["count"][some], 5 if known else 1),
                *(b"" if known else _planes(c[name][some], width) for name, width in _HASHES))

    def folded(parts: list[tuple], keys: np.ndarray, bodies: np.ndarray) -> pa.RecordBatch:
        c = dict(zip(("row", "start", "count", "anchor", "content", "second"),
                     map(np.concatenate, zip(*parts, strict=True)), strict=True))
        parts.clear()
        c["keys"], c["bodies"] = keys, bodies
        owner = keys[c["row"]]
        gone = np.zeros(len(owner), bool)
        order = _repeats(c["anchor"])
        if len(order):
            order = order[np.lexsort((owner[order], c["second"][order], c["content"][order], c["anchor"][order]))]
            fresh = np.append(True, np.any([np.diff(c[name][order]) != 0 for name, _ in _HASHES], axis=0))
            gone[order] = owner[order] > owner[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        out = []
        bucket = ((c["anchor"] >> np.uint64(16)) % np.uint64(buckets)).astype("int64")
        stay = np.flatnonzero(~gone)
        stay = stay[np.argsort(bucket[stay], kind="stable")]
        for some in np.split(stay, np.flatnonzero(np.diff(bucket[stay])) + 1):
            if len(some):
                out.append(packed(some, int(bucket[some[0]]), False, c))
        gone = np.flatnonzero(gone)
        if len(gone):  # neighbouring runs make one range
            ends = c["start"] + c["count"]
            apart = (np.diff(c["row"][gone]) != 0) | (c["start"][gone][1:] != ends[gone][:-1])
            heads = gone[np.append(True, apart)]
            c["count"][heads] = ends[gone[np.append(apart, True)]] - c["start"][heads]
            out.append(packed(heads, int(bodies[c["row"][heads[0]]] % buckets), True, c))
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()),
             *(pa.array(x, pa.binary()) for x in columns[2:])], names=_PACKED)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").fill_null(_LAST).to_numpy()
            bodies = batch.column("body_hash").to_numpy()
            parts, size = [], 0
            for raw, ends, rows, offsets in gathered(batch.column("body"), length):
                starts, counts, hashes = runs(raw, ends, length, gram)
                data = raw.tobytes()
                digests = b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(
                    starts.tolist(), (starts + counts + length - 1).tolist(), strict=True)])
                contents = np.frombuffer(digests, "<u8").reshape(-1, 2)
                part = np.searchsorted(ends, starts, side="right")
                begin = np.append(0, ends[:-1])[part]
                parts.append((rows[part], starts - begin + offsets[part], counts, hashes, contents[:, 0], contents[:, 1]))
                size += len(raw)
                if size >= _FLUSH:
                    yield folded(parts, keys, bodies)
                    size = 0
                    give_back()
            if parts:
                yield folded(parts, keys, bodies)

    return read


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, the ranges that go (``anchor`` null) and the open runs with their anchor."""

    def unpacked(r: dict) -> tuple:
        at = _unplaned(r["doc"], 4).astype("int64")
        return (np.frombuffer(r["docs"], "int64")[at], np.frombuffer(r["bodies"], "int64")[at],
                _unplaned(r["places"], 5), _unplaned(r["counts"], 5 if r["known"] else 1))

    def made(columns, anchor, open_, many) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*(pa.array(x.astype("int64")) for x in columns), pa.array(anchor.view("int64"), mask=~open_), pa.array(many)],
            names=[*_RANGES, "anchor", "many"])

    for bucket, rows in _grouped(batches, "bucket"):
        for r in (r for r in rows if r["known"]):
            columns = unpacked(r)
            none = np.zeros(len(columns[0]), bool)
            yield made(columns, np.zeros(len(none), "uint64"), none, none)
        rows = [r for r in rows if not r["known"]]
        if not rows:
            continue
        parts = [(*unpacked(r), *(_unplaned(r[f"{name}s"], width) for name, width in _HASHES)) for r in rows]
        keys, bodies, start, count, anchor, content, second = map(np.concatenate, zip(*parts, strict=True))
        order = _repeats(anchor)
        if not len(order):
            continue
        order = order[np.lexsort((keys[order], second[order], content[order], anchor[order]))]
        keys, bodies, start, count, anchor, content, second = (
            x[order] for x in (keys, bodies, start, count, anchor, content, second))
        new_anchor = np.append(True, np.diff(anchor) != 0)
        new_run = new_anchor | np.append(True, (np.diff(content) != 0) | (np.diff(second) != 0))
        group, run = np.cumsum(new_anchor) - 1, np.cumsum(new_run) - 1
        heads = np.flatnonzero(new_anchor)
        several = (np.minimum.reduceat(keys, heads) != np.maximum.reduceat(keys, heads))[group]
        unequal = (np.bincount(group[new_run]) > 1)[group]
        gone = keys > keys[np.flatnonzero(new_run)][run]
        open_ = several & unequal & ~gone
        many = (np.bincount(group[open_], minlength=len(heads)) > MANY_RUNS)[group]
        out = np.flatnonzero(gone | open_)
        gathering = _mixed(anchor + np.uint64(bucket * 0x9E3779B97F4A7C15 % (1 << 64)))
        yield made([x[out] for x in (keys, bodies, start, count)], gathering[out], open_[out], many[out])


def _grouped(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows by runs of equal ``name`` in sorted batches."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[name] != now and rows:
                yield now, rows
                rows = []
            now = row[name]
            rows.append(row)
    if rows:
        yield now, rows


def _listed(column: pa.Array, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ends of the rows' lists in the flat fields of a list of structs; a missing list is empty."""
    flat = column.flatten()
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return ends, [flat.field(n).to_numpy(zero_copy_only=False) for n in names]


def _contexts(length: int):
    """The bytes of open runs. Those of anchors with many runs go window by window, folded as far as they are
    read together; ranges that folding finds have no ``piece``."""

    def made(out: list[tuple], single: dict[bytes, list]) -> pa.RecordBatch:
        for piece, places in single.items():
            least = min(places)[0]
            h = xxhash.xxh3_64_intdigest(piece) - (1 << 63)
            for key, body_hash, w in places:
                if key == least:
                    out.append((h, key, body_hash, w, 1, piece))
                else:
                    out.append((body_hash ^ w, key, body_hash, w, 1, None))
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())],
            names=["gathering", *_RANGES, "piece"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, single, size = [], {}, 0
            ends, fields = _listed(batch.column("found"), ["start", "windows", "anchor", "many"])
            first = 0
            rows = zip(batch.column("key").to_pylist(), batch.column("body_hash").to_pylist(), _bytes(batch.column("body")),
                       ends.tolist(), strict=True)
            for key, body_hash, data, end in rows:
                for a, n, anchor, many in zip(*(f[first:end].tolist() for f in fields), strict=True):
                    if many:
                        for w in range(a, a + n):
                            single.setdefault(data[w:w + length], []).append((key, body_hash, w))
                        size += n
                    else:
                        out.append((anchor, key, body_hash, a, n, data[a:a + n + length - 1]))
                        size += 1
                first = end
                if size > _ROWS:
                    yield made(out, single)
                    out, single, size = [], {}, 0
            yield made(out, single)

    return read


def repeated_windows(pieces: pa.BinaryArray, keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, first window and number of windows of each run of windows that also start in a piece of a
    smaller key."""
    edges = np.frombuffer(pieces.buffers()[1], "int32")[pieces.offset:pieces.offset + len(pieces) + 1].astype("int64")
    sizes = np.diff(edges)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    heads = edges[:-1] - edges[0] + np.arange(len(sizes))
    text = np.zeros(len(owner), "int16")  # a separator ends each piece
    inner = np.ones(len(owner), bool)
    inner[heads + sizes] = False
    text[inner] = np.frombuffer(pieces.buffers()[2], "uint8")[edges[0]:edges[-1]].astype("int16") + 1
    place = np.arange(len(text)) - heads[owner]
    order = suffix_order(text, length)
    order = order[(place + length <= sizes[owner])[order]]
    gone = np.zeros(len(text) + 2, bool)
    if len(order):
        group = np.cumsum(~common_runs(text, order, length)) - 1
        least = np.minimum.reduceat(keys[owner[order]], np.flatnonzero(np.diff(group, prepend=-1)))
        gone[1 + order] = keys[owner[order]] > least[group]
    turns = np.flatnonzero(gone[1:] != gone[:-1])
    a, b = turns[::2], turns[1::2]
    return owner[a], place[a], b - a


def _induced(length: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved(batch: pa.RecordBatch) -> pa.RecordBatch:
            known = batch.filter(batch.column("piece").is_null())
            open_ = batch.filter(batch.column("piece").is_valid())
            keys, bodies, start = (open_.column(c).to_numpy() for c in _RANGES[:3])
            piece, first, n = repeated_windows(open_.column("piece"), keys, length) if len(keys) > 1 else ([], 0, [])
            columns = [keys[piece], bodies[piece], start[piece] + first, n] if len(piece) else [np.empty(0, "int64")] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([known.column(name).to_numpy(), x])) for name, x in zip(_RANGES, columns, strict=True)],
                names=_RANGES)

        for batch in batches:
            held.append(batch)
            if sum(b.column("piece").nbytes for b in held) > _GATHER:
                whole = pa.concat_batches(held)
                gathering = whole.column("gathering").to_numpy()
                cut = int(np.searchsorted(gathering, gathering[-1]))  # the last one may go on
                if cut:
                    yield solved(whole.slice(0, cut))
                held = [whole.slice(cut)]
        if held:
            yield solved(pa.concat_batches(held))

    return read


def _cut(length: int, digest: Callable[[bytes], str], carried: list[str]):
    """Each row's kept bytes and counts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, first = [], 0
            ends, (starts, windows) = _listed(batch.column("found"), ["start", "windows"])
            for data, end in zip(_bytes(batch.column("body")), ends.tolist(), strict=True):
                if first == end:
                    made.append((len(data), 0, 0, digest(data)))
                    continue
                size = len(data)
                turn = np.bincount(np.minimum(starts[first:end], size), minlength=size + 1)
                turn -= np.bincount(np.minimum(starts[first:end] + windows[first:end] + length - 1, size), minlength=size + 1)
                first = end
                keep = np.cumsum(turn[:-1]) == 0
                spans = int((~keep[:1]).sum() + (keep[:-1] & ~keep[1:]).sum())
                made.append((size, int((~keep).sum()), spans, digest(np.frombuffer(data, "uint8")[keep].tobytes())))
            columns = list(zip(*made, strict=True)) if made else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), *(pa.array(c, pa.int64()) for c in columns[:3]),
                 pa.array(columns[3], pa.string())], names=[*carried, "n_bytes", "n_removed", "n_spans", "kept"])

    return read


def repeated_ranges(docs: DataFrame, key: str, text: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``key`` (null: the largest long), ``body_hash``, ``start`` and ``windows`` of all ranges of windows
    that also start in a document of smaller key; a place may be named more than once."""
    small_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    bodies = docs.select(F.col(key).cast("long").alias("key"), _body_hash(text).alias("body_hash"), F.col(text).alias("body"))
    packed = bodies.mapInArrow(lean(_sampled(length, gram, buckets)), _PACKED_TYPES)
    settled = write_table(packed.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(
        lean(_settled), _RANGE_TYPES + ", anchor long, many boolean"), "suffix-settled")
    wanted = settled.filter("anchor is not null").groupBy("key", "body_hash").agg(
        F.collect_list(F.struct("start", "windows", "anchor", "many")).alias("found"))
    named = bodies.withColumn("key", F.coalesce("key", F.lit(_LAST)))
    contexts = named.join(wanted, ["key", "body_hash"]).mapInArrow(
        lean(_contexts(length)), "gathering long, " + _RANGE_TYPES + ", piece binary")
    induced = write_table(contexts.repartition("gathering").sortWithinPartitions("gathering").mapInArrow(
        lean(_induced(length)), _RANGE_TYPES), "suffix-induced")
    return settled.filter("anchor is null").select(*_RANGES).union(induced)


def _body_hash(text: str) -> Column:
    return F.xxhash64(text)


def remove_repeats(docs: DataFrame, digest: Callable[[bytes], str], key: str = "doc_id", text: str = "text",
                   length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Every row (as struct ``row``, without its text) with ``has_text``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, what ``digest``
    makes of the remaining bytes."""
    found = repeated_ranges(docs, key, text, length, gram).groupBy("key", "body_hash").agg(
        F.collect_list(F.struct("start", "windows")).alias("found"))
    rows = docs.select(
        F.struct(*[c for c in docs.columns if c != text]).alias("row"), F.col(text).alias("body"),
        F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("key"), _body_hash(text).alias("body_hash"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.join(found, ["key", "body_hash"], "left").select("row", F.isnotnull("body").alias("has_text"), "body", "found").mapInArrow(
        lean(_cut(length, digest, ["row", "has_text"])), f"row {kind}, has_text boolean, n_bytes long, n_removed long, n_spans long, kept string")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def readable(data: bytes) -> str:
    """The kept bytes as text; characters that lost a part of their bytes go."""
    return data.decode("utf-8", "ignore")


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """All columns with what remains of ``text`` and its length in ``chars`` (where there is such a column); rows
    that lose everything go, rows that had no text stay."""
    done = remove_repeats(docs, readable, key, text).filter("n_removed < n_bytes or n_bytes = 0")
    left = F.when((F.col("n_removed") > 0) | F.col("has_text"), F.col("kept"))
    new = {text: left, chars: F.char_length(left).cast("long")}
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
