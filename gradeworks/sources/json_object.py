"""One large ``{id: record}`` JSON object, read by many tasks.

The file is cut into byte ranges right after a closing brace, wherever Spark's splits fall. What a range means depends on
the state in which it begins: inside a string or not, and how deep. A first pass sums each range up for both beginnings;
the sums compose, so a scan over the ranges (one row each) gives every range its beginning. In a second pass each
range finds its entries; the few that go on in the next range are put together from their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What matters between two closing braces: escaped characters, quotes, other brackets.
_MARK = re.compile(r'\\.|["{\[\]]', re.S)
_DEEPER = {"{": 1, "[": 1, "]": -1}
_PLACE = ["file", "start"]

Batches = Iterator[pa.RecordBatch]


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between closing braces, with the byte range that it lies in. A range's rows stay in order."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def step(piece: str, quoted: bool, depth: int) -> tuple[bool, int]:
    """State after a piece and the brace that ends it."""
    for mark in _MARK.findall(piece):
        if mark == '"':
            quoted = not quoted
        elif not quoted:
            depth += _DEEPER.get(mark, 0)
    return quoted, depth if quoted else depth - 1


def _rows(batches: Batches) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value")), strict=True)


def _summed(batches: Batches) -> Batches:
    """Per range the end and the change of depth, for a beginning outside and inside a string."""
    now, states = None, [(False, 0), (True, 0)]

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [now[0]], "start": [now[1]], "out_quoted": [states[0][0]], "out_depth": [states[0][1]],
                                           "in_quoted": [states[1][0]], "in_depth": [states[1][1]]})
    for file, start, piece in _rows(batches):
        if (file, start) != now:
            if now:
                yield made()
            now, states = (file, start), [(False, 0), (True, 0)]
        states = [step(piece, *s) for s in states]
    if now:
        yield made()


_SUMS = "file string, start long, out_quoted boolean, out_depth long, in_quoted boolean, in_depth long"


def beginnings(sums: DataFrame) -> dict[tuple[str, int], tuple[bool, int]]:
    """State in which each range begins, from one row per range."""
    out, state, file = {}, (False, 0), None
    for r in sorted(sums.collect(), key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, state = r["file"], (False, 0)
        out[r["file"], r["start"]] = state
        state = (r["in_quoted"], state[1] + r["in_depth"]) if state[0] else (r["out_quoted"], state[1] + r["out_depth"])
    return out


HEAD, WHOLE, TAIL = 0, 1, 2


def _entries(begin: dict[tuple[str, int], tuple[bool, int]]):
    """The text of the entries of each range. A part at its beginning belongs to an earlier entry (HEAD, ``done`` if it
    ends here), one at its end goes on (TAIL)."""

    def read(batches: Batches) -> Batches:
        now, held, out = None, [], []

        def put(kind: int, done: bool) -> None:
            out.append((*now, kind, done, "".join(held)))
            held.clear()

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            out.clear()
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*_PLACE, "kind", "done", "text"])

        def leave() -> None:
            if held and (first or quoted or depth > 1):
                put(HEAD if first else TAIL, False)
            held.clear()

        first, quoted, depth = False, False, 0
        for file, start, piece in _rows(batches):
            if (file, start) != now:
                if now:
                    leave()
                now = (file, start)
                quoted, depth = begin[now]
                first = quoted or depth > 1
            if depth == 0 and not quoted:  # the object begins here, or has ended
                opening = piece.find("{")
                if opening < 0:
                    continue
                depth, piece = 1, piece[opening + 1:]
            quoted, depth = step(piece, quoted, depth)
            held.append(piece + ("}" if quoted or depth > 0 else ""))
            if not quoted and depth <= 1 and "".join(held).strip(" \t\r\n,"):
                put(HEAD if first else WHOLE, True)
                first = False
            if len(out) > 5000:
                yield made()
        if now:
            leave()
        yield made()

    return read


def read_object(spark: SparkSession, path: str, record: T.StructType, key: str = "pageid") -> DataFrame:
    """Rows of the ``{id: record}`` objects in the files at ``path``, one object a file. Ids that are no integers give a
    null ``key``; a record that is null or of another kind has null fields."""
    text = pieces(spark, path)
    begin = beginnings(text.mapInArrow(_summed, _SUMS))
    parts = text.mapInArrow(_entries(begin), "file string, start long, kind int, done boolean, text string")
    whole = parts.filter(F.col("kind") == WHOLE).select("text")
    # what crosses ranges: two parts a range at most; a TAIL and the HEADs after it are one text
    order = Window.partitionBy("file").orderBy("start", "kind")
    cut = parts.filter(F.col("kind") != WHOLE).withColumn("chain", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    chained = cut.groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "text"))).alias("parts"))
    joined = chained.select(F.array_join(F.col("parts.text"), "").alias("text"))
    body = F.concat(F.lit("{"), F.regexp_replace("text", r"^[\s,]+|[\s,]+$", ""), F.lit("}"))
    entries = whole.union(joined).select(F.explode(F.from_json(body, T.MapType(T.StringType(), record))).alias("_k", "_v"))
    return entries.select(F.col("_k").try_cast("long").alias(key), "_v.*")
