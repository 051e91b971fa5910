"""Training sequences by shortest-pack-first packing over the histogram of piece lengths.

A document is its token ids and a closing id. Whole stretches of ``limit`` ids are sequences by
themselves; the rest of each document is one piece. Pieces are placed by length only: from the longest
length down, all pieces of a length go at once into the emptiest open packs that hold them, which
updates the counts of packing patterns. The patterns (bounded by the limit, not by the corpus) then give
each piece its sequence and offset by its rank among pieces of its length.

Defined results: a null or empty text is the closing id alone; repeated rows and null ids are documents
like all others; among pieces of one length the order is by hash cell and id, arbitrary for equal ids; an
empty table gives an empty table. Only ``key`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.lean import lean
from gradeworks.llm.numbering import number_rows
from gradeworks.llm.tokens import VOCABULARY, encoder
from gradeworks.session import write_table

LIMIT = 2048
CLOSING_ID = 1
_SHIFT = 44


def spread_lengths(histogram: dict[int, int], limit: int) -> list[tuple[int, list[int]]]:
    """Packing patterns as (number of packs, lengths in order) by shortest pack first."""
    open_packs: list[list[tuple[int, list[int]]]] = [[] for _ in range(limit + 1)]  # by remaining space
    closed: list[tuple[int, list[int]]] = []

    def put(count: int, lengths: list[int], space: int) -> None:
        if space:
            open_packs[space].append((count, lengths))
        else:
            closed.append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left, space = histogram[length], limit
        made = []
        while left:
            while space >= length and not open_packs[space]:
                space -= 1
            if space < length:
                made.append((left, [length], limit - length))
                break
            count, lengths = open_packs[space].pop()
            used = min(count, left)
            if count > used:
                open_packs[space].append((count - used, lengths))
            made.append((used, [*lengths, length], space - length))
            left -= used
        for pattern in made:
            put(*pattern)
    return closed + [p for packs in open_packs for p in packs]


def slots(patterns: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """For each run of ranks of a length: the first rank, the first sequence and the offset there."""
    rows, ranks, sequence = [], {}, 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            first = ranks.get(length, 0)
            rows.append((length, first, sequence, offset))
            ranks[length] = first + count
            offset += length
        sequence += count
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"], dtype="int64")


def _pieces(limit: int, closing: int, vocabulary: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            out = []
            for row, text in enumerate(batch.column("body").to_pylist()):
                ids = encode(text)
                ids.append(closing)
                raw = np.asarray(ids, dtype="<u4")
                for start in range(0, len(raw), limit):
                    piece = raw[start:start + limit]
                    out.append((row, start, len(piece), zlib.crc32(piece.tobytes()), len(raw)))
            made = np.array(out, dtype="int64").reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(made[0])), *map(pa.array, made[1:])],
                names=["key", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


def _placer(table: pd.DataFrame):
    table = table.sort_values(["length", "first"])
    marks = (table["length"].to_numpy() << _SHIFT) | table["first"].to_numpy()
    first, sequence, offset = (table[c].to_numpy() for c in ("first", "sequence", "offset"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(marks, (batch.column("length").to_numpy() << _SHIFT) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT,
         closing: int = CLOSING_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """Key, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset`` of
    every piece; the ids of a piece are those of its document from ``start`` on."""
    kind = docs.schema[key].dataType.simpleString()
    columns = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = write_table(docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body")).mapInArrow(
        lean(_pieces(limit, closing, vocabulary)), columns), "pack-pieces")
    counts = pieces.groupBy("length").agg(F.count("*").alias("group_rows"))  # at most ``limit`` rows
    histogram = {r["length"]: r["group_rows"] for r in counts.collect()}
    table = slots(spread_lengths(histogram, limit))
    ranked = number_rows(pieces, "length", "key", counts)
    ranked = ranked.select("key", "start", "length", "ids_crc32", "doc_tokens", "rank")
    placed = ranked.mapInArrow(_placer(table), columns + ", sequence_id long, offset long")
    return placed.withColumnRenamed("key", key)
