"""Small pieces in, memory back out: Arrow functions for rows that hold whole texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import pyarrow as pa

from gradeworks.session import setting

if TYPE_CHECKING:
    from pyspark.sql import SparkSession

PIECE_BYTES = 4 << 20
_BATCH_BYTES, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

Batches = Iterator[pa.RecordBatch]


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand rows to Python in batches of PIECE_BYTES at most, unless the session has a size of its own."""
    if setting(spark, _BATCH_BYTES) == _SPARKS_OWN:
        spark.conf.set(_BATCH_BYTES, str(PIECE_BYTES))


def pieces(batches: Batches, most: int = PIECE_BYTES) -> Batches:
    """The rows of ``batches`` in slices of about ``most`` bytes, one row at least."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def give_back() -> None:
    """Return what this worker no longer uses to the machine; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def lean(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``work`` on small slices of its input, giving memory back at its end."""
    def run(batches: Batches) -> Batches:
        try:
            yield from work(pieces(batches))
        finally:
            give_back()

    return run
