"""Gapless numbers inside groups, with hot groups split into cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CELL = 256


def number_rows(rows: DataFrame, group: str, order: str, sizes: DataFrame, rank: str = "rank",
                rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """``rows`` with ``rank`` 0, 1, ... inside each ``group``.

    ``sizes`` (group, group_rows) must have a bound of its own, as it is broadcast. A group is cut into
    cells of about ``rows_per_cell`` rows by the hash of ``order``; a window sees one cell at a time, and
    only cell counts (one row per cell) are added up per group. Rows that agree in ``order`` get
    different numbers in an arbitrary order.
    """
    cells = F.greatest(F.lit(1), F.ceil(F.col("group_rows") / rows_per_cell)).cast("long")
    split = rows.join(F.broadcast(sizes), group).withColumn("cell", F.pmod(F.xxhash64(order), cells)).drop("group_rows")
    before = Window.partitionBy(group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = split.groupBy(group, "cell").count().select(
        group, "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy(group, "cell").orderBy(order)) - 1
    return split.withColumn(rank, inside).join(bases, [group, "cell"]).withColumn(
        rank, (F.col(rank) + F.col("base")).cast("long")).drop("cell", "base")
