"""Result shaping shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def tidy(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns (all by default) with integers widened and doubles rounded."""
    out = []
    for c in columns or df.columns:
        kind = df.schema[c].dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            out.append(F.col(c).cast("long").alias(c))
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(c).cast("double"), DIGITS).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
