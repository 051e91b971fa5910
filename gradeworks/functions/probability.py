"""Decision rules over a probability array of one entry per grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.schemas import K, grade_name


def _dot_index(p: Column, weight) -> Column:
    weighted = F.zip_with(p, F.sequence(F.lit(0), F.size(p) - 1), lambda v, k: v * weight(k))
    return F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v)


def argmax(p: Column) -> Column:
    """Index of the largest entry, the first one on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def expected_index(p: Column) -> Column:
    return _dot_index(p, lambda k: k.cast("double"))


def expected_round(p: Column) -> Column:
    """Expected grade rounded half to even and kept inside the scale."""
    return F.least(F.lit(K - 1), F.greatest(F.lit(0), F.rint(expected_index(p)).cast("int")))


def expected_grade(p: Column) -> Column:
    return grade_name(expected_round(p))


def confidence(p: Column) -> Column:
    return F.array_max(p)


def softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    return normalise(shifted)


def normalise(weights: Column) -> Column:
    total = F.aggregate(weights, F.lit(0.0), lambda a, v: a + v)
    return F.transform(weights, lambda v: v / total)


def cumulative_to_class(gt: Column, floor: float = 1e-9) -> Column:
    """Class probabilities from P(y > k), k ascending: running minimum, adjacent differences,
    a small floor, then a normalisation."""
    mono = F.transform(F.sequence(F.lit(1), F.size(gt)), lambda i: F.array_min(F.slice(gt, F.lit(1), i)))
    upper = F.concat(F.array(F.lit(1.0)), mono)
    lower = F.concat(mono, F.array(F.lit(0.0)))
    return normalise(F.zip_with(upper, lower, lambda a, b: F.greatest(a - b, F.lit(floor))))


def soft_target_rows(df: DataFrame, p: str, y: str, alpha: float = 0.7, floor: float = 1e-3,
                     label: str = "target", weight: str = "weight") -> DataFrame:
    """One row per (example, class), weighted by a blend of soft and one-hot targets."""
    blend = F.lit(alpha) * F.col("_soft") + F.when(F.col(label) == F.col(y), 1 - alpha).otherwise(0.0)
    return (
        df.select("*", F.posexplode(p).alias(label, "_soft"))
        .withColumn(weight, blend).drop("_soft").filter(F.col(weight) > floor)
    )


def expected_distance(p: Column, y: Column) -> Column:
    """Expected distance in grades between the model's opinion and the recorded grade."""
    return _dot_index(p, lambda k: F.abs(k - y))
