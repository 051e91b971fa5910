"""Staleness: how far the model's opinion lies from the recorded grade, and what goes with it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.functions.probability import expected_distance
from gradeworks.operators.ranking import rank_columns, row_numbers, spearman, weighted_corr
from gradeworks.session import write_table

PROXIES = ["age_days", "days_since_edit", "edits_90d", "edits"]
MIN_GRADE_AGES = 30
BUCKET_ROWS = 20


def with_distance(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    return df.withColumn("d", expected_distance(F.col(p), F.col(y)))


def proxy_correlations(df: DataFrame, proxies: Sequence[str] = PROXIES, **kw) -> DataFrame:
    """Spearman of the distance with each proxy; a missing proxy counts as 0."""
    wide = df.select("d", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in proxies])
    ranked = rank_columns(wide, ["d", *proxies], **kw).withColumn("_w", F.lit(1))
    sums = ranked.agg(F.count("*").alias("n"), *[weighted_corr("_r_d", f"_r_{c}", "_w").alias(c) for c in proxies])
    return sums.unpivot(["n"], list(proxies), "proxy", "spearman")


def grade_age(df: DataFrame, dates: DataFrame, as_of: Column) -> DataFrame:
    """Whole days since the recovered grade date; null where none was found."""
    days = F.floor((as_of.cast("double") - F.col("grade_ts").cast("double")) / 86400)
    return df.join(dates.select("pageid", "grade_ts"), on="pageid", how="left").withColumn(
        "grade_age_days", days)


def grade_age_correlation(df: DataFrame, **kw) -> DataFrame:
    """Spearman of distance and grade age; null unless more than 30 pages have an age."""
    out = spearman(df.select("d", "grade_age_days"), [], "d", "grade_age_days", **kw)
    return out.withColumn("spearman", F.when(F.col("n") > MIN_GRADE_AGES, F.col("spearman")))


def partial_spearman(df: DataFrame, x: str = "d", z: str = "days_since_edit", given: str = "age_days",
                     key: str = "pageid", **kw) -> DataFrame:
    """Spearman of the residuals of rank(x) and rank(z) on rank(given); ties broken by key.

    The distinct ranks make both lines least-squares fits over known sums, taken in one aggregate.
    """
    ranked = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                              for c in (x, z, given)])
    for c in (x, z, given):
        ranked = row_numbers(ranked, [], c, key, number=f"_r_{c}", total="_n", **kw).drop("_n")
    a, b, c = (F.col(f"_r_{v}").cast("double") for v in (x, z, given))
    ranked = write_table(ranked.select(key, a.alias("a"), b.alias("b"), c.alias("c")), "partial-ranks")
    line = ranked.agg(F.regr_slope("a", "c").alias("sa"), F.regr_intercept("a", "c").alias("ia"),
                      F.regr_slope("b", "c").alias("sb"), F.regr_intercept("b", "c").alias("ib"))
    both = ranked.withColumn("_k", F.lit(1)).join(F.broadcast(line.withColumn("_k", F.lit(1))), on="_k")
    resid = both.select(F.round(F.col("a") - F.col("sa") * F.col("c") - F.col("ia"), 6).alias("ra"),
                        F.round(F.col("b") - F.col("sb") * F.col("c") - F.col("ib"), 6).alias("rb"))
    return spearman(resid, [], "ra", "rb", **kw)


def review_buckets(df: DataFrame, key: str = "pageid", rows: int = BUCKET_ROWS, **kw) -> DataFrame:
    """The highest, middle and lowest rows by distance, ties by key; needs three times ``rows`` rows.

    The ends are top-k sorts; for the middle only the ranges around it are numbered.
    """
    high = df.orderBy(F.col("d").desc(), key).limit(rows).withColumn("bucket", F.lit("high"))
    low = df.orderBy("d", F.col(key).desc()).limit(rows).withColumn("bucket", F.lit("low"))
    before = F.floor(F.col("_n") / 2) - rows // 2
    mid = row_numbers(df.withColumn("_neg", -F.col("d")), [], "_neg", key, number="_rn", total="_n",
                      only=(before + 1, before + rows), **kw)
    mid = mid.select(*df.columns).withColumn("bucket", F.lit("mid"))
    return high.unionByName(mid).unionByName(low).withColumn("d", F.round("d", 3))


def preferred_model(models: DataFrame, selected: str) -> DataFrame:
    """The ordinal model if trained, else the selected arm, else the first by name."""
    rank = F.when(F.col("kind") == "ordinal_cumulative", 0).when(F.col("kind") == selected, 1).otherwise(2)
    return models.agg(F.min_by("kind", F.struct(rank.alias("r"), F.col("kind"))).alias("kind"))


def one_sided_p(rho: float, n: int) -> float:
    """Half the two-sided p of a Spearman correlation, whatever its sign (t approximation)."""
    if n < 3 or abs(rho) >= 1:
        return 0.0 if abs(rho) >= 1 else float("nan")
    df = n - 2
    t2 = rho * rho * df / (1 - rho * rho)
    return _reg_beta(df / (df + t2), df / 2, 0.5) / 2


def _reg_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _reg_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * total


def with_p_values(corr: DataFrame) -> DataFrame:
    """Add the one-sided p to a table of correlations (one row per proxy)."""
    rows = corr.collect()
    schema = corr.schema.add("p_one_sided", "double")
    made = [(*r, None if r["spearman"] is None else round(one_sided_p(r["spearman"], r["n"]), 5))
            for r in rows]
    return corr.sparkSession.createDataFrame(made, schema)
