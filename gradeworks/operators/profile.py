"""Feature profiling against the ordered grade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeworks.operators.ranking import (cumulative_counts, exact_quantiles, rank_columns, running_sums, spearman,
                                          weighted_corr)
from gradeworks.schemas import GRADES, K, grade_rank
from gradeworks.session import write_table

TOP_N = 12
MI_BINS = 20
TREE_DEPTH = 3
LEAK_ACCURACY = 0.80
# What must not turn up as a feature or in clean text.
FORBIDDEN = ["talk_page", "assessment", "featured article", "good article", "grade"]


def long_features(df: DataFrame, features: list[str], carry: list[str] = ("label", "grade_rank")) -> DataFrame:
    """One row per (row, feature); NaN becomes null."""
    wide = df.select(*carry, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
                               for c in features])
    return wide.unpivot(list(carry), features, "feature", "value")


def feature_stats(df: DataFrame, features: list[str], **kw) -> DataFrame:
    """Per (feature, grade): count, mean, deviation, deciles 1, 5 and 9, missing share.

    Moments and missing share are one partial aggregate; the quantiles come from value counts.
    """
    long = long_features(df, features, ["label"]).withColumnRenamed("label", "grade")
    keys = ["feature", "grade"]
    moments = long.groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.avg(F.col("value").isNull().cast("int")).alias("missing"))
    quant = exact_quantiles(long, keys, "value", {"p10": 0.10, "p50": 0.50, "p90": 0.90}, **kw)
    return moments.join(quant, on=keys, how="left")


def medians(df: DataFrame, features: list[str], **kw) -> DataFrame:
    """Exact median per feature over present values."""
    return exact_quantiles(long_features(df, features, []), ["feature"], "value", {"median": 0.5}, **kw)


def median_map(df: DataFrame, features: list[str], **kw) -> dict[str, float]:
    """The medians as a driver-side dict: one number per feature, 0 where all are missing."""
    got = {r["feature"]: r["median"] for r in medians(df, features, **kw).collect()}
    return {f: float(got.get(f) or 0.0) for f in features}


def median_impute(df: DataFrame, features: list[str], **kw) -> DataFrame:
    """Missing values become the feature's median, or 0 if the feature is missing throughout."""
    med = median_map(df, features, **kw)
    filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(med[c]))
              for c in features}
    return df.withColumns(filled)


def mutual_information(df: DataFrame, features: list[str], bins: int = MI_BINS, **kw) -> DataFrame:
    """MI in nats between an equal-frequency binned feature and the grade. Equal values share a bin."""
    filled = median_impute(df, features, **kw)
    long = long_features(filled, features, ["grade_rank"])
    by_value = long.groupBy("feature", "value", "grade_rank").agg(F.count("*").alias("w"))
    places = cumulative_counts(long, ["feature"], "value", **kw).select(
        "feature", "value", F.floor(bins * F.col("before") / F.col("total")).alias("bin"))
    joint = (by_value.join(places, on=["feature", "value"])
             .groupBy("feature", "bin", "grade_rank").agg(F.sum("w").alias("n")))
    return mi_from_counts(joint, ["feature"], "bin", "grade_rank")


def mi_from_counts(joint: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """MI from joint counts. A group holds one row per (bin, grade), so its margins are windows
    over a bounded group."""
    def margin(*by: str) -> Column:
        return F.sum("n").over(Window.partitionBy(*keys, *by)).cast("double")
    cells = joint.select(*keys, F.col("n").cast("double").alias("n"), margin(x).alias("_x"),
                         margin(y).alias("_y"), margin().alias("_t"))
    term = F.col("n") / F.col("_t") * F.log(F.col("n") * F.col("_t") / (F.col("_x") * F.col("_y")))
    return cells.groupBy(*keys).agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"))


def spearman_label(df: DataFrame, features: list[str], **kw) -> DataFrame:
    long = long_features(df, features, ["grade_rank"])
    return spearman(long, ["feature"], "value", "grade_rank", **kw).select("feature", "spearman")


def missing_fraction(df: DataFrame, features: list[str]) -> DataFrame:
    long = long_features(df, features, [])
    return long.groupBy("feature").agg(F.avg(F.col("value").isNull().cast("int")).alias("missing_frac"))


def best_cuts(counts: DataFrame, keys: list[str], classes: list[str], **kw) -> DataFrame:
    """Per group the cut between two values that leaves the least Gini impurity, of equals the most even one, then the
    lowest, from class counts per distinct value. Groups of one class or one value have none."""
    sums = running_sums(counts, keys, "value", classes, **kw)

    def purity(part) -> Column:
        squares = reduce(lambda a, b: a + b, [part(c) * part(c) for c in classes])
        return squares.cast("double") / reduce(lambda a, b: a + b, [part(c) for c in classes])
    left, every = (lambda c: F.col(f"upto_{c}")), (lambda c: F.col(f"all_{c}"))
    total = reduce(lambda a, b: a + b, [every(c) for c in classes])
    mixed = reduce(lambda a, b: a & b, [every(c) != total for c in classes])
    rest = reduce(lambda a, b: a + b, [every(c) - left(c) for c in classes])
    cut = sums.filter(mixed & (rest > 0)).withColumn("_s", purity(left) + purity(lambda c: every(c) - left(c)))
    return cut.groupBy(*keys).agg(F.max_by("value", F.struct(F.col("_s"), -F.abs(total - 2 * rest), -F.col("value"))).alias("cut"))


def single_feature_accuracy(df: DataFrame, features: list[str], depth: int = TREE_DEPTH, **kw) -> DataFrame:
    """Training accuracy of the Gini tree of depth 3 that sees one feature only.

    All features' trees grow together, level by level, from class counts per distinct value.
    """
    filled = median_impute(df, features, **kw)
    classes = [f"n{k}" for k in range(K)]
    counts = long_features(filled, features, ["grade_rank"]).groupBy("feature", "value").agg(
        *[F.count_if(F.col("grade_rank") == k).alias(c) for k, c in enumerate(classes)])
    nodes = write_table(counts.withColumn("node", F.lit(0).cast("long")), "single-feature")
    for level in range(depth):
        cuts = best_cuts(nodes, ["feature", "node"], classes, **kw)  # 2 ** level rows for each feature
        side = F.coalesce((F.col("value") > F.col("cut")).cast("long"), F.lit(0))
        nodes = write_table(nodes.join(F.broadcast(cuts), ["feature", "node"], "left").withColumn(
            "node", F.col("node") * 2 + side).drop("cut"), f"single-feature-{level}")
    leaves = nodes.groupBy("feature", "node").agg(*[F.sum(c).alias(c) for c in classes])
    best, total = F.greatest(*[F.col(c) for c in classes]), reduce(lambda a, b: a + b, [F.col(c) for c in classes])
    return leaves.groupBy("feature").agg((F.sum(best).cast("double") / F.sum(total)).alias("single_feature_acc"))


def leakage_suspects(accuracy: DataFrame, threshold: float = LEAK_ACCURACY) -> DataFrame:
    return accuracy.filter(F.col("single_feature_acc") >= threshold)


def feature_summary(df: DataFrame, features: list[str], with_accuracy: bool = True, **kw) -> DataFrame:
    """One row per feature: MI, Spearman with the grade, missing share, single-feature accuracy."""
    out = (mutual_information(df, features, **kw)
           .join(spearman_label(df, features, **kw), on="feature", how="left")
           .join(missing_fraction(df, features), on="feature"))
    if with_accuracy:
        out = out.join(single_feature_accuracy(df, features, **kw), on="feature")
    return out


def summary_top(summary: DataFrame, n: int = TOP_N) -> DataFrame:
    return summary.orderBy(F.col("mi").desc(), "feature").limit(n)


def class_balance(df: DataFrame) -> DataFrame:
    """Rows per grade in grade order, zero for an absent grade."""
    counts = df.agg(*[F.count_if(F.col("label") == g).alias(g) for g in GRADES])
    long = counts.unpivot([], GRADES, "grade", "n")
    return long.withColumn("grade_rank", grade_rank(F.col("grade")))


def corr_matrix(df: DataFrame, features: list[str], **kw) -> DataFrame:
    """Spearman matrix in long form over pairwise complete rows, 3 decimals.

    Complete features: ranks go back to the rows one feature at a time and all pairs are sums of
    one aggregate. Pairs with a feature that has gaps are ranked again over their complete rows.
    """
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    gaps = wide.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in features]).first()
    full = [c for c in features if gaps[c] == 0]
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    dense = [(a, b) for a, b in pairs if a in full and b in full]
    sparse = [p for p in pairs if p not in dense]
    parts = []
    if dense:
        ranked = rank_columns(wide.select(*full), full, **kw)
        sums = ranked.withColumn("_w", F.lit(1)).agg(
            *[weighted_corr(f"_r_{a}", f"_r_{b}", "_w").alias(f"{a}|{b}") for a, b in dense])
        parts.append(sums.unpivot([], [f"{a}|{b}" for a, b in dense], "pair", "spearman"))
    if sparse:
        both = F.array(*[F.struct(F.lit(f"{a}|{b}").alias("pair"), F.col(a).alias("_x"), F.col(b).alias("_y"))
                         for a, b in sparse])
        again = wide.select(F.inline(F.filter(both, lambda s: s["_x"].isNotNull() & s["_y"].isNotNull())))
        names = wide.sparkSession.createDataFrame([(f"{a}|{b}",) for a, b in sparse], "pair string")
        found = spearman(again, ["pair"], "_x", "_y", **kw).select("pair", "spearman")
        parts.append(names.join(found, on="pair", how="left"))
    ends = wide.agg(*[(F.min(c) < F.max(c)).alias(c) for c in features]).unpivot(
        [], features, "x", "varies")
    upper = reduce(DataFrame.unionByName, parts).select(
        F.substring_index("pair", "|", 1).alias("x"), F.substring_index("pair", "|", -1).alias("y"),
        F.round("spearman", 3).alias("spearman"))
    diagonal = ends.select("x", F.col("x").alias("y"), F.when(F.col("varies"), 1.0).alias("spearman"))
    mirrored = upper.select(F.col("y").alias("x"), F.col("x").alias("y"), "spearman")
    return upper.unionByName(mirrored).unionByName(diagonal)


def median_by_grade(df: DataFrame, features: list[str], **kw) -> DataFrame:
    long = long_features(df, features, ["label"]).withColumnRenamed("label", "grade")
    return exact_quantiles(long, ["feature", "grade"], "value", {"median": 0.5}, **kw)


def notes_summary(df: DataFrame, summary: DataFrame) -> DataFrame:
    """Row and grade counts, rows per grade in grade order, the three strongest features and the worst
    missingness, as one row."""
    counts = df.groupBy("grade_rank", "label").agg(F.count("*").alias("n"))  # one row per grade
    line = F.concat("label", F.lit(": "), F.col("n").cast("string"))
    each = F.sort_array(F.collect_list(F.struct("grade_rank", line.alias("t"))))
    rows = counts.agg(F.sum("n").alias("rows"), F.count_distinct("label").alias("grades"),
                      F.array_join(F.transform(each, lambda g: g["t"]), ", ").alias("per_grade"))
    # the summary has one row per feature
    place = F.struct(-F.col("mi"), F.col("feature"))
    feats = summary.agg(
        F.array_join(F.slice(F.transform(F.sort_array(F.collect_list(place)), lambda s: s["feature"]), 1, 3),
                     ", ").alias("top3"),
        F.min_by("feature", F.struct(-F.col("missing_frac"), F.col("feature"))).alias("worst_missing"),
        F.max("missing_frac").alias("worst_missing_frac"))
    return rows.withColumn("_k", F.lit(1)).join(feats.withColumn("_k", F.lit(1)), on="_k").drop("_k")


def leak_check(clean: DataFrame, features: list[str], forbidden: list[str] = FORBIDDEN) -> DataFrame:
    """Per forbidden phrase: feature columns named after it and clean texts that contain it."""
    low = F.lower("clean_text")
    counts = clean.agg(*[F.count_if(low.contains("{{" + w)).alias(w) for w in forbidden])
    long = counts.unpivot([], forbidden, "phrase", "texts")
    hits = F.lit(0).cast("long")
    for w in forbidden:
        n = sum(w.replace(" ", "_") in f.lower() for f in features)
        hits = F.when(F.col("phrase") == w, F.lit(n).cast("long")).otherwise(hits)
    return long.withColumn("columns", hits)
