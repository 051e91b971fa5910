"""Model explanations as one scoring pass over an expanded table.

Each expansion multiplies the rows by the number of features, steps or repeats, all fixed by the
model; the expanded rows are scored once and reduced by conditional sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeworks.functions.probability import argmax
from gradeworks.operators.learners import Fitted
from gradeworks.operators.metrics import macro_f1
from gradeworks.operators.ranking import row_numbers, spearman, top_per_group
from gradeworks.session import write_table

TOP_FEATURES = 15
LOCAL_TOP = 8
PER_GRADE_TOP = 5
UNMAPPED = "unmapped"
# The quality criterion each feature speaks to.
CRITERIA = {
    "ref_n": "FA 1c well-researched: citations",
    "refs_per_1k_words": "FA 1c citation density",
    "bytes": "FA 1b comprehensive: length proxy",
    "words": "FA 1b comprehensive",
    "sections_l2": "FA 2b structure",
    "images": "FA 3 media",
    "wikilinks": "B1 linking",
    "cleanup_tags": "B4 grammar/cleanup (inverse)",
    "edits": "history: attention",
    "editors": "history: many eyes",
    "age_days": "history: maturity",
    "views_90d_log": "demand-side salience (not a criterion)",
}


def _replaced(features: Sequence[str], other: dict[str, Column], take: dict[str, Column]) -> list[Column]:
    """Features where ``take`` holds come from ``other``."""
    return [F.when(take[c], other[c]).otherwise(F.col(c)).alias(c) for c in features]


def permutation_importance(model: Fitted, df: DataFrame, features: list[str], repeats: int = 1,
                           seed: int = 42) -> DataFrame:
    """Drop of macro-F1 when one feature is taken from another row.

    The other row is the next one in a seeded hash order (the last wraps to the first): one join on
    row numbers per repeat serves all features.
    """
    base = df.select("pageid", "y", *features)
    parts = []
    for r in range(repeats):
        order = F.xxhash64(F.lit(seed + r), F.col("pageid"))
        numbered = write_table(row_numbers(base.withColumn("_h", order), [], "_h", "pageid",
                                           number="_rn", total="_n").drop("_h"), "permuted")
        donor = numbered.select(F.col("_rn").alias("_next"), *[F.col(c).alias(f"_d_{c}") for c in features])
        parts.append(numbered.withColumn("_next", F.col("_rn") % F.col("_n") + 1)
                     .join(donor, on="_next").withColumn("repeat", F.lit(r)))
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    names = F.array(F.lit(""), *[F.lit(c) for c in features])  # '' keeps the row as it is
    expanded = joined.withColumn("feature", F.explode(names))
    swapped = expanded.select("y", "repeat", "feature", *_replaced(
        features, {c: F.col(f"_d_{c}") for c in features}, {c: F.col("feature") == c for c in features}))
    scored = model.score(swapped).withColumn("pred", argmax(F.col("p")))
    f1 = scored.groupBy("repeat", "feature").agg(macro_f1(F.col("y"), F.col("pred")).alias("f1"))
    whole = f1.filter(F.col("feature") == "").select("repeat", F.col("f1").alias("base"))
    return (f1.filter(F.col("feature") != "").join(whole, on="repeat")
            .groupBy("feature").agg(F.avg(F.col("base") - F.col("f1")).alias("importance")))


def tree_importance(model: Fitted, spark) -> DataFrame:
    """Impurity importance of a forest; for boosters the mean share of the gain over their outputs."""
    shares = model.parts["forest"].importance().mean(axis=0) if "forest" in model.parts else model.parts["model"].featureImportances
    rows = [(c, float(shares[i])) for i, c in enumerate(model.features)]
    return spark.createDataFrame(rows, "feature string, importance double")


def rank_features(importance: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def stability(importance: DataFrame, **kw) -> DataFrame:
    """Mean Spearman of the importance vectors of all seed pairs; 1 with a single seed.

    One row per (seed, feature) is model-sized, so the pairs are seeds times seeds times features.
    """
    left = importance.select(F.col("seed").alias("a"), "feature", F.col("importance").alias("x"))
    right = importance.select(F.col("seed").alias("b"), "feature", F.col("importance").alias("y"))
    pairs = left.join(right, on="feature").filter(F.col("a") < F.col("b"))
    per_pair = spearman(pairs, ["a", "b"], "x", "y", **kw)
    return per_pair.agg(F.count("*").alias("pairs"), F.coalesce(F.avg("spearman"), F.lit(1.0)).alias("mean_spearman"))


def ablation_curve(model: Fitted, df: DataFrame, order: list[str], medians: dict[str, float],
                   insert: bool = False) -> DataFrame:
    """Macro-F1 per step as the top features turn into medians one after another; with ``insert``
    all start as medians and return one by one."""
    features = model.features
    place = {c: order.index(c) + 1 for c in features}
    steps = df.select("y", *features, F.explode(F.sequence(F.lit(0), F.lit(len(order)))).alias("step"))
    med = {c: F.lit(float(medians[c])) for c in features}
    take = {c: (F.col("step") < place[c]) if insert else (F.col("step") >= place[c]) for c in features}
    scored = model.score(steps.select("y", "step", *_replaced(features, med, take)))
    return scored.groupBy("step").agg(F.round(macro_f1(F.col("y"), argmax(F.col("p"))), 4).alias("macro_f1"))


def curve_auc(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area divided by the number of points; a curve has one row per model feature."""
    w = Window.partitionBy(*keys, F.lit(0)).orderBy("step")
    area = (F.col("macro_f1") + F.lag("macro_f1").over(w)) / 2
    return curve.withColumn("_a", area).groupBy(*keys).agg((F.sum("_a") / F.count("*")).alias("auc"))


def per_grade_top(model: Fitted, spark, n: int = PER_GRADE_TOP) -> DataFrame:
    """The strongest features of each grade's own trees."""
    rows = [(k, c, float(v)) for k, shares in enumerate(model.parts["forest"].importance())
            for c, v in zip(model.features, shares, strict=True)]
    table = spark.createDataFrame(rows, "grade_rank int, feature string, importance double")
    return top_per_group(table, ["grade_rank"], [F.col("importance").desc(), F.col("feature")], n,
                         spread=F.col("feature"))


def local_attribution(model: Fitted, df: DataFrame, medians: dict[str, float],
                      top: int = LOCAL_TOP) -> DataFrame:
    """Per row: the features whose median would change the predicted grade's probability most."""
    features = model.features
    predicted = model.score(df.select("pageid", *features))
    predicted = predicted.select("pageid", *features, argmax(F.col("p")).alias("k"), F.array_max("p").alias("_top"))
    names = F.array(*[F.lit(c) for c in features])
    expanded = predicted.withColumn("feature", F.explode(names))
    value = F.get(F.array(*[F.col(c) for c in features]), (F.array_position(names, F.col("feature")) - 1).cast("int"))
    med = {c: F.lit(float(medians[c])) for c in features}
    swapped = expanded.withColumn("value", value).select(
        "pageid", "k", "_top", "feature", "value",
        *_replaced(features, med, {c: F.col("feature") == c for c in features}))
    effects = model.score(swapped).select("pageid", "k", "feature", "value",
                                          (F.col("_top") - F.get("p", F.col("k"))).alias("effect"))
    # a page has exactly one row per feature, so its list is as long as the model is wide
    entry = F.struct((-F.abs("effect")).alias("s"), "feature", "value", "effect")
    best = effects.groupBy("pageid", "k").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, top).alias("_e"))
    return best.select("pageid", F.col("k").alias("pred"), F.posexplode("_e").alias("_i", "_x")).select(
        "pageid", "pred", (F.col("_i") + 1).alias("rank"), "_x.feature", "_x.value",
        F.round("_x.effect", 3).alias("effect"))


def plausibility(ranked: DataFrame, criteria: dict[str, str] = CRITERIA) -> DataFrame:
    """The criterion behind each feature, a default where there is none."""
    table = ranked.sparkSession.createDataFrame(list(criteria.items()), "feature string, criterion string")
    joined = ranked.join(F.broadcast(table), on="feature", how="left")
    return joined.withColumn("criterion", F.coalesce("criterion", F.lit(UNMAPPED)))
