"""Search, selection and training loops; every loop runs over configs, never over rows."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.functions.probability import argmax, expected_distance, expected_grade, expected_index, expected_round
from gradeworks.operators import boosting
from gradeworks.operators.boosting import Forest
from gradeworks.operators.learners import BOOSTERS, SPACES, Fitted, binned, fit, lane_of, save
from gradeworks.operators.metrics import accuracy, macro_f1, qwk
from gradeworks.operators.ranking import row_numbers
from gradeworks.schemas import grade_name

# Model ladder, training seeds, sample sizes per grade, margin of the second rung.
RUNGS = {"rung0": ["majority", "logreg"],
         "rung1": ["xgboost", "lightgbm", "catboost", "histgb", "random_forest"],
         "rung2": ["mlp"]}
SEEDS = [7, 42, 1337]
LEVELS = [25, 50, 75, 100, 125]
RUNG2_MARGIN = 0.01
RUN_SCHEMA = ("kind string, seed int, params string, n long, val_macro_f1 double, val_acc double, "
              "val_qwk_argmax double, val_qwk_regress_round double, val_macro_f1_regress_round double, "
              "wall_s double")


MEASURES = ["val_macro_f1", "val_acc", "val_qwk_argmax", "val_qwk_regress_round", "val_macro_f1_regress_round"]


def _measures(y: Column, a: Column, r: Column) -> list[Column]:
    found = [macro_f1(y, a), accuracy(y, a), qwk(y, a), qwk(y, r), macro_f1(y, r)]
    return [f.alias(name) for name, f in zip(MEASURES, found, strict=True)]


def validation_row(fitted: Fitted, valid: DataFrame):
    """Both decision rules on a labelled table, as one aggregated row."""
    scored = fitted.score(valid).select("y", argmax(F.col("p")).alias("a"), expected_round(F.col("p")).alias("r"))
    return scored.agg(F.count("*").alias("n"), *_measures(F.col("y"), F.col("a"), F.col("r"))).first()


def fit_score(kind: str, train: DataFrame, valid: DataFrame, features: list[str],
              params: dict | None = None, seed: int = 42) -> tuple[Fitted, dict]:
    """Fit, validate and time one setting."""
    start = time.monotonic()
    fitted = fit(kind, train, features, params, seed)
    row = validation_row(fitted, valid).asDict()
    return fitted, {"kind": kind, "seed": seed, "params": str(sorted((params or {}).items())), **row,
                    "wall_s": round(time.monotonic() - start, 2)}


def runs_frame(spark, runs: Sequence[dict], extra: Sequence[str] = ()) -> DataFrame:
    """Runs as a table, one row per fit; ``extra`` names further text fields."""
    schema = ", ".join([RUN_SCHEMA, *[f"{c} string" for c in extra]])
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in runs], schema)


TRIALS = 5  # fixed value: settings tried by a search
HALVING_RUNGS = (0.25, 0.5, 1.0)


def drawn_settings(kind: str, trials: int = TRIALS, seed: int = 42) -> list[dict]:
    """The settings that a search tries, drawn from the kind's space."""
    rng = random.Random(seed)
    space = SPACES.get(kind, lambda r: {})
    return [space(rng) for _ in range(trials)]


def param_search(kind: str, train: DataFrame, valid: DataFrame, features: list[str], trials: int = TRIALS,
                 seed: int = 42, parallelism: int = 4, halving: bool = True) -> tuple[dict, list[dict]]:
    """Seeded random search on a fixed validation table.

    Boosters are searched by successive halving: the trials share the table of bins and are compared on all validation
    rows after a quarter and half of their rounds; the better half goes on from its own trees. ``halving=False``
    gives every trial all of its rounds. Other kinds always try all settings in full.
    """
    tried = drawn_settings(kind, trials, seed)
    if kind in BOOSTERS:
        runs = boosted_trials(kind, tried, train, valid, features, seed, HALVING_RUNGS if halving else (1.0,))
    else:
        with ThreadPoolExecutor(parallelism) as pool:
            runs = list(pool.map(lambda p: fit_score(kind, train, valid, features, p, seed)[1], tried))
    best = max(range(trials), key=lambda i: (runs[i]["share"] if "share" in runs[i] else 1.0, runs[i]["val_macro_f1"], -i))
    return tried[best], runs


def boosted_trials(kind: str, tried: list[dict], train: DataFrame, valid: DataFrame, features: list[str], seed: int,
                   rungs: Sequence[float]) -> list[dict]:
    """A run per trial as of the last rung that it reached (``share`` of its rounds)."""
    start = time.monotonic()
    table = binned(train, features)
    lanes = [lane_of(BOOSTERS[kind], p, seed) for p in tried]
    forests: dict[int, Forest] = {}
    runs: list[dict] = [{} for _ in tried]
    live = list(range(len(tried)))
    for share in rungs:
        cut = [replace(lanes[i], rounds=max(1, math.ceil(lanes[i].rounds * share))) for i in live]
        grown = boosting.train(table, cut, [forests[i] for i in live] if forests else None)
        forests = dict(zip(live, grown, strict=True))
        found = validation_rows({i: Fitted(kind, "trees", features, {"forest": f, "columns": features}) for i, f in forests.items()}, valid)
        for i in live:
            runs[i] = {"kind": kind, "seed": seed, "params": str(sorted(tried[i].items())), **found[i], "share": share,
                       "wall_s": round(time.monotonic() - start, 2)}
        ranked = sorted(live, key=lambda i: (-runs[i]["val_macro_f1"], i))
        live = sorted(ranked[:max(1, -(-len(live) // 2))])
    return runs


def validation_rows(models: dict[int, Fitted], valid: DataFrame) -> dict[int, dict]:
    """Both decision rules for several models, one pass over the rows."""
    scored = valid
    for i, m in models.items():
        scored = m.score(scored).withColumn(f"_a{i}", argmax(F.col("p"))).withColumn(f"_r{i}", expected_round(F.col("p"))).drop("p")
    each = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"_a{i}").alias("_a"), F.col(f"_r{i}").alias("_r")) for i in models])
    rows = scored.select("y", F.inline(each)).groupBy("_i").agg(F.count("*").alias("n"), *_measures(F.col("y"), F.col("_a"), F.col("_r"))).collect()
    found = {r["_i"]: {"n": r["n"], **{name: r[name] for name in MEASURES}} for r in rows}
    return {i: found.get(i, {"n": 0, **dict.fromkeys(MEASURES)}) for i in models}  # no rows, no groups


def select_best(candidates: DataFrame, margin: float = RUNG2_MARGIN) -> DataFrame:
    """Best kind per rung by macro-F1 to 3 decimals, then speed; the overall arm is rung 2 only if
    it leads rung 1 by ``margin``."""
    place = F.struct(F.round("val_macro_f1", 3).alias("f"), (-F.col("wall_s")).alias("w"), F.col("kind"))
    per_rung = candidates.groupBy("rung").agg(F.max_by("kind", place).alias("kind"),
                                              F.max("val_macro_f1").alias("best_f1"))
    def of(rung: str, c: str):
        return F.max(F.when(F.col("rung") == rung, F.col(c)))
    arm = per_rung.agg(F.when(F.coalesce(of("rung2", "best_f1"), F.lit(0.0))
                              >= F.coalesce(of("rung1", "best_f1"), F.lit(0.0)) + margin, of("rung2", "kind"))
                       .otherwise(of("rung1", "kind")).alias("kind"))
    return per_rung.select("rung", "kind").unionByName(arm.select(F.lit("overall").alias("rung"), "kind"))


def tune(train: DataFrame, valid: DataFrame, features: list[str], rungs: dict[str, list[str]] = RUNGS) -> tuple[dict[str, dict], str]:
    """Settings by kind, from each kind's own search (the first rung keeps its own), and the best arm."""
    def one(job: tuple[str, str]) -> tuple[dict, tuple]:
        rung, kind = job
        if rung == "rung0":
            best, runs = {}, [fit_score(kind, train, valid, features)[1]]
        else:
            best, runs = param_search(kind, train, valid, features)
        chosen = max((r for r in runs if r.get("share", 1.0) == 1.0), key=lambda r: r["val_macro_f1"])
        return best, (rung, kind, chosen["val_macro_f1"], chosen["wall_s"])

    binned(train, features)  # made once, before the searches start side by side
    jobs = [(rung, kind) for rung, kinds in rungs.items() for kind in kinds]
    with ThreadPoolExecutor(len(jobs)) as pool:
        done = list(pool.map(one, jobs))
    settings = {kind: best for (_, kind), (best, _) in zip(jobs, done, strict=True)}
    candidates = train.sparkSession.createDataFrame([row for _, row in done], "rung string, kind string, val_macro_f1 double, wall_s double")
    return settings, select_best(candidates).filter("rung = 'overall'").first()["kind"]


def train_all(train: DataFrame, valid: DataFrame, features: list[str], configs: dict[str, tuple],
              seeds: Sequence[int] = SEEDS, parallelism: int = 4, save_to: str | None = None) -> DataFrame:
    """Every config with every seed; the result is a runs table. A config is (kind, settings) and
    maybe its own feature list. With ``save_to`` the models are stored by config and seed."""
    jobs = [(name, *c, s) for name, c in configs.items() for s in seeds]

    def one(job) -> dict:
        name, kind, params, *own, s = job
        fitted, row = fit_score(kind, train, valid, own[0] if own else features, params, s)
        if save_to:
            save(fitted, f"{save_to}/{name}_s{s}", train.sparkSession)
        return {**row, "config": name}

    with ThreadPoolExecutor(parallelism) as pool:
        runs = list(pool.map(one, jobs))
    return runs_frame(train.sparkSession, runs, ["config"])


def nested_sample(train: DataFrame, seed: int, label: str = "y", key: str = "pageid") -> DataFrame:
    """Add ``_rn``: the row's place in its label's seeded order, so smaller samples nest in larger."""
    prefix = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8)
    hashed = train.withColumn("_h", F.conv(prefix, 16, 10).cast("long"))
    return row_numbers(hashed, [label], "_h", key, number="_rn", total="_n").drop("_h", "_n")


def learning_curve(train: DataFrame, valid: DataFrame, test: DataFrame, features: list[str], kind: str,
                   levels: Sequence[int], seeds: Sequence[int], params: dict | None = None) -> DataFrame:
    """Scores per sample size and seed on fixed validation and test tables."""
    def one(job) -> tuple:
        seed, n = job
        part = nested_sample(train, seed).filter(F.col("_rn") <= n).drop("_rn")
        fitted, row = fit_score(kind, part, valid, features, params, seed)
        on_test = validation_row(fitted, test)
        return (n, seed, part.count(), row["val_macro_f1"], on_test["val_macro_f1"], on_test["val_qwk_argmax"], row["wall_s"])

    with ThreadPoolExecutor(4) as pool:
        rows = list(pool.map(one, [(s, n) for s in seeds for n in levels]))
    return train.sparkSession.createDataFrame(
        rows, "n_per_grade int, seed int, n_train long, val_macro_f1 double, test_macro_f1 double, test_qwk double, wall_s double")


def curve_bands(runs: DataFrame) -> DataFrame:
    """Mean and population deviation of the scores per sample size."""
    return runs.groupBy("n_per_grade").agg(
        F.count("*").alias("seeds"), F.avg("test_macro_f1").alias("mean_f1"),
        F.stddev_pop("test_macro_f1").alias("sd_f1"), F.avg("val_macro_f1").alias("mean_val_f1"))


def score_with(models: dict[str, Fitted], df: DataFrame) -> DataFrame:
    """The rows scored by every model, stacked under ``config``: one read, a column per model, then one row per column."""
    keep = df.columns
    wide = df
    for i, model in enumerate(models.values()):
        wide = model.score(wide).withColumnRenamed("p", f"_p{i}").select(*keep, *[f"_p{j}" for j in range(i + 1)])
    each = F.array(*[F.struct(F.lit(name).alias("config"), F.col(f"_p{i}").alias("p")) for i, name in enumerate(models)])
    return wide.select(*keep, F.inline(each))


def batch_score(models: dict[str, Fitted], df: DataFrame, grade: str = "y") -> DataFrame:
    """Opinion of every model on every row: probabilities, grade, expected grade, staleness."""
    p = F.col("p")
    return score_with(models, df).select(
        "pageid", "config", F.transform(p, lambda v: F.round(v, 4)).alias("probs"),
        grade_name(argmax(p)).alias("argmax"), expected_grade(p).alias("expected_grade"),
        F.round(expected_index(p), 2).alias("expected_index"),
        F.round(expected_distance(p, F.col(grade)), 3).alias("staleness"))
