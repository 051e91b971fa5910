"""Classifiers over feature tables: one registry, one fitted form that adds probability arrays.

A training table has the feature columns, an integer label ``y`` in 0..K-1 and ``pageid``. ``fit`` returns a :class:`Fitted`, whose ``score`` adds ``p``, an array of K class
probabilities. A form says how the parts of a model make a score; ``save`` and ``load`` store the parts.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from threading import Lock
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.functions.probability import argmax, cumulative_to_class, soft_target_rows
from gradeworks.operators import bagging, boosting
from gradeworks.operators.bagging import Bag, Bagged
from gradeworks.operators.boosting import Forest, Lane
from gradeworks.operators.isotonic import curves_of
from gradeworks.schemas import K
from gradeworks.session import write_table

Score = Callable[[dict, DataFrame], DataFrame]
FORMS: dict[str, Score] = {}


@dataclass
class Fitted:
    """A trained model: its kind, its form, its inputs and its parts."""

    kind: str
    form: str
    features: list[str]
    parts: dict = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        return FORMS[self.form](self.parts, df)


Builder = Callable[[DataFrame, list[str], dict, int], Fitted]
BUILDERS: dict[str, Builder] = {}
SPACES: dict[str, Callable[[random.Random], dict]] = {}


def register(kind: str, space: Callable[[random.Random], dict] | None = None):
    """Add a learner, and optionally its search space, under ``kind``."""
    def add(builder: Builder) -> Builder:
        BUILDERS[kind] = builder
        if space:
            SPACES[kind] = space
        return builder
    return add


def load_plugins(plugins: dict[str, Callable[[], object]]) -> dict[str, str]:
    """Register drop-in learners: each entry returns an object with ``KIND`` and ``build`` (and
    maybe ``search_space``). A broken one is reported and skipped."""
    status = {}
    for name, load in plugins.items():
        try:
            module = load()
            register(module.KIND, getattr(module, "search_space", None))(module.build)
            status[name] = "ok"
        except Exception as e:  # a plug-in may fail in any way
            status[name] = f"broken: {e}"
    return status


def form(name: str):
    """Register how a form's parts score a table."""
    def add(fn: Score) -> Score:
        FORMS[name] = fn
        return fn
    return add


def settle(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose expression the optimizer will not copy into later references.

    A score is costly and read many times; as a generated column it is computed once per row, and
    filters on it stay above it.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def fit(kind: str, train: DataFrame, features: list[str], params: dict | None = None,
        seed: int = 42) -> Fitted:
    if kind not in BUILDERS:
        raise ValueError(f"unknown learner {kind}")
    return BUILDERS[kind](train, features, dict(params or {}), seed)


def _assembled(features: list[str], scale: bool = False):
    stages = [VectorAssembler(inputCols=features, outputCol="_raw_x" if scale else "_x")]
    if scale:
        stages.append(StandardScaler(inputCol="_raw_x", outputCol="_x", withMean=True, withStd=True))
    return Pipeline(stages=stages)


def _training(prepare, train: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return prepare.transform(train).select("_x", F.col("y").cast("double").alias("y"), *extra)


def _padded(prob: Column) -> Column:
    """K probabilities from a model that may have seen fewer classes."""
    arr = vector_to_array(prob)
    return F.concat(arr, F.array_repeat(F.lit(0.0), K - F.size(arr)))


def _simple(kind: str, estimator, train: DataFrame, features: list[str], scale: bool = False,
            weight: str | None = None) -> Fitted:
    """Fit one multiclass estimator and read its probability vector."""
    prepare = _assembled(features, scale).fit(train)
    data = _training(prepare, train, [weight] if weight else [])
    estimator = estimator.copy().setFeaturesCol("_x").setLabelCol("y").setProbabilityCol("_prob") \
        .setRawPredictionCol("_rawp").setPredictionCol("_pred")
    if weight:
        estimator = estimator.setWeightCol(weight)
    model = estimator.fit(data)
    return Fitted(kind, "single", features, {"model": model, "prepare": prepare})


@form("single")
def _score_single(parts: dict, df: DataFrame) -> DataFrame:
    out = settle(parts["model"].transform(parts["prepare"].transform(df)), "p", _padded(F.col("_prob")))
    return out.drop("_raw_x", "_x", "_prob", "_rawp", "_pred")


# Rounds, rates and limits of the four boosters with one role, each with a growth rule of its own.
BOOSTERS = {
    "xgboost": Lane(rounds=100, rate=0.3, growth="depth", depth=6, l2=1.0, min_weight=1.0),
    "lightgbm": Lane(rounds=100, rate=0.1, growth="leaves", leaves=31, depth=1 << 20, l2=0.0, min_rows=20),
    "catboost": Lane(rounds=1000, rate=0.1, growth="levels", depth=6, l2=3.0),
    "histgb": Lane(rounds=100, rate=0.1, growth="leaves", leaves=31, depth=1 << 20, l2=0.0, min_rows=20),
}
SCALED = Lane(rounds=200, rate=0.1, growth="depth", depth=3, l2=0.0)
ORDINAL = Lane(rounds=300, rate=0.05, growth="leaves", leaves=31, depth=1 << 20, l2=0.0, min_rows=20, thresholds=True)
CALIBRATED = replace(BOOSTERS["histgb"], rounds=300, depth=6)
TEACHER = CALIBRATED
FOLD_SEED = 42  # folds are the same for all seeds of a learner
_SETTINGS = {"iterations": "rounds", "learning_rate": "rate", "depth": "depth", "leaves": "leaves", "subsample": "sample"}


def lane_of(base: Lane, params: dict, seed: int) -> Lane:
    """``base`` with the settings that ``params`` names."""
    return replace(base, seed=seed, **{_SETTINGS[k]: v for k, v in params.items() if k in _SETTINGS})


_binned: WeakKeyDictionary = WeakKeyDictionary()
_binning = Lock()


def binned(train: DataFrame, features: Sequence[str], folds: Sequence[tuple[int, int]] = (), target: str | None = None) -> boosting.Binned:
    """The table of bins of ``train``, made once for all that fit on the same DataFrame. ``folds`` are (number, seed)."""
    key = (tuple(features), tuple(folds), target)
    with _binning:
        known = _binned.setdefault(train, {})
        edges = next((k.edges for (names, *_), k in known.items() if names == tuple(features)), None)
        if key not in known:
            df = train
            for i, (n, seed) in enumerate(folds):
                df = with_fold(df, n, seed, name=f"_fold{i}")
            known[key] = boosting.binned(df, features, K, target=target, folds=[f"_fold{i}" for i in range(len(folds))], edges=edges)
        return known[key]


def _inputs(features: Sequence[str]) -> Column:
    return F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)])


def scored_by(features: Sequence[str], made: Callable[[list[np.ndarray]], np.ndarray]) -> Column:
    """An array column: what ``made`` makes of the features' columns, row by row."""
    @F.pandas_udf("array<double>")
    def run(x: pd.DataFrame) -> pd.Series:
        return pd.Series(list(made([x[c].to_numpy(float) for c in x.columns])))
    return run(_inputs(features))


def _boosted(kind: str, train: DataFrame, features: list[str], lane: Lane) -> Fitted:
    """All classes' trees in one model; its scores go through a softmax."""
    forest = boosting.forests(binned(train, features), [lane])[0]
    return Fitted(kind, "trees", features, {"forest": forest, "columns": features})


@form("trees")
def _score_trees(parts: dict, df: DataFrame) -> DataFrame:
    return settle(df, "p", scored_by(parts["columns"], parts["forest"].probabilities))


def majority_class(train: DataFrame) -> DataFrame:
    """The most frequent label, the smallest on ties, as one row."""
    counts = train.groupBy("y").agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("y", F.struct(F.col("n"), -F.col("y"))).alias("majority"))


@register("majority")
def _majority(train, features, params, seed) -> Fitted:
    return Fitted("majority", "constant", features, {"grade": majority_class(train).first()["majority"]})


@form("constant")
def _score_constant(parts: dict, df: DataFrame) -> DataFrame:
    return df.withColumn("p", F.array(*[F.lit(1.0 if k == parts["grade"] else 0.0) for k in range(K)]))


def _log_uniform(rng: random.Random, lo: float, hi: float) -> float:
    return lo * (hi / lo) ** rng.random()


ROWS_A_TASK = 1 << 15  # fixed value: fewer rows than that are not worth a task of an iteration

_logregs: WeakKeyDictionary = WeakKeyDictionary()
_asking = Lock()


@register("logreg", lambda r: {"C": _log_uniform(r, 0.01, 100)})
def _logreg(train, features, params, seed) -> Fitted:
    """The fit starts from zeros and draws nothing, so seeds share it, as do all who fit the same DataFrame side by side."""
    key = (tuple(features), str(sorted(params.items())))
    with _asking:
        known = _logregs.setdefault(train, {})
        mine = key not in known
        fitted = known.setdefault(key, Future())
    if mine:
        try:
            fitted.set_result(_logreg_fit(train, features, params))
        except BaseException as e:
            known.pop(key).set_exception(e)
            raise
    return fitted.result()


def _logreg_fit(train: DataFrame, features: list[str], params: dict) -> Fitted:
    # the penalty of a per-row mean loss: 1 / (C * n)
    n = params.get("n_rows") or train.count()
    train = train.coalesce(max(1, -(-n // ROWS_A_TASK)))  # hundreds of short jobs: what a task costs is paid in each
    est = LogisticRegression(family="multinomial", maxIter=params.get("max_iter", 2000),
                             regParam=1.0 / (params.get("C", 1.0) * max(n, 1)), standardization=False)
    return _simple("logreg", est, train, features, scale=True)


def _rate(rng: random.Random, lo: float = 0.01) -> float:
    return _log_uniform(rng, lo, 0.3)


_BOOSTER_SPACES = {
    "xgboost": lambda r: {"depth": r.randint(3, 10), "learning_rate": _rate(r), "iterations": r.randint(100, 800), "subsample": r.uniform(0.5, 1.0)},
    "lightgbm": lambda r: {"leaves": r.randint(15, 255), "learning_rate": _rate(r), "iterations": r.randint(100, 800)},
    "catboost": lambda r: {"depth": r.randint(4, 10), "learning_rate": _rate(r), "iterations": r.randint(100, 800)},
    "histgb": lambda r: {"depth": r.randint(3, 10), "learning_rate": _rate(r), "iterations": r.randint(100, 600)},
}


def _register_booster(kind: str, base: Lane) -> None:
    @register(kind, _BOOSTER_SPACES[kind])
    def build(train, features, params, seed) -> Fitted:
        return _boosted(kind, train, features, lane_of(base, params, seed))


for _kind, _lane in BOOSTERS.items():
    _register_booster(_kind, _lane)


@register("scaled_gbt", lambda r: {"iterations": r.randint(100, 600), "depth": r.randint(2, 6), "learning_rate": _rate(r)})
def _scaled_gbt(train, features, params, seed) -> Fitted:
    """A booster behind a scaler; bins follow the order of values, so scaling changes nothing and is left out."""
    return _boosted("scaled_gbt", train, features, lane_of(SCALED, params, seed))


def bag_of(params: dict, seed: int) -> Bag:
    return Bag(trees=params.get("trees", 100), depth=min(params.get("depth", 10), 30), min_leaf=params.get("min_leaf", 1), seed=seed)


@register("random_forest", lambda r: {"trees": r.randint(200, 800), "depth": r.randint(5, 30),
                                      "min_leaf": r.randint(1, 10)})
def _random_forest(train, features, params, seed) -> Fitted:
    """Trees dealt to tasks; Spark's own forest for weighted rows and for tables beyond what a task may hold."""
    if not params.get("weight"):
        table = binned(train, features)
        if table.n_blocks <= boosting.WHOLE_BLOCKS:
            return Fitted("random_forest", "trees", features, {"forest": bagging.bagged(table, [bag_of(params, seed)])[0], "columns": features})
    est = RandomForestClassifier(numTrees=params.get("trees", 100), maxDepth=min(params.get("depth", 10), 30),
                                 minInstancesPerNode=params.get("min_leaf", 1), seed=seed,
                                 checkpointInterval=-1, cacheNodeIds=True)
    return _simple("random_forest", est, train, features, weight=params.get("weight"))


@register("mlp", lambda r: {"width": r.choice([64, 128, 256]), "layers": r.randint(2, 3)})
def _mlp(train, features, params, seed) -> Fitted:
    layers = [len(features)] + [params.get("width", 64)] * params.get("layers", 2) + [K]
    est = MultilayerPerceptronClassifier(layers=layers, maxIter=params.get("max_iter", 400), seed=seed)
    return _simple("mlp", est, train, features, scale=True)


def with_fold(df: DataFrame, folds: int, seed: int, key: str = "pageid", name: str = "_fold") -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds)).cast("int"))


def _held_out(df: DataFrame, features: list[str], folds: int, forests: Sequence[Forest | Bagged]) -> DataFrame:
    """``p`` of each row from the forest that left its fold (``_fold``) out."""
    def made(columns: list[np.ndarray]) -> np.ndarray:
        fold, x = columns[-1], columns[:-1]
        out = np.zeros((len(fold), K))
        for i in range(folds):
            mine = fold == i
            if mine.any():
                out[mine] = forests[i].probabilities([c[mine] for c in x])
        return out
    return settle(df, "p", scored_by([*features, "_fold"], made))


@register("calibrated_gbt", lambda r: {"depth": r.randint(3, 10), "iterations": r.randint(100, 500), "learning_rate": _rate(r, 0.02)})
def _calibrated(train, features, params, seed) -> Fitted:
    """Per fold: a booster on the other folds, one isotonic curve per grade on the fold. The folds' calibrated
    probabilities are averaged."""
    folds = params.get("folds", 3)
    table = binned(train, features, [(folds, FOLD_SEED)])
    forests = boosting.forests(table, [replace(lane_of(CALIBRATED, params, seed), held=(0, i)) for i in range(folds)])
    held = _held_out(with_fold(train, folds, FOLD_SEED), features, folds, forests).select("_fold", "y", F.posexplode("p").alias("k", "v"))
    points = held.select((F.col("_fold") * K + F.col("k")).alias("curve"), "v", (F.col("y") == F.col("k")).cast("double").alias("t"))
    curves = curves_of(points, "curve", "v", "t")
    return Fitted("calibrated_gbt", "calibrated", features, {
        "folds": folds, "columns": features, "curves": [curves.get(c, [[0.0], [0.0]]) for c in range(folds * K)],
        **{f"forest{i}": f for i, f in enumerate(forests)}})


@form("calibrated")
def _score_calibrated(parts: dict, df: DataFrame) -> DataFrame:
    folds, curves = parts["folds"], [np.array(c) for c in parts["curves"]]
    forests = [parts[f"forest{i}"] for i in range(folds)]

    def made(columns: list[np.ndarray]) -> np.ndarray:
        total = 0.0
        for i, forest in enumerate(forests):
            p = forest.probabilities(columns)
            q = np.stack([np.interp(p[:, k], *curves[i * K + k]) for k in range(K)], axis=1)
            sums = q.sum(axis=1, keepdims=True)
            total = total + np.where(sums > 0, q / np.where(sums > 0, sums, 1.0), 1.0 / K)
        return total / folds
    return settle(df, "p", scored_by(parts["columns"], made))


@register("ordinal_cumulative", lambda r: {"leaves": r.randint(15, 127), "learning_rate": _rate(r, 0.02), "iterations": r.randint(100, 600)})
def _ordinal(train, features, params, seed) -> Fitted:
    """One output per ``y > k``, recombined into class probabilities."""
    forest = boosting.forests(binned(train, features), [lane_of(ORDINAL, params, seed)])[0]
    return Fitted("ordinal_cumulative", "cumulative", features, {"forest": forest, "columns": features})


@form("cumulative")
def _score_cumulative(parts: dict, df: DataFrame) -> DataFrame:
    out = settle(df, "_gt", scored_by(parts["columns"], parts["forest"].probabilities))
    return settle(out, "p", cumulative_to_class(F.col("_gt"))).drop("_gt")


# The settings of the stacked learners.
STACK_BASES = {"xgboost": {"iterations": 300, "depth": 6, "learning_rate": 0.1, "subsample": 0.9}, "lightgbm": {"iterations": 300, "leaves": 63},
               "histgb": {"iterations": 300}, "random_forest": {"trees": 400, "min_leaf": 2}}


@register("stacking", lambda r: {"meta_C": _log_uniform(r, 0.05, 10)})
def _stacking(train, features, params, seed) -> Fitted:
    """Base learners give out-of-fold probabilities; a logistic meta learner combines them.

    The boosters of all folds and of the whole table are lanes of one training; so are the random forests.
    """
    folds, bases = params.get("folds", 5), params.get("bases", STACK_BASES)
    table = binned(train, features, [(folds, FOLD_SEED)])
    boosters = [b for b in bases if b in BOOSTERS]
    bagged = [b for b in bases if b == "random_forest" and table.n_blocks <= boosting.WHOLE_BLOCKS]
    others = [b for b in bases if b not in [*boosters, *bagged]]
    folded = with_fold(train, folds, FOLD_SEED)
    lanes = [replace(lane_of(BOOSTERS[b], bases[b], seed), held=None if i == folds else (0, i)) for b in boosters for i in range(folds + 1)]
    bags = [replace(bag_of(bases[b], seed), held=None if i == folds else (0, i)) for b in bagged for i in range(folds + 1)]
    with ThreadPoolExecutor(2 + (folds + 1) * len(others)) as pool:
        grown = pool.submit(lambda: boosting.forests(table, lanes))
        drawn = pool.submit(lambda: bagging.bagged(table, bags) if bags else [])
        rest = {(b, i): pool.submit(fit, b, train if i == folds else folded.filter(F.col("_fold") != i), features, bases[b], seed)
                for b in others for i in range(folds + 1)}
        forests, models = [*grown.result(), *drawn.result()], {k: v.result() for k, v in rest.items()}
    by_base = {b: forests[n * (folds + 1):(n + 1) * (folds + 1)] for n, b in enumerate([*boosters, *bagged])}

    def one_base(df: DataFrame, b: str) -> DataFrame:
        if b in by_base:
            scored = _held_out(df, features, folds, by_base[b][:folds])
        else:
            parts = [models[b, i].score(df.filter(F.col("_fold") == i)) for i in range(folds)]
            scored = parts[0]
            for part in parts[1:]:
                scored = scored.unionByName(part)
            scored = write_table(scored, "stacked")
        return scored.select(*df.columns, *[F.get("p", F.lit(k)).alias(f"m_{b}_{k}") for k in range(K)])

    stacked = folded.select("pageid", "y", "_fold", *features)
    for b in [*others, *boosters, *bagged]:
        stacked = one_base(stacked, b)
    meta_cols = [f"m_{b}_{k}" for b in bases for k in range(K)]
    stacked = write_table(stacked.select("pageid", "y", *meta_cols), "stacked")  # the meta learner reads it many times
    meta = fit("logreg", stacked, meta_cols, {"C": params.get("meta_C", 1.0)}, seed)
    full = {f"base_{b}": models[b, folds] if b in others else Fitted(b, "trees", features, {"forest": by_base[b][folds], "columns": features}) for b in bases}
    return Fitted("stacking", "stacked", features, {"bases": list(bases), "meta": meta, **full})


@form("stacked")
def _score_stacked(parts: dict, df: DataFrame) -> DataFrame:
    out = df
    for name in parts["bases"]:
        model = parts[f"base_{name}"]
        out = model.score(out).select(*out.columns, *[F.get("p", F.lit(k)).alias(f"m_{name}_{k}") for k in range(K)])
    return parts["meta"].score(out).select(*df.columns, "p")


@register("distilled", lambda r: {"trees": r.randint(20, 60), "depth": r.randint(2, 5),
                                  "alpha": 0.3 + 0.6 * r.random()})
def _distilled(train, features, params, seed) -> Fitted:
    """A strong booster teaches a small forest through weighted soft-target rows."""
    teacher = _boosted("histgb", train, features, lane_of(TEACHER, params.get("teacher", {}), seed))
    soft = teacher.score(train)
    rows = write_table(soft_target_rows(soft, "p", "y", params.get("alpha", 0.7)).select(
        *features, F.col("target").alias("y"), "weight"), "soft-targets")
    student = fit("random_forest", rows, features,
                  {"trees": params.get("trees", 40), "depth": params.get("depth", 4), "weight": "weight"}, seed)
    student.kind = "distilled"
    student.parts["teacher"] = teacher
    return student


def fidelity(student: Fitted, df: DataFrame) -> DataFrame:
    """Share of rows where student and teacher agree on the grade."""
    taught = student.parts["teacher"].score(df).withColumn("_t", argmax(F.col("p"))).drop("p")
    both = student.score(taught)
    return both.agg(F.count("*").alias("n"), F.avg((argmax(F.col("p")) == F.col("_t")).cast("double")).alias("fidelity"))


def save(fitted: Fitted, path: str, spark: SparkSession) -> None:
    """Store a model under ``path``: its parts as saved Spark models, the rest as one JSON line."""
    plain, kept = {}, {}
    for name, part in fitted.parts.items():
        if name == "teacher":
            continue  # only needed to measure the student
        if isinstance(part, Fitted):
            save(part, f"{path}/{name}", spark)
            kept[name] = "fitted"
        elif isinstance(part, (Forest, Bagged)):
            part.save(spark, f"{path}/{name}")
            kept[name] = "forest" if isinstance(part, Forest) else "bagged"
        elif isinstance(part, Model):
            PipelineModel(stages=[part]).write().save(f"{path}/{name}")
            kept[name] = "model"
        else:
            plain[name] = part
    about = {"kind": fitted.kind, "form": fitted.form, "features": fitted.features, "plain": plain, "kept": kept}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")


def load(path: str, spark: SparkSession) -> Fitted:
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    parts = dict(about["plain"])
    for name, how in about["kept"].items():
        if how == "fitted":
            parts[name] = load(f"{path}/{name}", spark)
        elif how == "forest":
            parts[name] = Forest.load(spark, f"{path}/{name}")
        elif how == "bagged":
            parts[name] = Bagged.load(spark, f"{path}/{name}")
        else:
            parts[name] = PipelineModel.load(f"{path}/{name}").stages[0]
    return Fitted(about["kind"], about["form"], about["features"], parts)
