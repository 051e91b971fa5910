"""Registered queries: learners, selection, text arm and model explanations.

Learners run with the package's own settings on the whole training partition; searches, folds, seeds and levels
are those of the operators.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

from pyspark.sql import functions as F

from gradeworks.functions.probability import argmax
from gradeworks.operators import explain, learners, metrics, portable, selection, staleness, text_models
from gradeworks.operators.corpus import grade_dates
from gradeworks.operators.profile import median_map
from gradeworks.plans import bindings as b
from gradeworks.plans.assembly import scratch
from gradeworks.plans.registry import query
from gradeworks.plans.shape import tidy
from gradeworks.plans.twin_sql import twin
from gradeworks.schemas import FEATURES, GRADES, HISTORY_LIKE
from gradeworks.session import input_state, staged
from gradeworks.plans.evaluation import ACC, MACRO, WITHIN

_fitted: dict = {}
_partitions: dict = {}


def part(spark, sf, split: str):
    """A partition of the model table, the same DataFrame for all fits on one state of the input."""
    key = (spark.sparkContext.applicationId, sf, input_state(spark, sf), split)
    if key not in _partitions:
        _partitions[key] = b.part_of(spark, sf, split)
    return _partitions[key]


def model(spark, sf, kind: str, params: dict | None = None, seed: int = 42) -> learners.Fitted:
    """A learner fitted on the training partition, kept for the session and state of the input."""
    key = (spark.sparkContext.applicationId, sf, input_state(spark, sf), kind, str(params), seed)
    if key not in _fitted:
        _fitted[key] = learners.fit(kind, part(spark, sf, "train"), FEATURES, params, seed)
    return _fitted[key]


def _scored(spark, sf, fitted: learners.Fitted):
    test = part(spark, sf, "test")
    return fitted.score(test).select("pageid", "y", "p", "temporal_holdout")


def _learner(name: str, kind: str) -> None:
    @query(name)
    def run(spark, sf):
        df = _scored(spark, sf, model(spark, sf, kind)).withColumn("config", F.lit(kind))
        return tidy(metrics.results_table(df))


@query("M1_majority", twin("""SELECT pageid, (SELECT CAST(grade_rank AS BIGINT) FROM splits WHERE split = 'train' GROUP BY grade_rank ORDER BY count(*) DESC, grade_rank LIMIT 1) AS pred
    FROM splits WHERE split = 'test'""", "splits"))
def majority(spark, sf):
    return tidy(_scored(spark, sf, model(spark, sf, "majority")).select("pageid", argmax(F.col("p")).alias("pred")))


_learner("M2_logreg", "logreg")
for _kind in learners.BOOSTERS:
    _learner(f"M3_boosted_{_kind}", _kind)
_learner("M4_random_forest", "random_forest")
_learner("M5_mlp", "mlp")
_learner("M6_calibrated_gbt", "calibrated_gbt")
_learner("M7_scaled_gbt", "scaled_gbt")
_learner("M8_ordinal_cumulative", "ordinal_cumulative")
_learner("M9_stacking", "stacking")


@query("M10_distilled")
def distilled(spark, sf):
    student = model(spark, sf, "distilled")
    return tidy(learners.fidelity(student, part(spark, sf, "test")))


@query("M11_portable_scorer")
def portable_scorer(spark, sf):
    student = model(spark, sf, "distilled")
    column = portable.forest_column(portable.export_nodes(student, spark), FEATURES)
    return tidy(portable.verify(student, column, part(spark, sf, "test")))


@query("M12_plugin_registry")
def plugin_registry(spark, sf):
    """Two drop-in learners, one of them broken; the working one is trained and measured."""
    def broken():
        raise ImportError("no such learner")
    plugin = SimpleNamespace(KIND="two_level", build=lambda train, cols, params, seed: learners.BUILDERS["random_forest"](
        train, cols, {"depth": 2, **params}, seed))
    status = learners.load_plugins({"two_level": lambda: plugin, "absent": broken})
    rows = spark.createDataFrame(list(status.items()), "plugin string, status string").withColumn("_k", F.lit(1))
    scored = _scored(spark, sf, model(spark, sf, "two_level")).withColumn("pred", argmax(F.col("p")))
    acc = metrics.all_metrics(scored).select("acc", F.lit(1).alias("_k"))
    return tidy(rows.join(acc, on="_k").withColumn("acc", F.when(F.col("status") == "ok", F.col("acc"))).drop("_k"))


@query("M13_param_search")
def param_search(spark, sf):
    train, valid = part(spark, sf, "train"), part(spark, sf, "val")
    _, runs = selection.param_search("random_forest", train, valid, FEATURES)
    return tidy(selection.runs_frame(spark, runs).drop("wall_s"))


@query("M14_fit_score")
def fit_score(spark, sf):
    """One setting, fitted and validated; the time it took is in the run, but not in the result."""
    train, valid = part(spark, sf, "train"), part(spark, sf, "val")
    _, row = selection.fit_score("random_forest", train, valid, FEATURES)
    return tidy(selection.runs_frame(spark, [row]).drop("wall_s"))


@query("M15_select_best", twin("""SELECT rung, kind FROM (SELECT rung, kind, row_number() OVER (PARTITION BY rung ORDER BY round(val_macro_f1, 3) DESC, wall_s, kind DESC) AS rn FROM candidates) WHERE rn = 1
    UNION ALL SELECT 'overall', (SELECT kind FROM candidates WHERE rung = CASE WHEN (SELECT max(val_macro_f1) FROM candidates WHERE rung = 'rung2') >= (SELECT max(val_macro_f1) FROM candidates WHERE rung = 'rung1') + 0.01
    THEN 'rung2' ELSE 'rung1' END ORDER BY round(val_macro_f1, 3) DESC, wall_s, kind DESC LIMIT 1)""", "candidates"))
def select_best(spark, sf):
    return selection.select_best(b.candidates(spark, sf))


CONFIGS = {"rung0_majority": "majority", "rung0_logreg": "logreg", "rung1_xgboost": "xgboost", "rung1_lightgbm": "lightgbm",
           "rung1_catboost": "catboost", "rung1_histgb": "histgb", "rung1_rf": "random_forest", "rung2_mlp": "mlp",
           "custom_calibrated_gbt": "calibrated_gbt", "custom_gboost_demo": "scaled_gbt", "custom_ordinal_coral": "ordinal_cumulative",
           "custom_stack_meta": "stacking", "custom_wikilite": "distilled"}


@query("M16_train_all")
def train_all(spark, sf):
    """Every config with the settings its own search chose; the best arm once more without the history features."""
    train, valid = part(spark, sf, "train"), part(spark, sf, "val")
    settings, best = selection.tune(train, valid, FEATURES)
    configs = {name: (kind, settings.get(kind, {})) for name, kind in CONFIGS.items()}
    configs["metadata_noH"] = (best, settings[best], [c for c in FEATURES if c not in HISTORY_LIKE])
    return tidy(selection.train_all(train, valid, FEATURES, configs).drop("wall_s", "params"))


@query("M17_train_one")
def train_one(spark, sf):
    """A search on one config, then a refit with the chosen settings."""
    train, valid = part(spark, sf, "train"), part(spark, sf, "val")
    best, _ = selection.param_search("random_forest", train, valid, FEATURES)
    runs = selection.train_all(train, valid, FEATURES, {"rung1_rf": ("random_forest", best)})
    return tidy(runs.drop("wall_s"))


def _texts(spark, sf):
    rows = b.model_table(spark, sf).select("pageid", "y", "split")
    bodies = b.articles(spark, sf).select("pageid", "wikitext", "categories")
    return rows.join(bodies, on="pageid", how="inner")


def _windows(spark, sf):
    """The token windows of :func:`_texts`, cut where the texts are read: no text is joined, and the fit and the scores read windows."""
    def build():
        rows = b.model_table(spark, sf).select("pageid", "y", "split")
        cut = text_models.with_window(b.texts(spark, sf), "wikitext").select("pageid", "n_chars", text_models.WINDOW)
        return rows.join(b.graded(spark, sf, cut).select("pageid", text_models.WINDOW), on="pageid", how="inner")
    return staged(spark, sf, "windows", build)


def _text_model(spark, sf) -> learners.Fitted:
    key = (spark.sparkContext.applicationId, sf, input_state(spark, sf), "text")
    if key not in _fitted:
        train = _windows(spark, sf).filter(F.col("split") == "train")
        _fitted[key] = text_models.fit_text(train, "wikitext")
    return _fitted[key]


def _logits(spark, sf):
    return staged(spark, sf, "logits", lambda: text_models.logits_table(_text_model(spark, sf).score(_windows(spark, sf))))


@query("M18_text_arm")
def text_arm(spark, sf):
    return tidy(_logits(spark, sf))


@query("M19_fusion")
def fusion(spark, sf):
    fused, cols = text_models.fuse(b.model_table(spark, sf), _logits(spark, sf), HISTORY_LIKE)
    fitted = text_models.fit_fusion(fused, cols)
    return tidy(text_models.prediction_table(fitted.score(fused.filter(F.col("split") == "test"))))


@query("M20_learning_curve")
def learning_curve(spark, sf):
    parts = [part(spark, sf, s) for s in ("train", "val", "test")]
    return tidy(selection.learning_curve(*parts, FEATURES, "random_forest", selection.LEVELS, selection.SEEDS).drop("wall_s"))


@query("M20_sample_sizes", twin(f"""SELECT CAST(seed AS BIGINT) AS seed, CAST(level AS BIGINT) AS n_per_grade, CAST((SELECT sum(least(c, level)) FROM (
    SELECT count(*) AS c FROM splits WHERE split = 'train' GROUP BY grade_rank)) AS BIGINT) AS n_train
    FROM (SELECT unnest({selection.SEEDS}) AS seed), (SELECT unnest({selection.LEVELS}) AS level)""", "splits"))
def sample_sizes(spark, sf):
    """Rows of the nested samples that the learning curve is fitted on."""
    out = None
    for seed in selection.SEEDS:
        placed = selection.nested_sample(part(spark, sf, "train"), seed)
        each = F.explode(F.array(*[F.lit(n).cast("long") for n in selection.LEVELS])).alias("n_per_grade")
        one = placed.select("_rn", each).filter(F.col("_rn") <= F.col("n_per_grade")).groupBy("n_per_grade").agg(F.count("*").alias("n_train"))
        one = one.select(F.lit(seed).cast("long").alias("seed"), "n_per_grade", "n_train")
        out = one if out is None else out.unionByName(one)
    return out


@query("M13_halving")
def halving(spark, sf):
    """A booster's search by halving: how far each setting went and how it did there."""
    _, runs = selection.param_search("xgboost", part(spark, sf, "train"), part(spark, sf, "val"), FEATURES)
    shares = spark.createDataFrame([(r["params"], r["share"]) for r in runs], "params string, share double")
    return tidy(selection.runs_frame(spark, runs).drop("wall_s").join(shares, on="params"))


@query("M20_curve_bands", """SELECT CAST(label AS BIGINT) AS n_per_grade, count(*) AS seeds, round(avg(CAST(embedding[1] AS DOUBLE)), 6) + 0 AS mean_f1,
    round(stddev_pop(CAST(embedding[1] AS DOUBLE)), 6) AS sd_f1, round(avg(CAST(embedding[2] AS DOUBLE)), 6) + 0 AS mean_val_f1 FROM embeddings GROUP BY label""")
def curve_bands(spark, sf):
    runs = b.table(spark, sf, "embeddings").select(
        F.col("label").alias("n_per_grade"), F.element_at("embedding", 1).cast("double").alias("test_macro_f1"),
        F.element_at("embedding", 2).cast("double").alias("val_macro_f1"))
    return tidy(selection.curve_bands(runs))


@query("M21_leak_ablation")
def leak_ablation(spark, sf):
    fitted = _text_model(spark, sf)
    on_text = learners.Fitted("text", "text", ["text"], {**fitted.parts, "text": "text"})
    return tidy(text_models.leak_ablation(on_text, _texts(spark, sf).filter(F.col("split") == "test")))


def stored_models(spark, sf) -> dict[str, learners.Fitted]:
    """The model of every config, fitted side by side, stored once per state of the input and loaded again."""
    key = (spark.sparkContext.applicationId, sf, input_state(spark, sf), "store")
    if key not in _fitted:
        store = scratch(spark, "models")
        learners.binned(part(spark, sf, "train"), FEATURES)  # shared by all

        def one(item) -> None:
            learners.save(model(spark, sf, item[1]), f"{store}/{item[0]}", spark)
        with ThreadPoolExecutor(len(CONFIGS)) as pool:
            list(pool.map(one, CONFIGS.items()))
        _fitted[key] = {name: learners.load(f"{store}/{name}", spark) for name in CONFIGS}
    return _fitted[key]


@query("M22_batch_score")
def batch_score(spark, sf):
    """The model of every config is stored, loaded again and scores the test partition."""
    out = selection.batch_score(stored_models(spark, sf), part(spark, sf, "test"))
    return out.withColumn("probs", F.array_join(F.transform("probs", lambda v: v.cast("string")), "|"))


def _test_scores(spark, sf):
    """Every stored model's opinion on the test partition, one pass."""
    return staged(spark, sf, "test-scores", lambda: selection.score_with(stored_models(spark, sf), part(spark, sf, "test").select(
        "pageid", "y", "temporal_holdout", *FEATURES)).select("pageid", "y", "temporal_holdout", "config", "p"))


@query("V14_model_results")
def model_results(spark, sf):
    """Metric row of every stored model with its interval and the family of its features; timings are V16's."""
    scored = _test_scores(spark, sf)
    ci = metrics.bootstrap_ci(scored.withColumn("pred", argmax(F.col("p"))), by=["config"]).filter("metric = 'macro_f1'")
    rows = metrics.results_table(scored).withColumn("family", F.lit("metadata"))
    return tidy(rows.join(ci.select("config", "ci_lo", "ci_hi"), on="config"))


def _costs(spark, sf):
    return metrics.model_costs(stored_models(spark, sf), part(spark, sf, "test"))


@query("V15_model_headline")
def model_headline(spark, sf):
    """Score against cost of every stored model."""
    return metrics.headline(metrics.results_table(_test_scores(spark, sf)).join(_costs(spark, sf), on="config"))


@query("V16_throughput")
def throughput(spark, sf):
    """Seconds per 1000 test rows of every stored model: by the clock and summed over tasks."""
    return _costs(spark, sf)


def _model_opinions(spark, sf):
    """Validation and test rows with the distance of the ordinal model's opinion."""
    def build():
        rows = b.model_table(spark, sf).filter("split <> 'train'").select("pageid", "y", *FEATURES)
        return staleness.with_distance(model(spark, sf, "ordinal_cumulative").score(rows)).drop("p")
    return staged(spark, sf, "model-opinions", build)


@query("K1_model_staleness")
def model_staleness(spark, sf):
    return tidy(_model_opinions(spark, sf).select("pageid", "y", "d"))


@query("K2_model_proxies")
def model_proxies(spark, sf):
    return tidy(staleness.proxy_correlations(_model_opinions(spark, sf)))


@query("K3_model_grade_age")
def model_grade_age(spark, sf):
    dates = grade_dates(b.talk_texts(spark, sf), F.lit("GA")).select("page_id", "grade_ts")
    rows = _model_opinions(spark, sf).withColumn("page_id", b.page_of(spark, sf, "pageid"))
    dated = rows.join(dates, on="page_id", how="left").select("pageid", "grade_ts")
    return tidy(staleness.grade_age_correlation(staleness.grade_age(rows.drop("page_id"), dated, b.as_of())))


@query("K4_model_partial")
def model_partial(spark, sf):
    return tidy(staleness.partial_spearman(_model_opinions(spark, sf)))


@query("K5_model_review")
def model_review(spark, sf):
    return tidy(staleness.review_buckets(_model_opinions(spark, sf).select("pageid", "y", "d")))


@query("M23_external_model_compare", twin(f"""SELECT count(*) AS n, round({MACRO}, 6) AS macro_f1, round({WITHIN}, 6) AS within_one, round({ACC}, 6) AS acc FROM (
    SELECT o.pageid, o.y, s.pred FROM (SELECT * FROM predictions WHERE config = 'first') o JOIN (SELECT * FROM predictions WHERE config = 'second') s USING (pageid) JOIN articles USING (pageid))""",
    "predictions", "articles"))
def external_model_compare(spark, sf):
    """Another model's grades, known per revision, measured on the same pages."""
    names = F.array(*[F.lit(g) for g in GRADES])
    preds = b.predictions(spark, sf)
    test = preds.filter(F.col("config") == "first").select("pageid", "y")
    revs = b.interim(spark, sf).select("pageid", "revid")
    outside = preds.filter(F.col("config") == "second").select((F.col("pageid") * 7 + 1).alias("revid"), F.get(names, F.col("pred")).alias("prediction"))
    joined = text_models.outside_predictions(test, revs, outside)
    return tidy(metrics.all_metrics(joined).drop("qwk", "ordinal_mae"))


@query("M24_pca_space")
def pca_space(spark, sf):
    points = text_models.pca_space(b.model_table(spark, sf), FEATURES, 20)
    head = [F.get("point", F.lit(i)).alias(f"pc{i}") for i in range(3)]
    return tidy(points.select("pageid", "y", "split", F.size("point").alias("dims"), *head))


@query("M24_pca_checks", twin(f"""SELECT count(*) AS n, CAST((SELECT count(*) FROM (SELECT feature FROM long GROUP BY feature
    HAVING min(coalesce(value, 0)) < max(coalesce(value, 0)))) AS DOUBLE) AS variance, true AS uncorrelated FROM splits""", "long", "splits"))
def pca_checks(spark, sf):
    """All components: their variances add up to one for each feature that varies, and no two of them go together."""
    rows = b.model_table(spark, sf)
    found = text_models.space_checks(text_models.pca_space(rows, FEATURES, len(FEATURES)), len(FEATURES))
    return found.select("n", F.round("variance", 6).alias("variance"), (F.col("largest_covariance") < 1e-6).alias("uncorrelated"))


# what holds for every fitted model, whatever it has learnt

VALID = twin("""SELECT count(*) AS n, count(*) AS n_valid, count(DISTINCT pageid) AS pages, true AS beats_majority, true AS same_again
    FROM splits WHERE split = 'test'""", "splits")


def _validity(name: str, kind: str) -> None:
    @query(f"{name}_valid", VALID)
    def run(spark, sf):
        """Every test page once, with probabilities that add up to one; better than the majority; a stored and reloaded
        model says the same."""
        test = part(spark, sf, "test")
        again = scratch(spark, f"again-{kind}")
        learners.save(model(spark, sf, kind), again, spark)
        first, second = model(spark, sf, kind).score(test), learners.load(again, spark).score(test)
        twice = first.select("pageid", "y", "p").join(second.select("pageid", F.col("p").alias("q")), on="pageid")
        sums = F.abs(F.aggregate("p", F.lit(0.0), lambda a, v: a + v) - 1) < 1e-6
        known = F.coalesce(F.array_min("p") >= 0, F.lit(False)) & (F.size("p") == len(GRADES))
        rule = model(spark, sf, "majority").parts["grade"]
        y = F.col("y")
        found = twice.agg(F.count("*").alias("n"), F.count_if(sums & known).alias("n_valid"), F.count_distinct("pageid").alias("pages"),
                          metrics.macro_f1(y, argmax(F.col("p"))).alias("f1"), metrics.macro_f1(y, F.lit(rule)).alias("base"),
                          F.max(F.array_max(F.zip_with("p", "q", lambda a, c: F.abs(a - c)))).alias("gap"))
        return found.select("n", "n_valid", "pages", (F.col("f1") > F.col("base")).alias("beats_majority"), (F.col("gap") < 1e-9).alias("same_again"))


for _name, _kind in {"M2_logreg": "logreg", **{f"M3_boosted_{k}": k for k in learners.BOOSTERS}, "M4_random_forest": "random_forest", "M5_mlp": "mlp",
                     "M6_calibrated_gbt": "calibrated_gbt", "M7_scaled_gbt": "scaled_gbt", "M8_ordinal_cumulative": "ordinal_cumulative",
                     "M9_stacking": "stacking", "M10_distilled": "distilled"}.items():
    _validity(_name, _kind)


@query("M22_batch_valid", twin(f"""SELECT config, count(*) AS n, count(*) AS n_valid FROM splits, (SELECT unnest({list(CONFIGS)}) AS config)
    WHERE split = 'test' GROUP BY config""", "splits"))
def batch_valid(spark, sf):
    """Every stored model gives every test page six probabilities that add up to one."""
    sums = F.abs(F.aggregate("p", F.lit(0.0), lambda a, v: a + v) - 1) < 1e-6
    return _test_scores(spark, sf).groupBy("config").agg(F.count("*").alias("n"), F.count_if(sums & (F.size("p") == len(GRADES))).alias("n_valid"))


@query("K1_model_valid", twin("SELECT count(*) AS n, count(DISTINCT pageid) AS pages, count(*) AS in_range FROM splits WHERE split <> 'train'", "splits"))
def model_valid(spark, sf):
    """Every validation and test page has a distance between 0 and the longest possible one."""
    return _model_opinions(spark, sf).agg(F.count("*").alias("n"), F.count_distinct("pageid").alias("pages"),
                                          F.count_if(F.col("d").between(0, len(GRADES) - 1)).alias("in_range"))


@query("X4_curve_ends", twin(f"SELECT count(*) AS points, true AS ends_meet FROM range({len(FEATURES) + 1})", "splits"))
def curve_ends(spark, sf):
    """Deletion begins where insertion ends, and the other way round."""
    down, up = (_curve(spark, sf, insert).withColumnRenamed("macro_f1", name) for insert, name in ((False, "down"), (True, "up")))
    both = down.join(up, on="step")
    last = len(FEATURES)
    def at(step: int, c: str):
        return F.max(F.when(F.col("step") == step, F.col(c)))
    return both.agg(F.count("*").alias("points"), ((at(0, "down") == at(last, "up")) & (at(last, "down") == at(0, "up"))).alias("ends_meet"))


# explanations

@query("X1_global_importance")
def global_importance(spark, sf):
    """Means over the forests of all seeds."""
    permuted, tree = None, None
    for seed in selection.SEEDS:
        forest = model(spark, sf, "random_forest", seed=seed)
        one = explain.permutation_importance(forest, part(spark, sf, "val"), FEATURES, seed=seed)
        two = explain.tree_importance(forest, spark).withColumnRenamed("importance", "impurity")
        permuted, tree = (one, two) if permuted is None else (permuted.unionByName(one), tree.unionByName(two))
    means = permuted.groupBy("feature").agg(F.avg("importance").alias("importance"))
    return tidy(means.join(tree.groupBy("feature").agg(F.avg("impurity").alias("impurity")), on="feature"))


def _order(spark, sf, forest) -> list[str]:
    ranked = explain.tree_importance(forest, spark).orderBy(F.col("importance").desc(), "feature")
    return [r["feature"] for r in ranked.collect()]


def _curve(spark, sf, insert: bool):
    forest = model(spark, sf, "random_forest")
    med = median_map(part(spark, sf, "train"), FEATURES)
    return explain.ablation_curve(forest, part(spark, sf, "val"), _order(spark, sf, forest), med, insert)


@query("X4_deletion_curve")
def deletion_curve(spark, sf):
    return tidy(_curve(spark, sf, False))


@query("X5_insertion_curve")
def insertion_curve(spark, sf):
    return tidy(_curve(spark, sf, True))


@query("X7_per_grade_top5")
def per_grade_top5(spark, sf):
    return tidy(explain.per_grade_top(model(spark, sf, "xgboost"), spark))


@query("X9_local_attribution")
def local_attribution(spark, sf):
    forest = model(spark, sf, "random_forest")
    med = median_map(part(spark, sf, "train"), FEATURES)
    return tidy(explain.local_attribution(forest, part(spark, sf, "test"), med))
