"""Learners: valid probabilities, better than the majority, same result for the same seed."""

import pytest
from pyspark.sql import functions as F

from gradeworks.functions.probability import argmax
from gradeworks.operators import explain, learners, metrics, portable, selection, text_models
from gradeworks.schemas import K

SMALL = {"iterations": 3, "depth": 3}
COLS = ["a", "b", "c"]
SETTINGS = {"logreg": {"max_iter": 30}, "random_forest": {"trees": 8, "depth": 5}, "mlp": {"width": 8, "max_iter": 40},
            "xgboost": SMALL, "ordinal_cumulative": {"iterations": 20, "leaves": 8, "learning_rate": 0.3}, "calibrated_gbt": {**SMALL, "folds": 2},
            "stacking": {"folds": 2, "bases": {"random_forest": {"trees": 5, "depth": 4}, "histgb": SMALL}},
            "distilled": {"trees": 8, "depth": 4, "teacher": SMALL}}


@pytest.fixture(scope="module")
def table(spark):
    y = (F.col("id") * 7 % 6).cast("int")
    noise = [F.rand(seed=s) for s in (1, 2, 3)]
    df = spark.range(900).select(F.col("id").alias("pageid"), y.alias("y"), (y + noise[0]).alias("a"),
                                 (noise[1] - y * 0.5).alias("b"), noise[2].alias("c"))
    return df.persist()


@pytest.fixture(scope="module")
def majority_f1(table):
    scored = learners.fit("majority", table, COLS).score(table).withColumn("pred", argmax(F.col("p")))
    return metrics.all_metrics(scored).first()["macro_f1"]


@pytest.mark.parametrize("kind", list(SETTINGS))
def test_learner(kind, spark, table, majority_f1, tmp_path):
    fitted = learners.fit(kind, table, COLS, SETTINGS[kind], 42)
    learners.save(fitted, str(tmp_path / kind), spark)
    scored = learners.load(str(tmp_path / kind), spark).score(table).select("y", "p")
    assert scored.orderBy("y", "p").head(5) == fitted.score(table).select("y", "p").orderBy("y", "p").head(5)
    bad = F.abs(F.aggregate("p", F.lit(0.0), lambda a, v: a + v) - 1) > 1e-6
    odd = scored.filter(bad | (F.size("p") != K) | (F.array_min("p") < 0)).count()
    f1 = metrics.all_metrics(scored.withColumn("pred", argmax(F.col("p")))).first()["macro_f1"]
    assert odd == 0 and f1 > majority_f1 + 0.2


def test_same_seed_same_forest(table):
    one, two = (learners.fit("random_forest", table, COLS, SETTINGS["random_forest"], 7).score(table)
                .select("pageid", "p").orderBy("pageid").collect() for _ in range(2))
    assert one == two


def test_fewer_classes_are_padded(table):
    few = table.filter("y < 3")
    for kind in ("logreg", "random_forest", "xgboost"):
        sizes = learners.fit(kind, few, COLS, SETTINGS[kind]).score(few).agg(F.min(F.size("p")), F.max(F.size("p"))).first()
        assert tuple(sizes) == (K, K)


def test_portable_forest(spark, table):
    student = learners.fit("distilled", table, COLS, SETTINGS["distilled"])
    column = portable.forest_column(portable.export_nodes(student, spark), COLS)
    r = portable.verify(student, column, table).first()
    assert r["argmax_agreement"] == 1.0 and r["max_prob_diff"] < 1e-9


def test_unknown_learner(table):
    with pytest.raises(ValueError):
        learners.fit("nope", table, COLS)


def test_search_is_seeded(table, monkeypatch):
    train, valid = table.filter("pageid < 600"), table.filter("pageid >= 600")
    assert selection.drawn_settings("mlp", 3) == selection.drawn_settings("mlp", 3)
    assert {k for p in selection.drawn_settings("xgboost") for k in p} == {"depth", "learning_rate", "iterations", "subsample"}
    tried = [{"iterations": n, "depth": d} for n, d in ((4, 1), (8, 3), (12, 2), (8, 1), (4, 2))]
    runs = selection.boosted_trials("xgboost", tried, train, valid, COLS, 42, selection.HALVING_RUNGS)
    again = selection.boosted_trials("xgboost", tried, train, valid, COLS, 42, selection.HALVING_RUNGS)
    def plain(rs):
        return [{k: v for k, v in r.items() if k != "wall_s"} for r in rs]
    assert plain(runs) == plain(again) and sorted(r["share"] for r in runs) == [0.25, 0.25, 0.5, 1.0, 1.0]
    full = selection.boosted_trials("xgboost", tried, train, valid, COLS, 42, (1.0,))
    for r, f, p in zip(runs, full, tried, strict=True):  # a trial that went all the way has the trees of a full fit
        if r["share"] == 1.0:
            assert abs(r["val_macro_f1"] - f["val_macro_f1"]) < 1e-9
            alone = selection.fit_score("xgboost", train, valid, COLS, p)[1]
            assert abs(alone["val_qwk_regress_round"] - r["val_qwk_regress_round"]) < 1e-9
    monkeypatch.setattr(selection, "drawn_settings", lambda *a: tried)
    best, _ = selection.param_search("xgboost", train, valid, COLS, halving=False)
    assert best == tried[max(range(5), key=lambda i: (full[i]["val_macro_f1"], -i))]


def test_costs_of_each_model(spark, table):
    models = {k: learners.fit(k, table, COLS, SETTINGS.get(k)) for k in ("majority", "xgboost")}
    cost = {r["config"]: r for r in metrics.model_costs(models, table).collect()}
    assert set(cost) == set(models) and all(r["infer_s_per_1k"] > 0 for r in cost.values())
    assert cost["xgboost"]["task_s_per_1k"] > cost["majority"]["task_s_per_1k"] >= 0


def test_batch_score_reads_once(table):
    models = {k: learners.fit(k, table, COLS, SETTINGS.get(k)) for k in ("majority", "xgboost", "random_forest", "calibrated_gbt")}
    out = selection.batch_score(models, table)
    assert out.count() == 4 * table.count()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1
    alone = selection.batch_score({"xgboost": models["xgboost"]}, table)
    assert out.filter("config = 'xgboost'").exceptAll(alone).count() == 0


def test_selection_needs_a_clear_lead(spark):
    def pick(rung2):
        rows = [("rung0", "logreg", 0.5, 1.0), ("rung1", "slow", 0.7004, 9.0), ("rung1", "fast", 0.7, 1.0), ("rung2", "mlp", rung2, 1.0)]
        df = spark.createDataFrame(rows, "rung string, kind string, val_macro_f1 double, wall_s double")
        return dict(selection.select_best(df).collect())
    assert pick(0.705)["rung1"] == "fast" and pick(0.705)["overall"] == "fast" and pick(0.72)["overall"] == "mlp"


def test_nested_samples(table):
    small = {r[0] for r in selection.nested_sample(table, 7).filter("_rn <= 5").select("pageid").collect()}
    large = {r[0] for r in selection.nested_sample(table, 7).filter("_rn <= 20").select("pageid").collect()}
    assert len(small) == 30 and len(large) == 120 and small < large


def test_importance_and_curves(spark, table):
    forest = learners.fit("random_forest", table, COLS, SETTINGS["random_forest"])
    imp = {r["feature"]: r["importance"] for r in explain.permutation_importance(forest, table, COLS).collect()}
    assert imp["a"] > imp["c"] + 0.05 and abs(imp["c"]) < 0.05
    med = {"a": 3.0, "b": -1.0, "c": 0.5}
    order = sorted(imp, key=imp.get, reverse=True)
    down = [r["macro_f1"] for r in explain.ablation_curve(forest, table, order, med).orderBy("step").collect()]
    up = [r["macro_f1"] for r in explain.ablation_curve(forest, table, order, med, insert=True).orderBy("step").collect()]
    assert len(down) == 4 and down[0] == up[-1] and down[-1] == up[0] and down[0] > down[-1]


def test_local_attribution(spark, table):
    forest = learners.fit("random_forest", table, COLS, SETTINGS["random_forest"])
    got = explain.local_attribution(forest, table.limit(10), {"a": 3.0, "b": -1.0, "c": 0.5}, top=2)
    assert got.count() == 20 and got.agg(F.max("rank")).first()[0] == 2


def test_text_arm(spark):
    words = ["stub", "start", "cee", "bee", "good", "best"]
    rows = [(i, i % 6, f"{words[i % 6]} text number {i}", "train" if i < 240 else "test") for i in range(300)]
    df = spark.createDataFrame(rows, "pageid long, y int, text string, split string")
    model = text_models.fit_text(df.filter("split = 'train'"), buckets=1 << 10)
    scored = model.score(df.filter("split = 'test'")).withColumn("pred", argmax(F.col("p")))
    assert metrics.all_metrics(scored).first()["acc"] > 0.95
    assert text_models.logits_table(scored).columns[-1] == "logit_5"


def test_a_logistic_fit_is_shared_by_seeds(spark, monkeypatch):
    """It draws nothing: a second seed on the same DataFrame gets the same model, other settings and rows do not."""
    rows = spark.range(200).select(F.col("id").alias("pageid"), (F.col("id") % 3).cast("int").alias("y"), (F.col("id") % 3 + F.rand(seed=1)).alias("a")).persist()
    fits, made = [], learners._simple
    monkeypatch.setattr(learners, "_simple", lambda *a, **k: fits.append(a[0]) or made(*a, **k))
    one, two = (learners.fit("logreg", rows, ["a"], {"max_iter": 5}, seed) for seed in (7, 42))
    assert one is two and len(fits) == 1
    assert learners.fit("logreg", rows, ["a"], {"max_iter": 6}) is not one
    assert learners.fit("logreg", rows.limit(100), ["a"], {"max_iter": 5}) is not one and len(fits) == 3
