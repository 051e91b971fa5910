"""Registered model queries fit with the package's own settings; the fits themselves are not run here."""

import inspect

import pytest
from pyspark.sql import functions as F

from gradeworks.operators import learners, selection, text_models
from gradeworks.plans import models
from gradeworks.plans.catalog import QUERIES

FITTED = ["M2_logreg", *[f"M3_boosted_{k}" for k in learners.BOOSTERS], "M4_random_forest", "M5_mlp", "M6_calibrated_gbt",
          "M7_scaled_gbt", "M8_ordinal_cumulative", "M9_stacking", "M10_distilled", "M11_portable_scorer", "M14_fit_score",
          "X1_global_importance", "X4_deletion_curve", "X5_insertion_curve", "X7_per_grade_top5",
          "X9_local_attribution"]


class Stopped(Exception):
    pass


@pytest.fixture
def calls(monkeypatch):
    """Arguments of the first call of a fit or a search, which ends there."""
    seen = []

    def recorded(f):
        def call(*args, **options):
            seen.append(inspect.signature(f).bind(*args, **options).arguments)
            raise Stopped
        return call

    for module, name in ((learners, "fit"), (selection, "fit"), (selection, "param_search"), (text_models, "fit_text"), (text_models, "fit"),
                         (selection, "learning_curve"), (selection, "tune")):
        monkeypatch.setattr(module, name, recorded(getattr(module, name)))
    monkeypatch.setattr(models, "_fitted", {})
    return seen


def first_call(calls, spark, sf, name):
    with pytest.raises(Stopped):
        QUERIES[name](spark, sf)
    return calls[0]


@pytest.mark.parametrize("name", FITTED)
def test_own_settings(name, spark, sf, calls):
    assert not first_call(calls, spark, sf, name).get("params")


@pytest.mark.parametrize("name", ["M13_param_search", "M17_train_one"])
def test_searches_are_not_clamped(name, spark, sf, calls):
    assert not {"trials", "halving"} & set(first_call(calls, spark, sf, name))


@pytest.mark.parametrize("name", ["M18_text_arm", "M21_leak_ablation"])
def test_text_model(name, spark, sf, calls):
    if name == "M18_text_arm":
        with pytest.raises(Stopped):
            models._text_model(spark, sf)
    else:
        first_call(calls, spark, sf, name)
    assert not {"buckets", "max_iter"} & set(calls[0])


def test_curve_has_all_levels_and_seeds(spark, sf, calls):
    call = first_call(calls, spark, sf, "M20_learning_curve")
    assert call["levels"] == [25, 50, 75, 100, 125] and call["seeds"] == [7, 42, 1337] and not call.get("params")


def test_all_configs_are_trained_as_tuned(spark, sf, monkeypatch):
    seen = {}

    def trained(train, valid, features, configs, *rest, **options):
        seen.update(configs)
        assert not rest and not options
        raise Stopped

    monkeypatch.setattr(selection, "tune", lambda *a: ({"xgboost": {"depth": 7}, "mlp": {"width": 128}}, "xgboost"))
    monkeypatch.setattr(selection, "train_all", trained)
    with pytest.raises(Stopped):
        QUERIES["M16_train_all"](spark, sf)
    assert len(seen) == 14 and seen["rung1_xgboost"] == ("xgboost", {"depth": 7}) and seen["rung2_mlp"][1] == {"width": 128}
    assert seen["metadata_noH"][:2] == ("xgboost", {"depth": 7}) and "edits" not in seen["metadata_noH"][2]


def test_tune_searches_every_kind(spark, sf, monkeypatch):
    row = lambda kind, f1: {"kind": kind, "val_macro_f1": f1, "wall_s": 1.0}
    monkeypatch.setattr(selection, "binned", lambda *a: None)
    monkeypatch.setattr(selection, "fit_score", lambda kind, *a: (None, row(kind, 0.1)))
    monkeypatch.setattr(selection, "param_search", lambda kind, *a: (
        {"of": kind}, [row(kind, 0.2), row(kind, 0.6 if kind == "histgb" else 0.5)]))
    settings, best = selection.tune(spark.range(1), None, [])
    assert best == "histgb" and settings["logreg"] == {} and settings["mlp"] == {"of": "mlp"} and len(settings) == 8


def test_rows_of_the_learners_are_dealt_out_evenly(spark, sf):
    """A share for each core, whatever the grades' sizes."""
    rows = models.part(spark, sf, "train")
    shares = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    cores = spark.sparkContext.defaultParallelism
    assert len(shares) == cores and max(shares) <= 2 * rows.count() / cores


def test_the_text_arm_reads_windows_and_joins_no_text(spark, sf, calls):
    """Fit and scores share one table of token windows, which are those of the joined texts."""
    with pytest.raises(Stopped):
        models._text_model(spark, sf)
    train = calls[0]["train"]
    assert text_models.WINDOW in train.columns and "wikitext" not in train.columns
    joined = text_models.with_window(models._texts(spark, sf), "wikitext").select("pageid", "y", "split", text_models.WINDOW)
    assert sorted(map(tuple, models._windows(spark, sf).collect())) == sorted(map(tuple, joined.collect()))
