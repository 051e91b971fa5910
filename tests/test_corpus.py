"""Corpus assembly on small tables with known answers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gradeworks.functions.titles import class_mentions, normalise_title
from gradeworks.operators import corpus
from gradeworks.schemas import RAW

NOW = datetime(2024, 6, 1)


def test_highest_class_wins(spark):
    rated = [(7, "ships", "Stub"), (7, "rivers", " C "), (7, "towns", "C"), (7, "maps", "Start"), (7, "old", "Disambig"),
             (8, "maps", "FA"), (9, "maps", None), (9, "towns", "Template")]
    rows = corpus.resolve_label(spark.createDataFrame(rated, "page_id int, project string, class string")).collect()
    assert sorted(map(tuple, rows)) == [(7, "C", 4, 2), (8, "FA", 1, 0)]


def test_fallback(spark):
    pages = spark.createDataFrame([(9,)], "page_id int")
    resolved = spark.createDataFrame([], "page_id int, label string, n_projects long, n_disagree long")
    assert tuple(corpus.label_or_fallback(pages, resolved, F.lit("FA")).first()) == (9, "FA", 0, 0)


def _history(spark, rows, cap=500):
    df = spark.createDataFrame(rows, "page_id int, rev_id long, ts timestamp, editor string, anon boolean, tags array<string>")
    return corpus.revision_counts(df, F.lit(NOW), 90, cap).first()


def test_revision_counts(spark):
    def at(days):
        return NOW - timedelta(days=days)

    r = _history(spark, [
        (4, 11, at(3), "Ines", False, ["mw-undo", "mobile"]), (4, 12, at(89), "Ines", False, []), (4, 13, at(91), "SweepBot", False, []),
        (4, 14, at(120), "10.0.0.9", True, ["mw-manual-revert"]), (4, 15, at(700), "robotics fan", False, ["visual"]),
        (4, 16, at(900), "helper bot", True, [])])
    assert r.asDict() == {"page_id": 4, "edits": 6, "editors": 5, "anon_n": 2, "bot_n": 1, "reverted_n": 2, "edits_90d": 2,
                          "created": at(900)}


def test_revision_cap_takes_the_newest(spark):
    rows = [(1, i, NOW - timedelta(days=i), f"u{i}", False, []) for i in range(501)]
    r = _history(spark, rows)
    assert r["edits"] == 500 and r["created"] == NOW - timedelta(days=499)


def test_pageviews(spark):
    pages = spark.createDataFrame([(1,), (2,)], "page_id int")
    views = spark.createDataFrame([(1, "2024-05-31", 10), (1, "2024-05-30", 20), (1, "2024-05-01", 30), (1, "2024-06-01", 999),
                                   (1, "2023-01-01", 999)], "page_id int, day string, views int").withColumn("day", F.to_date("day"))
    got = dict(corpus.pageviews_mean(pages, views, F.lit("2024-06-01").cast("date")).collect())
    assert got == {1: 20.0, 2: 0.0}


@pytest.mark.parametrize("title,redirect,disambig,size,grade,reason", [
    ("Harbour", True, False, 20, "GA", "redirects"), ("List of harbours", False, True, 20, "GA", "disambigs"),
    ("List of piers", False, False, 20, "Start", "list_prefix"), ("Harbour", False, False, 99, "Start", "min_bytes_non_stub"),
    ("Harbour", False, False, 100, "Start", None), ("Harbour", False, False, 1, "Stub", None), ("A List of piers", False, False, 900, "B", None)])
def test_exclusions(spark, title, redirect, disambig, size, grade, reason):
    args = [F.lit(v) for v in (title, redirect, disambig, size, grade)]
    assert spark.range(1).select(corpus.exclusion_reason(*args)).first()[0] == reason


def test_quota_counts_what_is_stored(spark):
    candidates = spark.createDataFrame([("B", i, i) for i in range(10)] + [("C", 1, 50)], "label string, at int, id int")
    existing = spark.createDataFrame([("B",)] * 3, "label string")
    got = corpus.fill_quota(candidates, existing, 5, arrival="at", tie="id").select("label", "id").collect()
    assert sorted(map(tuple, got)) == [("B", 0), ("B", 1), ("C", 50)]


def test_round_robin_order(spark):
    members = spark.createDataFrame([("A", f"Talk:a{i}", i) for i in range(3)] + [("B", "Talk:a0", 7), ("B", "User:x", 8)],
                                    "category string, title string, member_id long")
    order = spark.createDataFrame([("A", 2), ("B", 1)], "category string, cat_order long")
    got = {r["title"]: (r["round"], r["cat_order"], r["rn"]) for r in corpus.round_robin(members, order, per_round=2).collect()}
    assert got == {"a0": (0, 1, 1), "a1": (0, 2, 2), "a2": (1, 2, 3)}


def _graded(spark, flags):
    rows = [(1, i, NOW + timedelta(days=i), "{{P|class=GA}}" if f else "{{P|class=c}}") for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "page_id int, rev_id long, ts timestamp, text string")
    return corpus.grade_dates(df, F.lit("GA")).first()["grade_ts"]


@pytest.mark.parametrize("flags,day", [([0, 1, 1], 1), ([1, 1, 1], 0), ([1, 0, 1, 1], 2), ([1, 1, 0], None)])
def test_grade_date(spark, flags, day):
    assert _graded(spark, flags) == (None if day is None else NOW + timedelta(days=day))


def test_class_mentions(spark):
    df = spark.createDataFrame([("{{a|class = ga}} {{b|Class=GA}} {{c|class=list}} subclass=FA class=b",), (None,)], "t string")
    assert [r[0] for r in df.select(class_mentions(F.col("t"))).collect()] == [["GA", "B"], []]


@pytest.mark.parametrize("given,title", [
    ("https://en.wikipedia.org/wiki/Albert_Einstein#Life", "Albert Einstein"), ("en.m.wikipedia.org/wiki/A%2FB", "A/B"),
    (" C++ ", "C++"), ("wiki/100%_sure", "100% sure")])
def test_titles(spark, given, title):
    assert spark.range(1).select(normalise_title(F.lit(given))).first()[0] == title


def test_validation(spark):
    good = {f.name: None for f in RAW.fields} | {"pageid": 1, "title": "t", "label": "B", "revid": 1, "wikitext": "x", "bytes": 1}
    rows = [good, good, good | {"pageid": 2, "title": ""}, good | {"pageid": 3, "bytes": None}]
    r = corpus.validate_records(spark.createDataFrame(rows, RAW)).first()
    assert (r["total"], r["dups"], r["missing"], r["missing_rate"], r["warn"]) == (4, 1, 2, 0.5, True)
