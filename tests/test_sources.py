"""Readers, writers, lineage and streams on files."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gradeworks.schemas import RAW
from gradeworks.sources import lineage, records
from gradeworks.streaming import ingest


def _lines(path, rows):
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def _record(i, label="B", **more):
    return json.dumps({"pageid": i, "title": f"t{i}", "label": label, "revid": i, "wikitext": "x", "bytes": 1,
                       "categories": ["a"], "project_classes": [["P", "B"]], "fetch_ts": f"2024-01-0{i}", **more})


def test_read_raw(spark, tmp_path):
    path = _lines(tmp_path / "B.jsonl", [_record(1), "", "   ", "{broken", _record(2, edits=5), _record(3, edits="many")])
    df = records.read_raw(spark, path)
    assert {r["pageid"]: r["edits"] for r in df.collect()} == {1: None, 2: 5, 3: None}
    assert df.schema.names == RAW.names and df.count() == 3
    kept = records.read_raw(spark, path, keep_corrupt=True).collect()
    assert "{broken" in [r["_corrupt_record"] for r in kept]


def test_append_skips_stored_keys(spark, tmp_path):
    store = str(tmp_path / "store")
    raw = records.read_raw(spark, _lines(tmp_path / "a.jsonl", [_record(1), _record(2)]))
    records.write_raw(raw, store)
    more = records.read_raw(spark, _lines(tmp_path / "b.jsonl", [_record(2, "GA"), _record(3), _record(3)]))
    records.append_new(more, store)
    got = records.read_raw(spark, store)
    assert sorted((r["pageid"], r["label"]) for r in got.collect()) == [(1, "B"), (2, "B"), (3, "B")]
    assert records.existing_keys(got, "B").count() == 3
    one = records.read_raw(spark, store, grade="B")
    assert one.schema.names == RAW.names and one.count() == 3
    assert "PartitionFilters: [isnotnull(grade_dir" in one._jdf.queryExecution().toString()
    assert records.read_raw(spark, store, grade="FA").count() == 0


def test_frozen(spark, tmp_path):
    path = str(tmp_path / "frozen")
    df = spark.createDataFrame([(1, "train")], "pageid int, split string")
    records.write_frozen(df, path)
    with pytest.raises(AnalysisException):
        records.write_frozen(df, path)


def test_payload(spark):
    full = {"pageid": 31, "title": "Oak table", "length": 640, "redirect": "",
            "protection": [{"type": "move", "level": "autoconfirmed"}, {"type": "edit", "level": "extended"}],
            "revisions": [{"revid": 71, "timestamp": "2021-03-04T05:06:07Z", "slots": {"main": {"content": "made of [[oak]]"}}}],
            "categories": [{"title": "Category:Furniture"}, {"title": "Category:Wood"}],
            "templates": [{"title": "Template:Wood"}]}
    bodies = [{"query": {"pages": {"31": full, "-1": {"title": "Nowhere", "missing": ""}}}},
              {"query": {"pages": {"44": {"pageid": 44, "title": "Only a name", "pageprops": {"disambiguation": ""}}}}},
              {"batchcomplete": ""}]
    df = spark.createDataFrame([(json.dumps(x),) for x in bodies], "body string")
    rows = {r["pageid"]: r.asDict() for r in records.flatten_pages(df, F.col("body")).collect()}
    assert sorted(rows) == [31, 44]
    assert rows[31]["wikitext"] == "made of [[oak]]" and rows[31]["revid"] == 71 and rows[31]["bytes"] == 640
    assert rows[31]["protection"] == ["move:autoconfirmed", "edit:extended"]
    assert (rows[31]["is_redirect"], rows[31]["is_disambig"]) == (True, False)
    assert (rows[44]["is_redirect"], rows[44]["is_disambig"], rows[44]["bytes"], rows[44]["wikitext"]) == (False, True, 0, "")
    lists = {r["pageid"]: (r["categories"], r["templates"]) for r in records.list_props(df, F.col("body")).collect()}
    assert lists[31] == (["Category:Furniture", "Category:Wood"], ["Template:Wood"])
    assert lists[44] == ([], [])


def test_fingerprint_tells_rows_apart(spark):
    def print_of(*rows):
        return lineage.fingerprint(spark.createDataFrame(rows, "a string, b string"), "t").first()["fingerprint"]

    different = [(("a|b", "c"),), (("a", "b|c"),), ((None, "c"),), (("~", "c"),), (("-", "c"),), (("1:a;", "c"),), (("", "c"),)]
    assert len({print_of(*rows) for rows in different}) == len(different)
    assert print_of(("x", "y"), ("z", None)) == print_of(("z", None), ("x", "y"))


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "data")
    spark.range(10).write.parquet(path)
    first = lineage.dataset_row(spark, "raw", "raw", path, "make", created=F.lit("1"))
    second = lineage.dataset_row(spark, "raw", "raw", path, "make", created=F.lit("2"))
    rows = lineage.upsert(first, second).collect()
    assert len(rows) == 1 and (rows[0]["rows"], rows[0]["cols"], rows[0]["created"]) == (10, 1, "2")
    import os
    assert rows[0]["bytes"] == sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet")) and len(rows[0]["sha256"]) == 64
    spark.range(10).orderBy(F.desc("id")).coalesce(1).write.parquet(path + "-again")  # other order, other files
    again = lineage.dataset_row(spark, "raw", "raw", path + "-again", "make", "older", F.lit("3")).first()
    assert again["sha256"] == rows[0]["sha256"] and again["parent"] == "older"
    assert lineage.content_hash(spark.range(1, 11)).first()["sha256"] != again["sha256"]


def test_latest_run_keeps_all_its_rows(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "c")], "run_id string, v string")
    assert sorted(r["v"] for r in lineage.latest_run(df).collect()) == ["b", "c"]


def test_merge_external(spark):
    own = spark.createDataFrame([("a", 1.0)], "config string, f1 double")
    ext = spark.createDataFrame([("a", 9.0, "x"), ("b", 2.0, "y")], "config string, f1 double, note string")
    assert sorted(map(tuple, lineage.merge_external(own, ext).collect())) == [("a", 1.0, None), ("b", 2.0, "y")]


def test_stream_keeps_the_first_record(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def drain():
        ingest.ingest_new(ingest.stream_records(spark, str(src)), out, state).awaitTermination()
        return sorted((r["pageid"], r["fetch_ts"]) for r in spark.read.parquet(out).collect())

    def told(page, at):
        return json.dumps({**json.loads(_record(page)), "fetch_ts": at}) if isinstance(_record(page), str) else {**_record(page), "fetch_ts": at}

    _lines(src / "1.jsonl", [told(1, "2024-02"), "", told(2, "2024-05"), told(1, "2024-01")])
    assert drain() == [(1, "2024-01"), (2, "2024-05")]
    _lines(src / "2.jsonl", [told(2, "2024-01"), told(3, "2024-04"), told(3, "2024-03")])
    assert drain() == [(1, "2024-01"), (2, "2024-05"), (3, "2024-03")]
    assert drain() == [(1, "2024-01"), (2, "2024-05"), (3, "2024-03")]


def test_late_revisions_count(spark, tmp_path):
    out, state, src = (str(tmp_path / n) for n in ("out", "state", "in"))
    kinds = "page_id long, rev_id long, ts timestamp, editor string, anon boolean, tags array<string>"
    schema = spark.createDataFrame([], kinds).schema

    def add(*rows):
        made = spark.createDataFrame([(p, r, e, a, t) for p, r, _, e, a, t in rows], "page_id long, rev_id long, editor string, anon boolean, tags array<string>")
        times = spark.createDataFrame([(r, ts) for _, r, ts, *_ in rows], "rev_id long, t string")
        made.join(times, "rev_id").selectExpr("page_id", "rev_id", "cast(t as timestamp) ts", "editor", "anon", "tags").write.mode("append").parquet(src)
        ingest.store_daily(spark.readStream.schema(schema).parquet(src), out, state).awaitTermination()

    add((1, 1, "2024-01-20", "ann", False, []), (1, 2, "2024-01-20", "TidyBot", False, ["mw-undo"]))
    add((1, 3, "2023-01-01", "x", True, []), (2, 4, "2024-01-19", "bob", False, []))
    got = {r["page_id"]: tuple(r)[1:] for r in ingest.trailing_counts(spark.read.parquet(out), F.lit("2024-01-31").cast("date"), 90).collect()}
    assert got == {1: (3, 1, 1, 1, 2), 2: (1, 0, 0, 0, 1)}
