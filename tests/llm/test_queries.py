"""Every query against its SQL twin, and the pipeline against a chain of plain functions."""

import duckdb
import pytest

import corpus_pipeline
from gradeworks.llm import registry


def rows_of(rows, columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.TWINS))
def test_twin(spark, sf, name):
    got = registry.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.sql(registry.TWINS[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    found = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert rows_of(got.collect(), columns) == rows_of(found, columns)


def test_queries_in_order():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_pipeline(spark, sf, tables):
    """Each stage on its own input, against what its operator's brute force allows."""
    from test_decontamination import brute as leaks
    from test_ngram_join import brute as near
    from test_suffix_dedup import brute as repeats

    from gradeworks.session import write_table

    docs = tables["documents"]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = write_table(stage(spark, docs, sf), "stage")
        seen.append(name)
        a = {r["doc_id"]: r for r in before.collect()}
        b = {r["doc_id"]: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == before.columns and len(b) == docs.count() and set(b) <= set(a)
        pairs = [(k, r["text"]) for k, r in a.items()]
        if name == "quality_rules":
            assert len(b) > 0.6 * len(a) and all(set(b[k]["text"].split("\n")) <= set(a[k]["text"].split("\n")) for k in b)
        if name == "ngram_jaccard_join":
            assert {str(k) for k in b} == {k for k, n, c in near(pairs, 5, 80) if n == 0 or k == c}
        if name == "suffix_array_dedup":
            changed = {k for k, _, removed, _, _ in repeats(pairs) if removed}
            assert changed >= {str(k) for k in b if b[k]["text"] != a[k]["text"]}
            assert all(b[int(k)]["text"] != a[int(k)]["text"] for k in changed if int(k) in b)
            assert all(n == removed for k, n, removed, _, _ in repeats(pairs) if int(k) not in b)
        if name == "benchmark_decontamination":
            items = [tuple(r) for r in tables["benchmark"].collect()]
            assert set(a) - set(b) == {k for k, _ in leaks(pairs, items)}
        if name == "packing":
            assert set(b) == set(a)
    assert seen == ["quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "packing"]
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_pipeline_on_awkward_and_empty_tables(spark, sf, edge, nothing):
    for docs in (edge, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            docs.collect()
