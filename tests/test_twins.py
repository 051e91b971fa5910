"""Every query with a SQL twin gives the twin's rows, exactly."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {("bigint", "BIGINT"), ("int", "INTEGER"), ("string", "VARCHAR"), ("double", "DOUBLE"), ("boolean", "BOOLEAN")}
#: Whole fits of the learners with their own settings take minutes, and a test partition of thirty rows says little.
FITS = {n for n in entry.oracle_sql() if n.endswith("_valid") or n == "X4_curve_ends"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    yield con
    con.close()


def _cell(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - FITS))
def test_same_rows(name, spark, sf, duck):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(map(_cell, r)) for r in df.select(*columns).collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    order = [list(kinds).index(c) for c in columns] if sorted(kinds) == columns else None
    assert order is not None, (columns, sorted(kinds))
    want = sorted(tuple(_cell(r[i]) for i in order) for r in cursor.fetchall())
    assert got == want
    assert all((dict(df.dtypes)[c], kinds[c]) in TYPES for c in columns)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
