"""Every query of the engine against its SQL in DuckDB, on the smallest data."""

from __future__ import annotations

import math

import duckdb
import pytest

from symgraph.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    return x if x is None else str(x)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    found = catalogue.queries()[name](spark, sf_dir)
    want = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    rows = sorted(str([cell(r[c]) for c in columns]) for r in found.collect())
    other = sorted(str([cell(dict(zip(want.columns, r, strict=True))[c]) for c in columns]) for r in want.fetchall())
    assert rows == other


def test_every_query_without_sql_gives_rows(spark, sf_dir):
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        assert catalogue.queries()[name](spark, sf_dir).count() > 0, name
