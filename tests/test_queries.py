"""Every registered query of the core against its SQL in DuckDB."""

import math

import duckdb
import pytest
from conftest import SF

from factloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    result = con.execute(catalog.oracle_sql()[name])
    columns = [x[0] for x in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
