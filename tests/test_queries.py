"""Every query with SQL gives what the SQL gives, on the smallest tables."""

import os

import duckdb
import pytest

from skeinflow.plans import catalog


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{sf}/{f}'")
    return c


def _rows(df, columns):
    return sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_sql(spark, sf, db, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), db.sql(catalog.ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and _rows(got, columns) == _rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
