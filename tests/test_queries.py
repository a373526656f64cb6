"""Every query with SQL against DuckDB on the smallest tables."""

import os

import pytest

from lagwise import catalog

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    return round(v, 7) + 0.0 if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v


def same(spark_rows, columns, found):
    order = sorted(columns)
    assert order == sorted(found.columns)
    a = sorted(repr([plain(r[c]) for c in order]) for r in spark_rows)
    b = sorted(repr([plain(r[found.columns.index(c)]) for c in order]) for r in found.fetchall())
    assert a == b


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf, db, name):
    df = catalog.queries()[name](spark, sf)
    same(df.collect(), df.columns, db.sql(catalog.oracle_sql()[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
