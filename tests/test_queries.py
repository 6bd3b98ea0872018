"""Every registered query with SQL against that SQL, on the smallest tables."""

import os

import duckdb
import pytest

from facetspark.plans import queries as Q

SQL, QUERIES = Q.oracle_sql(), Q.queries()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, db, name):
    got = QUERIES[name](spark, sf)
    cursor = db.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    columns = sorted(names)
    want = sorted((repr(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == want


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 60
