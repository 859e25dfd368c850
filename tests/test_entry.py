"""Registered queries against DuckDB on the small tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def compare(spark, name):
    import duckdb

    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    tidy = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    got = tidy(tuple(r[c] for c in columns) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    assert got == tidy(tuple(r[i] for i in order) for r in rel.fetchall())


def _names():
    from docloom.plans.queries import QUERIES

    return list(QUERIES)


@pytest.mark.parametrize("name", _names())
def test_query(spark, name):
    compare(spark, name)


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1000
