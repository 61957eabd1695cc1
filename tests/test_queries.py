"""Registered queries against their SQL on the smallest tables, and the guard for the optional part."""

from __future__ import annotations

import os

import pytest

from tessitura.plans import flow_queries, name_queries, queries, table_queries  # noqa: F401 - they register their queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    expected = duck.execute(queries.SQL[name])
    at = [d[0] for d in expected.description]
    assert sorted(at) == columns
    right = sorted(str(tuple(r[at.index(c)] for c in columns)) for r in expected.fetchall())
    assert sorted(str(tuple(r)) for r in frame.select(*columns).collect()) == right


def test_entry(spark):
    import __spark_entry__

    assert {*queries.QUERIES} <= {*__spark_entry__.queries()} and {*__spark_entry__.oracle_sql()} <= {*__spark_entry__.queries()}
