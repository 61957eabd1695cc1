"""Ties that an order leaves open go to the row written first, in whatever order tasks hand rows on."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessitura.operators import tables
from tessitura.plans import queries


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """Two files of line items in the order of l_suppkey; all rows of an order tie, and those of a part in a file."""
    path = tmp_path_factory.mktemp("ties")
    rows = spark.range(4000).selectExpr("id % 40 as l_orderkey", "cast(1 as int) as l_linenumber", "id % 40 as l_partkey", "id as l_suppkey")
    for part in range(2):
        half = rows.where(f"l_suppkey div 2000 = {part}").coalesce(1).sortWithinPartitions("l_suppkey")
        half.withColumn("l_partkey", F.when(F.lit(part == 0), F.col("l_partkey")).otherwise(F.col("l_partkey") + 100)).write.mode("append").parquet(str(path / f"lineitem.parquet/{part}"))
    return str(path)


def reader(spark, path):
    return lambda name: spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/{name}.parquet")


@pytest.fixture
def backwards(monkeypatch):
    """Rows reach the window in the opposite of the file's order."""
    kept = tables.first_per_key
    monkeypatch.setattr(tables, "first_per_key", lambda df, key, order: kept(df.repartition(3, *key).sortWithinPartitions(F.desc("l_partkey")), key, order))


def test_first_and_last_of_equal_rows(spark, written, backwards):
    read = reader(spark, written)
    want = [(k, 1, k) for k in range(40)]
    for query in (queries.w2_first_per_key, queries.w3_last_per_key):
        out = query(read)
        assert out.columns == ["l_orderkey", "l_linenumber", "l_partkey"]
        assert sorted(map(tuple, out.collect())) == want


def test_owner_of_equal_rows(spark, written, monkeypatch):
    kept = tables.flag_conflicts
    monkeypatch.setattr(tables, "flag_conflicts", lambda df, value, owner, order: kept(df.repartition(3, *value).sortWithinPartitions(F.desc("l_suppkey")), value, owner, order))
    out = queries.w4_flag_conflicts(reader(spark, written))
    first = {i for i in range(4000) if i % 2000 < 40}
    assert {r.l_suppkey for r in out.where("conflicts = 0").collect()} == first and out.count() == 4000
