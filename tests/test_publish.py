"""Publication of table sets: all or nothing, conflicts, repeated runs, snapshots, clearing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessitura.sources.publish import PublishConflict, TableSet


@pytest.fixture
def tables(spark, tmp_path):
    return TableSet(spark, str(tmp_path / "set"))


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_versions_and_snapshots(spark, tables):
    assert tables.version() == 0 and tables.names() == [] and tables.versions() == []
    a = spark.range(3).withColumn("x", F.lit(None).cast("array<string>"))
    assert tables.publish({"a": a, "b": spark.range(2)}, run_id="one") == 1
    old = tables.read("a")
    assert tables.publish({"a": tables.read("a").where("id > 0").unionByName(a.where("id = 2"))}, run_id="two") == 2
    assert ids(tables.read("a")) == [1, 2, 2] and ids(tables.read("b")) == [0, 1] and tables.names() == ["a", "b"]
    assert ids(old) == ids(tables.read("a", 1)) == [0, 1, 2] and tables.read("a").schema.simpleString() == a.schema.simpleString()
    assert tables.manifest()["tables"]["a"]["rows"] == 3
    assert tables.publish({"c": spark.range(0)}, run_id="three", drop=("b",)) == 3
    assert tables.names() == ["a", "c"] and tables.read("c").count() == 0
    with pytest.raises(ValueError):
        tables.read("b")


@pytest.mark.parametrize("where", ["task", "driver"])
def test_failed_writer_changes_nothing(spark, tables, where):
    tables.publish({"a": spark.range(3), "b": spark.range(3)}, run_id="one")
    bad = spark.range(5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("stop"))).alias("id"))

    def written(name):
        if where == "driver" and name == "a":
            raise RuntimeError("stop")

    with pytest.raises(Exception, match="stop"):
        tables.publish({"a": spark.range(9), "b": bad if where == "task" else spark.range(9)}, run_id="two", written=written)
    assert tables.version() == 1 and ids(tables.read("a")) == ids(tables.read("b")) == [0, 1, 2]
    assert tables.publish({"a": spark.range(9)}, run_id="two") == 2 and tables.read("a").count() == 9


def test_repeated_run_and_conflict(spark, tables):
    assert tables.publish({"a": spark.range(3)}, run_id="one") == tables.publish({"a": spark.range(9)}, run_id="one") == 1
    assert tables.read("a").count() == 3
    assert tables.publish({"a": spark.range(4)}, run_id="two", expected=1) == 2
    with pytest.raises(PublishConflict):
        tables.publish({"a": spark.range(5)}, run_id="three", expected=1)
    with pytest.raises(PublishConflict):  # another writer publishes while this one writes

        def other(_):
            TableSet(spark, tables.root).publish({"b": spark.range(1)}, run_id="other")

        tables.publish({"a": spark.range(5)}, run_id="three", written=other)
    assert tables.read("a").count() == 4 and tables.names() == ["a", "b"]


def test_a_taken_version_is_not_replaced(spark, tables):
    """The rename itself refuses, even if the earlier look did not see the other writer."""
    tables.publish({"a": spark.range(3)}, run_id="one")
    tables.version = lambda: 0
    with pytest.raises(PublishConflict):
        tables._commit({"version": 1, "run_id": "x", "tables": {}})
    del tables.version
    assert tables.manifest()["run_id"] == "one" and tables.versions() == [1]


def test_vacuum(spark, tables):
    for i in range(4):
        tables.publish({"a": spark.range(i)} if i != 1 else {"b": spark.range(i)}, run_id=str(i))
    with pytest.raises(RuntimeError):
        tables.publish({"a": spark.range(9)}, run_id="x", written=fail)
    assert len(tables.vacuum(keep=2)) == 2 and tables.versions() == [3, 4]  # the first table, and the failed one
    assert ids(tables.read("a")) == [0, 1, 2] and ids(tables.read("b")) == [0] and ids(tables.read("a", 3)) == [0, 1]
    assert tables.vacuum() == []
    with pytest.raises(ValueError):
        tables.vacuum(keep=0)


def fail(_):
    raise RuntimeError
