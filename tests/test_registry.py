"""Typed tables: drift, nulls, values and keys; result runs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessitura.sources import readers, registry

TAG = "id long, work_id long, tag string"


def write(spark, root, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{root}/{name}.parquet")


def test_schemas(spark):
    assert set(registry.COLUMNS) <= set(registry.TABLES) and set(registry.UNIQUE) <= set(registry.COLUMNS) and set(registry.VALUES) <= set(registry.COLUMNS)
    for name in registry.COLUMNS:
        fields = {f.name: f for f in registry.schema_of(name).fields}
        assert not fields[registry.key_of(name)].nullable
        assert {*registry.UNIQUE.get(name, []), *registry.VALUES.get(name, {})} <= set(fields)
    for bad in ("nothing", "download_jobs"):
        with pytest.raises(ValueError):
            registry.schema_of(bad)


def test_drift(spark, tmp_path):
    write(spark, tmp_path, "work_tags", [(1, 1, "a")], TAG)
    write(spark, tmp_path, "work_tags", [(2, 1, "b", 0)], "id int, work_id long, tag string, more int")
    assert registry.scan_typed(spark, str(tmp_path), "work_tags").rows.count() == 2  # wider and more columns are no drift
    write(spark, tmp_path, "work_tags", [(3, 1)], "id long, work_id long")
    with pytest.raises(registry.SchemaDrift, match="tag is missing"):
        registry.scan_typed(spark, str(tmp_path), "work_tags")
    write(spark, tmp_path, "work_parts", [("1", 1, "x")], "id string, work_id long, part_name string")
    with pytest.raises(registry.SchemaDrift, match="id is string, not bigint"):
        registry.scan_typed(spark, str(tmp_path), "work_parts")


def test_rejects(spark, tmp_path):
    rows = [(1, 1, "a"), (2, 1, "a"), (3, 1, None), (None, 1, "b"), (5, 2, "a"), (5, 2, "c"), (6, 1, "a"), (7, None, None)]
    write(spark, tmp_path, "work_tags", rows, TAG)
    found = registry.scan_typed(spark, str(tmp_path), "work_tags")
    assert sorted(r.id for r in found.rows.collect()) == [1] and found.rows.columns == ["id", "work_id", "tag"]
    assert sorted((r.id or 0, r.reason) for r in found.rejects.collect()) == [
        (0, "null:id"), (2, "key:work_id,tag"), (3, "null:tag"), (5, "key:id"), (5, "key:id"), (6, "key:work_id,tag"), (7, "null:work_id,null:tag"),
    ]
    assert found.rows.count() + found.rejects.count() == len(rows)


def test_values_and_null_keys(spark):
    rows = spark.createDataFrame([(1, None, "n", None, None, "available"), (2, None, "n", None, None, "lost"), (3, None, "n", None, None, None)], "id long, sha256 string, name string, mime_type string, size_bytes long, status string")
    found = registry.checked(rows, "files")
    assert sorted((r.id, r.reason) for r in found.rejects.collect()) == [(2, "value:status"), (3, "null:status")]
    assert [r.id for r in found.rows.collect()] == [1]
    assert registry.checked(rows.limit(0), "files").rows.count() == 0


def test_one_key_in_most_rows(spark):
    rows = spark.range(9_000).select("id", (F.col("id") % 3 > 0).cast("long").alias("work_id"), F.lit("t").alias("tag"))
    found = registry.checked(rows, "work_tags")
    assert sorted(r.id for r in found.rows.collect()) == [0, 1] and found.rejects.count() == 8_998


def test_runs(spark, tmp_path):
    rows = spark.range(10).select("id", F.when(F.col("id") < 3, "x").when(F.col("id") < 5, "y").alias("outcome"))
    path = str(tmp_path / "out")
    for _ in range(2):
        run = readers.append_results(rows, path, "007", outcome="outcome", outcomes=["x", "z"])
        assert (run.rows, run.counts) == (10, {"x": 3, "z": 0, "other": 7})
    assert readers.append_results(rows.limit(0), path, "a/b=c", outcome="outcome", outcomes=["x"]).counts == {"x": 0, "other": 0}
    assert readers.append_results(rows.where("id = 1"), path, "é 1").rows == 1
    assert sorted((r.run_id, r["count"]) for r in readers.read_results(spark, path).groupBy("run_id").count().collect()) == [("007", 10), ("é 1", 1)]
    assert {(r.outcome, r.n) for r in readers.run_summary(spark, [run]).collect()} == {("x", 3), ("z", 0), ("other", 7)}
