"""Assembly in pages, and index tables over JDBC."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from tessitura.operators import search
from tessitura.sources import readers


def children(spark):
    """A work with most of the children, some with few, one without, and children of no work."""
    rows = spark.range(600).withColumn("work_id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 7 + 2)).withColumn("relative_path", F.concat(F.lit("d/"), "id", F.lit(".pdf")))
    rows = rows.withColumns({"file_id": F.col("id"), "genre": F.concat(F.lit("g"), F.col("id") % 5), "instrument": F.lit("i"), "part_name": F.concat(F.lit("p"), "id")})
    return spark.range(1, 10).selectExpr("id", "concat('t', id) as title"), rows


def test_pages_hold_all_children(spark):
    works, rows = children(spark)
    lists = (rows, rows, rows.where("id % 2 = 0"), rows.where("id % 11 = 0"))
    whole = {r.id: r for r in search.assemble_works(works, *lists).collect()}
    paged = search.work_pages(works, *lists, per_page=25).orderBy("id", "page").collect()
    assert max(len(r.resources) for r in paged) == 25 and sum(r.id == 1 for r in paged) == 16
    assert [r.page for r in paged if r.id == 9] == [0]
    for id, work in whole.items():
        own = [r for r in paged if r.id == id]
        assert [r.page for r in own] == list(range(len(own)))
        for into in ("resources", "genres", "instruments", "parts_names"):
            assert [x for r in own for x in r[into]] == work[into]
    assert sorted(map(str, search.work_pages(works, *lists).drop("page").select(*works.columns, "resources", "genres", "instruments", "parts_names").collect())) == sorted(
        map(str, search.assemble_works(works, *lists).select(*works.columns, "resources", "genres", "instruments", "parts_names").collect())
    )


def test_composer_pages(spark):
    composers = spark.createDataFrame([("a",), ("b",)], "id string")
    aliases = spark.range(30).select(F.lit("a").alias("composer_id"), F.format_string("n%02d", "id").alias("alias"))
    ids = spark.createDataFrame([("a", "viaf", "2"), ("a", "viaf", "1"), ("x", "viaf", "3")], "composer_id string, id_type string, id_value string")
    evidence = spark.createDataFrame([("a", "r", "d")], "composer_id string, rule string, decision string")
    works = spark.createDataFrame([("b",), ("b",)], "composer_id string")
    got = search.composer_pages(composers, aliases, works, ids, evidence, per_page=12).orderBy("id", "page").collect()
    assert [(r.id, r.page, len(r.aliases), len(r.identifiers), len(r.evidence), r.work_count) for r in got] == [("a", 0, 12, 2, 1, 0), ("a", 1, 12, 0, 0, 0), ("a", 2, 6, 0, 0, 0), ("b", 0, 0, 0, 0, 2)]
    assert [a for r in got for a in r.aliases] == [f"n{i:02d}" for i in range(30)] and [i.id_value for i in got[0].identifiers] == ["1", "2"]


@pytest.fixture
def index(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    props = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(i if i % 10 else None, f"n{i}", i % 3) for i in range(100)], "id long, name string, kind int")
    rows.write.jdbc(url, "works", properties=props)
    return url, props


def test_jdbc_ranges(spark, index):
    url, props = index
    found = readers.read_jdbc_index(spark, url, "works", props, key="id", rows_per_task=30)
    assert found.rdd.getNumPartitions() == 4 and sorted(r.name for r in found.collect()) == sorted(f"n{i}" for i in range(100))
    some = readers.read_jdbc_index(spark, url, "works", props, key="id", rows_per_task=10, columns=("id", "name"), where='"kind" = 1')
    assert some.columns == ["id", "name"] and sorted(r.name for r in some.collect()) == sorted(f"n{i}" for i in range(1, 100, 3))
    later = found.where("kind = 2 and id > 50")
    assert "PushedFilters" in later._jdf.queryExecution().executedPlan().toString() and later.count() == sum(i % 3 == 2 and i % 10 > 0 and i > 50 for i in range(100))


def test_jdbc_in_one_task(spark, index):
    url, props = index
    assert readers.read_jdbc_index(spark, url, "works", props).count() == 100
    none = readers.read_jdbc_index(spark, url, "works", props, key="id", rows_per_task=1, where='"kind" = 9')
    assert none.count() == 0 and none.rdd.getNumPartitions() == 1
