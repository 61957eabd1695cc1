"""Name functions go over a text few times, and what spares them passes is exact."""

from __future__ import annotations

import sys

import pytest
from pyspark.sql import functions as F

from tessitura.functions import names


@pytest.mark.parametrize("form", ["column", "sql"])
def test_score_is_summed_once(spark, form):
    names.register_functions(spark)
    rows = spark.createDataFrame([("x",)], "x string")
    plan = rows.select((names.validate_name(F.col("x")) if form == "column" else F.expr("validate_name(x)")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("aggregate("), plan.count("regexp_replace(")) == (1, 1)


def test_white_space_and_signs_are_whole(spark):
    signs = spark.range(1, sys.maxunicode + 1).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    space = signs.where(r"c rlike '(?U)^\\s'").agg(F.array_sort(F.collect_list("c"))).first()[0]
    assert space == sorted(names.WHITE_SPACE)
    assert all(spark.createDataFrame([(s,) for s in names.SPELLED_OUT], "c string").select(F.col("c").rlike(names._SIGNS)).toPandas().iloc[:, 0])


def test_validity_by_first_tokens_and_by_all(spark):
    names.register_functions(spark)
    texts = ["Ann " * 3 + "low " * 60, "low " * 60 + "Ann Lee", "low " * 60 + "Ann", "Ann Lee " * 30 + "song", "low " * 39 + "Ann Lee", "de " * 45, "De " * 2, "x", "Ann", "", " Ann Lee ", "aé " * 50 + "ÉA"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", names.clean_name(F.col("x")).alias("o"))
    out = rows.select(F.when((F.col("o") != "") & names.validate_name(F.col("o"))["valid"], F.col("o")), names.extract_name(F.col("x")), F.expr("extract_name(x)")).collect()
    assert [r[0] for r in out] == [r[1] for r in out] == [r[2] for r in out] and sum(r[0] is None for r in out) == 5
