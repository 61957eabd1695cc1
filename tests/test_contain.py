"""The containment join against every pair."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessitura.operators import contain


def lists(spark, names, needles):
    texts = spark.createDataFrame(list(enumerate(names)), "id long, text string")
    return texts, spark.createDataFrame([(n,) for n in needles], "needle string")


def brute(names, needles, fold=lambda s: s.lower().rstrip(" ")):
    return sorted({(i, n) for i, t in enumerate(names) if t is not None for n in needles if n and n.strip() and fold(n) in fold(t)})


@pytest.mark.parametrize(("gram", "per_salt"), [(3, 100_000), (3, 2), (1, 3), (5, 100_000)])
def test_every_pair(spark, gram, per_salt):
    rng = random.Random(gram)
    names = ["".join(rng.choice("abcA %_") for _ in range(rng.randrange(12))) for _ in range(150)] + [None, "", "aaaaaaa", "aaaaaaa"]
    needles = ["".join(rng.choice("abc %_") for _ in range(rng.randrange(7))) for _ in range(80)] + [None, "", " ", "zzz", "aaaaaaaaaaaa"]
    got = contain.contains_join(*lists(spark, names, needles), gram=gram, per_salt=per_salt)
    assert sorted(map(tuple, got.collect())) == brute(names, needles)


def test_plan_has_no_nested_loop(spark):
    got = contain.contains_join(*lists(spark, ["one two", "Élan vital"], ["two", "elan", "Q"]))
    assert sorted(map(tuple, got.collect())) == [(0, "two"), (1, "elan")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_one_name_in_most_rows(spark):
    texts = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, "the same name").otherwise(F.concat(F.lit("n"), "id")).alias("text"))
    needles = spark.createDataFrame([("same",), ("n1",), ("he s",)], "needle string")
    got = contain.contains_join(texts, needles, per_salt=100).groupBy("needle").count()
    expected = {"same": 13_333, "he s": 13_333, "n1": sum(f"n{i}".startswith("n1") for i in range(0, 20_000, 3))}
    assert {r.needle: r["count"] for r in got.collect()} == expected


def test_empty_sides(spark):
    texts, needles = lists(spark, ["a"], ["a"])
    assert contain.contains_join(texts.limit(0), needles).count() == contain.contains_join(texts, needles.limit(0)).count() == 0
    assert contain.contains_join(texts, needles).columns == ["id", "needle"]
    assert contain.contains_join(texts, needles.select(F.lit(9).alias("id"), "needle"), needle_id="id").columns == ["id", "needle_id"]


def test_names_and_aliases(spark):
    composers = spark.createDataFrame([(1, "Dvořák", "active"), (2, "Smith", "active"), (3, "Dvorak", "merged"), (4, None, "active")], "id long, name string, status string")
    aliases = spark.createDataFrame([(2, "a dvorak jr"), (3, "dvorak"), (4, "x")], "composer_id long, normalized_alias string")
    needles = spark.createDataFrame([("DVOŘ",), ("A. Dvo",), ("mit",)], "needle string")
    assert sorted(map(tuple, contain.composers_like_any(composers, aliases, needles).collect())) == [(1, "DVOŘ"), (2, "A. Dvo"), (2, "DVOŘ"), (2, "mit")]
