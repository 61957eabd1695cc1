"""Requests that meet the same keys share one list of candidates, which no exchange carries once per request."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.operators import resolve


def test_lists_are_made_once_per_set_of_keys(spark, monkeypatch):
    monkeypatch.setattr(resolve, "PER_COPY", 3, raising=False)
    composers = spark.createDataFrame([(i, f"n{i % 9}", "merged" if i % 10 == 7 else "active", i - 1 if i % 10 == 7 else None) for i in range(60)], "id long, name string, status string, merged_into long")
    ids = composers.selectExpr("id as composer_id", "'viaf' as id_type", "cast(id % 2 as string) as id_value")
    aliases = spark.createDataFrame([("also", 3), ("also", 7), ("n4", 5)], "normalized_alias string, composer_id long")
    asked = spark.range(40).selectExpr("id as request_id", "case id % 4 when 0 then 'n4' when 1 then 'Also' when 2 then 'none' end as name", "if(id % 5 = 4, null, array(struct('viaf' as id_type, cast(id % 3 as string) as id_value))) as identifiers")
    found = resolve.find_candidates(asked, composers, aliases, ids)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "collect_list(ids" not in plan and "flatten(" not in plan

    def want(i: int) -> list[int]:
        of = lambda k: {x - 1 if x % 10 == 7 else x for x in k}
        name = ({x for x in range(60) if x % 9 == 4} | {5}, {3, 7}, set(), set())[i % 4]
        return sorted(of(name | ({x for x in range(60) if x % 2 == i % 3} if i % 5 < 4 and i % 3 < 2 else set())))

    assert {r.request_id: r.composer_ids for r in found.collect()} == {i: want(i) for i in range(40)}
    joined = resolve.find_candidates(asked, composers, aliases, ids, shape=lambda c: F.array_join(c, ","))
    assert {r.request_id: r.composer_ids for r in joined.collect()} == {i: ",".join(map(str, want(i))) for i in range(40)}
