"""Cleaning of names: who is renamed or merged is found once, in a table without names."""

from __future__ import annotations

from tessitura.plans import identity


def test_merges_come_from_hashes_of_keys(spark):
    given = [(1, "Bach 1", "active"), (2, "bàch", "active"), (3, "Bach", "active"), (4, " 12", "active"), (5, "Bach!", "candidate"), (6, None, "active"), (7, "Lee?", "active"), (8, "(Lee)", "active")]
    composers = spark.createDataFrame([(i, n, s, True, None) for i, n, s in given], "id long, name string, status string, visible boolean, merged_into long")
    once = identity.clean_names(composers)
    for table in (once.merges, once.counts):
        plan = table._jdf.queryExecution().analyzed().toString()
        assert "regexp_replace" not in plan and "name#" not in plan
    assert sorted((r.source, r.target) for r in once.merges.collect()) == [(1, 2), (3, 2), (8, 7)] and len({r.operation_id for r in once.merges.collect()}) == 2
    assert {r.id: r.name for r in once.composers.collect()} == {i: n for i, n, _ in given} | {7: "Lee"} and tuple(once.counts.first()) == (1, 3)
    assert once.composers.columns == composers.columns
