from __future__ import annotations

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from tessitura.functions import names
from tessitura.operators import content, ratings, resolve, search, tables
from tessitura.plans import catalogue, identity
from tessitura.sources import readers
from tessitura.streaming.votes import running_counts, total_counts, vote_stream


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_ratings(spark):
    votes = spark.createDataFrame([(1, "a", 7, 2), (2, "b", 7, 4), (3, "c", 7, 5), (4, "a", 7, 1), (5, "d", 7, 9)], "id long, user_id string, work_id long, vote int").withColumn("voted_at", F.timestamp_seconds(F.col("id")))
    got = ratings.item_ratings(votes).first()
    assert got.vote_count == 3 and abs(got.rating - 11 / 3) < 1e-9 and got.confidence == 3 / 5
    assert rows(ratings.first_vote_of_day(votes).rejects, "id", "reason") == [(4, "same_day"), (5, "out_of_range")]
    items = spark.createDataFrame([(8, "g"), (9, "g")], "work_id long, composer_id string")
    empty = ratings.group_ratings(items, items, ratings.item_ratings(votes)).first()
    assert (empty.work_count, empty.vote_count, empty.rating, empty.confidence) == (2, 0, None, 0.0)


def test_canonical_chains(spark):
    nodes = spark.createDataFrame([("a", "active", None), ("b", "merged", "a"), ("c", "merged", "b"), ("d", "merged", "c"), ("x", "merged", "y"), ("y", "merged", "x"), ("z", "merged", "gone")], "id string, status string, merged_into string")
    found = resolve.canonical_map(nodes)
    assert rows(found.map, "id", "canonical_id") == [(n, "a") for n in "abcd"]
    assert rows(found.rejects, "id") == [("x",), ("y",), ("z",)]


def test_merges(spark):
    composers = spark.createDataFrame([(i, i, "active", True, None) for i in "tbc"], "id string, name string, status string, visible boolean, merged_into string")
    aliases = spark.createDataFrame([("b", "B", "b")], "composer_id string, alias string, normalized_alias string")
    ids = spark.createDataFrame([("b", "viaf", "1")], "composer_id string, id_type string, id_value string")
    works = spark.createDataFrame([(1, "t"), (2, "t"), (3, "b"), (4, "b"), (5, "b"), (6, "c")], "id long, composer_id string")
    merges = spark.createDataFrame([("b", "t", "op"), ("c", "t", "op"), ("q", "t", "op"), ("t", "t", "op")], "source string, target string, operation_id string")
    done = identity.apply_merges(composers, aliases, ids, works, merges)
    assert tuple(done.counts.first()) == (2, 4)
    assert rows(done.works.where("composer_id = 't'"), "id") == [(i,) for i in range(1, 7)]
    assert rows(done.rejects, "source", "reason") == [("q", "no_source"), ("t", "target_among_sources")]
    again = identity.apply_merges(done.composers, done.aliases, done.identifiers, done.works, merges.where("source in ('b', 'c')"))
    assert tuple(again.counts.first()) == (0, 0) and rows(again.aliases, "composer_id") == [("b",), ("t",)]


def test_populate_twice(spark):
    given = ["W. A. Mozart", "w. a. mozart", "W A Mozart", "W. A. Mozart", "Wolfgang Amadeus Mozart", "Compositor Inexistente", "", "NA", None]
    frame = spark.createDataFrame([(n,) for n in given], "name string")
    none = spark.createDataFrame([], "id string, name string, status string")
    no_aliases = spark.createDataFrame([], "composer_id string, alias string, normalized_alias string")
    first = catalogue.populate_composers(frame, none, no_aliases)
    assert tuple(first.counts.first()) == (3, 0) and first.aliases.count() == 3
    assert rows(first.aliases.where("normalized_alias = 'w a mozart'"), "alias") == [("W A Mozart",)]
    again = catalogue.populate_composers(frame, first.composers.select("id", "name", "status"), first.aliases.select("composer_id", "alias", "normalized_alias"))
    assert tuple(again.counts.first()) == (0, 3)


def test_ingest_identifiers(spark):
    schema = "entity_id string, scheme string, value string, source string, pos long"
    current = spark.createDataFrame([], "entity_type string, entity_id string, scheme string, value string, source string")
    snap = spark.createDataFrame([("w", "isni", "1", "s", 1), ("w", "wikidata", "Q1", "s", 2), ("", "isni", "5", "s", 3), ("v", "isni", "1", "s", 4)], schema)
    first = identity.ingest_identifiers(current, snap, "composer")
    assert dict(first.outcomes.collect()) == {"inserted": 2, "invalid": 1, "conflict": 1}
    again = identity.ingest_identifiers(first.table, spark.createDataFrame([("w", "isni", "1", "s", 1), ("w", "wikidata", "Q2", "s", 2)], schema), "composer")
    assert dict(again.outcomes.collect()) == {"ignored": 1, "updated": 1}


def test_catalogue_inference_and_seed(spark):
    seeds = catalogue.seed_catalogues(spark, spark.createDataFrame([], "prefix string, composer string, catalogue_name string, creator string, ordering_criterion string"))
    assert seeds.count() == 22 and catalogue.seed_catalogues(spark, seeds).count() == 22
    refs = spark.createDataFrame([("BWV 846",), ("K. 15h",)], "ref string")
    assert rows(resolve.infer_from_catalogue(refs, seeds), "ref", "composer") == [("BWV 846", "Johann Sebastian Bach"), ("K. 15h", None)]


def test_upsert_and_lists(spark):
    old = spark.createDataFrame([(1, True, "a"), (2, False, "b")], "k int, anchor boolean, v string")
    new = spark.createDataFrame([(1, False), (3, True)], "k int, anchor boolean")
    assert rows(tables.upsert(old, new, ["k"], rules={"anchor": tables.keep_flag}), "k", "anchor", "v") == [(1, True, "a"), (2, False, "b"), (3, True, None)]
    child = spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], "id int, position int, tag string")
    fresh = spark.createDataFrame([(1, [" q ", "", "p", "q"])], "id int, tag array<string>")
    assert rows(tables.replace_list(child, fresh, "id", "tag"), "id", "position", "tag") == [(1, 0, "q"), (1, 1, "p"), (2, 0, "y")]


def test_index_files(spark, tmp_path):
    path = tmp_path / "index.csv"
    path.write_text("﻿relative_path,archive,url,key\nmxl/4/5/8/000458.mxl,one.tar.gz,http://src/1.tar.gz,K618\n,one.tar.gz,,\nmxl/1/1/2.mxl,one.tar.gz,http://other,NA\n")
    index = readers.read_index_csv(spark, str(path))
    archives = spark.createDataFrame([], "id long, name string, url string, status string")
    entries = spark.createDataFrame([], "id long, archive_id long, relative_path string, logical_id string, composer string, title string, work_id long, status string")
    first = catalogue.build_index(index, archives, entries)
    assert tuple(first.counts.first()) == (2, 1, 2)
    assert rows(first.archives, "name", "url") == [("one.tar.gz", "http://src/1.tar.gz")]
    again = catalogue.build_index(index, first.archives, first.entries)
    assert tuple(again.counts.first()) == (2, 0, 0) and again.entries.count() == 2
    with pytest.raises(ValueError):
        readers.read_name_csv(spark, str(path))


def test_expand_archives(spark):
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w") as tar:
        for name, body in (("a.mxl", b"one"), ("b.mxl", b"one")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    archives = spark.createDataFrame([(1, data.getvalue(), "imported"), (2, b"bad", "imported")], "id long, content binary, status string")
    entries = spark.createDataFrame([(1, 1, "./a.mxl"), (2, 1, "b.mxl"), (3, 1, "gone.mxl"), (4, 2, "x.mxl")], "id long, archive_id long, relative_path string")
    done = content.expand_archives(archives, entries, content.archive_members(archives))
    assert rows(done.entries, "id", "status") == [(1, "ready"), (2, "ready"), (3, "failed"), (4, "failed")]
    assert done.files.count() == 1 and rows(done.archives, "id", "status") == [(1, "materialized"), (2, "failed")]


def test_vote_stream(spark, tmp_path):
    schema = "id long, user_id string, work_id long, vote int, voted_at timestamp"
    batch = spark.createDataFrame([(1, "a", 7, 2), (2, "a", 7, 4), (3, "b", 7, 5), (4, "b", 8, 5), (5, "c", 7, 9)], "id long, user_id string, work_id long, vote int")
    batch.withColumn("voted_at", F.timestamp_seconds(F.col("id"))).coalesce(1).write.parquet(str(tmp_path / "in"))
    items = spark.createDataFrame([(7,)], "work_id long")
    stream = vote_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), items)
    running_counts(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert rows(total_counts(spark, str(tmp_path / "out")), "work_id", "n") == [(7, 2)]


def test_search_is_literal_and_blank_lists_all(spark):
    works = spark.createDataFrame([(1, "Ária 100%", "x"), (2, "aria", "y"), (3, "zz", "Aria")], "id long, title string, composer string")
    found = search.search_works(works, "aria", others={"composer": 40})
    assert [(r.id, r.score) for r in found.collect()] == [(2, 100), (1, 90), (3, 40)]
    assert search.search_works(works, "%", others={"composer": 40}).count() == 1 and search.search_works(works, " ", others={}).count() == 3
    assert names.fold_key(F.lit("x")) is not None


def test_common_identifiers_make_no_pairs(spark):
    from tessitura.operators import resolve

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    def reduced(frame):
        """Of each inner join of the plan, whether its right side is aggregated."""
        plan = frame._jdf.queryExecution().analyzed()
        joins = [n for n in nodes(plan) if n.nodeName() == "Join" and n.joinType().toString() == "Inner"]
        return [any(n.nodeName() == "Aggregate" for n in nodes(j.children().apply(1))) for j in joins]

    composers = spark.createDataFrame([(i, f"n{i % 9}", "active", f"m{i}", None) for i in range(60)], "id long, name string, status string, musicbrainz_id string, merged_into long")
    ids = composers.selectExpr("id as composer_id", "'viaf' as id_type", "cast(id % 2 as string) as id_value")
    who = spark.createDataFrame([(i, None, str(i % 3), None, "n4") for i in range(30)], "key long, mbid string, viaf string, qid string, name string")
    found = resolve.find_existing(who, composers, ids)
    assert all(reduced(found)) and {r.key: r.composer_id for r in found.collect()} == {i: (0, 1, 4)[i % 3] for i in range(30)}
    asked = who.selectExpr("key as request_id", "if(key = 2, 'n4', 'none') as name", "array(struct('viaf' as id_type, viaf as id_value)) as identifiers")
    aliases = spark.createDataFrame([("none5", 3)], "normalized_alias string, composer_id long")
    found = resolve.find_candidates(asked, composers.drop("musicbrainz_id"), aliases, ids)
    assert sum(reduced(found)) == 3
    want = {i: [x for x in range(60) if i % 3 < 2 and x % 2 == i % 3 or i == 2 and x % 9 == 4] for i in range(30)}
    assert {r.request_id: r.composer_ids for r in found.collect()} == want


def test_archives_of_any_size_and_registry(spark, tmp_path):
    from tessitura.sources import registry

    with tarfile.open(tmp_path / "one.tar.gz", "w:gz") as tar:
        for name in ("a.mxl", "d/b.mxl"):
            info = tarfile.TarInfo(name)
            info.size = 3_000_000
            tar.addfile(info, io.BytesIO(name.encode() * 600_000))
    (tmp_path / "bad.tar").write_bytes(b"no archive")
    archives = spark.createDataFrame([(1, str(tmp_path / "one.tar.gz")), (2, str(tmp_path / "bad.tar"))], "id long, path string")
    assert rows(content.archive_members_at(archives), "archive_id", "relative_path", "size") == [(1, "a.mxl", 3_000_000), (1, "d/b.mxl", 3_000_000)]
    assert len(registry.tables()) == 23 and registry.key_of("work_statistics") == "work_id"
    with pytest.raises(ValueError):
        registry.scan(spark, str(tmp_path), "users")


def test_moves_of_aliases(spark):
    aliases = spark.createDataFrame([("a", "X", "x"), ("a", "x.", "x"), ("b", "X", "x"), ("c", "Y", "y"), ("c", "y", "y")], "composer_id string, alias string, normalized_alias string")
    works = spark.createDataFrame([(1, "a", "X"), (2, "a", "other"), (3, "c", "Y")], "id long, composer_id string, composer string")
    moves = spark.createDataFrame([("a", "X", "b"), ("a", "X", "b"), ("c", "Y", "a"), ("c", "Y", "b")], "composer_id string, alias string, target string")
    done = identity.move_aliases(aliases, works, moves)
    assert rows(done.works, "id", "composer_id") == [(1, "b"), (2, "a"), (3, "c")] and rows(done.rejects, "composer_id", "alias") == [("c", "Y")]
    assert rows(done.aliases, "composer_id", "alias") == [("a", "x."), ("b", "X"), ("c", "Y"), ("c", "y")]


def test_clean_names_until_stable(spark):
    composers = spark.createDataFrame([(1, "Bach 1", "active", True, None), (2, "Bach", "active", True, None), (3, " bach ", "active", True, None), (4, "123", "active", True, None)], "id long, name string, status string, visible boolean, merged_into long")
    aliases = spark.createDataFrame([(1, "B", "b")], "composer_id long, alias string, normalized_alias string")
    works = spark.createDataFrame([(7, 1), (8, 3), (9, 4)], "id long, composer_id long")
    done = identity.clean_names(composers, aliases, works)
    assert rows(done.works, "id", "composer_id") == [(7, 2), (8, 2), (9, 4)] and tuple(done.counts.first()) == (0, 2)
    assert rows(done.aliases, "composer_id") == [(1,), (2,)] and rows(done.composers.where("status = 'merged'"), "id", "merged_into") == [(1, 2), (3, 2)]


def test_recogniser_is_asked_where_a_mark_points_nowhere(spark):
    frame = spark.createDataFrame([("Song by",), ("by Ann Lee",), ("plain words",)], "s string")
    out = frame.select(names.extract_name(F.col("s"), lambda c: F.when(c != "plain words", "Ada Lovelace")).alias("n"))
    assert [r.n for r in out.collect()] == ["Ada Lovelace", "Ann Lee", None]


def test_long_merge_circles_end(spark):
    ring = [(i, "merged", (i + 1) % 5) for i in range(5)] + [(9, "merged", 0)] + [(100 + i, "merged", 101 + i) for i in range(60)] + [(160, "active", None)]
    found = resolve.canonical_map(spark.createDataFrame(ring, "id long, status string, merged_into long"))
    assert found.map.where("canonical_id = 160").count() == 61 and found.rejects.count() == 6


def test_csv_in_pieces(spark, tmp_path):
    lines = ["mxl,title"] + [f"x/{i % 50}.mxl,t{i}" for i in range(2000)]
    (tmp_path / "m.csv").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for multi_line in (True, False):
            out = readers.read_metadata_csv(spark, str(tmp_path / "m.csv"), multi_line=multi_line)
            assert rows(out, "content_key", "title") == sorted(((str(i), f"t{1950 + i}") for i in range(50)), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
