"""Resolution of names and identifiers to entities, through aliases and merge chains."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import catalogue_prefix, normalize_name
from ..sources.staging import stage, unstage


class Canonical(NamedTuple):
    map: DataFrame
    rejects: DataFrame


def canonical_map(nodes: DataFrame, *, id: str = "id", status: str = "status", parent: str = "merged_into", rounds: int = 40) -> Canonical:
    """Every node's first non-merged ancestor (id, canonical_id). Chains that break or go in a
    circle are rejects. Pointers double each round, so a chain of n links takes log2(n) rounds; a round
    that finishes no chain leaves only broken ones and circles. Each round's table is written to the shared folder."""
    merged = F.col(status) == "merged"
    state = nodes.select(F.col(id).alias("id"), F.when(merged, F.col(parent)).otherwise(F.col(id)).alias("at"), (~F.coalesce(merged, F.lit(False))).alias("done"))
    state = stage(state)
    finished = state.where("done").count()
    for _ in range(rounds):
        hop = state.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("done").alias("next_done"))
        open_rows = state.where("not done and at is not null")
        moved = open_rows.join(hop, "at", "left").select("id", F.col("next").alias("at"), F.coalesce("next_done", F.lit(False)).alias("done"))
        after = stage(state.where("done or at is null").unionByName(moved))
        unstage(state)
        state, before = after, finished
        finished = state.where("done").count()
        if finished == before:
            break
    else:
        raise RuntimeError(f"chains are still open after {rounds} rounds; allow more")
    return Canonical(state.where("done").select("id", F.col("at").alias("canonical_id")), state.where("not done").select("id"))


def resolve_names(names: DataFrame, aliases: DataFrame, composers: DataFrame, *, name: str = "name") -> DataFrame:
    """Name, composer_id, canonical_name, ambiguous. The key is made once per distinct name. An
    alias of several entities gives the least canonical id and is marked ambiguous."""
    asked = names.select(F.col(name).alias("name")).distinct().withColumn("normalized_alias", normalize_name(F.col("name")))
    owners = aliases.select("normalized_alias", F.col("composer_id").alias("id")).distinct()
    canonical = canonical_map(composers).map
    known = owners.join(canonical, "id").groupBy("normalized_alias").agg(F.min("canonical_id").alias("composer_id"), (F.count_distinct("canonical_id") > 1).alias("ambiguous"))
    labels = composers.select(F.col("id").alias("composer_id"), F.col("name").alias("canonical_name"))
    found = asked.join(known, "normalized_alias", "left").join(labels, "composer_id", "left")
    return found.select("name", "composer_id", "canonical_name", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def find_existing(identities: DataFrame, composers: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(key, composer_id) by MusicBrainz id, then VIAF, Wikidata, MusicBrainz identifiers, then
    exact name; the first kind that hits wins, the least id among equals. Owners of a value are
    reduced to the least before they meet the identities, so a common value makes no pairs."""
    active = composers.where(F.coalesce(F.col("status"), F.lit("active")) != "merged")

    def by_identifier(kind: str, column: str, turn: int) -> DataFrame:
        owners = identifiers.where(F.col("id_type").isin(kind, {"qid": "wikidata_qid"}.get(kind, kind))).groupBy(F.col("id_value").alias(column)).agg(F.min("composer_id").alias("composer_id"))
        return identities.where(F.col(column).isNotNull()).join(owners, column).select("key", "composer_id", F.lit(turn).alias("turn"))

    own = active.where("musicbrainz_id is not null").groupBy(F.col("musicbrainz_id").alias("mbid")).agg(F.min("id").alias("composer_id"))
    hits = identities.join(own, "mbid").select("key", "composer_id", F.lit(1).alias("turn"))
    for turn, (kind, column) in enumerate((("viaf", "viaf"), ("qid", "qid"), ("mbid", "mbid")), 2):
        hits = hits.unionByName(by_identifier(kind, column, turn))
    by_name = identities.where("name is not null").join(active.groupBy("name").agg(F.min("id").alias("composer_id")), "name").select("key", "composer_id", F.lit(5).alias("turn"))
    return hits.unionByName(by_name).groupBy("key").agg(F.min_by("composer_id", F.struct("turn", "composer_id")).alias("composer_id"))


#: Requests that one copy of a set of candidates is for.
PER_COPY = 256


def find_candidates(requests: DataFrame, composers: DataFrame, aliases: DataFrame, identifiers: DataFrame, *, shape: Callable[[Column], Column] = lambda ids: ids) -> DataFrame:
    """request_id and the distinct canonical ids that its name, as alias or name, or any of its
    identifiers leads to. `requests`: request_id, name, identifiers array<struct<id_type, id_value>>.

    Requests that meet the same keys share one set of ids, which is made (and put into `shape`, if given) and written
    once; requests are exchanged by their keys alone and meet the sets last, a row at a time."""
    keyed = requests.select("request_id", normalize_name(F.col("name")).alias("k"), F.explode_outer("identifiers").alias("i"))
    named = keyed.select("request_id", F.lit("").alias("t"), F.col("k").alias("v")).where("v <> ''").distinct()
    values = keyed.select("request_id", F.col("i.id_type").alias("t"), F.col("i.id_value").alias("v")).where("v is not null").distinct()
    of_name = lambda c: (F.lit("").alias("t"), c.alias("v"))
    by_alias = aliases.select(*of_name(F.col("normalized_alias")), F.col("composer_id").alias("id"))
    by_name = composers.select(*of_name(normalize_name(F.col("name"))), "id")
    by_value = identifiers.select(F.col("id_type").alias("t"), F.col("id_value").alias("v"), F.col("composer_id").alias("id"))

    def met(asked: DataFrame, owners: DataFrame, kind: int) -> DataFrame:
        there = owners.groupBy("t", "v").agg(F.count("*").alias("owners"))
        return asked.join(there, ["t", "v"]).select("request_id", F.struct(F.lit(kind).alias("kind"), "t", "v").alias("key"))

    hits = met(named, by_alias, 0).unionByName(met(named, by_name, 0)).unionByName(met(values, by_value, 1))
    asked = hits.groupBy("request_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    lots = stage(asked.groupBy("keys").agg(F.count("*").alias("n")))
    parts = lots.select("keys", F.explode("keys").alias("key"))
    owners = by_alias.unionByName(by_name).select(F.lit(0).alias("kind"), "*").unionByName(by_value.select(F.lit(1).alias("kind"), "*")).select(F.struct("kind", "t", "v").alias("key"), "id")
    owners = owners.join(parts.select("key").distinct(), "key", "left_semi").join(canonical_map(composers).map, "id")
    sets = stage(owners.groupBy("key").agg(F.array_sort(F.collect_set("canonical_id")).alias("ids")))
    alone = parts.where("size(keys) = 1").join(sets, "key", "left").select("keys", "ids")
    several = parts.where("size(keys) > 1").join(sets, "key", "left").groupBy("keys").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    none = F.array().cast(sets.schema["ids"].dataType)
    made = stage(alone.unionByName(several).join(lots, "keys").select("keys", shape(F.coalesce("ids", none)).alias("composer_ids"), F.ceil(F.col("n") / PER_COPY).cast("int").alias("copies")))
    copies = made.select("keys", "composer_ids", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    dealt = asked.join(made.select("keys", "copies"), "keys", "left").select("request_id", "keys", F.pmod(F.xxhash64("request_id"), F.col("copies")).cast("int").alias("copy"))
    found = requests.select("request_id").join(dealt, "request_id", "left").join(copies, ["keys", "copy"], "left")
    return found.select("request_id", F.coalesce("composer_ids", shape(none)).alias("composer_ids"))


def infer_from_catalogue(refs: DataFrame, catalogues: DataFrame, *, ref: str = "ref") -> DataFrame:
    """The composer of a catalogue reference, where exactly one catalogue has its prefix."""
    single = catalogues.groupBy(F.lower("prefix").alias("_p")).agg(F.count("*").alias("_n"), F.first("composer").alias("composer")).where("_n = 1").drop("_n")
    return refs.withColumn("_p", F.lower(catalogue_prefix(F.col(ref)))).join(single, "_p", "left").drop("_p")


def has_alias_like(composers: DataFrame, aliases: DataFrame, q: str) -> DataFrame:
    """Entities with an alias that contains the text (by its normal form)."""
    key = F.lit(q).cast("string")
    hits = aliases.where(F.contains(F.col("normalized_alias"), normalize_name(key))).select(F.col("composer_id").alias("id"))
    return composers.join(hits, "id", "left_semi")


def first_child_evidence(composers: DataFrame, works: DataFrame, evidence: DataFrame, provider: str) -> DataFrame:
    """Evidence rows (composer_id, provider, work_id) for active entities without one, from their work of least id."""
    first = works.where("composer_id is not null").groupBy("composer_id").agg(F.min("id").alias("work_id"))
    open_ids = composers.where("status = 'active'").select(F.col("id").alias("composer_id"))
    have = evidence.where(F.col("provider") == provider).select("composer_id").distinct()
    return open_ids.join(first, "composer_id").join(have, "composer_id", "left_anti").select("composer_id", F.lit(provider).alias("provider"), "work_id")


def lookup_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in a list."""
    return df.join(ids.select(key).distinct(), key, "left_semi")
