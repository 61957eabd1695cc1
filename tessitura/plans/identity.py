"""Entities of persons: review, merging, candidates, resolver evidence, identifiers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import id_type, identity_payload, is_strong, uuid5
from ..functions.names import (
    ANONYMOUS_IN_CANDIDATES, attribution_type, candidate_label, classify_name, clean_name, clip, fold_key, is_anonymous, is_mojibake, let, name_key, norm_light, normalize_name, strip, text,
)
from ..operators.resolve import find_candidates, find_existing
from ..operators.tables import edit_rows, first_per_key, flag_conflicts, insert_ignore
from ..sources.staging import stage
from .catalogue import UNKNOWN_ID

# What stands before the identifier in the id of an entity made by matching.
MATCH_PREFIX = "250k:"
# Resolver outcomes.
RESOLVED = ["resolved_by_mbid", "resolved_by_viaf", "resolved_by_qid_plus_evidence", "resolved_by_name_dates"]
RESOLVABLE = [*RESOLVED, "resolved_by_prolific", "matched_existing"]


class Merge(NamedTuple):
    composers: DataFrame
    aliases: DataFrame
    identifiers: DataFrame
    works: DataFrame
    history: DataFrame
    counts: DataFrame
    rejects: DataFrame


def apply_merges(composers: DataFrame, aliases: DataFrame, identifiers: DataFrame, works: DataFrame, merges: DataFrame) -> Merge:
    """Merges (source, target, operation_id). A target exists and is not merged, a source exists,
    is no target, and is not merged elsewhere; a repeated merge changes nothing. Aliases and
    identifiers are copied to the target, works move, sources are merged and hidden."""
    ids = composers.select(F.col("id"), F.col("status"), F.col("merged_into"))
    asked = merges.distinct()
    s = ids.select(F.col("id").alias("source"), F.col("status").alias("s_status"), F.col("merged_into").alias("s_into"))
    t = ids.select(F.col("id").alias("target"), F.col("status").alias("t_status"))
    targets = asked.select(F.col("target").alias("source"), F.lit(True).alias("is_target")).distinct()
    several = asked.groupBy("source").agg((F.count_distinct("target") > 1).alias("several"))
    seen = asked.join(s, "source", "left").join(t, "target", "left").join(targets, "source", "left").join(several, "source", "left")
    merged = F.coalesce(F.col("s_status") == "merged", F.lit(False))
    reason = (
        F.when(F.col("t_status").isNull(), "no_target").when(F.col("t_status") == "merged", "target_merged").when(F.col("s_status").isNull(), "no_source")
        .when((F.col("source") == F.col("target")) | F.coalesce("is_target", F.lit(False)), "target_among_sources").when(merged & (F.col("s_into") != F.col("target")), "merged_elsewhere")
        .when(F.col("several"), "several_targets")
    )
    judged = seen.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull() & ~merged).select("source", "target", "operation_id")
    own = good.select(F.col("source").alias("composer_id"), F.col("target").alias("_target"))

    def copied(table: DataFrame, keys: list[str]) -> DataFrame:
        new = table.join(own, "composer_id").withColumn("composer_id", F.col("_target")).select(*table.columns).dropDuplicates(keys)
        return insert_ignore(table, new, keys)

    moved = works.join(own, "composer_id", "left")
    n_moved = moved.agg(F.count_if(F.col("_target").isNotNull()).alias("works_moved"))
    new_works = moved.withColumn("composer_id", F.coalesce("_target", "composer_id")).select(*works.columns)
    changed = composers.join(good.select(F.col("source").alias("id"), F.col("target").alias("_target")), "id", "left")
    hit = F.col("_target").isNotNull()
    changed = changed.withColumns({"status": F.when(hit, "merged").otherwise(F.col("status")), "visible": F.when(hit, False).otherwise(F.col("visible")), "merged_into": F.coalesce("_target", "merged_into")})
    history = good.select("operation_id", F.col("source").alias("source_composer_id"), F.col("target").alias("target_composer_id"))
    counts = good.agg(F.count("*").alias("merged")).crossJoin(n_moved)
    return Merge(
        changed.select(*composers.columns), copied(aliases, ["composer_id", "normalized_alias"]), copied(identifiers, ["composer_id", "id_type", "id_value"]),
        new_works, history, counts, judged.where("reason is not null").select("source", "target", "operation_id", "reason"),
    )


class Moved(NamedTuple):
    aliases: DataFrame
    works: DataFrame
    rejects: DataFrame


def move_aliases(aliases: DataFrame, works: DataFrame, moves: DataFrame) -> Moved:
    """Moves (composer_id, alias, target): the alias goes, and works with that owner and spelling follow.
    A move given twice is one; moves of one alias to several targets are rejects. An alias that the
    target has already is dropped; of several moved ones with one normal form the first by spelling stays."""
    asked = moves.groupBy("composer_id", "alias").agg(F.min("target").alias("_t"), (F.count_distinct("target") > 1).alias("_several"))
    m, keys = asked.where("not _several and _t is not null").drop("_several"), ["composer_id", "normalized_alias"]
    seen = aliases.join(m, ["composer_id", "alias"], "left")
    moved = seen.where("_t is not null").withColumn("composer_id", F.col("_t")).select(*aliases.columns)
    stayed = seen.where("_t is null").select(*aliases.columns)
    w = works.join(m.withColumnRenamed("alias", "composer"), ["composer_id", "composer"], "left").withColumn("composer_id", F.coalesce("_t", "composer_id"))
    return Moved(insert_ignore(stayed, first_per_key(moved, keys, ["alias"]), keys), w.select(*works.columns), asked.where("_several").select("composer_id", "alias"))


def promote_aliases(composers: DataFrame, aliases: DataFrame, works: DataFrame, picks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Picks (composer_id, alias) become entities of their own, with the works of that spelling."""
    made = picks.select("composer_id", "alias").distinct().withColumn("target", uuid5(F.concat(F.lit("alias:"), normalize_name(F.col("alias")))))
    new = made.select(F.col("target").alias("id"), F.col("alias").alias("name"), F.lit("active").alias("status"), F.lit(True).alias("visible")).dropDuplicates(["id"])
    moved = move_aliases(aliases, works, made)
    return insert_ignore(composers, new, ["id"]), moved.aliases, moved.works


def to_attribution(composers: DataFrame, works: DataFrame, ids: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Works of the entities get type and note and lose the entity, which is retired."""
    chosen = composers.join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("composer_id"), F.left("name", F.lit(255)).alias("_note"))
    w = works.join(chosen, "composer_id", "left")
    hit = F.col("_note").isNotNull()
    w = w.withColumns({"attribution_type": F.when(hit, kind).otherwise(F.col("attribution_type")), "attribution_note": F.coalesce("_note", "attribution_note"), "composer_id": F.when(~hit, F.col("composer_id"))})
    retired = composers.join(ids.select("id", F.lit(True).alias("_r")).distinct(), "id", "left")
    retired = retired.withColumns({"status": F.when(F.col("_r"), "attribution").otherwise(F.col("status")), "visible": F.when(F.col("_r"), False).otherwise(F.col("visible"))})
    return retired.select(*composers.columns), w.select(*works.columns)


def add_aliases(aliases: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New (composer_id, alias) pairs, blanks dropped; those whose normal form the entity has are duplicates."""
    keyed = new.withColumn("alias", strip(text(F.col("alias")))).where("alias <> ''").withColumn("normalized_alias", normalize_name(F.col("alias")))
    keys = ["composer_id", "normalized_alias"]
    first = first_per_key(keyed, keys, ["alias"])
    duplicates = keyed.join(aliases.select(*keys).distinct(), keys, "left_semi").select("composer_id", "alias").unionByName(
        keyed.join(first.select("composer_id", "alias"), ["composer_id", "alias"], "left_anti").select("composer_id", "alias")
    )
    return insert_ignore(aliases, first, keys), duplicates.distinct()


def classify_pending(composers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States of active, unreviewed entities by the form of their names; ambiguous ones are left. With counts."""
    pending = (F.col("status") == "active") & (F.coalesce("review_status", F.lit("not_reviewed")) == "not_reviewed")
    verdict = classify_name(F.col("name"))
    done = composers.withColumn("_v", F.when(pending, verdict)).withColumn("review_status", F.coalesce("_v", "review_status"))
    return done.drop("_v"), done.where("_v is not null").groupBy(F.col("_v").alias("verdict")).agg(F.count("*").alias("n"))


class Cleaned(NamedTuple):
    composers: DataFrame
    merges: DataFrame
    counts: DataFrame
    aliases: DataFrame | None = None
    works: DataFrame | None = None


def clean_names(composers: DataFrame, aliases: DataFrame | None = None, works: DataFrame | None = None, rounds: int = 10) -> Cleaned:
    """Cleans names of active entities. Of those whose clean names are equal (case and accents
    aside) one stays: an entity that had the clean name already, else the least id; the others are
    merges (source, target, operation_id).

    With aliases and works the merges are applied to all three, and all is done again until nothing
    changes; counts and merges are those of all rounds. Without them, merges are for apply_merges."""
    if aliases is None or works is None:
        return _clean_once(composers)
    nobody = aliases.select("composer_id", F.lit("").alias("id_type"), F.lit("").alias("id_value")).limit(0)
    merges = counts = None
    for _ in range(rounds):
        once = _clean_once(composers)
        renamed, merged = once.counts.first()
        merges = once.merges if merges is None else merges.unionByName(once.merges)
        counts = once.counts if counts is None else counts.unionByName(once.counts)
        if not renamed and not merged:
            break
        done = apply_merges(once.composers, aliases, nobody, works, once.merges)
        composers, aliases, works = stage(done.composers), stage(done.aliases), stage(done.works)
    else:
        raise RuntimeError(f"names still change after {rounds} rounds; allow more")
    return Cleaned(composers, merges, counts.agg(F.sum("renamed").alias("renamed"), F.sum("merged").alias("merged")), aliases, works)


def _clean_once(composers: DataFrame) -> Cleaned:
    """One round. Names are cleaned once to find out who is renamed or merged, which is staged as ids and hashes of the
    clean names' keys (SHA-256), and once more where a name changes; only the rows themselves carry names."""

    def seen(clean: Column) -> Column:
        changed = (F.col("name") != clean).cast("int").alias("changed")
        return F.when(clean != "", let(fold_key(clean).cast("binary"), lambda k: F.struct(changed, F.unhex(F.sha2(k, 256)).alias("key"), F.sha1(k).alias("operation_id"))))

    active = stage(composers.where("status = 'active'").select("id", let(clean_name(F.col("name")), seen).alias("s"))).where("s is not null").select("id", "s.*")
    heads = active.groupBy("key").agg(F.min(F.struct("changed", "id")).alias("h")).select("key", F.col("h.id").alias("target"))
    pairs = stage(active.join(heads, "key").select("id", "target", "operation_id", "changed"))
    merges = pairs.where("id <> target").select(F.col("id").alias("source"), "target", "operation_id")
    renamed = pairs.where("id = target and changed = 1")
    counts = renamed.agg(F.count("*").alias("renamed")).crossJoin(merges.agg(F.count("*").alias("merged")))
    marked = composers.join(renamed.select("id", F.lit(True).alias("_renamed")).distinct(), "id", "left")
    name = F.when(F.col("_renamed") & (F.col("status") == "active"), clean_name(F.col("name"))).otherwise(F.col("name"))
    return Cleaned(marked.withColumn("name", name).select(*composers.columns), merges, counts)


def flag_mojibake(composers: DataFrame, mode: str = "incorrect") -> DataFrame:
    """Marks corrupt names as incorrect, or sets the reason `encoding_anomaly` (mode "suspicious")."""
    bad = (F.col("status") == "active") & is_mojibake(F.col("name"))
    if mode == "suspicious":
        return composers.withColumn("review_reason", F.when(bad, "encoding_anomaly").otherwise(F.col("review_reason")))
    return composers.withColumn("review_status", F.when(bad, "incorrect").otherwise(F.col("review_status")))


def backfill_attribution(works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Composers that are no persons become attribution type and note; moved rows are typed again. With counts."""
    source = F.coalesce(F.nullif(F.trim("composer"), F.lit("")), F.col("attribution_note"))
    kind = attribution_type(source)
    done = works.withColumn("_k", kind).withColumn("_s", clip(source, 255))
    hit = F.col("_k").isNotNull()
    done = done.withColumns({"attribution_type": F.coalesce("_k", "attribution_type"), "attribution_note": F.when(hit, F.col("_s")).otherwise(F.col("attribution_note")), "composer": F.when(~hit, F.col("composer")), "composer_id": F.when(~hit, F.col("composer_id"))})
    return done.select(*works.columns), done.where(hit).groupBy("attribution_type").agg(F.count("*").alias("n"))


def clean_candidates(resolutions: DataFrame, run: str | None = None) -> DataFrame:
    """Unknown attributions of a run with counts, keys and labels; real ones and those to review stay."""
    rows = resolutions if run is None else resolutions.where(F.col("test_id") == run)
    rows = rows.where((F.col("status") == "unknown") & (strip(text(F.col("attribution"))) != ""))
    groups = rows.groupBy(fold_key(F.col("attribution")).alias("_k")).agg(F.min("attribution").alias("attribution"), F.count("*").alias("work_count"))
    labelled = groups.withColumn("l", candidate_label(F.col("attribution")))
    out = labelled.select("attribution", name_key(F.col("attribution"), ANONYMOUS_IN_CANDIDATES).alias("name_key"), clean_name(F.col("attribution")).alias("cleaned_name"), "work_count", "l.label", "l.verdict")
    return out.where(F.col("label").isin("real", "review"))


class Incorporated(NamedTuple):
    composers: DataFrame
    aliases: DataFrame
    identifiers: DataFrame | None
    works: DataFrame
    counts: DataFrame


def incorporate_candidates(candidates: DataFrame, resolutions: DataFrame, composers: DataFrame, aliases: DataFrame, works: DataFrame, prolific: int = 5) -> Incorporated:
    """E5: resolvable candidates by name key; the largest row gives name and status; visible when strong
    or prolific; reused by name, case aside; variants are aliases; all works of that key are linked."""
    rows = candidates.where(F.col("resolved_status").isin(RESOLVABLE) & (F.coalesce("name_key", F.lit("")) != ""))
    head = first_per_key(rows, ["name_key"], [F.desc("work_count"), "attribution"])
    strong = F.col("resolved_status").isin(RESOLVED)
    totals = rows.groupBy("name_key").agg(F.sum("work_count").alias("total"))
    groups = head.join(totals, "name_key").select("name_key", F.coalesce(F.nullif("cleaned_name", F.lit("")), F.nullif("attribution", F.lit("")), F.col("name_key")).alias("name"), (strong | (F.col("total") >= prolific)).alias("visible"))
    existing = composers.where("status <> 'merged'").groupBy(F.lower("name").alias("_l")).agg(F.min("id").alias("known"))
    groups = groups.withColumn("_l", F.lower("name")).join(existing, "_l", "left").withColumn("id", F.coalesce("known", uuid5(F.concat(F.lit("candidate:"), F.col("name_key")))))
    fresh = groups.where("known is null")
    made = fresh.select("id", "name", F.lit("active").alias("status"), "visible", F.lit("identity-resolver").alias("source_system"))
    variants = rows.join(groups.select("name_key", F.col("id").alias("composer_id")), "name_key").select("composer_id", F.col("attribution").alias("alias"))
    new_aliases, _ = add_aliases(aliases, variants)
    keyed = resolutions.select("work_id", name_key(F.col("attribution"), ANONYMOUS_IN_CANDIDATES).alias("name_key")).join(groups.select("name_key", F.col("id").alias("_cid")), "name_key")
    links = keyed.groupBy(F.col("work_id").alias("id")).agg(F.min("_cid").alias("composer_id"))
    linked = edit_rows(works, links, "id")
    counts = groups.agg(F.count("*").alias("groups"), F.count_if(F.col("known").isNull()).alias("created")).crossJoin(links.agg(F.count("*").alias("works_linked")))
    return Incorporated(composers.unionByName(made, allowMissingColumns=True), new_aliases, None, linked, counts)


def incorporate_resolutions(resolutions: DataFrame, composers: DataFrame, aliases: DataFrame, identifiers: DataFrame, works: DataFrame) -> Incorporated:
    """Links matched works; groups resolved ones by identity key and reuses or creates (visible with
    VIAF or MBID); ambiguous ones become hidden placeholders per name key."""
    rows = resolutions.withColumn("p", F.when(F.col("status").isin(RESOLVED), identity_payload(F.col("decision_reason"), F.col("evidence_json"))))
    matched = rows.where("status = 'matched_existing'").select(F.col("work_id").alias("id"), F.get_json_object("evidence_json", "$.maestro.composer_id").alias("composer_id"))
    keyed = rows.where("p is not null").select("work_id", "p.*")
    heads = first_per_key(keyed, ["key"], ["work_id"])
    found = find_existing(heads.select("key", "name", "viaf", "qid", "mbid"), composers, identifiers)
    groups = heads.join(found, "key", "left").withColumn("id", F.coalesce("composer_id", uuid5(F.col("key"))))
    fresh = groups.where("composer_id is null")
    made = fresh.select("id", F.coalesce("name", "key").alias("name"), F.lit("active").alias("status"), F.col("strong").alias("visible"), F.col("mbid").alias("musicbrainz_id"), F.lit("identity-resolver").alias("source_system"))
    ambiguous = rows.where("status = 'ambiguous'").select(name_key(F.col("attribution")).alias("k"), "attribution").where("k <> ''").groupBy("k").agg(F.min("attribution").alias("name"))
    places = ambiguous.select(uuid5(F.concat(F.lit("ambiguous:"), F.col("k"))).alias("id"), "name", F.lit("candidate").alias("status"), F.lit(False).alias("visible"), F.lit("identity-resolver").alias("source_system"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("id_type"), F.col(c).alias("id_value"), F.lit(k == "viaf").alias("is_identity_anchor")) for k, c in (("viaf", "viaf"), ("wikidata_qid", "qid"), ("mbid", "mbid"), ("isni", "isni")))))
    new_ids = groups.select(F.col("id").alias("composer_id"), kinds.alias("i")).select("composer_id", "i.*", F.lit("strong").alias("strength")).where("id_value is not null").dropDuplicates(["composer_id", "id_type", "id_value"])
    variants = groups.select(F.col("id").alias("composer_id"), F.explode(F.array_compact(F.concat(F.array("name"), "aliases"))).alias("alias"))
    links = matched.where("composer_id is not null").unionByName(keyed.select(F.col("work_id").alias("id"), "key").join(groups.select("key", F.col("id").alias("composer_id")), "key").select("id", "composer_id"))
    outcome = F.when(F.col("status") == "matched_existing", "matched").when(F.col("p").isNotNull(), "resolved").when(F.col("status").isin(RESOLVED), "resolved_without_identity").when(F.col("status") == "ambiguous", "ambiguous").otherwise("unknown")
    counts = rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
    everyone = insert_ignore(composers.unionByName(made, allowMissingColumns=True), places, ["id"])
    return Incorporated(everyone, add_aliases(aliases, variants)[0], insert_ignore(identifiers, new_ids, ["composer_id", "id_type", "id_value"]), edit_rows(works, links.groupBy("id").agg(F.min("composer_id").alias("composer_id")), "id"), counts)


class Matched(NamedTuple):
    outcomes: DataFrame
    composers: DataFrame
    aliases: DataFrame
    identifiers: DataFrame
    works: DataFrame


def match_works(works: DataFrame, responses: DataFrame, composers: DataFrame, aliases: DataFrame, identifiers: DataFrame, checkpoint: DataFrame | None = None) -> Matched:
    """One outcome per work, by the ladder no_title, already_associated, error, not_applicable,
    no_match, then by the number of known entities found: matched_existing, ambiguous_maestro,
    composer_created. `responses`: work_id, status, candidates array<struct<name, external_ids map>>.
    Works in `checkpoint` (work_id) are left out."""
    todo = works if checkpoint is None else works.join(checkpoint.select(F.col("work_id").alias("id")).distinct(), "id", "left_anti")
    live = composers.where("status <> 'merged'").select(F.col("id").alias("composer_id"), F.lit(True).alias("live"))
    rows = todo.select("id", "title", "composer", "composer_id").join(live, "composer_id", "left").join(responses.select(F.col("work_id").alias("id"), F.col("status").alias("r_status"), "candidates"), "id", "left")
    same = F.filter("candidates", lambda c: norm_light(c["name"]) == norm_light(F.col("composer")))
    pairs = F.flatten(F.transform(same, lambda c: F.transform(F.map_entries(c["external_ids"]), lambda e: F.struct(id_type(e["key"]).alias("id_type"), e["value"].alias("id_value")))))
    strong = F.filter(F.coalesce(pairs, F.array().cast("array<struct<id_type: string, id_value: string>>")), lambda i: is_strong(i["id_type"]) & (text(i["id_value"]) != ""))
    rows = rows.withColumn("identifiers", strong)
    usable = (F.col("r_status") == "resolved") & (F.size("identifiers") > 0)
    early = (
        F.when(strip(text(F.col("title"))) == "", "no_title").when(F.coalesce("live", F.lit(False)) & (F.col("composer_id") != UNKNOWN_ID), "already_associated").when(F.col("r_status").isNull(), "error")
        .when((strip(text(F.col("composer"))) == "") | is_anonymous(F.col("composer")), "not_applicable").when(~F.coalesce(usable, F.lit(False)), "no_match")
    )
    rows = rows.withColumn("early", early)
    found = find_candidates(rows.where("early is null").select(F.col("id").alias("request_id"), F.col("composer").alias("name"), "identifiers"), composers, aliases, identifiers)
    rows = rows.join(found.withColumnRenamed("request_id", "id"), "id", "left")
    n = F.coalesce(F.size("composer_ids"), F.lit(0))
    rows = rows.withColumn("outcome", F.coalesce("early", F.when(n == 1, "matched_existing").when(n > 1, "ambiguous_maestro").otherwise("composer_created")))
    anchor = F.get("identifiers", F.lit(0))
    new_id = uuid5(F.concat(F.lit(MATCH_PREFIX), anchor["id_type"], F.lit(":"), anchor["id_value"]))
    rows = rows.withColumn("assigned", F.when(F.col("outcome") == "matched_existing", F.get("composer_ids", F.lit(0))).when(F.col("outcome") == "composer_created", new_id))
    created = first_per_key(rows.where("outcome = 'composer_created'"), ["assigned"], ["id"])
    made = created.select(F.col("assigned").alias("id"), F.col("composer").alias("name"), F.lit("active").alias("status"), F.lit(True).alias("visible"))
    ids = created.select(F.col("assigned").alias("composer_id"), F.posexplode("identifiers").alias("p", "i")).select("composer_id", "i.*", (F.col("p") == 0).alias("is_identity_anchor")).dropDuplicates(["composer_id", "id_type", "id_value"])
    return Matched(
        rows.select(F.col("id").alias("work_id"), "outcome", F.col("assigned").alias("composer_id")), insert_ignore(composers, made, ["id"]),
        add_aliases(aliases, created.select(F.col("assigned").alias("composer_id"), F.col("composer").alias("alias")))[0], insert_ignore(identifiers, ids, ["composer_id", "id_type", "id_value"]),
        edit_rows(works, rows.where("assigned is not null").select("id", F.col("assigned").alias("composer_id")), "id"),
    )


def recover_identities(works: DataFrame, suspicious: DataFrame, responses: DataFrame, composers: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Works of suspicious entities with the resolver's answers (work_id, status, name, mbid, aliases):
    works, composers, aliases, audit. Each work gives an audit row: resolved, or pending_human with a reason."""
    rows = works.join(suspicious.select(F.col("id").alias("composer_id")), "composer_id", "left_semi").join(responses.withColumnRenamed("work_id", "id"), "id", "left")
    named = strip(text(F.col("name")))
    good = (strip(text(F.col("title"))) != "") & (F.col("status") == "resolved") & (named != "")
    reason = F.when(strip(text(F.col("title"))) == "", "no_title").when(F.col("status").isNull(), "error").otherwise(F.col("status"))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("reason", reason)
    active = composers.where("status = 'active'").groupBy("name").agg(F.min("id").alias("known"))
    hits = rows.where("good").select("id", named.alias("name"), "mbid", F.col("aliases").alias("names")).join(active, "name", "left").withColumn("target", F.coalesce("known", uuid5(F.concat(F.lit("recovered:"), F.col("name")))))
    heads = first_per_key(hits, ["target"], [F.col("mbid").isNull(), "id"])
    made = heads.where("known is null").select(F.col("target").alias("id"), "name", F.lit("active").alias("status"), F.lit(True).alias("visible"))
    everyone = composers.unionByName(made, allowMissingColumns=True)
    mbids = heads.select(F.col("target").alias("id"), F.col("mbid").alias("_m"))
    everyone = everyone.join(mbids, "id", "left").withColumn("musicbrainz_id", F.coalesce(F.nullif("musicbrainz_id", F.lit("")), "_m")).drop("_m").select(*composers.columns)
    new_aliases, _ = add_aliases(aliases, hits.select(F.col("target").alias("composer_id"), F.explode("names").alias("alias")))
    fixed = edit_rows(works, hits.select("id", F.col("target").alias("composer_id"), F.col("name").alias("composer")), "id")
    return fixed, everyone, new_aliases, rows.select(F.col("id").alias("work_id"), F.when(F.col("good"), "resolved").otherwise("pending_human").alias("decision"), "reason")


class LookedUp(NamedTuple):
    composers: DataFrame
    merges: DataFrame
    aliases: DataFrame
    counts: DataFrame
    works: DataFrame | None = None


LOOKUP = "array<struct<id: string, name: string, type: string, score: int, aliases: array<struct<name: string>>>>"


def enrich_from_lookups(composers: DataFrame, aliases: DataFrame, lookups: DataFrame, works: DataFrame | None = None) -> LookedUp:
    """Cached answers (query_key, payload: JSON). Persons only; the first whose normal name is the
    entity's, else the best score. A canonical name that another entity has gives a merge, else the
    entity is renamed; both get the id and are correct. With works, the merges are applied to
    entities, aliases and works; without, they are for apply_merges."""
    parsed = lookups.select(F.col("query_key").alias("name"), F.posexplode(F.from_json("payload", LOOKUP)).alias("at", "c")).where("lower(c.type) = 'person'")
    exact = (normalize_name(F.col("c.name")) == normalize_name(F.col("name"))).cast("int")
    best = first_per_key(parsed.withColumn("exact", exact).withColumn("rank", F.when(F.col("exact") == 1, F.lit(0)).otherwise(-F.coalesce("c.score", F.lit(0)))), ["name"], [F.desc("exact"), "rank", "at"])
    chosen = best.where(strip(text(F.col("c.name"))) != "").select("name", F.col("c.id").alias("mbid"), strip(F.col("c.name")).alias("canonical"), F.transform("c.aliases", lambda a: a["name"]).alias("names"))
    active = composers.where("status = 'active'")
    rows = active.select("id", "name").join(chosen, "name", "left")
    hit = rows.where("canonical is not null").withColumn("k", normalize_name(F.col("canonical")))
    owners = active.select(F.col("id").alias("owner"), normalize_name(F.col("name")).alias("k")).unionByName(aliases.select(F.col("composer_id").alias("owner"), F.col("normalized_alias").alias("k")))
    claims = hit.select(F.col("id").alias("owner"), "k")
    heads = owners.unionByName(claims).join(active.select(F.col("id").alias("owner")), "owner", "left_semi").groupBy("k").agg(F.min("owner").alias("target"))
    judged = hit.join(heads, "k")
    edits = judged.where("id = target").select("id", F.col("canonical").alias("name"), F.col("mbid").alias("musicbrainz_id"), F.lit("correct").alias("review_status"))
    merges = judged.where("id <> target").select(F.col("id").alias("source"), "target", F.sha1(F.col("k").cast("binary")).alias("operation_id"))
    targets = merges.join(judged.select(F.col("id").alias("source"), "mbid"), "source").groupBy(F.col("target").alias("id")).agg(F.min("mbid").alias("musicbrainz_id"), F.lit("correct").alias("review_status"))
    new_aliases, _ = add_aliases(aliases, judged.select(F.col("target").alias("composer_id"), F.explode(F.concat(F.array("canonical"), F.coalesce("names", F.array().cast("array<string>")))).alias("alias")))
    counts = rows.agg(F.count("*").alias("looked_up"), F.count_if(F.col("canonical").isNull()).alias("no_match")).crossJoin(edits.agg(F.count("*").alias("renamed"))).crossJoin(merges.agg(F.count("*").alias("merged")))
    edited = edit_rows(edit_rows(composers, targets, "id"), edits, "id")
    if works is None:
        return LookedUp(edited, merges, new_aliases, counts)
    nobody = aliases.select("composer_id", F.lit("").alias("id_type"), F.lit("").alias("id_value")).limit(0)
    done = apply_merges(edited, new_aliases, nobody, works, merges)
    return LookedUp(done.composers, merges, done.aliases, counts, done.works)


class Ingested(NamedTuple):
    table: DataFrame
    outcomes: DataFrame


def ingest_identifiers(current: DataFrame, snapshot: DataFrame, entity_type: str) -> Ingested:
    """Identifiers (entity_id, scheme, value, source, pos) against the table: inserted, updated,
    ignored (the same value), invalid (blank key or value), or conflict (another entity has the value first)."""
    rows = snapshot.withColumn("entity_type", F.lit(entity_type))
    blank = (strip(text(F.col("entity_id"))) == "") | (strip(text(F.col("value"))) == "")
    old = current.where(F.col("entity_type") == entity_type)
    owners = old.select("entity_id", "scheme", "value", F.lit(-1).cast("long").alias("pos")).unionByName(rows.where(~blank).select("entity_id", "scheme", "value", F.col("pos").cast("long").alias("pos")))
    first = flag_conflicts(owners, ["scheme", "value"], "entity_id", ["pos", "entity_id"]).where("pos >= 0").select("entity_id", "scheme", "value", F.col("pos"), "conflict").distinct()
    judged = rows.withColumn("pos", F.col("pos").cast("long")).join(first, ["entity_id", "scheme", "value", "pos"], "left").join(old.select("entity_id", "scheme", F.col("value").alias("old_value")), ["entity_id", "scheme"], "left")
    outcome = F.when(blank, "invalid").when(F.coalesce("conflict", F.lit(False)), "conflict").when(F.col("old_value").isNull(), "inserted").when(F.col("old_value") == F.col("value"), "ignored").otherwise("updated")
    judged = judged.withColumn("outcome", outcome)
    good = first_per_key(judged.where(F.col("outcome").isin("inserted", "updated")), ["entity_id", "scheme"], [F.desc("pos")]).select("entity_type", "entity_id", "scheme", "value", "source")
    kept = current.join(good.select("entity_type", "entity_id", "scheme"), ["entity_type", "entity_id", "scheme"], "left_anti")
    return Ingested(kept.unionByName(good, allowMissingColumns=True), judged.groupBy("outcome").agg(F.count("*").alias("n")))


def entity_ids(names: Column) -> Column:
    """The id that populate_composers gives a name."""
    return uuid5(F.concat(F.lit("name:"), normalize_name(names)))
