"""From index files to works: index build, works, enrichment, catalogue seeds, external works."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import content_key, external_key, number_rows, uuid5
from ..functions.names import clean_name, extract_name, is_mojibake, normalize_name, strip, text
from ..operators.resolve import infer_from_catalogue, resolve_names
from ..operators.tables import bulk_set, first_per_key, insert_ignore, last_per_key, replace_list, upsert
from ..sources.staging import stage

UNKNOWN_ID = "00000000-0000-0000-0000-000000000000"

# Thematic catalogues (prefix, composer, name, creator, order).
CATALOGUES = [
    ("K", "Wolfgang Amadeus Mozart", "Catálogo Köchel (Köchel-Verzeichnis)", "Ludwig von Köchel", "Cronológico"),
    ("KV", "Wolfgang Amadeus Mozart", "Köchel-Verzeichnis", "Ludwig von Köchel", "Cronológico"),
    ("BWV", "Johann Sebastian Bach", "Bach-Werke-Verzeichnis", "Wolfgang Schmieder", "Temático (género)"),
    ("WoO", "Ludwig van Beethoven", "Werke ohne Opuszahl", "Willy Hess / Kinsky-Halm", "Sin número de opus"),
    ("Hess", "Ludwig van Beethoven", "Catálogo Hess", "Willy Hess", "Temático"),
    ("Wq", "Carl Philipp Emanuel Bach", "Wotquenne", "Alfred Wotquenne", "Temático"),
    ("H", "Carl Philipp Emanuel Bach", "Helm (Thematic Catalogue of the Works of C. P. E. Bach)", "E. Eugene Helm", "Temático"),
    ("Wq", "Christoph Willibald Gluck", "Wotquenne", "Alfred Wotquenne", "Temático"),
    ("H", "Marc-Antoine Charpentier", "Catálogo Hitchcock", "Hugh Wiley Hitchcock", "Temático"),
    ("BuxWV", "Dietrich Buxtehude", "Buxtehude-Werke-Verzeichnis", "Georg Karstädt", "Temático"),
    ("HWV", "Georg Friedrich Händel", "Händel-Werke-Verzeichnis", "Bernd Baselt", "Temático"),
    ("Hob", "Joseph Haydn", "Hoboken-Verzeichnis", "Anthony van Hoboken", "Temático"),
    ("S", "Franz Liszt", "Catálogo Searle (The Music of Liszt)", "Humphrey Searle", "Temático"),
    ("R", "Franz Liszt", "Catálogo Raabe (Franz Liszt: Leben und Schaffen)", "Peter Raabe", "Temático"),
    ("F", "Wilhelm Friedemann Bach", "Catálogo Falck", "Martin Falck", "Temático"),
    ("RV", "Antonio Vivaldi", "Ryom-Verzeichnis", "Peter Ryom", "Temático"),
    ("D", "Franz Schubert", "Deutsch-Verzeichnis", "Otto Erich Deutsch", "Cronológico"),
    ("WWV", "Richard Wagner", "Wagner-Werk-Verzeichnis", "Varios", "Temático"),
    ("Z", "Henry Purcell", "Catálogo Zimmerman (Henry Purcell, 1659-1695)", "Franklin B. Zimmerman", "Por tipo de composición"),
    ("L", "Domenico Scarlatti", "Catálogo Longo", "Alessandro Longo", "Temático (piano)"),
    ("K", "Domenico Scarlatti", "Catálogo Kirkpatrick", "Ralph Kirkpatrick", "Temático"),
    ("R", "Antonio Soler", "Catálogo Rubio (Samuel Rubio Calzón)", "Samuel Rubio Calzón", "Temático"),
]


class Index(NamedTuple):
    archives: DataFrame
    entries: DataFrame
    counts: DataFrame


def build_index(rows: DataFrame, archives: DataFrame, entries: DataFrame) -> Index:
    """Archives by name (the first url wins), entries by (archive, path); a new import overwrites
    logical id, composer and title and leaves the rest. `rows` as read_index_csv gives them; their order
    is that of their column `pos`, or without one that of their partitions."""
    placed = rows.withColumn("_at", F.col("pos") if "pos" in rows.columns else F.struct(F.monotonically_increasing_id()))
    named = first_per_key(placed, ["archive_name"], ["_at"]).select(F.col("archive_name").alias("name"), F.col("archive_url").alias("url"))
    fresh = named.join(archives.select("name"), "name", "left_anti")
    start = archives.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    all_archives = archives.unionByName(number_rows(fresh, ["name"], start).withColumn("status", F.lit("imported")), allowMissingColumns=True)
    owner = all_archives.select(F.col("id").alias("archive_id"), F.col("name").alias("archive_name"))
    keyed = last_per_key(placed.join(owner, "archive_name"), ["archive_id", "relative_path"], ["_at"])
    keyed = keyed.select("archive_id", "relative_path", "logical_id", "composer", "title")
    both = upsert(entries, keyed, ["archive_id", "relative_path"])
    known, new = both.where("id is not null"), both.where("id is null")
    last = entries.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = number_rows(new.drop("id").withColumn("status", F.coalesce("status", F.lit("missing"))), ["archive_id", "relative_path"], last)
    counts = rows.agg(F.count("*").alias("rows")).crossJoin(fresh.agg(F.count("*").alias("new_archives"))).crossJoin(new.agg(F.count("*").alias("new_entries")))
    return Index(all_archives, known.unionByName(numbered.select(*known.columns)), counts)


class Works(NamedTuple):
    works: DataFrame
    entries: DataFrame
    counts: DataFrame


def build_works(entries: DataFrame, works: DataFrame, aliases: DataFrame, composers: DataFrame, unknown_id: str = UNKNOWN_ID) -> Works:
    """One work per content key of the entries without one; the first entry gives composer and
    title. Linked entries and existing keys stay."""
    keyed = entries.where("work_id is null").withColumn("work_key", content_key(F.col("relative_path"))).where("work_key <> ''")
    first = first_per_key(keyed, ["work_key"], ["id"]).select("work_key", "relative_path", "composer", "title")
    fresh = first.join(works.select("work_key"), "work_key", "left_anti")
    raw = fresh.select("composer").where("composer is not null").distinct().withColumn("name", extract_name(F.col("composer")))
    ids = resolve_names(raw.where("name is not null"), aliases, composers).select("name", "composer_id")
    fresh = fresh.join(raw.join(ids, "name", "left").select("composer", "composer_id"), "composer", "left")
    start = works.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = number_rows(fresh.withColumn("composer_id", F.coalesce("composer_id", F.lit(unknown_id))), ["work_key"], start)
    everything = works.unionByName(new.select("id", "work_key", "relative_path", "composer", "composer_id", "title"), allowMissingColumns=True)
    links = keyed.select(F.col("id"), "work_key").join(everything.select("work_key", F.col("id").alias("work_id")), "work_key").select("id", "work_id")
    counts = new.agg(F.count("*").alias("created")).crossJoin(links.agg(F.count("*").alias("linked")))
    return Works(everything, bulk_set(entries, links, "id", "work_id"), counts)


class Populated(NamedTuple):
    composers: DataFrame
    aliases: DataFrame
    evidence: DataFrame
    counts: DataFrame


def populate_composers(names: DataFrame, composers: DataFrame, aliases: DataFrame, provider: str | None = None, *, name: str = "name") -> Populated:
    """Names grouped by the normal form of what is extracted from them; the usual spelling gives
    the canonical name. Groups that resolve already are reused. Heavy functions see each spelling once, and what they give is written."""
    raw = names.select(F.col(name).alias("raw")).where(~F.lower(strip(text(F.col(name)))).isin("", "na", "nan", "null", "none", "-"))
    counted = raw.groupBy("raw").agg(F.count("*").alias("n")).where(~is_mojibake(F.col("raw")))
    keyed = counted.withColumn("found", F.coalesce(extract_name(F.col("raw")), clean_name(F.col("raw")))).withColumn("normalized_alias", normalize_name(F.col("found"))).where("normalized_alias <> ''")
    keyed = stage(keyed.select("raw", "n", "found", "normalized_alias"))
    usual = first_per_key(keyed, ["normalized_alias"], [F.desc("n"), F.desc(F.length("raw")), "raw"])
    groups = usual.select("normalized_alias", F.col("found").alias("canonical"))
    known = groups.join(aliases.select("normalized_alias").distinct(), "normalized_alias", "left_semi")
    fresh = groups.join(known.select("normalized_alias"), "normalized_alias", "left_anti").withColumn("id", uuid5(F.concat(F.lit("name:"), F.col("normalized_alias"))))
    made = fresh.select("id", F.col("canonical").alias("name"), F.lit("active").alias("status"), F.lit(True).alias("visible"), F.lit("not_reviewed").alias("review_status"))
    new_aliases = fresh.select(F.col("id").alias("composer_id"), F.col("canonical").alias("alias"), "normalized_alias", F.lit("canonical").alias("name_type"))
    evidence = fresh.select(F.col("id").alias("composer_id"), F.lit(provider).cast("string").alias("provider"))
    counts = fresh.agg(F.count("*").alias("created")).crossJoin(known.agg(F.count("*").alias("reused")))
    return Populated(composers.unionByName(made, allowMissingColumns=True), aliases.unionByName(new_aliases, allowMissingColumns=True), evidence, counts)


class Backfilled(NamedTuple):
    works: DataFrame
    counts: DataFrame


def backfill_composer_ids(works: DataFrame, aliases: DataFrame, composers: DataFrame, catalogues: DataFrame, unknown_id: str = UNKNOWN_ID) -> Backfilled:
    """Extract the name, else infer it from the catalogue reference of that work; resolve, else unknown."""
    raw = works.select("composer").distinct().withColumn("extracted", extract_name(F.col("composer")))
    named = works.join(raw, "composer", "left")
    named = infer_from_catalogue(named.withColumnRenamed("composer", "composer_text"), catalogues, ref="catalogue").withColumnRenamed("composer", "inferred").withColumnRenamed("composer_text", "composer")
    named = named.withColumn("_name", F.coalesce("extracted", "inferred"))
    found = resolve_names(named.where("_name is not null").select(F.col("_name").alias("name")), aliases, composers).select(F.col("name").alias("_name"), F.col("composer_id").alias("_id"))
    done = named.join(found, "_name", "left").withColumn("_new", F.coalesce("_id", F.lit(unknown_id)))
    changed = ~F.col("_new").eqNullSafe(F.col("composer_id"))
    counts = done.agg(F.count("*").alias("scanned"), F.count_if(changed).alias("updated"))
    return Backfilled(done.withColumn("composer_id", F.col("_new")).select(*works.columns), counts)


def backfill_by_key(works: DataFrame, meta: DataFrame, key: str, cols: list[str]) -> Backfilled:
    """Overwrites columns of works by content key; the last metadata row of a key has been kept."""
    new = meta.select(key, *(F.col(c).alias(f"_{c}") for c in cols), F.lit(True).alias("_hit"))
    joined = works.join(new, key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    changed = hit & ~F.struct(*cols).eqNullSafe(F.struct(*(F.col(f"_{c}").alias(c) for c in cols)))
    counts = joined.agg(F.count_if(hit).alias("matched"), F.count_if(changed).alias("updated"))
    done = joined.withColumns({c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in cols})
    return Backfilled(done.select(*works.columns), counts)


class Merged(NamedTuple):
    rows: DataFrame
    rejects: DataFrame


def merge_enrichment(csv: DataFrame, json: DataFrame, key: str = "content_key") -> Merged:
    """Field by field, from the CSV and then the JSON; a key that neither has does not occur;
    rows whose JSON is unreadable are rejects and keep what the CSV says."""
    good, bad = json.where("readable"), json.where("not readable").select(key)
    shared = [c for c in csv.columns if c in json.columns and c != key]
    other = good.select(key, *(F.col(c).alias(f"_{c}") if c in shared else F.col(c) for c in json.columns if c != key and c != "readable"))
    joined = csv.join(other, key, "full_outer")
    kinds = dict(csv.dtypes)
    for c in shared:
        first = F.when(F.size(c) > 0, F.col(c)) if kinds[c].startswith("array") else F.nullif(c, F.lit("")) if kinds[c] == "string" else F.col(c)
        joined = joined.withColumn(c, F.coalesce(first, F.col(f"_{c}"), F.col(c))).drop(f"_{c}")
    return Merged(joined, bad)


class Enriched(NamedTuple):
    works: DataFrame
    tags: DataFrame
    genres: DataFrame
    instruments: DataFrame
    parts: DataFrame


def enrich_works(works: DataFrame, enrichment: DataFrame, aliases: DataFrame, composers: DataFrame, lists: dict[str, DataFrame]) -> Enriched:
    """Non-blank texts and non-null numbers override, public domain only turns on, genre is the
    first, tags and instrumentation are joined lists, the composer is resolved again, child lists are replaced.

    `enrichment` has work_key; `lists` the child tables (work_id, position, value) by name.
    """
    e = enrichment.join(works.select("work_key", F.col("id").alias("work_id")), "work_key")
    names = resolve_names(e.where("composer is not null").select(F.col("composer").alias("name")), aliases, composers).select(F.col("name").alias("composer"), F.col("composer_id").alias("_cid"))
    e = e.join(names, "composer", "left")
    joined_list = lambda c: F.nullif(F.array_join(c, ", "), F.lit(""))
    edits = e.withColumn("genre", F.get("genres", F.lit(0))).withColumn("instrumentation", F.coalesce(joined_list("instruments"), joined_list("parts_names")))
    edits = edits.withColumn("tag_text", joined_list("tags"))
    out = works
    for c in ("title", "subtitle", "composer", "artist", "song_name", "license", "musical_key", "duration", "description", "genre", "instrumentation", "measures", "pages", "parts", "complexity"):
        if c in out.columns and c in edits.columns:
            value = F.nullif(strip(F.col(c)), F.lit("")) if dict(edits.dtypes)[c] == "string" else F.col(c)
            out = bulk_set(out, edits.select("work_key", value.alias(c)), "work_key", c)
    if "tags" in out.columns:
        out = bulk_set(out, edits.select("work_key", F.col("tag_text").alias("tags")), "work_key", "tags")
    if "composer_id" in out.columns:
        out = bulk_set(out, edits.select("work_key", F.col("_cid").alias("composer_id")), "work_key", "composer_id")
    if "public_domain" in out.columns and "public_domain" in edits.columns:
        out = bulk_set(out, edits.where("public_domain").select("work_key", "public_domain"), "work_key", "public_domain")
    tables = {n: replace_list(lists[n], e.select("work_id", F.col(src).alias(value)), "work_id", value) for n, src, value in (("tags", "tags", "tag"), ("genres", "genres", "genre"), ("instruments", "instruments", "instrument"), ("parts", "parts_names", "part_name"))}
    return Enriched(out, tables["tags"], tables["genres"], tables["instruments"], tables["parts"])


def register_external(works: DataFrame, requests: DataFrame) -> Merged:
    """Works known by an outside reference; an existing key wins, the provider is kept as tag, a blank reference is rejected."""
    good = F.coalesce(strip(F.col("reference")), F.lit("")) != ""
    keyed = requests.where(good).withColumn("work_key", external_key(strip(F.col("reference"))))
    fresh = first_per_key(keyed, ["work_key"], ["pos"]).join(works.select("work_key"), "work_key", "left_anti")
    start = works.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = number_rows(fresh.select("work_key", "title", "composer", F.col("provider").alias("tags")), ["work_key"], start)
    return Merged(works.unionByName(new, allowMissingColumns=True), requests.where(~good))


def seed_catalogues(spark: SparkSession, current: DataFrame) -> DataFrame:
    """The thematic catalogues, where (prefix, composer, name) is not there yet."""
    rows = spark.createDataFrame(CATALOGUES, "prefix string, composer string, catalogue_name string, creator string, ordering_criterion string")
    return insert_ignore(current, rows, ["prefix", "composer", "catalogue_name"])


class Authority(NamedTuple):
    authority: DataFrame
    names: DataFrame


def load_authority(rows: DataFrame) -> Authority:
    """Authority rows with ids in the order of name and identifiers, and their names."""
    numbered = number_rows(rows.distinct(), ["name", "wikidata_id"], 0, into="authority_id")
    names = numbered.select("authority_id", "name", normalize_name(F.col("name")).alias("normalized_name"))
    return Authority(numbered, names)


