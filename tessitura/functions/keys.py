"""Keys, formats, links and rating arithmetic as Column expressions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .names import strip, text

# File endings and formats, media types, kinds of identifiers.
FORMATS = {".mxl": "MusicXML", ".musicxml": "MusicXML", ".xml": "MusicXML", ".pdf": "PDF", ".mid": "MIDI", ".midi": "MIDI", ".mscz": "MuseScore"}
MIME = {"MusicXML": "application/vnd.recordare.musicxml+xml", "PDF": "application/pdf", "MIDI": "audio/midi"}
ID_TYPES = {
    "mbid": "mbid", "musicbrainz": "mbid", "viaf": "viaf", "wikidata": "qid", "wikidata_qid": "qid", "isni": "isni", "ipi": "ipi", "imslp": "imslp",
}
STRONG_ID_TYPES = ["mbid", "viaf", "isni", "ipi", "qid", "imslp"]
IDENTITY_NAMESPACE = uuid.UUID("6f1b3c2e-4f5a-4b6c-9d8e-7a0b1c2d3e4f")


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """The last extension with its full stop, or ''; a name that begins with it has none."""
    return F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)


def content_key(path: Column, only: str | None = None) -> Column:
    """Basename without the last extension; with `only`, without that extension alone."""
    name = basename(text(path))
    if only:
        return F.when(F.endswith(name, F.lit(only)), F.left(name, F.length(name) - len(only))).otherwise(name)
    return F.left(name, F.length(name) - F.length(suffix(name)))


def format_of(path: Column) -> Column:
    end = F.lower(suffix(basename(text(path))))
    return F.coalesce(lookup(FORMATS, end), F.nullif(F.upper(F.regexp_replace(end, r"^\.+", "")), F.lit("")))


def mime_of(form: Column) -> Column:
    return lookup(MIME, form)


def external_key(reference: Column) -> Column:
    """`ext:` and the SHA-1 of the reference."""
    return F.concat(F.lit("ext:"), F.sha1(reference.cast("binary")))


def uuid5(name: Column, namespace: uuid.UUID = IDENTITY_NAMESPACE) -> Column:
    """Name-based UUID of version 5, as Python's uuid.uuid5."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.instr(F.lit("0123456789abcdef"), F.substr(digest, F.lit(17), F.lit(1))) - 1) % 4 + 1)
    return F.concat_ws(
        "-",
        F.substr(digest, F.lit(1), F.lit(8)),
        F.substr(digest, F.lit(9), F.lit(4)),
        F.concat(F.lit("5"), F.substr(digest, F.lit(14), F.lit(3))),
        F.concat(variant, F.substr(digest, F.lit(18), F.lit(3))),
        F.substr(digest, F.lit(21), F.lit(12)),
    )


def valid_sha256(c: Column) -> Column:
    """The hash trimmed and in lower case, or null if it is none."""
    bare = F.lower(strip(c))
    return F.when(bare.rlike("^[0-9a-f]{64}$"), bare)


def storage_key(sha256: Column) -> Column:
    return F.concat(F.left(sha256, F.lit(2)), F.lit("/"), sha256)


def id_type(c: Column) -> Column:
    """The usual name of a kind of identifier, or null."""
    return lookup(ID_TYPES, F.lower(text(c)))


def is_strong(kind: Column) -> Column:
    return kind.isin(STRONG_ID_TYPES)


def adjusted_rating(n: Column, rating: Column, mean: Column, m: float = 5) -> Column:
    """Mean drawn to the global mean by m imagined votes."""
    return (n * F.coalesce(rating, F.lit(0.0)) + m * mean) / (n + m)


def confidence(n: Column, m: float = 5) -> Column:
    return F.least(F.lit(1.0), n / F.lit(float(m)))


def work_weight(n: Column) -> Column:
    return F.sqrt(n)


@dataclass(frozen=True)
class Links:
    """Where files are served. With `public_url` straight from the store, else by file id."""

    base_url: str = ""
    public_url: str | None = None
    prefix: str = ""


def resource_url(path: Column, file_id: Column, links: Links) -> Column:
    if links.public_url:
        parts = [p for p in (links.public_url.rstrip("/"), links.prefix.strip("/")) if p]
        return F.concat_ws("/", *map(F.lit, parts), F.regexp_replace(text(path), r"^[./]+", ""))
    return F.when(file_id.isNotNull(), F.concat(F.lit(f"{links.base_url.rstrip('/')}/api/v1/files/"), file_id.cast("string"), F.lit("/content")))


def download_name(file_name: Column, title: Column, logical_id: Column, composer: Column) -> Column:
    """"composer - title.ext", without signs that file systems refuse; the file's name without a title."""
    label = F.coalesce(F.nullif(title, F.lit("")), F.nullif(logical_id, F.lit("")))
    named = F.when((text(composer) != "") & (F.instr(label, composer) == 0), F.concat_ws(" - ", composer, label)).otherwise(label)
    safe = F.regexp_replace(strip(F.regexp_replace(named, r'[\\/:*?"<>|\x00-\x1f]+', "-")), r"^\.+|\.+$", "")
    end = F.coalesce(F.nullif(suffix(text(file_name)), F.lit("")), F.lit(".mxl"))
    whole = F.coalesce(F.nullif(file_name, F.lit("")), F.lit("file"))
    return F.coalesce(F.when(safe != "", F.concat(safe, end)), whole)


AUTHORITY_HITS = "array<struct<name: string, viaf: string, qid: string, birth: string, death: string>>"
EVIDENCE = (
    "struct<maestro: struct<composer_id: string>,"
    " open: struct<canonical_name: string, viaf: string, qid: string, mbid: string, isni: string, aliases: array<string>>,"
    f" authority: {AUTHORITY_HITS}>"
)


def identity_payload(reason: Column, evidence: Column) -> Column:
    """struct of key, name, identifiers, aliases, dates and strength from resolver evidence (JSON);
    null without an identifier to make a key of."""
    e = F.from_json(evidence, EVIDENCE)
    first = F.get(e["authority"], F.lit(0))
    blank = F.lit("")
    some = lambda c: F.nullif(c, blank)
    viaf = F.coalesce(some(F.regexp_extract(text(reason), r"viaf=([A-Za-z0-9]+)", 1)), some(e["open"]["viaf"]), some(first["viaf"]))
    qid = F.coalesce(some(e["open"]["qid"]), some(first["qid"]))
    mbid, isni = some(e["open"]["mbid"]), some(e["open"]["isni"])
    name = F.coalesce(some(e["open"]["canonical_name"]), some(first["name"]))
    none = F.array().cast("array<string>")
    others = F.filter(F.transform(F.coalesce(e["authority"], F.array().cast(AUTHORITY_HITS)), lambda a: a["name"]), lambda n: (text(n) != "") & ~n.eqNullSafe(name))
    key = F.coalesce(F.concat(F.lit("viaf:"), viaf), F.concat(F.lit("mbid:"), mbid), F.concat(F.lit("qid:"), qid))
    return F.when(
        key.isNotNull(),
        F.struct(
            key.alias("key"), name.alias("name"), viaf.alias("viaf"), qid.alias("qid"), mbid.alias("mbid"), isni.alias("isni"),
            F.array_distinct(F.concat(F.coalesce(e["open"]["aliases"], none), others)).alias("aliases"),
            first["birth"].alias("birth"), first["death"].alias("death"), (viaf.isNotNull() | mbid.isNotNull()).alias("strong"),
        ),
    )


def number_rows(df: DataFrame, order: list[str], start: int, into: str = "id", parts: int = 32) -> DataFrame:
    """Consecutive numbers from start + 1 in the given unique order, without one task for all rows:
    range partitions, a running sum of their sizes, and a number inside each. The parts are written to
    the shared folder first, so that a lost executor can't cut them anew."""
    cut = stage(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    sizes = cut.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return cut.join(offsets, "_p").withColumn(into, (F.lit(start) + F.col("_o") + inside).cast("long")).drop("_p", "_o")


