"""The tables of a catalogue by name, their columns and types, and scans of them under one folder."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from .staging import stage

# The tables and the column that is the key of each.
TABLES = {
    "archives": "id",
    "archive_entries": "id",
    "composers": "id",
    "composer_aliases": "id",
    "composer_identifiers": "id",
    "composer_evidence": "id",
    "composer_merge_history": "id",
    "catalogues": "id",
    "download_jobs": "id",
    "files": "id",
    "import_sources": "id",
    "musicbrainz_cache": "id",
    "statistics": "id",
    "statistics_runs": "id",
    "storage_locations": "id",
    "storage_providers": "id",
    "votes": "id",
    "works": "id",
    "work_genres": "id",
    "work_instruments": "id",
    "work_parts": "id",
    "work_statistics": "work_id",
    "work_tags": "id",
}

# Columns, types and nullability of tables.
COLUMNS = {
    "archives": "id long not null, provider_id long, name string not null, url string, format string not null, local_path string, status string not null, size long, sha256 string, downloaded_at timestamp",
    "archive_entries": "id long not null, archive_id long not null, logical_id string, composer string, title string, work_id long, relative_path string not null, file_id long, size long, offset_bytes long, status string not null",
    "catalogues": "id long not null, prefix string not null, composer string not null, catalogue_name string not null, creator string not null, ordering_criterion string not null",
    "composers": "id string not null, name string not null, musicbrainz_id string, status string not null, visible boolean not null, birth_year int, death_year int, cluster_id string, review_status string, review_reason string, reviewed_at timestamp, source_system string, merged_into string, merged_at timestamp",
    "composer_aliases": "id long not null, composer_id string not null, alias string not null, normalized_alias string not null, name_type string not null, language string, source string not null",
    "composer_identifiers": "id long not null, composer_id string not null, id_type string not null, id_value string not null, is_identity_anchor boolean not null, source string, strength string, channels array<string>",
    "composer_evidence": "id long not null, composer_id string not null, rule string, decision string, reason string, anchor_type string, anchor_value string, channels string, identifiers_used string, matcher_version string, created_at timestamp",
    "composer_merge_history": "id long not null, merge_operation_id string not null, source_composer_id string not null, target_composer_id string not null, merged_at timestamp not null, merged_by string",
    "files": "id long not null, sha256 string, name string not null, mime_type string, size_bytes long, status string not null",
    "import_sources": "id long not null, provider string not null, version string, csv_path string not null, notes string, imported_at timestamp not null",
    "musicbrainz_cache": "id long not null, query_key string not null, payload string not null",
    "statistics": "id long not null, archives long not null, entries long not null, files long not null, downloaded_tar long not null, materialized long not null, pending long not null, bytes long not null, computed_at timestamp not null",
    "statistics_runs": "id long not null, started_at timestamp not null, finished_at timestamp, works_updated int, composers_updated int",
    "storage_locations": "id long not null, file_id long not null, provider_id long not null, object_key string not null, status string not null",
    "storage_providers": "id long not null, name string not null, provider_type string not null, config string not null, enabled boolean not null",
    "votes": "id long not null, user_id string not null, work_id long not null, vote int not null, voted_at timestamp not null, vote_day date not null",
    "works": "id long not null, work_key string, relative_path string, composer string, composer_id string, attribution_type string, attribution_note string, title string, genre string, opus string, catalogue string, musical_key string, year int, language string, tags string, license string, public_domain boolean",
    "work_genres": "id long not null, work_id long not null, genre string not null",
    "work_instruments": "id long not null, work_id long not null, instrument string not null",
    "work_parts": "id long not null, work_id long not null, part_name string not null",
    "work_statistics": "work_id long not null, rating decimal(10,3), adjusted_rating decimal(10,3), vote_count int not null, work_count int not null, confidence decimal(5,4), calculated_at timestamp not null",
    "work_tags": "id long not null, work_id long not null, tag string not null",
}

# What no two rows of a table share; rows with a null in it don't count.
UNIQUE = {
    "archives": ["name"],
    "archive_entries": ["archive_id", "relative_path"],
    "composer_aliases": ["composer_id", "normalized_alias"],
    "composer_identifiers": ["composer_id", "id_type", "id_value"],
    "files": ["sha256"],
    "musicbrainz_cache": ["query_key"],
    "storage_locations": ["file_id", "provider_id"],
    "votes": ["user_id", "work_id", "vote_day"],
    "works": ["work_key"],
    "work_genres": ["work_id", "genre"],
    "work_instruments": ["work_id", "instrument"],
    "work_parts": ["work_id", "part_name"],
    "work_tags": ["work_id", "tag"],
}

# The values of closed columns.
VALUES = {
    "archives": {"status": ["imported", "downloaded", "materialized", "failed"]},
    "archive_entries": {"status": ["missing", "ready", "failed"]},
    "composers": {"status": ["active", "merged", "candidate", "attribution"]},
    "files": {"status": ["registered", "downloading", "available", "failed"]},
    "storage_locations": {"status": ["stored", "failed", "removed"]},
    "votes": {"vote": [1, 2, 3, 4, 5]},
}

#: Types that a column may be read as without loss.
WIDER = {
    ("tinyint", "smallint"), ("tinyint", "int"), ("tinyint", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("int", "bigint"), ("float", "double"), ("timestamp_ntz", "timestamp"),
}


class SchemaDrift(ValueError):
    """A file lacks a column of its table, or has it in another type."""


class Typed(NamedTuple):
    rows: DataFrame
    rejects: DataFrame


def schema_of(name: str) -> T.StructType:
    """The registered columns of a table."""
    key_of(name)
    if name not in COLUMNS:
        raise ValueError(f"the columns of {name!r} are not registered")
    return T.StructType.fromDDL(COLUMNS[name])


def drift(found: T.StructType, wanted: T.StructType) -> list[str]:
    """What a file's columns lack of a table's, in the table's order. More columns are no drift."""
    have = {f.name: f.dataType.simpleString() for f in found.fields}
    out = []
    for f in wanted.fields:
        kind = f.dataType.simpleString()
        if f.name not in have:
            out.append(f"{f.name} is missing")
        elif have[f.name] != kind and (have[f.name], kind) not in WIDER:
            out.append(f"{f.name} is {have[f.name]}, not {kind}")
    return out


def drifted_files(files: DataFrame, wanted: T.StructType) -> DataFrame:
    """(path, drift) of the Parquet files (path) that don't fit, from the footer of each, read by tasks."""
    from ..operators.content import open_file

    def run(batches):
        for batch in batches:
            found = []
            for path in batch["path"]:
                with open_file(path) as source:
                    off = drift(from_arrow_schema(pq.read_schema(source)), wanted)
                if off:
                    found.append((path, ", ".join(off)))
            yield pd.DataFrame(found, columns=["path", "drift"])

    return files.select("path").mapInPandas(run, "path string, drift string")


def scan_typed(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> Typed:
    """The table in its registered types, or in `schema`, and its rejects.

    Every file's columns are compared first: a file that lacks a column or has another type raises
    SchemaDrift. Rejects have the row, and `reason`: `null:` and the columns that may not be null, `value:` and the closed
    columns with other values; rows without these, `key:` and the columns, if their key is
    another row's: all rows of a key, and of what else must be unique all but the one of least key."""
    from ..operators.content import list_tree

    wanted, path = schema or schema_of(name), f"{root.rstrip('/')}/{name}.parquet"
    off = drifted_files(list_tree(spark, path, "*.parquet").repartition(8), wanted).limit(5).collect()
    if off:
        raise SchemaDrift("; ".join(f"{r.path}: {r.drift}" for r in off))
    return checked(spark.read.schema(wanted).parquet(path), name, wanted)


def checked(rows: DataFrame, name: str, wanted: T.StructType | None = None) -> Typed:
    """Rows of a table and the rejects among them, as `scan_typed` tells."""
    wanted = wanted or schema_of(name)
    nulls = [F.when(F.col(f.name).isNull(), f"null:{f.name}") for f in wanted.fields if not f.nullable]
    values = [F.when(~F.col(c).isin(allowed), f"value:{c}") for c, allowed in VALUES.get(name, {}).items()]
    key = key_of(name)
    seen = stage(rows.withColumn("reason", F.array_join(F.array_compact(F.array(*nulls, *values)), ",") if nulls or values else F.lit("")))
    sound = seen.where("reason = ''")
    for columns in ([key], UNIQUE.get(name, [])):
        if columns:
            sound = _unique(sound, columns, key)
    good = sound.where("reason = ''").drop("reason")
    return Typed(good, seen.where("reason <> ''").unionByName(sound.where("reason <> ''")))


def _unique(rows: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Gives a reason to rows whose columns another row has too: to all of them if these are the key."""
    open_rows = (F.col("reason") == "") & reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    several = rows.where(open_rows).groupBy(*columns).agg(F.min(key).alias("_least"), F.count("*").alias("_n")).where("_n > 1")
    hit = F.col("_n").isNotNull() if list(columns) == [key] else F.col(key) != F.col("_least")
    joined = rows.join(several, list(columns), "left")
    return joined.withColumn("reason", F.when((F.col("reason") == "") & hit, f"key:{','.join(columns)}").otherwise(F.col("reason"))).select(*rows.columns)


def tables() -> list[str]:
    return sorted(TABLES)


def key_of(name: str) -> str:
    if name not in TABLES:
        raise ValueError(f"no table {name!r}")
    return TABLES[name]


def scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table, as Parquet under `root`; an unknown name is an error before anything is read."""
    key_of(name)
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def columns(spark: SparkSession, root: str, name: str) -> list[str]:
    """The table's columns in order, from its files' footers."""
    return scan(spark, root, name).columns


def rows(spark: SparkSession, root: str, name: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of the table in the order of its key."""
    return scan(spark, root, name).orderBy(key_of(name)).offset(offset).limit(limit)
