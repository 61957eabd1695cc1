"""Content hashes, registration by content, archive expansion, mirror checks."""

from __future__ import annotations

import hashlib
import io
import tarfile
import uuid
from collections.abc import Callable
from fnmatch import fnmatchcase
from typing import NamedTuple
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.keys import basename, number_rows, valid_sha256
from ..functions.names import strip, text
from ..sources.staging import stage
from .tables import first_per_key

BLOCK = 1 << 20


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a local path or of one as Spark shows it, a URI without escapes, of the kinds that
    pyarrow knows (local, HDFS, S3, GCS)."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path if path.startswith("/") else quote(path, safe="/:@?&=+,;$!*'()~"))


def open_file(path: str):
    """A binary file that can be sought."""
    store, at = store_of(path)
    return store.open_input_file(at)


def _dealt(rows: DataFrame, size: str, keys: list[str], bytes_per_task: int) -> DataFrame:
    """The rows dealt to as many tasks as their bytes ask for."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return rows.repartition(max(1, -(-total // bytes_per_task)), *keys)


def hash_ranges(ranges: DataFrame, *, bytes_per_task: int = 256 << 20, opener: Callable = open_file) -> DataFrame:
    """`ranges` (path, offset, length, and other columns) with the SHA-256 of these bytes, read a block at a
    time: memory doesn't depend on their number. Tasks get about `bytes_per_task` each; a longer range is a
    task's alone. A range that ends beyond the file, or a file that can't be read, has a null hash."""

    def run(batches):
        for batch in batches:
            found = pd.Series(None, index=batch.index, dtype=object)
            for path, rows in batch.groupby("path", sort=False).groups.items():
                try:
                    with opener(path) as source:
                        for i in rows:
                            found[i] = _digest(source, int(batch.at[i, "offset"]), int(batch.at[i, "length"]))
                except OSError:
                    continue
            yield batch.assign(sha256=found)

    return _dealt(ranges, "length", ["path", "offset"], bytes_per_task).mapInPandas(run, StructType([*ranges.schema.fields, StructField("sha256", StringType())]))


def _digest(source, offset: int, length: int) -> str | None:
    digest, left = hashlib.sha256(), length
    source.seek(offset)
    while left:
        piece = source.read(min(left, BLOCK))
        if not piece:
            return None
        digest.update(piece)
        left -= len(piece)
    return digest.hexdigest()


def list_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path and length of the files under a folder whose names fit, empty ones among them (which Spark's file
    sources pass over); names that begin with `.` or `_` don't count, as there. The folder's own folders
    are listed by tasks."""

    def shown(info: pafs.FileInfo, base: str) -> bool:
        return not any(part[:1] in "._" for part in info.path[len(base) :].split("/") if part)

    def files(infos, base: str) -> pd.DataFrame:
        found = [(prefix + i.path, i.size) for i in infos if i.type == pafs.FileType.File and shown(i, base) and fnmatchcase(i.base_name, glob)]
        return pd.DataFrame(found, columns=["path", "length"])

    def run(batches):
        store, base = store_of(root.rstrip("/"))
        for batch in batches:
            for path in batch["path"]:
                yield files(store.get_file_info(pafs.FileSelector(path, recursive=True)), base)

    store, base = store_of(root.rstrip("/"))
    prefix = "" if isinstance(store, pafs.LocalFileSystem) else root.rstrip("/").removesuffix(base)
    top = store.get_file_info(pafs.FileSelector(base))
    folders = [i.path for i in top if i.type == pafs.FileType.Directory and shown(i, base)]
    own = spark.createDataFrame(files(top, base).values.tolist(), "path string, length long")
    if not folders:
        return own
    below = spark.createDataFrame([(f,) for f in folders], "path string").repartition(min(len(folders), 200), "path")
    return own.unionByName(below.mapInPandas(run, "path string, length long"))


def hash_files(spark: SparkSession, path: str, glob: str = "*", **options) -> DataFrame:
    """Path, length and SHA-256 of files of any size under a folder; only their listing is rows."""
    files = list_tree(spark, path, glob)
    return hash_ranges(files.select("path", F.lit(0).cast("long").alias("offset"), "length"), **options).drop("offset")


def verify_copies(files: DataFrame, locations: DataFrame, hashes: DataFrame) -> DataFrame:
    """Per file whether every stored copy has the expected hash, case aside. `hashes`: object_key, sha256."""
    stored = locations.where("status = 'stored'").select("file_id", "object_key")
    seen = stored.join(hashes.select("object_key", F.lower("sha256").alias("found")), "object_key", "left")
    joined = files.select(F.col("id").alias("file_id"), F.lower("sha256").alias("expected")).join(seen, "file_id")
    good = F.coalesce(F.col("found") == F.col("expected"), F.lit(False))
    return joined.groupBy("file_id").agg(F.count("*").alias("copies"), F.count_if(good).alias("valid"), F.bool_and(good).alias("ok"))


class Registered(NamedTuple):
    files: DataFrame
    rejects: DataFrame


def register_content(files: DataFrame, new: DataFrame, *, order: str = "pos") -> Registered:
    """New (sha256, name, size_bytes, mime_type, order) rows by hash: an existing hash wins, else the first row."""
    checked = new.withColumn("sha256", valid_sha256(F.col("sha256"))).withColumn("name", strip(text(F.col("name"))))
    good = F.col("sha256").isNotNull() & (F.col("name") != "")
    fresh = first_per_key(checked.where(good), ["sha256"], [order]).join(files.select("sha256").distinct(), "sha256", "left_anti")
    start = files.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = number_rows(fresh.select("sha256", "name", "size_bytes", "mime_type"), ["sha256"], start).withColumn("status", F.lit("registered"))
    return Registered(files.unionByName(numbered, allowMissingColumns=True), new.join(checked.where(~good).select(order), order, "left_semi"))


class Expanded(NamedTuple):
    entries: DataFrame
    files: DataFrame
    archives: DataFrame


def archive_members(archives: DataFrame) -> DataFrame:
    """(archive_id, relative_path, sha256, size) of small TAR archives (id, content: binary). Members are
    hashed block by block; their bytes are never rows. `archive_members_at` reads large ones."""

    def run(batches):
        for batch in batches:
            rows = []
            for archive_id, content in zip(batch["id"], batch["content"]):
                try:
                    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                        for member in tar:
                            if member.isfile():
                                digest, source = hashlib.sha256(), tar.extractfile(member)
                                while piece := source.read(BLOCK):
                                    digest.update(piece)
                                rows.append((archive_id, member.name, digest.hexdigest(), member.size))
                except tarfile.TarError:
                    continue
            yield pd.DataFrame(rows, columns=["archive_id", "relative_path", "sha256", "size"])

    return archives.select("id", "content").mapInPandas(run, "archive_id long, relative_path string, sha256 string, size long")


def archive_members_at(archives: DataFrame, opener: Callable | None = None) -> DataFrame:
    """As `archive_members`, for archives of any size: (id, path). Each task reads its archives as streams,
    a block at a time. `opener` takes a path and gives a binary file; by default the path is a URI
    that pyarrow's file systems know (local, HDFS, S3, GCS)."""

    def run(batches):
        def opened(path: str):
            store, at = store_of(path)
            return store.open_input_stream(at)

        rows = []

        def frame():
            return pd.DataFrame(rows, columns=["archive_id", "relative_path", "sha256", "size"])

        for batch in batches:
            for archive_id, path in zip(batch["id"], batch["path"]):
                try:
                    with (opener or opened)(path) as source, tarfile.open(fileobj=source, mode="r|*") as tar:
                        for member in tar:
                            if member.isfile():
                                digest, inner = hashlib.sha256(), tar.extractfile(member)
                                while piece := inner.read(BLOCK):
                                    digest.update(piece)
                                rows.append((archive_id, member.name, digest.hexdigest(), member.size))
                                if len(rows) == 10_000:
                                    yield frame()
                                    rows.clear()
                except tarfile.TarError:
                    continue
        yield frame()

    return archives.select("id", "path").mapInPandas(run, "archive_id long, relative_path string, sha256 string, size long")


def pack_archives(rows: DataFrame, root: str, *, archive: str = "archive_id", name: str = "relative_path", content: str = "content") -> DataFrame:
    """Writes rows as members of TAR files `<root>/<archive>.tar`, in the order of their names, and gives
    (archive_id, path, members). An archive is written by one task, row by row; it takes its name when it is
    whole, so a task that runs again, or twice, leaves one."""

    def run(batches):
        done, at, tar, out, n = [], None, None, None, 0
        store, folder = store_of(root)
        store.create_dir(folder)

        def finish():
            nonlocal tar
            if tar is not None:
                tar.close()
                out.close()
                store.move(draft, f"{folder}/{at}.tar")
                done.append((at, f"{root.rstrip('/')}/{at}.tar", n))
                tar = None

        for batch in batches:
            for key, member, data in zip(batch[archive], batch[name], batch[content]):
                if tar is None or key != at:
                    finish()
                    at, n, draft = key, 0, f"{folder}/.{key}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(draft)
                    tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.GNU_FORMAT)
                info = tarfile.TarInfo(member)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
                n += 1
        finish()
        yield pd.DataFrame(done, columns=["archive_id", "path", "members"])

    dealt = rows.select(archive, name, content).repartition(archive).sortWithinPartitions(archive, name)
    return dealt.mapInPandas(run, "archive_id long, path string, members long")


def truncate_files(cuts: DataFrame) -> DataFrame:
    """Cuts files (path, length) off after so many bytes, as a broken transfer does; gives the paths. A file
    that is no longer than that stays."""

    def run(batches):
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"]):
                store, at = store_of(path)
                draft, left = f"{at}.{uuid.uuid4().hex}", int(length)
                with store.open_input_stream(at) as source, store.open_output_stream(draft) as out:
                    while left and (piece := source.read(min(left, BLOCK))):
                        out.write(piece)
                        left -= len(piece)
                store.move(draft, at)
            yield batch[["path"]]

    return cuts.select("path", "length").mapInPandas(run, "path string")


def archive_index(archives: DataFrame, *, opener: Callable = open_file) -> DataFrame:
    """(archive_id, path, relative_path, offset, length) of the members of plain TAR files (id, path): headers
    are read, contents are passed over. Where a header can't be read the list ends."""

    def run(batches):
        for batch in batches:
            for archive_id, path in zip(batch["id"], batch["path"]):
                rows = []
                try:
                    with opener(path) as source, tarfile.open(fileobj=source, mode="r:") as tar:
                        while (member := tar.next()) is not None:
                            tar.members.clear()  # tarfile would keep them all
                            if member.isreg() and not member.issparse():
                                rows.append((archive_id, path, member.name, member.offset_data, member.size))
                            if len(rows) == 10_000:
                                yield pd.DataFrame(rows, columns=columns)
                                rows.clear()
                except (tarfile.TarError, OSError):
                    pass
                yield pd.DataFrame(rows, columns=columns)

    columns = ["archive_id", "path", "relative_path", "offset", "length"]
    return archives.select("id", "path").mapInPandas(run, "archive_id long, path string, relative_path string, offset long, length long")


def archive_members_by_range(archives: DataFrame, *, bytes_per_task: int = 256 << 20, opener: Callable = open_file) -> DataFrame:
    """As `archive_members_at`, for plain TAR files: members are listed first, and then hashed by their
    offsets, so one huge archive is the work of many tasks. A member that the file cuts off has no row."""
    index = stage(archive_index(_spread(archives), opener=opener))
    hashed = hash_ranges(index, bytes_per_task=bytes_per_task, opener=opener).where("sha256 is not null")
    return hashed.select("archive_id", "relative_path", "sha256", F.col("length").alias("size"))


def _spread(archives: DataFrame) -> DataFrame:
    return archives.select("id", "path").repartition("path")


def expand_archives(archives: DataFrame, entries: DataFrame, members: DataFrame) -> Expanded:
    """Entries become ready or failed by the members found, files are one per hash, archives
    materialized (any entry ready), failed (all failed) or imported (no entries)."""
    found = members.withColumn("relative_path", F.regexp_replace("relative_path", r"^\./", ""))
    keyed = entries.drop("size", "status").withColumn("_path", F.regexp_replace("relative_path", r"^\./", ""))
    joined = keyed.join(found.select("archive_id", F.col("relative_path").alias("_path"), "sha256", "size").dropDuplicates(["archive_id", "_path"]), ["archive_id", "_path"], "left")
    done = joined.withColumn("status", F.when(F.col("sha256").isNotNull(), "ready").otherwise("failed")).drop("_path")
    files = done.where("status = 'ready'").groupBy("sha256").agg(F.min(basename(F.col("relative_path"))).alias("name"), F.first("size").alias("size_bytes"))
    per_archive = done.groupBy(F.col("archive_id").alias("id")).agg(F.count_if(F.col("status") == "ready").alias("_ready"))
    status = F.when(F.col("_ready") > 0, "materialized").when(F.col("_ready") == 0, "failed").otherwise("imported")
    return Expanded(done, files, archives.drop("status", "content", "path").join(per_archive, "id", "left").withColumn("status", status).drop("_ready"))


class Mirrored(NamedTuple):
    files: DataFrame
    locations: DataFrame
    entries: DataFrame


def register_mirror(entries: DataFrame, provider_id: int, start: int = 0) -> Mirrored:
    """C4: a file and a stored place for every entry without one; the name is the basename, the hash is unknown."""
    fresh = number_rows(entries.where("file_id is null").select("id", "relative_path"), ["id"], start, into="new_file")
    files = fresh.select(F.col("new_file").alias("id"), F.lit(None).cast("string").alias("sha256"), basename(F.col("relative_path")).alias("name"), F.lit("available").alias("status"))
    places = fresh.select(F.col("new_file").alias("file_id"), F.lit(provider_id).cast("long").alias("provider_id"), F.col("relative_path").alias("object_key"), F.lit("stored").alias("status"))
    linked = entries.join(fresh.select("id", "new_file"), "id", "left").withColumn("file_id", F.coalesce("file_id", "new_file")).drop("new_file")
    return Mirrored(files, places, linked.select(*entries.columns))


class LinkCheck(NamedTuple):
    summary: DataFrame
    samples: DataFrame


def check_links(locations: DataFrame, listing: DataFrame, n: int = 10) -> LinkCheck:
    """Stored places against the listing (provider_id, object_key): counts, and some that are missing."""
    seen = listing.select("provider_id", "object_key").distinct().withColumn("_there", F.lit(True))
    joined = locations.where("status = 'stored'").join(seen, ["provider_id", "object_key"], "left")
    there = F.coalesce("_there", F.lit(False))
    summary = joined.agg(F.count("*").alias("checked"), F.count_if(there).alias("found"), F.count_if(~there).alias("missing"))
    return LinkCheck(summary, joined.where(~there).drop("_there").orderBy("id").limit(n))


def consistency_report(counts: dict[str, DataFrame], manifest: DataFrame, links: DataFrame) -> DataFrame:
    """One row: rows per table, the manifest's difference, the link check, and whether all is well."""
    out = manifest.withColumnsRenamed({c: f"manifest_{c}" for c in manifest.columns}).crossJoin(F.broadcast(links.withColumnsRenamed({c: f"links_{c}" for c in links.columns})))
    for name, df in counts.items():
        out = out.crossJoin(F.broadcast(df.agg(F.count("*").alias(f"n_{name}"))))
    return out.withColumn("consistent", F.col("manifest_ok") & (F.col("links_missing") == 0))
