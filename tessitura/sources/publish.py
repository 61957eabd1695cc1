"""Sets of tables that become visible together.

Under one root, each publication writes its tables to a folder of its own and then adds one small
manifest, numbered by version, that says where every table of the set lies. Readers look at the newest
manifest, so a writer that fails before it leaves all tables as they were, and one that fails after it has
published all of them. A manifest is put in place by a rename that does not replace: of two writers of
the same version one loses and its tables stay unseen. The data of a version stay as they are while
it is kept, so a reader holds a snapshot of all tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class PublishConflict(RuntimeError):
    """Another writer has published since the tables were read, or at the same moment."""


class TableSet:
    """The tables under `root`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._manifests = f"{self.root}/_manifests"

    # -- reading

    def versions(self) -> list[int]:
        folder = self._path(self._manifests)
        store = self._store(folder)
        if not store.exists(folder):
            return []
        names = [s.getPath().getName() for s in store.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The newest version, 0 where nothing is published."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "run_id": None, "tables": {}}
        path = self._path(self._manifest_path(version))
        stream = self._store(path).open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def version_of(self, run_id: str) -> int | None:
        """The version that a run has published, if it is kept."""
        return next((v for v in reversed(self.versions()) if self.manifest(v)["run_id"] == run_id), None)

    def names(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version)["tables"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, by default the newest."""
        found = self.manifest(version)["tables"].get(name)
        if found is None:
            raise ValueError(f"no table {name!r}")
        schema = StructType.fromJson(found["schema"])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{found['path']}")

    def read_all(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of one version."""
        version = self.version() if version is None else version
        return {name: self.read(name, version) for name in self.names(version)}

    # -- writing

    def publish(
        self, tables: dict[str, DataFrame], *, run_id: str, expected: int | None = None, drop: tuple[str, ...] = (), written: Callable[[str], None] | None = None
    ) -> int:
        """Writes `tables` and makes them visible at once; the set's other tables stay, without those in
        `drop`. Returns the new version.

        Frames may read the tables that they replace. `expected` is the version that they were made from,
        by default the newest now: if there is another by the time of the manifest, nothing changes and
        PublishConflict is raised. A `run_id` that a kept version has is not published again: its version is
        returned, so a run can be repeated as a whole. `written` is called after each table's data."""
        before = self.version() if expected is None else expected
        done = self.version_of(run_id)
        if done is not None:
            return done
        held = {n: t for n, t in self.manifest(before)["tables"].items() if n not in drop}
        folder = f"data/{uuid.uuid4().hex}"
        for name, df in tables.items():
            path = f"{folder}/{name}"
            df.write.parquet(f"{self.root}/{path}")
            rows = self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}").count()  # from the footers
            held[name] = {"path": path, "rows": rows, "schema": df.schema.jsonValue()}
            if written is not None:
                written(name)
        self._commit({"version": before + 1, "run_id": run_id, "tables": held})
        return before + 1

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes the manifests but the newest `keep`, and the data that none of these names: old
        versions, and what failed writers left. Not to be called while a writer is at work."""
        versions = self.versions()
        kept = versions[-keep:] if keep > 0 else []
        if versions and not kept:
            raise ValueError("keep at least one version")
        for version in versions[: len(versions) - len(kept)]:
            self._delete(self._manifest_path(version))
        used = {t["path"].split("/")[1] for v in kept for t in self.manifest(v)["tables"].values()}
        folder = self._path(f"{self.root}/data")
        store = self._store(folder)
        found = [s.getPath().getName() for s in store.listStatus(folder)] if store.exists(folder) else []
        removed = sorted(n for n in found if n not in used)
        for name in removed:
            self._delete(f"{self.root}/data/{name}")
        return removed

    # -- files

    def _manifest_path(self, version: int) -> str:
        return f"{self._manifests}/{version:012d}.json"

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _store(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        at = self._path(path)
        self._store(at).delete(at, True)

    def _commit(self, manifest: dict) -> None:
        """Puts the manifest in place if its version is free, by a rename that does not overwrite."""
        jvm, at = self.spark._jvm, self._path(self._manifest_path(manifest["version"]))
        store = self._store(at)
        if self.version() != manifest["version"] - 1:
            raise PublishConflict(f"version {manifest['version']} is taken")
        draft = self._path(f"{self._manifests}/.draft-{uuid.uuid4().hex}")
        stream = store.create(draft, False)
        try:
            stream.write(json.dumps(manifest, sort_keys=True).encode())
        finally:
            stream.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.makeQualified(at).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, at, options)
        except Exception as failed:
            store.delete(draft, False)
            if store.exists(at):
                raise PublishConflict(f"version {manifest['version']} is taken") from failed
            raise
