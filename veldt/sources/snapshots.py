"""Tables with versions: whole snapshots in Parquet, and a manifest a version that makes it exist.

A writer puts its rows into a folder of their own and then renames a manifest to the next version's
name, which fails if that name is taken. Until then readers see the version before; after a
lost driver nothing is half written, and of two writers that began from one version the second is told so.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer made the version first."""


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; under a local master a temporary one if it is unset."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="veldt-")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table of its own in the shared folder and read from there.

    It outlives lost executors, and what reads it starts from a scan: plans that read a long chain several times, each
    step with a self-join, otherwise grow with every step. The table stays until the folder is cleared.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class VersionedTable:
    """A table in a folder. `migrations` take the rows of a schema version to the next one; rows are read as of `schema_version`."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, schema_version: int = 1, migrations: dict[int, Callable[[DataFrame], DataFrame]] | None = None):
        self.spark, self.folder, self.schema, self.schema_version, self.migrations = spark, folder.rstrip("/"), schema, schema_version, migrations or {}
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def _rename(self, source: str, target: str) -> None:
        """Rename that never replaces anything."""
        context = self._hadoop.FileContext.getFileContext(self._path("").toUri(), self._conf)
        options = self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 0)
        context.rename(self._fs().makeQualified(self._path(source)), self._fs().makeQualified(self._path(target)), options)

    def _text(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def versions(self) -> list[int]:
        """Committed versions, the newest last."""
        fs, at = self._fs(), self._path("_versions")
        if not fs.exists(at):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(at))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int) -> dict | None:
        try:
            found = json.loads(self._text(f"_versions/{version:08d}.json"))
            return found if isinstance(found, dict) and {"data", "schema_version"} <= set(found) else None
        except (ValueError, UnicodeDecodeError):
            return None

    def latest(self) -> int:
        """The newest version that can be read, 0 if there is none. Manifests that can't are kept aside under another name."""
        for version in reversed(self.versions()):
            if self._manifest(version):
                return version
            self._rename(f"_versions/{version:08d}.json", f"_versions/{version:08d}.invalid-{uuid.uuid4().hex}")
        return 0

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, the newest by default, taken to the current schema; of no version, none. A newer schema is an error."""
        version = self.latest() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], self.schema)
        manifest = self._manifest(version) if version in self.versions() else None
        if manifest is None:
            raise ValueError(f"no version {version}")
        if manifest["schema_version"] > self.schema_version:
            raise ValueError(f"rows of schema {manifest['schema_version']} are newer than {self.schema_version}")
        out = self.spark.read.parquet(f"{self.folder}/{manifest['data']}")
        for v in range(manifest["schema_version"], self.schema_version):
            out = self.migrations[v](out)
        return out

    def commit(self, rows: DataFrame, base: int) -> int:
        """Write rows as the version after `base`. Conflict if that version exists by then; its rows are then deleted again."""
        data = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{data}")
        self._publish({"data": data, "schema_version": self.schema_version, "base": base}, base + 1)
        return base + 1

    def _publish(self, manifest: dict, version: int) -> None:
        fs, name = self._fs(), f"_versions/_{uuid.uuid4().hex}.tmp"
        stream = fs.create(self._path(name), False)
        try:
            stream.write(json.dumps(manifest).encode())
        finally:
            stream.close()
        try:
            self._rename(name, f"_versions/{version:08d}.json")
        except Py4JJavaError as e:
            fs.delete(self._path(name), False)
            fs.delete(self._path(manifest["data"]), True)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version} exists") from None
            raise

    def change(self, f: Callable[[DataFrame], DataFrame], tries: int = 3) -> int:
        """Commit f(rows) on the newest version; on a conflict again, on the rows that won."""
        for left in reversed(range(tries)):
            base = self.latest()
            try:
                return self.commit(f(self.read(base)), base)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def upsert(self, rows: DataFrame, keys: list[str], keep: list[str] = ()) -> int:
        """Rows replace those of their keys, but for the columns to keep (as a time of creation), and are added else. Of rows of one key any may count."""
        rows = rows.dropDuplicates(keys)

        def changed(old: DataFrame) -> DataFrame:
            known = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep])
            new = rows.join(known, keys, "left")
            values = [F.coalesce(F.col(f"_old_{c}"), F.col(c)).alias(c) if c in keep else F.col(c) for c in old.columns]
            return old.join(rows.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*values))

        return self.change(changed)

    def patch(self, rows: DataFrame, keys: list[str]) -> int:
        """Columns that a row supplies (not null) replace those of its key; unknown keys change nothing."""
        rows = rows.dropDuplicates(keys)
        supplied = [c for c in rows.columns if c not in keys]

        def changed(old: DataFrame) -> DataFrame:
            new = rows.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in supplied])
            joined = old.join(new, keys, "left")
            return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in supplied else F.col(c) for c in old.columns])

        return self.change(changed)

    def delete(self, which: Column) -> int:
        """Leave out the rows that a condition holds for."""
        return self.change(lambda old: old.where(~F.coalesce(which, F.lit(False))))

    def clear(self) -> int:
        return self.change(lambda old: old.limit(0))

    def vacuum(self, keep: int) -> int:
        """Delete all but the newest `keep` versions; data that no manifest names is left, as a writer may be about to publish it."""
        gone = self.versions()[:-keep] if keep else self.versions()
        for version in gone:
            manifest = self._manifest(version)
            self._fs().delete(self._path(f"_versions/{version:08d}.json"), False)
            if manifest:
                self._fs().delete(self._path(manifest["data"]), True)
        return len(gone)
