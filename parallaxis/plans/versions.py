"""Tables that are replaced whole, one version after another, behind an atomic pointer.

    path/data-<id>/          what a writer staged, never touched again
    path/_versions/<n>.json  the manifest of version n: the folder, its rows, its columns

A version appears when its manifest does, by one operation that fails if it is already there
(a hard link, or a rename that does not replace, as HDFS has it).  So readers see the last
version or the next, and never none; of two writers that began from the same version one wins
and the other is told.  Stores without such an operation need a lock from elsewhere.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from parallaxis.plans.commit import CommitError


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._at().getFileSystem(self._conf)

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def versions(self) -> list[int]:
        folder = self._at("_versions")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int | None:
        """The last version; null before there is one.  A writer takes it as its snapshot."""
        return max(self.versions(), default=None)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version is None or version not in self.versions():
            raise CommitError(f"{self.path} has no version {'' if version is None else version}".rstrip())
        stream = self._fs.open(self._at("_versions", f"{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        held = self.manifest(version)
        return self.spark.read.schema(StructType.fromJson(held["schema"])).parquet(f"{self.path}/{held['folder']}")

    def replace(self, df: DataFrame, checks: dict[str, Callable[[DataFrame], bool]] | None = None, snapshot: int | None = None) -> int:
        """Write ``df`` as the version after ``snapshot`` (null: the first); its number.

        ``checks`` see what was written.  If one fails, or another version has come since the
        snapshot, nothing changes and nothing is left.
        """
        folder = f"data-{uuid.uuid4().hex}"
        try:
            if self.version() != snapshot:
                raise CommitError(f"{self.path} is at version {self.version()}, not {snapshot}")
            df.write.parquet(f"{self.path}/{folder}")
            written = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}")
            failed = [name for name, holds in (checks or {}).items() if not holds(written)]
            if failed:
                raise CommitError("failed: " + ", ".join(failed))
            version = 0 if snapshot is None else snapshot + 1
            held = {"version": version, "folder": folder, "rows": written.count(), "schema": df.schema.jsonValue()}
            if not self._publish(f"{version:020d}.json", json.dumps(held)):
                raise CommitError(f"{self.path} got version {version} from another writer")
            return version
        except BaseException:
            self._fs.delete(self._at(folder), True)
            raise

    def _publish(self, name: str, content: str) -> bool:
        """Make the manifest appear whole, unless there is one."""
        staged, place = self._at("_versions", f".{uuid.uuid4().hex}"), self._at("_versions", name)
        out = self._fs.create(staged, True)
        out.write(bytearray(content.encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                try:
                    os.link(staged.toUri().getPath(), place.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            return not self._fs.exists(place) and self._fs.rename(staged, place)
        finally:
            self._fs.delete(staged, False)

    def expire(self, keep: int = 1) -> None:
        """Remove all but the last ``keep`` versions, and what failed writers left; readers of old versions must be done."""
        if keep < 1:
            raise ValueError("the last version stays")
        gone, kept = self.versions()[:-keep], self.versions()[-keep:]
        folders = {self.manifest(v)["folder"] for v in kept}
        for v in gone:
            self._fs.delete(self._at("_versions", f"{v:020d}.json"), False)
        for f in self._fs.listStatus(self._at()):
            name = f.getPath().getName()
            if name.startswith("data-") and name not in folders:
                self._fs.delete(f.getPath(), True)
