"""Tables that change as a whole: data folders that are never rewritten, and a manifest per version.

A commit writes its data beside the others and then places the manifest of the next version, which only one writer can
do. Readers take the newest manifest, so they see one whole version, also while others write.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has committed the version that this one was to become."""


class SnapshotTable:
    """A table below ``path``, in any file system that Spark reads and that renames without replacing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop
        conf = spark._jsc.hadoopConfiguration()
        self._folder = self._hadoop.fs.Path(f"{self.path}/manifests")
        self._fs = self._folder.getFileSystem(conf)
        self._files = self._hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(self._folder).toUri(), conf)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._folder)]
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json"))

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict:
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/{version}.json").collect()))

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            raise LookupError(f"{self.path} has no version")
        entry = self.manifest(version)
        return self.spark.read.schema(entry["schema"]).parquet(*[f"{self.path}/{f}" for f in entry["folders"]])

    def commit(self, rows: DataFrame, expected: int, append: bool = False) -> int:
        """``rows`` as the version after ``expected``, or added to it; :class:`Conflict` if that version exists already."""
        if self.version() != expected:
            raise Conflict(f"version {expected} is not the newest of {self.path}")
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        kept = self.manifest(expected)["folders"] if append and expected else []
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        self._place({"folders": [*kept, folder], "schema": schema}, expected + 1)
        return expected + 1

    def update(self, change: Callable[[DataFrame], DataFrame], attempts: int = 5) -> int:
        """Apply ``change`` to the newest version; if another commit comes first, to the version that it made."""
        for last in range(attempts - 1, -1, -1):
            seen = self.version()
            try:
                return self.commit(change(self.read(seen)), seen)
            except Conflict:
                if not last:
                    raise
        raise AssertionError

    def _place(self, entry: dict, version: int) -> None:
        """Write the manifest under a name of its own, then give it its version without replacing one that is there."""
        draft = self._hadoop.fs.Path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        options = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self._hadoop.fs, "Options$Rename").NONE
        try:
            self._files.rename(draft, self._hadoop.fs.Path(f"{self.path}/manifests/{version}.json"), options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "AlreadyExists" in str(e):
                raise Conflict(f"version {version} of {self.path} is taken") from None
            raise
