"""Names in a folder of whatever file system Spark reads it from, and numbered
snapshots: small JSON files of which the highest number counts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    """Paths are relative to the folder; all go through Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.root, self._jvm = path.rstrip("/"), spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.at(name))

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        return self._fs.rename(self._path(old), self._path(new))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


SNAPSHOTS = "_snapshots"


class Conflict(RuntimeError):
    """Another writer has committed since this one read its snapshot."""


def versions(folder: Folder) -> list[int]:
    return sorted(int(n[:-5]) for n in folder.names(SNAPSHOTS) if n.endswith(".json") and n[:-5].isdigit())


def snapshot(folder: Folder, version: int | None = None) -> dict | None:
    """The latest or a given snapshot; null if there is none."""
    found = versions(folder)
    return json.loads(folder.read(f"{SNAPSHOTS}/{version or found[-1]:010d}.json")) if found else None


def commit(folder: Folder, snap: dict) -> None:
    """Make a snapshot the latest one: written whole under another name, then renamed."""
    final, beside = f"{SNAPSHOTS}/{snap['version']:010d}.json", f"{SNAPSHOTS}/.{uuid.uuid4().hex}.tmp"
    folder.write(beside, json.dumps(snap))
    if folder.exists(final) or not folder.rename(beside, final):
        folder.delete(beside)
        raise Conflict(f"{folder.root}: version {snap['version']} exists")
