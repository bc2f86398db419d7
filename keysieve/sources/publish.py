"""Tables that replace an earlier one whole, or not at all.

A table is written beside its place, its files are listed in a manifest, and only then do
two renames put it there. A run that dies while it writes leaves the earlier table as it
was; one that dies between the renames leaves it under ``.previous``, where
``published`` finds it and the next ``publish`` starts from.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrameWriter, SparkSession

MANIFEST = "_manifest.json"


class _Store:
    """The file system of a path, as Spark sees it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._new(path))

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._new(old), self._new(new)):
            raise OSError(f"{old} could not be renamed to {new}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._new(path), True)

    def sizes(self, path: str) -> dict[str, int]:
        """Data files below a folder, by name relative to it."""
        root = self._fs.makeQualified(self._new(path)).toString().rstrip("/")
        found, files = {}, self._fs.listFiles(self._new(path), True)
        while files.hasNext():
            status = files.next()
            name = status.getPath().toString()[len(root) + 1 :]
            if not name.rpartition("/")[2].startswith(("_", ".")):
                found[name] = status.getLen()
        return found

    def write(self, path: str, text: str) -> None:
        out = self._fs.create(self._new(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str:
        stream = self._fs.open(self._new(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a new folder and put that in the place of ``path``; returns ``path``."""
    path = path.rstrip("/")
    store, staged, previous = _Store(spark, path), f"{path}.staged-{uuid.uuid4().hex}", f"{path}.previous"
    try:
        write(staged)
        store.write(f"{staged}/{MANIFEST}", json.dumps({"files": store.sizes(staged)}, sort_keys=True))
    except BaseException:
        store.delete(staged)
        raise
    if store.exists(path):
        # Only a whole table is worth more than what an interrupted run left.
        store.delete(previous)
        store.rename(path, previous)
    store.rename(staged, path)
    store.delete(previous)
    return path


def save(writer: DataFrameWriter, spark: SparkSession, path: str, format: str) -> str:
    """``writer``'s table as the published one at ``path``."""
    return publish(spark, path, lambda folder: writer.format(format).save(folder))


def published(spark: SparkSession, path: str) -> str:
    """Where the last whole table of ``path`` lies; its files are checked against the manifest."""
    path = path.rstrip("/")
    store = _Store(spark, path)
    for place in (path, f"{path}.previous"):
        if store.exists(place):
            if store.exists(f"{place}/{MANIFEST}") and json.loads(store.read(f"{place}/{MANIFEST}"))["files"] != store.sizes(place):
                raise OSError(f"{place} lacks files that its manifest names, or has others")
            return place
    raise FileNotFoundError(path)
