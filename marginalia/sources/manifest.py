"""Versioned manifests: a folder of segments whose present state is one small JSON file.

Every change ends with a new manifest, written in one step under a name that must not exist yet: readers see the state
before or after, and of two writers one fails.  Keys that are gone are listed in files of their own and named by the
segments they are gone from, so nothing is rewritten until segments are merged.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.library import LibraryError


class Manifested:
    """A folder of the shared file system with segments and manifests."""

    what = "store"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _read(self) -> dict:
        versions = self._versions()
        if not versions:
            raise LibraryError("not_found", f"no {self.what} in {self.folder}")
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{versions[-1]:09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8")) | {"version": versions[-1]}
        finally:
            stream.close()

    def _write(self, manifest: dict) -> None:
        version = manifest.pop("version", 0) + 1
        draft = self._path(f"{self.folder}/drafts/{os.urandom(8).hex()}")
        stream = self._fs.create(draft, False)
        stream.write(json.dumps(manifest).encode("utf-8"))
        stream.close()
        final = self._path(f"{self.folder}/manifests/{version:09d}.json")
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise LibraryError("invalid", f"{self.folder} was changed by another writer")

    def exists(self) -> bool:
        return bool(self._versions())

    def drop(self) -> None:
        self._fs.delete(self._path(self.folder), True)

    def vacuum(self) -> None:
        """Removes segments and lists that the newest manifest doesn't name.  Not while older readers run."""
        manifest = self._read()
        kept = {g["name"] for g in manifest["segments"]}
        lists = {x for g in manifest["segments"] for _, x in g["gone"]}
        for at, keep in ((f"{self.folder}/segments", kept), (self.folder, lists | {"segments", "manifests"})):
            if self._fs.exists(self._path(at)):
                for f in self._fs.listStatus(self._path(at)):
                    if f.getPath().getName() not in keep:
                        self._fs.delete(f.getPath(), True)

    def _base(self, segment: dict) -> str:
        return f"{self.folder}/segments/{segment['name']}"

    def _listed(self, keys: DataFrame, column: str) -> str:
        """The distinct values of ``column`` as a list of what is gone."""
        name = f"gone-{os.urandom(8).hex()}"
        keys.select(F.col(column).cast("string")).filter(F.col(column).isNotNull()).distinct().write.parquet(f"{self.folder}/{name}")
        return name

    def _alive(self, rows: DataFrame, segment: dict) -> DataFrame:
        for column, name in segment["gone"]:
            rows = rows.join(self.spark.read.schema(f"{column} string").parquet(f"{self.folder}/{name}"), column, "left_anti")
        return rows


def united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
