"""Several tables that change together: one commit for all of them.

Data goes to folders of its own that nothing refers to yet.  A snapshot is a small
record that names the folder of each table; it is written aside and put in place by
one rename, which fails if there is a record of that number.  So a commit is there as
a whole or not at all, of two writers that begin at the same snapshot the second is
refused (`Conflict`), and a reader that pins a snapshot goes on seeing its tables
whatever is committed meanwhile.  A crash before the rename leaves folders that no
record names; `vacuum` deletes them once they are old enough.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer's commit came first; what this one read is no longer the newest."""


class ReadOnly(RuntimeError):
    """The store was opened for reading."""


@dataclass(frozen=True)
class Snapshot:
    """The tables of one commit."""

    spark: SparkSession
    path: str
    version: int
    folders: dict[str, str]

    def read(self, table: str) -> DataFrame:
        if table not in self.folders:
            raise KeyError(f"snapshot {self.version} has no table {table}")
        return self.spark.read.parquet(f"{self.path}/{self.folders[table]}")


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("snapshots")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def at(self, version: int) -> Snapshot:
        stream = self._fs().open(self._path(f"snapshots/{version:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(self.spark, self.path, version, json.loads(text)["tables"])

    def newest(self) -> Snapshot:
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"{self.path} has no snapshot")
        return self.at(found[-1])

    def commit(self, tables: dict[str, DataFrame], base: Snapshot | None = None) -> Snapshot:
        """The tables given replace those of `base`; the others stay.  Refused if `base` isn't the newest snapshot (None: if there is any)."""
        if self.read_only:
            raise ReadOnly(self.path)
        version = base.version + 1 if base else 0
        if self.versions()[-1:] != ([base.version] if base else []):  # before work is done in vain
            raise Conflict(f"snapshot {version} of {self.path} is there already")
        folders = dict(base.folders) if base else {}
        for name, df in tables.items():
            folders[name] = f"data/{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{folders[name]}")
        self._put(version, json.dumps({"version": version, "parent": base.version if base else None, "tables": folders, "written": round(time.time())}, sort_keys=True))
        return Snapshot(self.spark, self.path, version, folders)

    def _put(self, version: int, text: str) -> None:
        """By one rename, without replacing anything."""
        jvm, fs = self.spark._jvm, self._fs()
        aside, place = self._path(f"snapshots/.{uuid.uuid4().hex}"), self._path(f"snapshots/{version:012d}.json")
        out = fs.create(aside, False)
        try:
            out.write(text.encode())
        finally:
            out.close()
        mode = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        modes = self.spark.sparkContext._gateway.new_array(mode, 1)
        modes[0] = mode.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri() if place.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(place), modes)
        except Py4JJavaError as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or fs.exists(place):
                raise Conflict(f"snapshot {version} of {self.path} is there already") from e
            raise

    def vacuum(self, keep: int = 2, older_than: float = 7 * 86_400) -> list[str]:
        """Deletes all snapshots but the newest `keep`, and folders that none of the rest names and that are older than so many seconds (they may belong to a writer at work)."""
        if self.read_only:
            raise ReadOnly(self.path)
        fs, found = self._fs(), self.versions()
        for v in found[: max(0, len(found) - max(1, keep))]:
            fs.delete(self._path(f"snapshots/{v:012d}.json"), False)
        named = {f for v in self.versions() for f in self.at(v).folders.values()}
        gone = []
        for table in fs.listStatus(self._path("data")) if fs.exists(self._path("data")) else []:
            for folder in fs.listStatus(table.getPath()):
                name = f"data/{table.getPath().getName()}/{folder.getPath().getName()}"
                if name not in named and folder.getModificationTime() / 1000 <= time.time() - older_than:
                    fs.delete(folder.getPath(), True)
                    gone.append(name)
        return gone
