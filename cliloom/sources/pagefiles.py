"""A file for each page, as a data source that is written in one commit.

    register(spark)
    pages.write.format("cliloom_pages").mode("append").save(folder)

Rows are (source, text, aliases): the text goes to ``<source>.gz`` (or ``<source>``, where it
ends so), aliases to entries of their own that name the source; a null text is an alias entry
alone.  gzip headers have a fixed time and no name, and entries are sorted, so equal rows give
equal bytes, whenever and wherever they are written.

Tasks write below a hidden folder of their own attempt, with sorted lists of what they wrote.
The commit takes the attempts that Spark counts, merges their lists row by row (it holds none
of them whole), writes the aliases' table and renames the hidden folder to ``set-<digest>``, all
at once, where the digest is of the rows' names and contents; a set that is there already is
left as it is, so writing the same again changes nothing.  Before that a reader sees nothing.
A task that fails deletes what it wrote, an aborted job its folder; what tasks write that are
still at work by then, or a lost driver leaves, stays hidden until `vacuum`.  `read_pages`
reads all sets.
"""

from __future__ import annotations

import gzip
import hashlib
import heapq
import io
import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: A task's lists of (place, digest) and of (alias, place), until the commit has merged them.
LISTS = ("_files", "_aliases")
#: Fixed value: characters of texts in a batch that is read.
BATCH = 1 << 23

SCHEMA = "source string, text string, aliases array<string>"


def packed(text: str) -> bytes:
    """gzip without time and name: the same bytes each time."""
    out = io.BytesIO()
    with gzip.GzipFile(filename="", mode="wb", fileobj=out, mtime=0) as f:
        f.write(text.encode())
    return out.getvalue()


def _place(source: str) -> str:
    """A source as a relative path; nothing leads out of the folder."""
    parts = source.split("/")
    if not source or any(p in ("", ".", "..") or p.startswith("_") for p in parts):
        raise ValueError(f"{source!r} can't be a file's name")
    return source if source.endswith(".gz") else source + ".gz"


def _merged(fs: pafs.FileSystem, lists: list[str]) -> Iterator[list[str]]:
    """The rows of sorted lists in order, read as they are asked for."""

    def rows(path: str) -> Iterator[list[str]]:
        with fs.open_input_stream(path, compression=None) as source:
            for line in io.TextIOWrapper(source, encoding="utf-8", newline="\n"):
                yield json.loads(line)

    return heapq.merge(*map(rows, lists))


@dataclass
class Written(WriterCommitMessage):
    """Where a task's pages are; what they are is told by the two lists beside them, so that the driver holds a line for each task only."""

    attempt: str
    files: int = 0
    aliases: int = 0


class PageWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def _opened(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path if ":/" in self.path else os.path.abspath(self.path))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = self._opened()
        done = Written(f"{root}/_job-{self.job}/{uuid.uuid4().hex}")
        try:
            self._write(fs, done, iterator)
        except BaseException:
            if fs.get_file_info(done.attempt).type != pafs.FileType.NotFound:
                fs.delete_dir(done.attempt)
            raise
        return done

    def _write(self, fs: pafs.FileSystem, done: Written, iterator: Iterator[pa.RecordBatch]) -> None:
        files, aliases = [], []
        for batch in iterator:
            for row in batch.to_pylist():
                place = _place(row["source"])
                aliases += [(a, place) for a in row["aliases"] or [] if a != row["source"]]
                if row["text"] is None:
                    continue
                data, target = packed(row["text"]), f"{done.attempt}/{place}"
                fs.create_dir(target.rsplit("/", 1)[0])
                with fs.open_output_stream(target, compression=None) as out:
                    out.write(data)
                files.append((place, hashlib.sha256(data).hexdigest()))
        for name, rows in zip(LISTS, (files, aliases)):
            if files or aliases:
                fs.create_dir(done.attempt)
                with fs.open_output_stream(f"{done.attempt}/{name}", compression=None) as out:
                    for row in sorted(set(rows) if name == LISTS[1] else rows):
                        out.write((json.dumps(row) + "\n").encode())
        done.files, done.aliases = len(files), len(aliases)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = self._opened()
        done = [m for m in messages if m and (m.files or m.aliases)]
        job = f"{root}/_job-{self.job}"
        digest = hashlib.sha256(b"[[")  # of the JSON of all files and all aliases
        if not done:
            self.abort(messages)
            return
        last, comma = None, ""
        for place, hash_ in _merged(fs, [f"{m.attempt}/{LISTS[0]}" for m in done]):
            if place == last:
                self.abort(messages)
                raise ValueError("a page is there twice")
            digest.update((comma + json.dumps([place, hash_])).encode())
            last, comma = place, ", "
        digest.update(b"], [")
        last, comma = None, ""
        with fs.open_output_stream(f"{job}/aliases.jsonl", compression=None) as out:
            for row in _merged(fs, [f"{m.attempt}/{LISTS[1]}" for m in done]):
                if row != last:
                    digest.update((comma + json.dumps(row)).encode())
                    out.write((json.dumps({"alias": row[0], "place": row[1]}) + "\n").encode())
                last, comma = row, ", "
        digest.update(b"]]")
        final = f"{root}/set-{digest.hexdigest()}"
        if fs.get_file_info(final).type != pafs.FileType.NotFound:
            self.abort(messages)
            return
        counted = {m.attempt: m.files for m in done}
        for info in fs.get_file_info(pafs.FileSelector(job)):  # attempts of lost tasks, and those with aliases alone
            if info.type == pafs.FileType.Directory and not counted.get(info.path):
                fs.delete_dir(info.path)
        for m in done:
            for name in LISTS if m.files else ():
                fs.delete_file(f"{m.attempt}/{name}")
        fs.move(job, final)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = self._opened()
        if fs.get_file_info(f"{root}/_job-{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_job-{self.job}")


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cliloom_pages"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> PageWriter:
        if overwrite:
            raise ValueError("sets of pages are only added to")
        if [f.name for f in schema] != ["source", "text", "aliases"]:
            raise ValueError("pages are (source, text, aliases)")
        return PageWriter(self.options["path"])


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(PageFiles)
    return spark


def vacuum(path: str, older_than: float = 7 * 86_400) -> list[str]:
    """Deletes hidden folders of jobs that began so many seconds ago; they may be at work if that is short."""
    fs, root = pafs.FileSystem.from_uri(path if ":/" in path else os.path.abspath(path))
    old = [i for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if i.base_name.startswith("_job-") and (i.mtime is None or i.mtime.timestamp() <= time.time() - older_than)]
    for info in old:
        fs.delete_dir(info.path)
    return [i.base_name for i in old]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """source (without .gz), text and length of the pages of all sets.

    The driver lists the folders that tasks wrote, never files; each is listed and read by one task.
    """
    path = path if ":/" in path else os.path.abspath(path)
    fs, root = pafs.FileSystem.from_uri(path)
    sets = [i.path for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if i.base_name.startswith("set-")]
    folders = [(i.path,) for s in sets for i in fs.get_file_info(pafs.FileSelector(s)) if i.type == pafs.FileType.Directory]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(path)
        made = lambda rows: pa.RecordBatch.from_pylist(rows, pa.schema([("source", pa.string()), ("text", pa.string())]))
        rows, size = [], 0
        for folder in (x for b in batches for x in b.column(0).to_pylist()):
            for info in fs.get_file_info(pafs.FileSelector(folder, recursive=True)):
                if info.type != pafs.FileType.File or not info.path.endswith(".gz"):
                    continue
                with fs.open_input_stream(info.path, compression=None) as source:
                    text = gzip.decompress(source.read()).decode("utf-8", "replace")
                rows.append({"source": info.path.removeprefix(folder + "/").removesuffix(".gz"), "text": text})
                size += len(text) + 100
                if size > BATCH:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    listed = spark.createDataFrame(spark.sparkContext.parallelize(folders, len(folders)), "folder string") if folders else spark.createDataFrame([], "folder string")
    return listed.mapInArrow(read, "source string, text string").select("source", "text", F.length("text").alias("length"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """alias, source of all sets."""
    lines = spark.read.schema("alias string, place string").json(f"{path.rstrip('/')}/set-*/aliases.jsonl")
    return lines.select("alias", F.regexp_replace("place", r"\.gz$", "").alias("source"))
