"""JSON-lines logs as a data source, in batch and as a stream, with the time window pushed down to the reader.

    register(spark)
    spark.read.format("cliloom_log").schema("at timestamp, ip string").option("time", "at").load(folder)

Files (plain or .gz) are read below the folder.  A plain file is cut into pieces of
`piece` bytes, each with the lines that begin in it; a .gz file is one piece.  Columns are
the top-level keys of a line's object; nested values come as JSON text; a key that is missing
or null, or whose value has not the column's type, is null.  Timestamps are ISO strings (UTC
where no zone is named) or seconds.

Bounds on the time column, and that a column isn't null, are checked while lines are read, so
that other lines never become rows; they are named in the plan as pushed.  A line that is no
JSON object, or has no time, is rejected: with the option ``rejects`` the source gives these
instead, as (file, place, line), so they can be counted and looked at.

A stream takes files in the order of their names, as rotated logs have them: later files have
greater names.  Paths are anything that pyarrow's file systems open.
"""

from __future__ import annotations

import gzip
import io
import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

PIECE = 64 << 20
ROWS = 8192
_REJECTS = "file string, place long, line string"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path else os.path.abspath(path))


def _files(path: str) -> list[tuple[str, int]]:
    """(path within its file system, size), by name; hidden files and those of Spark's own left out."""
    fs, root = _opened(path)
    found = [fs.get_file_info(root)]
    if found[0].type == pafs.FileType.Directory:
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._" and f.size)


@dataclass
class Piece(InputPartition):
    file: str
    start: int
    end: int | None  # None: the whole file


def _pieces(files: list[tuple[str, int]], size: int) -> list[Piece]:
    out = []
    for name, n in files:
        out += [Piece(name, 0, None)] if name.endswith(".gz") else [Piece(name, a, min(a + size, n)) for a in range(0, n, size)]
    return out


def _lines(fs: pafs.FileSystem, piece: Piece) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in a piece."""
    if piece.end is None:
        with fs.open_input_stream(piece.file, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw)) as lines:
            place = 0
            for line in lines:
                yield place, line
                place += len(line)
        return
    with fs.open_input_file(piece.file) as raw:
        lines = io.BufferedReader(raw, 1 << 20)
        place = piece.start
        if place:  # the line that is under way belongs to the piece before
            lines.seek(place - 1)
            place += len(lines.readline()) - 1
        while place < piece.end:
            line = lines.readline()
            if not line:
                return
            yield place, line
            place += len(line)


def _moment(value) -> datetime | None:
    if isinstance(value, bool):
        return None
    try:
        if isinstance(value, int | float):
            return datetime.fromtimestamp(value, UTC)
        at = datetime.fromisoformat(value)
        return (at if at.tzinfo else at.replace(tzinfo=UTC)).astimezone(UTC)
    except (TypeError, ValueError, OverflowError, OSError):
        return None


def _whole(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63 else None


_AS = {
    "timestamp": _moment, "bigint": _whole, "int": lambda v: x if (x := _whole(v)) is not None and abs(x) < 1 << 31 else None,
    "double": lambda v: float(v) if isinstance(v, int | float) and not isinstance(v, bool) else None, "boolean": lambda v: v if isinstance(v, bool) else None,
    "string": lambda v: v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False),
}

_ARROW = {"timestamp": pa.timestamp("us", "UTC"), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


class LogReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path, self.time, self.rejects, self.size = options["path"], options.get("time"), options.get("rejects", "").lower() == "true", int(options.get("piece", PIECE))
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema]
        if unknown := [k for _, k in self.fields if k not in _AS]:
            raise ValueError(f"columns of a log can't be {', '.join(unknown)}")
        self.schema = pa.schema([(name, _ARROW[kind]) for name, kind in self.fields])
        self.bounds: list[tuple[str, datetime]] = []
        self.present: set[str] = set()

    def pushFilters(self, filters: list) -> Iterable:
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", EqualTo: "="}
            if not self.rejects and type(f) in signs and name == self.time and isinstance(f.value, datetime):
                self.bounds.append((signs[type(f)], f.value if f.value.tzinfo else f.value.replace(tzinfo=UTC)))
            elif not self.rejects and isinstance(f, IsNotNull):
                self.present.add(name)
            else:
                yield f

    def partitions(self) -> list[Piece]:
        return _pieces(_files(self.path), self.size)

    def _inside(self, at: datetime) -> bool:
        return all(at > b if s == ">" else at >= b if s == ">=" else at < b if s == "<" else at <= b if s == "<=" else at == b for s, b in self.bounds)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.path)
        rows: list[list] = []
        for place, line in _lines(fs, partition):
            row = self._row(partition.file, place, line)
            if row is not None:
                rows.append(row)
            if len(rows) == ROWS:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)

    def _row(self, file: str, place: int, line: bytes) -> list | None:
        if not line.strip():
            return None
        try:
            record = json.loads(line)
        except ValueError:
            record = None
        at = _moment(record.get(self.time)) if isinstance(record, dict) and self.time else None
        if not isinstance(record, dict) or self.time and at is None:
            return [file, place, line.decode("utf-8", "replace").rstrip("\r\n")] if self.rejects else None
        if self.rejects or at is not None and not self._inside(at):
            return None
        row = [_AS[kind](record.get(name)) for name, kind in self.fields]
        return None if any(v is None and name in self.present for v, (name, _) in zip(row, self.fields, strict=True)) else row


class LogStreamReader(DataSourceStreamReader):
    """Offsets are the name of the last file taken."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.reader = LogReader(schema, options)

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        return {"file": max((name for name, _ in _files(self.reader.path)), default="")}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return _pieces([f for f in _files(self.reader.path) if start["file"] < f[0] <= end["file"]], self.reader.size)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cliloom_log"

    def schema(self) -> str:
        if self.options.get("rejects", "").lower() == "true":
            return _REJECTS
        raise ValueError("a log is read with a schema")

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> LogStreamReader:
        return LogStreamReader(schema, dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Makes the source known to the session, and lets Spark push filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSource)
    return spark
