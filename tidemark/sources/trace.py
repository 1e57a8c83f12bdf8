"""Traces (an event a line, as JSON) as a data source of Spark: ``spark.read.format("trace")``, ``readStream`` and ``write``."""

from __future__ import annotations

import datetime as dt
import io
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schemas import EVENT
from ..shipping import ship

#: Bytes of a partition; a line belongs to the partition that its first byte lies in.
SPLIT = 64 * 1024 * 1024

_TESTS = {EqualTo: lambda x, y: x == y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y, In: lambda x, y: x in y}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the traces in a folder, in order of names; those that begin with ``_`` or ``.`` aren't there yet."""
    store, place = _open(path)
    found = store.get_file_info(fs.FileSelector(place, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(".jsonl") and f.base_name[0] not in "_.")


@dataclass
class _Range(InputPartition):
    name: str
    start: int
    end: int


def _ranges(files: Iterable[tuple[str, int]], split: int) -> list[_Range]:
    return [_Range(name, at, min(at + split, size)) for name, size in files for at in range(0, size, split)]


def _event(line: bytes) -> tuple | None:
    """The columns of an event, or None for a line that is no object with an id and a time."""
    try:
        held = json.loads(line)
        ts = dt.datetime.fromisoformat(held["ts"].replace("Z", "+00:00"))
        more = {str(k): None if v is None else str(v) for k, v in (held.get("metadata") or {}).items()} or None
        event = held["event_id"]
    except (ValueError, KeyError, TypeError, AttributeError):
        return None
    if event is None:
        return None
    ts = ts if ts.tzinfo else ts.replace(tzinfo=dt.timezone.utc)
    texts = {k: None if held.get(k) is None else str(held[k]) for k in ("session_id", "event_type", "role", "text", "agent")}
    return str(event), texts["session_id"], ts, texts["event_type"], texts["role"], texts["text"], more, texts["agent"]


_NAMES = [part.split()[0] for part in EVENT.split(", ")]


def _read(path: str, part: _Range | None, filters: list[tuple[int, type, Any]]) -> Iterator[tuple]:
    if part is None:  # a folder without traces
        return
    store, place = _open(path)
    with io.BufferedReader(store.open_input_file(f"{place}/{part.name}")) as raw:
        raw.seek(max(part.start - 1, 0))
        if part.start:
            raw.readline()  # the rest of the line before
        while raw.tell() < part.end and (line := raw.readline()):
            row = _event(line)
            if row is not None and all(row[k] is not None and (kind is IsNotNull or _TESTS[kind](row[k], value)) for k, kind, value in filters):
                yield row


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split
        self.filters: list[tuple[int, type, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of columns that hold texts or times are made while lines are read; the rest is left to Spark."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if (type(f) in _TESTS or isinstance(f, IsNotNull)) and len(column) == 1 and column[0] in _NAMES and column[0] != "metadata":
                value = getattr(f, "value", None)
                if isinstance(value, dt.datetime) and value.tzinfo is None:
                    value = value.replace(tzinfo=dt.timezone.utc)
                if column[0] == "ts" and not isinstance(f, IsNotNull) and not isinstance(value, dt.datetime):
                    yield f
                    continue
                self.filters.append((_NAMES.index(column[0]), type(f), value))
            else:
                yield f

    def partitions(self) -> list[_Range]:
        return _ranges(_files(self.path), self.split)

    def read(self, partition: _Range) -> Iterator[tuple]:
        return _read(self.path, partition, self.filters)


class _Stream(DataSourceStreamReader):
    """Whole files in order of their names; the offset is the last name. Writers must name later files greater."""

    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        """All that is there: a batch is spread over as many tasks as it has splits."""
        return {"after": max((name for name, _ in _files(self.path)), default="")}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return _ranges([f for f in _files(self.path) if start["after"] < f[0] <= end["after"]], self.split)

    def read(self, partition: _Range) -> Iterator[tuple]:
        return _read(self.path, partition, [])

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceWriter):
    """Each task writes a hidden file; the commit gives the files of the tasks that counted their names, and an abort removes them."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"

    def write(self, iterator: Iterator[Row]) -> _Written:
        store, place = _open(self.path)
        name = f"{self.job}-{uuid.uuid4().hex[:12]}.jsonl"
        store.create_dir(place, recursive=True)
        with store.open_output_stream(f"{place}/_{name}") as out:
            for row in iterator:
                held = {k: v for k, v in row.asDict().items() if v is not None}
                if isinstance(held.get("ts"), dt.datetime):
                    held["ts"] = held["ts"].astimezone(dt.timezone.utc).isoformat()
                out.write(json.dumps(held, ensure_ascii=False).encode() + b"\n")
        return _Written(name)

    def commit(self, messages: list[_Written | None]) -> None:
        store, place = _open(self.path)
        before = [name for name, _ in _files(self.path)] if self.overwrite else []
        for m in messages:
            if m is not None:
                store.move(f"{place}/_{m.name}", f"{place}/{m.name}")
        for name in before:
            store.delete_file(f"{place}/{name}")

    def abort(self, messages: list[_Written | None]) -> None:
        store, place = _open(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{place}/_{m.name}")


class TraceSource(DataSource):
    """Options: path (a folder that all machines share), split (bytes of a partition).

    Lines that are no event (no JSON object, no id, no time) are passed over. Times without a zone are in UTC.
    """

    @classmethod
    def name(cls) -> str:
        return "trace"

    def schema(self) -> str:
        return EVENT

    def _split(self) -> int:
        return int(self.options.get("split", SPLIT))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._split())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"], self._split())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format ``trace`` known to a session, which then gives filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ship(spark)
    spark.dataSource.register(TraceSource)
