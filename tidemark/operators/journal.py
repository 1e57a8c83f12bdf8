"""Small durable records by name: checkpoints of jobs and the manifests of indexes."""

from __future__ import annotations

import json
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has put the version that this one meant to put."""


class Journal:
    """JSON records in a folder that all machines share. Each put writes a new version; the newest complete one counts.

    A version is one small file that is created only if it isn't there, so of two writers of one version one fails and
    knows it. A driver that dies while it writes leaves a file that is no JSON, and the older version stays in force.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _path(self, name: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _store(self, path: Any) -> Any:
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        path = self._path(name)
        store = self._store(path)
        names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
        return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), reverse=True)

    def _read(self, name: str, version: int) -> dict[str, Any] | None:
        lines = [r[0] for r in self.spark.read.option("wholetext", True).text(f"{self.folder}/{name}/{version}.json").collect()]  # one small file
        try:
            return json.loads("".join(lines))
        except json.JSONDecodeError:
            return None

    def newest(self, name: str) -> tuple[int, dict[str, Any] | None]:
        """The newest version's number (0: none) and the newest complete record, which may be an older version."""
        versions = self._versions(name)
        return max(versions, default=0), next((r for v in versions if (r := self._read(name, v)) is not None), None)

    def get(self, name: str) -> dict[str, Any] | None:
        """The newest record of a name, or None."""
        return self.newest(name)[1]

    def put(self, name: str, record: dict[str, Any], version: int | None = None) -> int:
        """Write a record and return its version. With ``version``, which must be new, a :class:`Conflict` if it is there."""
        mine = version or max(self._versions(name), default=0) + 1
        path = self._path(f"{name}/{mine}.json")
        try:
            out = self._store(path).create(path, False)
        except Py4JJavaError as e:
            if "Exist" not in e.java_exception.getClass().getName():
                raise
            if version:
                raise Conflict(f"{name} has a version {version} already") from None
            return self.put(name, record)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        return mine

    def exists(self, name: str) -> bool:
        path = self._path(name)
        return self._store(path).exists(path)

    def delete(self, name: str) -> None:
        path = self._path(name)
        self._store(path).delete(path, True)
