"""Versioned Parquet tables: a version is a list of parts, named in a file that only one writer can create."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class VersionStore:
    """path/parts holds the parts, path/_VERSIONS/N.json the parts of version N and what made it.

    A part is written whole before a version names it, and never changed, so readers see a version as a whole or not at all. A version's file is created
    only if there is none: of two writers one takes the next number. Works on any file system that Spark can reach.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _create(self, name: str, text: str) -> bool:
        """Write a file that is not there yet; False if somebody else has."""
        try:
            out = self.fs.create(self._path(name), False)
        except Exception as e:  # noqa: BLE001
            if self.fs.exists(self._path(name)):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _manifest(self, version: int) -> dict | None:
        at = self._path(f"_VERSIONS/{version}.json")
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        return json.loads(text) if text else None

    def version(self) -> int:
        """The current version, -1 if there is none: the greatest number whose file is complete."""
        folder = self._path("_VERSIONS")
        if not self.fs.exists(folder):
            return -1
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        numbers = sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)
        return next((n for n in numbers if self._manifest(n)), -1)

    def parts(self, version: int | None = None, kind: str | None = None) -> list[dict]:
        """The parts of a version (path and kind), all or those of one kind."""
        n = self.version() if version is None else version
        found = (self._manifest(n) or {"parts": []})["parts"] if n >= 0 else []
        return [x for x in found if kind is None or x["kind"] == kind]

    def put(self, new: list[tuple[str, DataFrame]], keep=lambda part: False, note: dict | None = None) -> int:
        """A version of the current one's parts that keep() holds for, and of new ones (kind, rows). If another writer is first, it is built on theirs."""
        made = []
        for kind, df in new:
            name = f"parts/{uuid.uuid4().hex}"
            df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
            made.append({"path": name, "kind": kind})
        while True:
            n = self.version()
            kept = [x for x in self.parts(n) if keep(x)] if n >= 0 else []
            if self._create(f"_VERSIONS/{n + 1}.json", json.dumps({"parts": kept + made, "note": note or {}})):
                return n + 1

    def write(self, df: DataFrame, note: dict | None = None) -> int:
        """A version of these rows only."""
        return self.put([("", df)], note=note)

    def append(self, df: DataFrame, note: dict | None = None) -> int:
        """A version of the current rows and these; nothing is written again."""
        return self.put([("", df)], lambda part: True, note)

    def read(self, version: int | None = None, kind: str | None = None) -> DataFrame:
        parts = self.parts(version, kind)
        if not parts:
            raise ValueError(f"{self.path} has no such version or kind of part")
        return self.spark.read.parquet(*[f"{self.path}/{x['path']}" for x in parts])

    def log(self) -> list[dict]:
        return [(self._manifest(n) or {"note": {}})["note"] for n in range(self.version() + 1)]
