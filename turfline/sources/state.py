"""History and snapshots as versioned tables: each write is a new path, and a pointer names the current one.

A table is never changed in place, so a reader or a retried task sees one version whole.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import newest


class VersionedTable:
    """A folder of versions and a one-row pointer, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        """Names of the manifests, the newest last. A manifest is never written over, so a crash leaves the one before."""
        if not self.fs.exists(self._path(self.root)):
            return []
        return sorted(n for f in self.fs.listStatus(self._path(self.root)) if re.fullmatch(r"manifest-\d{12}\.json", n := f.getPath().getName()))

    def _write_manifest(self, entries: list[dict]) -> None:
        known = self._manifests()
        number = int(known[-1][9:21]) + 1 if known else 1
        part, final = self._path(f"{self.root}/.part-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest-{number:012}.json")
        out = self.fs.create(part, True)
        out.write(bytearray(json.dumps(entries).encode()))
        out.close()
        if not self.fs.rename(part, final):
            self.fs.delete(part, False)
            raise RuntimeError(f"another writer made {final.getName()}")
        for name in known[:-1]:
            self.fs.delete(self._path(f"{self.root}/{name}"), False)

    def _read_text(self, name: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}").collect())

    def versions(self) -> list[dict]:
        """Manifest entries, the default first, then the newest."""
        known = self._manifests()
        if not known:
            return []
        return sorted(json.loads(self._read_text(known[-1])), key=lambda v: (not v["default"], -v["number"]))

    def current(self) -> dict | None:
        return next((v for v in self.versions() if v["active"]), None)

    def read(self, version: str | None = None) -> DataFrame:
        chosen = next(v for v in self.versions() if v["id"] == version) if version else self.current()
        if chosen is None:
            raise LookupError("the table has no version")
        return self.spark.read.parquet(f"{self.root}/{chosen['id']}")

    def write(self, rows: DataFrame, label: str = "", default: bool = False) -> str:
        """Add a version and make it current. The first or a named default can't be deleted."""
        known = self.versions()
        name = f"{safe_name(label) or 'v'}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.root}/{name}")
        entry = {"id": name, "label": label, "number": max([0, *(v["number"] for v in known)]) + 1, "default": default or not known, "active": True}
        self._write_manifest([v | {"active": False, "default": v["default"] and not default} for v in known] + [entry])
        return name

    def activate(self, version: str) -> None:
        known = self.versions()
        if version not in {v["id"] for v in known}:
            raise LookupError(version)
        self._write_manifest([v | {"active": v["id"] == version} for v in known])

    def delete(self, version: str) -> None:
        known = self.versions()
        gone = next(v for v in known if v["id"] == version)
        if gone["default"] or gone["active"]:
            raise ValueError("the default and the current version stay")
        self._write_manifest([v for v in known if v["id"] != version])
        self.fs.delete(self._path(f"{self.root}/{version}"), True)


def safe_name(x: str, length: int = 60) -> str:
    """Letters, digits, "_" and "-" only, so a name never leaves its folder."""
    return re.sub(r"[^A-Za-z0-9_-]+", "_", x).strip("_")[:length]


def upsert(table: VersionedTable, rows: DataFrame, key: list[str], time: str, cap: int = 5000) -> str:
    """Append with replacement by key, the newest rows up to the cap."""
    whole = table.read().unionByName(rows, allowMissingColumns=True) if table.current() else rows
    # Of equal times the order of all other columns decides, so reruns agree.
    order = [F.desc(time), *[F.desc_nulls_last(c) for c in sorted(whole.columns) if c != time]]
    return table.write(newest(whole, key, order).orderBy(*order).limit(cap), "history")
