"""Versioned Parquet tables: writers stage files and switch a manifest last, readers see one whole version, and any version can be returned to.

A table is a folder with ``data/<id>`` folders of Parquet files and ``manifests/<number>.json``, each a list of data folders. The greatest number is the
current version. A manifest is written beside its place and renamed into it, which fails if another writer has taken the number: that one
has won, and nothing of the loser is visible. A write that dies half way leaves only a data folder that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ConflictError(RuntimeError):
    """Another writer has made a version since this one read the table."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Files.

    def _read_text(self, path: str) -> str:
        return "\n".join(r["value"] for r in self.spark.read.text(path, wholetext=True).collect())

    def _write_text(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:08d}.json"

    # Versions.

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The current version; 0 before the first write."""
        return max(self.versions(), default=0)

    def describe(self, version: int | None = None) -> dict:
        """What the manifest of a version says: its data folders, schema, and what made it."""
        version = self.version() if version is None else version
        if version not in self.versions():
            raise KeyError(f"{self.path} has no version {version}")
        return json.loads(self._read_text(self._manifest(version)))

    def read(self, version: int | None = None) -> DataFrame:
        """A whole version, by default the current one; later writes do not change what it reads."""
        about = self.describe(version)
        schema = StructType.fromJson(json.loads(about["schema"]))
        folders = [f"{self.path}/data/{d}" for d in about["data"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _staged(self, rows: DataFrame, check: Callable[[DataFrame], bool] | None) -> str:
        name = uuid.uuid4().hex
        folder = f"{self.path}/data/{name}"
        try:
            rows.write.parquet(folder)
            if check is not None and not check(self.spark.read.schema(rows.schema).parquet(folder)):
                raise ValueError(f"the rows for {self.path} fail their check")
        except Exception:
            self._fs.delete(self._path(folder), True)
            raise
        return name

    def _commit(self, after: int, data: Sequence[str], schema: str, why: str) -> int:
        staged = f"{self.path}/manifests/.{uuid.uuid4().hex}"
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))
        self._write_text(staged, json.dumps({"data": list(data), "schema": schema, "why": why, "after": after}))
        target = self._path(self._manifest(after + 1))
        if self._fs.exists(target) or not self._fs.rename(self._path(staged), target):
            self._fs.delete(self._path(staged), False)
            raise ConflictError(f"{self.path} has a version {after + 1} already")
        return after + 1

    def replace(self, rows: DataFrame, check: Callable[[DataFrame], bool] | None = None, why: str = "replace", after: int | None = None) -> int:
        """A version of ``rows`` alone, which may be made of the version before; returns its number.

        ``check`` looks at the rows as written: where it fails (ValueError), or the write does, readers stay on the old version. ``after``: the version that the rows
        were made from, by default the current one; ConflictError if there is a later one."""
        after = self.version() if after is None else after
        return self._commit(after, [self._staged(rows, check)], rows.schema.json(), why)

    def append(self, rows: DataFrame, check: Callable[[DataFrame], bool] | None = None, why: str = "append", after: int | None = None) -> int:
        """A version with the rows of the one before and ``rows``, of which only these are written."""
        after = self.version() if after is None else after
        if not after:
            return self.replace(rows, check, why, after)
        about = self.describe(after)
        rows = rows.select(*self.read(after).columns)
        return self._commit(after, [*about["data"], self._staged(rows, check)], about["schema"], why)

    def rollback(self, to: int | None = None) -> int:
        """A new version that is an older one again, by default the one before; nothing is copied, and the versions between stay readable."""
        now = self.version()
        to = now - 1 if to is None else to
        about = self.describe(to)
        return self._commit(now, about["data"], about["schema"], f"rollback to {to}")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Forget all but the last ``keep`` versions and delete data folders that none of these names; returns the folders. Not while others write."""
        kept = self.versions()[-keep:] if keep else []
        named = {d for v in kept for d in self.describe(v)["data"]}
        for v in self.versions():
            if v not in kept:
                self._fs.delete(self._path(self._manifest(v)), False)
        folder = self._path(f"{self.path}/data")
        gone = [n for n in (s.getPath().getName() for s in self._fs.listStatus(folder)) if n not in named] if self._fs.exists(folder) else []
        for n in gone:
            self._fs.delete(self._path(f"{self.path}/data/{n}"), True)
        return sorted(gone)


def rebuilt(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """``old`` and ``new`` together, one row for each of ``keys``: the new one where both have it; of several, the one with the greatest ``order``."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("__new", F.lit(1)))
    first = Window.partitionBy(*keys).orderBy(F.desc("__new"), *([F.desc(order)] if order else []))
    return both.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__new", "__k")


def extended_calendar(calendar: DataFrame, bars: DataFrame) -> DataFrame:
    """(t): the dates of ``calendar`` and those of ``bars`` after its last one."""
    last = calendar.agg(F.max("t").alias("last"))
    later = bars.select("t").distinct().crossJoin(F.broadcast(last)).where(F.col("last").isNull() | (F.col("t") > F.col("last"))).select("t")
    return calendar.select("t").distinct().unionByName(later)


def tail_append(table: VersionedTable, bars: DataFrame, check: Callable[[DataFrame], bool] | None = None) -> int:
    """Append to a table of bars (asset, t, ...) those after each asset's last date, assets that are not there in whole; returns the version, the old one if there is nothing."""
    now = table.version()
    if not now:
        return table.replace(bars, check, "first bars", now)
    last = table.read(now).groupBy("asset").agg(F.max("t").alias("last"))
    tail = bars.join(last, "asset", "left").where(F.col("last").isNull() | (F.col("t") > F.col("last"))).select(*bars.columns)
    return table.append(tail, check, "tail", now) if tail.take(1) else now
