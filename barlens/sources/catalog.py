"""Panel sources by name, and tables that are appended to only after a check."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from barlens.sources import readers

SWITCH = "BARLENS_SOURCE_"


@dataclass(frozen=True)
class Source:
    name: str
    read: Callable[..., DataFrame]
    extra: bool = False


class Catalog:
    """Readers of bars by name. Extra sources are off unless they are switched on, by name here or in the environment (``BARLENS_SOURCE_<NAME>``)."""

    def __init__(self, enabled: set[str] | None = None):
        self._sources: dict[str, Source] = {}
        self._enabled = enabled

    def register(self, name: str, read: Callable[..., DataFrame], extra: bool = False) -> None:
        """Add a source; one of the same name is replaced."""
        self._sources[name] = Source(name, read, extra)

    def enabled(self, name: str) -> bool:
        source = self._sources[name]
        if not source.extra:
            return True
        if self._enabled is not None:
            return name in self._enabled
        return os.environ.get(SWITCH + name.upper(), "").strip().lower() in ("1", "true", "yes")

    def listed(self) -> list[tuple[str, bool]]:
        """Names with whether they are on, in order."""
        return [(n, self.enabled(n)) for n in sorted(self._sources)]

    def read(self, name: str, *args, **options) -> DataFrame:
        """The panel of a source; KeyError if there is none of that name, PermissionError if it is off."""
        if name not in self._sources:
            raise KeyError(f"no source {name!r}; there are {', '.join(sorted(self._sources))}")
        if not self.enabled(name):
            raise PermissionError(f"source {name!r} is switched off")
        return self._sources[name].read(*args, **options)

    def first(self, names: list[str], *args, keys: list[str], **options) -> DataFrame:
        """Rows of the sources that are on, by priority: for each key and field the first one that has a value."""
        found = [self.read(n, *args, **options) for n in names if self.enabled(n)]
        return readers.first_of(*found, keys=keys)


def append_checked(rows: DataFrame, path: str, check: Callable[[DataFrame], bool]) -> int:
    """Append ``rows`` to the Parquet table at ``path`` if ``check`` of them, as written, holds; returns their number.

    Rows are staged beside the table and read back, so that a failed computation or check leaves the table as it was (ValueError)."""
    spark = rows.sparkSession
    staged = f"{path.rstrip('/')}_staged-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    try:
        rows.write.parquet(staged)
        back = spark.read.schema(rows.schema).parquet(staged)
        if not check(back):
            raise ValueError(f"the rows for {path} fail their check; nothing was appended")
        n = back.count()
        back.write.mode("append").parquet(path)
        return n
    finally:
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
