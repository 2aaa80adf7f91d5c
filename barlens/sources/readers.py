"""Sources and sinks beside Parquet: binary columns, calendars, membership files, CSV panels, JSON state and experiment logs."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR_COLUMNS = ("asset", "t", "open", "high", "low", "close", "volume", "vwap", "amount")


def calendar(spark: SparkSession, path: str) -> DataFrame:
    """(t, idx) from a text file with an ISO date on each line."""
    days = spark.read.text(path).select(F.trim("value").try_cast("date").alias("t")).where("t is not null").distinct()
    return days.withColumn("idx", (F.row_number().over(Window.orderBy("t")) - 1).cast("int"))


def membership_file(spark: SparkSession, path: str, universe: str) -> DataFrame:
    """(universe, asset, start, end) from lines of tab-separated code, start, end; open ends are 1900-01-01 and 2999-12-31."""
    parts = F.split("value", "\t")
    date = lambda i, default: F.coalesce(F.get(parts, F.lit(i)).try_cast("date"), F.lit(default).cast("date"))
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.lit(universe).alias("universe"), F.upper(parts[0]).alias("asset"), date(1, "1900-01-01").alias("start"), date(2, "2999-12-31").alias("end"))


def binary_columns(spark: SparkSession, root: str, header: bool = True) -> DataFrame:
    """(asset, field, idx, value) from files ``root/asset/field.day.bin`` of little-endian 32-bit floats.

    With ``header`` the first number is the calendar index of the second. Files are decoded in the tasks that read them;
    values that are not finite are null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.day.bin").option("recursiveFileLookup", "true").load(root).select("path", "content")

    def decode(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                *_, asset, name = path.split("/")
                x = np.frombuffer(content, dtype="<f4").astype("float64")
                first, x = (int(x[0]), x[1:]) if header and len(x) else (0, x)
                yield pd.DataFrame({"asset": asset.upper(), "field": name.removesuffix(".day.bin"), "idx": np.arange(first, first + len(x), dtype="int64"), "value": np.where(np.isfinite(x), x, np.nan)})

    rows = files.mapInPandas(decode, "asset string, field string, idx long, value double")
    return rows.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def trimmed(values: DataFrame) -> DataFrame:
    """(asset, field, idx, value) between each series' first and last positive value."""
    good = F.when(F.col("value") > 0, F.col("idx"))
    w = Window.partitionBy("asset", "field")
    return values.withColumns({"a": F.min(good).over(w), "b": F.max(good).over(w)}).where(F.col("idx").between(F.col("a"), F.col("b"))).drop("a", "b")


def panel_of(values: DataFrame, dates: DataFrame, fields: list[str]) -> DataFrame:
    """(asset, t, fields...): wide bars from (asset, field, idx, value) and a calendar."""
    wide = values.groupBy("asset", "idx").pivot("field", fields).agg(F.first("value"))
    return wide.join(F.broadcast(dates), "idx").drop("idx")


def adjusted(bars: DataFrame, adjusted_close: str = "adjclose") -> DataFrame:
    """Prices scaled by adjusted over raw close (1 where that is unknown)."""
    ratio = F.coalesce(F.try_divide(F.col(adjusted_close), F.col("close")), F.lit(1.0))
    return bars.withColumns({c: F.col(c) * ratio for c in ("open", "high", "low", "close", "vwap") if c in bars.columns})


def csv_panel(spark: SparkSession, folder: str) -> DataFrame:
    """(asset, t, open ... amount) from a folder of CSV files named by asset."""
    schema = "date date, open double, high double, low double, close double, volume double, amount double"
    raw = spark.read.schema(schema).option("header", True).csv(folder)
    named = raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv", 1).alias("asset"), "*")
    return named.select("asset", F.col("date").alias("t"), "open", "high", "low", "close", "volume", F.try_divide(F.col("amount"), F.col("volume")).alias("vwap"), "amount")


def write_minutes(bars: DataFrame, path: str, backend: str = "parquet") -> None:
    """Overwrite a table of minute bars as Parquet or gzipped CSV, first row of each (asset, datetime) kept."""
    w = Window.partitionBy("asset", "datetime").orderBy("open", "close")
    once = bars.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    if backend == "parquet":
        once.write.mode("overwrite").parquet(path)
    else:
        once.write.mode("overwrite").option("compression", "gzip").option("header", True).csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append to a JSON-lines log (experiments, fills, events)."""
    rows.write.mode("append").json(path)


def best_runs(spark: SparkSession, path: str, metric: str, k: int = 5) -> DataFrame:
    """The ``k`` best runs of an experiment log by a metric in its map of metrics."""
    log = spark.read.schema("run_id string, params map<string,string>, metrics map<string,double>, tags array<string>").json(path)
    return log.where(F.try_element_at("metrics", F.lit(metric)).isNotNull()).orderBy(F.desc(F.col("metrics")[metric]), "run_id").limit(k)


def latest_state(spark: SparkSession, path: str, max_age_seconds: int | None = None) -> DataFrame:
    """(key, value, updated_at): the last write of each key of a state log, not older than asked for."""
    log = spark.read.schema("key string, value string, updated_at timestamp").json(path)
    w = Window.partitionBy("key").orderBy(F.desc("updated_at"), F.desc("value"))
    last = log.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return last if max_age_seconds is None else last.where(F.col("updated_at") >= F.current_timestamp() - F.make_interval(secs=F.lit(max_age_seconds)))


def first_of(*frames: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of several sources by priority: for each key and field the first source that has a value."""
    out = frames[0]
    for other in frames[1:]:
        values = [c for c in out.columns if c not in keys]
        both = out.alias("a").join(other.alias("b"), keys, "full")
        out = both.select(*keys, *[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in values])
    return out


class FactorCache:
    """Factor values stored under a digest of what determines them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, *parts: str) -> str:
        return f"{self.root}/{hashlib.sha1('|'.join(parts).encode()).hexdigest()}"

    def load_or_compute(self, expression: str, universe: str, start: str, end: str, version: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """The stored table, or what ``compute`` returns after it is written; a broken write is not taken for a table."""
        path = self.path(expression, universe, start, end, version)
        jvm = self.spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            compute().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def union_panels(frames: list[DataFrame]) -> DataFrame:
    """Panels of several sources with missing fields as null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def describe(bars: DataFrame) -> DataFrame:
    """One row: numbers of assets, dates and rows, and the range."""
    return bars.agg(F.count_distinct("asset").alias("assets"), F.count_distinct("t").alias("dates"), F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


def with_ids(rows: DataFrame) -> DataFrame:
    """Rows with a run id, one for the call."""
    return rows.withColumn("run_id", F.lit(uuid.uuid4().hex))
