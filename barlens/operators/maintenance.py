"""Upkeep of stored panels: splices, dirty first rows, disclosure dates, membership tails, as set-based repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.operators.expression import series


def dirty_heads(bars: DataFrame, least: float = 5.0) -> DataFrame:
    """(asset, t, ratio): first bars whose close is off the second's by at least that factor."""
    w = series()
    d = bars.withColumns({"n": F.row_number().over(w), "next": F.lead("close").over(w)}).where("n = 1")
    ratio = F.try_divide(F.greatest("close", "next"), F.least("close", "next"))
    return d.select("asset", "t", ratio.alias("ratio")).where(F.col("ratio") >= least)


def rescaled_splice(bars: DataFrame, boundary: str) -> DataFrame:
    """Bars from ``boundary`` on multiplied by the last close before it over the first one from it on."""
    b = F.lit(boundary).cast("date")
    own = bars.groupBy("asset").agg(F.max_by(F.when(F.col("t") < b, F.col("close")), F.when(F.col("t") < b, F.col("t"))).alias("p0"), F.min_by(F.when(F.col("t") >= b, F.col("close")), F.when(F.col("t") >= b, F.col("t"))).alias("v0"))
    k = F.when(F.col("t") >= b, F.coalesce(F.try_divide(F.col("p0"), F.col("v0")), F.lit(1.0))).otherwise(1.0)
    return bars.join(own, "asset").withColumns({c: F.col(c) * k for c in ("open", "high", "low", "close")}).drop("p0", "v0")


def disclosure_dates(rows: DataFrame, priority: list[str]) -> DataFrame:
    """(symbol, quarter, announced): the first date there is, by priority; the greatest of repeated rows."""
    return rows.groupBy("symbol", "quarter").agg(F.max(F.coalesce(*[F.col(c) for c in priority])).alias("announced"))


def extended_members(intervals: DataFrame, current: DataFrame, today: str) -> DataFrame:
    """Membership after a day's list: intervals that end last and are still listed are extended, new assets are added."""
    t = F.lit(today).cast("date")
    last = intervals.agg(F.max("end").alias("last"))
    j = intervals.crossJoin(F.broadcast(last)).join(current.select("asset", F.lit(True).alias("now")).distinct(), "asset", "left")
    kept = j.select("asset", "start", F.when((F.col("end") == F.col("last")) & F.coalesce("now", F.lit(False)), t).otherwise(F.col("end")).alias("end"))
    new = current.select("asset").distinct().join(intervals.select("asset"), "asset", "left_anti").select("asset", t.alias("start"), t.alias("end"))
    return kept.unionByName(new)


def gaps(bars: DataFrame) -> DataFrame:
    """(asset, idx, length): runs of calendar dates without a bar between an asset's first and last, by their first index."""
    dates = bars.select("t").distinct().withColumn("idx", F.row_number().over(Window.orderBy("t")))
    d = bars.join(F.broadcast(dates), "t").select("asset", "idx", (F.lead("idx").over(Window.partitionBy("asset").orderBy("idx")) - F.col("idx") - 1).alias("length"))
    return d.where("length > 0").select("asset", (F.col("idx") + 1).alias("idx"), "length")
