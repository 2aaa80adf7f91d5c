"""Order schedules, fills under participation caps, kill switches and pre-trade checks as windows over orders."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = [(9, 35), (10, 5), (10, 35), (11, 5), (13, 0), (13, 30), (14, 0), (14, 30)]


def time_grid(spark: SparkSession) -> DataFrame:
    """(slot, at) of a trading day, half-hours without the lunch break."""
    return spark.createDataFrame([(i, f"{h:02d}:{m:02d}") for i, (h, m) in enumerate(SLOTS)], "slot int, at string")


def slice_weights(style: str, n: int = len(SLOTS)) -> list[float]:
    """Shares of an order by slot: even (twap), heavy at both ends (vwap), or falling by a fifth each (shortfall)."""
    raw = {"twap": [1.0] * n, "vwap": [1 + 0.5 * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)], "shortfall": [0.8**i for i in range(n)]}[style]
    return [x / sum(raw) for x in raw]


def schedule(orders: DataFrame, style: Column, lot: int = 1) -> DataFrame:
    """(order_id, slot, style, qty): each order cut by its style's weights; what rounding leaves goes to the last slot."""
    tables = {s: F.array(*map(F.lit, slice_weights(s))) for s in ("twap", "vwap", "shortfall")}
    weights = F.when(style == "twap", tables["twap"]).when(style == "vwap", tables["vwap"]).otherwise(tables["shortfall"])
    rows = orders.withColumn("style", style).select("order_id", "style", F.col("qty").alias("whole"), F.posexplode(weights).alias("slot", "w"))
    cut = rows.withColumn("qty", F.floor(F.col("whole") * F.col("w") / lot) * lot)
    w = Window.partitionBy("order_id")
    return cut.select("order_id", "slot", "style", F.when(F.col("slot") == len(SLOTS) - 1, F.col("whole") - F.sum("qty").over(w) + F.col("qty")).otherwise(F.col("qty")).cast("double").alias("qty"))


def urgency_style(urgency: Column) -> Column:
    return F.when(urgency >= 0.7, "shortfall").when(urgency >= 0.3, "vwap").otherwise("twap")


def capped_fills(targets: DataFrame, days: DataFrame, share: float = 0.1) -> DataFrame:
    """(asset, t, fill, left): a target quantity worked off over days, each at most ``share`` of the day's volume.

    What earlier caps could have filled is a running sum, so no day waits for another."""
    cap = F.col("volume") * share
    before = F.coalesce(F.sum(cap).over(Window.partitionBy("asset").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    fill = F.greatest(F.lit(0.0), F.least(cap, F.col("target") - before))
    return days.join(targets, "asset").select("asset", "t", fill.alias("fill"), F.greatest(F.lit(0.0), F.col("target") - before - cap).alias("left"))


def kill_switch(equity: DataFrame, key: str, limit: float) -> DataFrame:
    """(key, t, drawdown, tripped): tripped stays once the drawdown from the running peak has reached ``limit``."""
    w = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    d = equity.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)
    return d.select(key, "t", "drawdown", F.max(F.col("drawdown") <= -limit).over(w).alias("tripped"))


def flow_counts(orders: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """``orders`` with the number of the key's orders in the ``seconds`` up to each, itself included."""
    w = Window.partitionBy(key).orderBy(F.unix_timestamp(ts)).rangeBetween(-seconds + 1, 0)
    return orders.withColumn("recent", F.count(F.lit(1)).over(w))


def order_ids(orders: DataFrame, prefix: str, key: str, ts: str, tie: str) -> DataFrame:
    """``orders`` with an id that reruns repeat: prefix, key and the order's number within the key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(ts, tie))
    return orders.withColumn("client_order_id", F.format_string(f"{prefix}-%s-%06d", F.col(key).cast("string"), n))


def replayed(log: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, value, n): the last write of each key, and how many there were."""
    return log.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("n"))
