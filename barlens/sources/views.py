"""Panels derived from the driver's tables: bars (asset, t, open ... amount), membership intervals, point-in-time facts.

Each view has a DuckDB twin in ``SQL``, a common table expression, so that every query's oracle starts from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(lines: DataFrame) -> DataFrame:
    """Bars from trades (asset, t, price, quantity, amount, place): first and last price by the total order ``place``."""
    money = F.sum(F.col("amount").cast(MONEY)).cast("double")
    volume = F.sum(F.col("quantity").cast(MONEY)).cast("double")
    bars = lines.groupBy("asset", "t").agg(
        F.min_by("price", "place").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "place").alias("close"), volume.alias("volume"), money.alias("amount")
    )
    return bars.withColumn("vwap", F.col("amount") / F.col("volume"))


def _trades(lineitem: DataFrame, asset: str) -> DataFrame:
    return lineitem.select(
        F.col(asset).alias("asset"),
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("t"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("place"),
    )


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of each supplier.

    A supplier has a few lines a month, so lines are not summed before they are shuffled: that would sort every input split whole, and shuffle each line's
    buffers. By supplier alone, so that the windows that follow need no other shuffle."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return _bars(_trades(lines.repartition("l_suppkey"), "l_suppkey"))


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of each brand. ``part`` grows with the data, so the join side is left to the optimizer."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return _bars(_trades(table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")), "p_brand"))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each event type."""
    events = table(spark, sf_dir, "events")
    return _bars(
        events.select(
            F.col("event_type").alias("asset"), F.to_date("ts").alias("t"), F.col("value").alias("price"), F.lit(1.0).alias("quantity"), F.col("value").alias("amount"), F.struct("ts", "event_id").alias("place")
        )
    )


def supplier_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, industry, sector): nation and region of each supplier; both dimensions have fixed sizes of 25 and 5 rows."""
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    region = F.broadcast(table(spark, sf_dir, "region"))
    joined = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select(F.col("s_suppkey").alias("asset"), F.coalesce("n_name", F.lit("Unknown")).alias("industry"), F.coalesce("r_name", F.lit("Unknown")).alias("sector"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(universe, asset, start, end): the interval in which each supplier ships, by region."""
    span = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("asset")).agg(F.to_date(F.min("l_shipdate")).alias("start"), F.to_date(F.max("l_shipdate")).alias("end"))
    return span.join(supplier_industry(spark, sf_dir), "asset").select(F.col("sector").alias("universe"), "asset", "start", "end")


def point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, field, report_date, publish, value): an order is a report that is published when its last line ships."""
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("publish"))
    orders = table(spark, sf_dir, "orders")
    return orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("symbol"), F.col("o_orderpriority").alias("field"), F.to_date("o_orderdate").alias("report_date"), "publish", F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("report_id")
    )


_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"


def _bars_sql(name: str, asset: str, source: str) -> str:
    return f"""{name} AS (
  SELECT *, amount / volume AS vwap FROM (
    SELECT {asset} AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS t,
      first(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS open, max(l_extendedprice / l_quantity) AS high,
      min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS close,
      CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
    FROM {source} GROUP BY ALL))"""


SQL = {
    "supplier_bars": _bars_sql("bars", "l_suppkey", "lineitem"),
    "brand_bars": _bars_sql("bars", "p_brand", "lineitem JOIN part ON l_partkey = p_partkey"),
    "event_bars": """bars AS (
  SELECT *, amount / volume AS vwap FROM (
    SELECT event_type AS asset, CAST(ts AS DATE) AS t, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
      last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount
    FROM events GROUP BY ALL))""",
    "industry": """industry AS (
  SELECT s_suppkey AS asset, coalesce(n_name, 'Unknown') AS industry, coalesce(r_name, 'Unknown') AS sector
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)""",
    "membership": """membership AS (
  SELECT r_name AS universe, s_suppkey AS asset, CAST(min(l_shipdate) AS DATE) AS start_date, CAST(max(l_shipdate) AS DATE) AS end_date
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)""",
    "pit": """pit AS (
  SELECT o_custkey AS symbol, o_orderpriority AS field, CAST(o_orderdate AS DATE) AS report_date, publish, o_totalprice AS value, o_orderkey AS report_id
  FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS publish FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)""",
}
