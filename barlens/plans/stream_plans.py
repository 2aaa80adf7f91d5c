"""Queries of the runtime over ``events``: batch forms with DuckDB twins, and the stateful stream drained once."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.functions.columns import quantised
from barlens.plans.stat_plans import _BARS, q
from barlens.sources import readers, views
from barlens.streaming import runtime


def _events(spark, sf_dir) -> DataFrame:
    return views.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def guard(spark, sf_dir):
    lag = (F.col("event_id") % 12_000 - 500) * 1000
    e = _events(spark, sf_dir).withColumn("local_ts", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + lag))
    return runtime.causal(e, "ts", "local_ts").groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def tumbling(spark, sf_dir):
    return runtime.tumbling(_events(spark, sf_dir), "ts", ["event_type"], "value").select("start", "event_type", "n", quantised("total").alias("total"))


def sliding(spark, sf_dir):
    return runtime.sliding(_events(spark, sf_dir), "ts", ["event_type"])


def sessions(spark, sf_dir):
    return runtime.sessions(_events(spark, sf_dir), "ts", "user_id", "6 hours").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def positions(spark, sf_dir):
    e = _events(spark, sf_dir).dropDuplicates(["event_id"])
    return runtime.positions(e, "user_id", F.when(F.col("event_type") == "purchase", "buy").otherwise("sell"), "value").select("user_id", quantised("position").alias("position"), "n")


def ratio(spark, sf_dir):
    orders = _events(spark, sf_dir).select("user_id", "event_id", (F.col("event_type") == "purchase").alias("filled"))
    return runtime.ratio_guard_batch(orders, "user_id", 20, 0.9).select("user_id", "event_id", quantised("share").alias("share"), "tripped")


def ratio_stream(spark, sf_dir):
    """The same rule with state on a stream of the table, drained once; keyed state, one row out for each order."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, name = posixpath.split(path)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    orders = stream.select("user_id", "event_id", (F.col("event_type") == "purchase").alias("filled"))
    out = runtime.drained(runtime.ratio_guard(orders, "user_id", 20, 0.9), "ratio")
    return out.select("user_id", "event_id", quantised("share").alias("share"), "tripped")


def settlement(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("day", F.to_date("ts")).withColumn("qty", F.floor("value").cast("double"))
    return runtime.settled(e, "user_id", "day", "qty")


def scan_summary(spark, sf_dir):
    return readers.describe(views.supplier_bars(spark, sf_dir))


def range_scan(spark, sf_dir):
    """Returns of a calendar range with the filter on the scanned column, as a range scan reads it."""
    l = views.table(spark, sf_dir, "lineitem").where(F.col("l_shipdate").between("1997-01-01", "1997-12-31"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))


def adjusted(spark, sf_dir):
    b = views.supplier_bars(spark, sf_dir).withColumn("adjclose", F.when(F.col("asset") % 3 == 0, F.col("close") * 0.5).when(F.col("asset") % 3 == 1, F.col("close")))
    return readers.adjusted(b).select("asset", "t", *[quantised(c).alias(c) for c in ("open", "close", "vwap")])


def fallback(spark, sf_dir):
    """Quotes by priority: a source with gaps, then the full one."""
    b = views.brand_bars(spark, sf_dir).select("asset", "t", "close", "volume")
    first = b.where("day(t) = 1 AND month(t) % 2 = 0").withColumn("close", F.when(F.col("volume") > 300, F.col("close") * 2))
    return readers.first_of(first, b, keys=["asset", "t"]).select("asset", "t", quantised("close").alias("close"), "volume")


QUERIES = {
    "causality_guard": guard,
    "tumbling_windows": tumbling,
    "sliding_windows": sliding,
    "session_windows": sessions,
    "fill_positions": positions,
    "order_ratio": ratio,
    "order_ratio_stream": ratio_stream,
    "settlement": settlement,
    "scan_summary": scan_summary,
    "range_scan": range_scan,
    "adjusted_prices": adjusted,
    "source_fallback": fallback,
}
_RATIO = "WITH r AS (SELECT user_id, event_id, 1 - avg((event_type = 'purchase')::INT::DOUBLE) OVER w AS share, count(*) OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT user_id, event_id, k >= 10 AND share > 0.9::DOUBLE AS tripped, " + q({"share": "share"}) + " FROM r"
ORACLE_SQL = {
    "causality_guard": "SELECT CASE WHEN event_id % 12000 - 500 < 0 THEN 'future' WHEN event_id % 12000 - 500 > 10000 THEN 'late' ELSE 'accepted' END AS reason, count(*) AS n FROM events GROUP BY 1",
    "tumbling_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, " + q({"total": "CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE)"}) + " FROM events GROUP BY ALL",
    "sliding_windows": "SELECT (date_trunc('day', ts) - INTERVAL 1 DAY * k)::TIMESTAMP AS start, event_type, count(*) AS n FROM events, (SELECT unnest(generate_series(0, 6)) AS k) GROUP BY ALL",
    "session_windows": """WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER w >= INTERVAL 6 HOURS)::INT AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(coalesce(brk, 0)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL)
    SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
    "fill_positions": "SELECT user_id, count(*) AS n, " + q({"position": "CAST(sum(CAST(CASE WHEN event_type = 'purchase' THEN value ELSE -value END AS DECIMAL(18,4))) AS DOUBLE)"}) + " FROM events GROUP BY user_id",
    "order_ratio": _RATIO,
    "order_ratio_stream": _RATIO,
    "settlement": "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(floor(value)) AS bought FROM events GROUP BY ALL) SELECT user_id, day, bought, coalesce(sum(bought) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sellable FROM d",
    "scan_summary": _BARS + " SELECT count(DISTINCT asset) AS assets, count(DISTINCT t) AS dates, count(*) AS n, min(t) AS first, max(t) AS last FROM bars",
    "range_scan": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' GROUP BY ALL",
    "adjusted_prices": _BARS + ", f AS (SELECT *, CASE WHEN asset % 3 = 0 THEN 0.5::DOUBLE ELSE 1.0 END AS k FROM bars) SELECT asset, t, " + q({"open": "open * k", "close": "close * k", "vwap": "vwap * k"}) + " FROM f",
    "source_fallback": "WITH " + views.SQL["brand_bars"] + " SELECT asset, t, volume, " + q({"close": "CASE WHEN month(t) % 2 = 0 AND volume > 300 THEN close * 2 ELSE close END"}) + " FROM bars",
}
