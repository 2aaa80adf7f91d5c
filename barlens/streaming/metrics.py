"""Labelled counters, gauges and histograms as sums over events: over a table, over a stream, and merged from parts.

A metric is rows (name, labels, kind, le, value, at). Counters and the buckets, sum and count of histograms add up, so parts of any split merge to the
whole; a gauge is its latest value by ``at``. Buckets are cumulative, the last one (``le`` infinite) is the count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of latencies in milliseconds.
LATENCY_MS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 5000.0)
COLUMNS = ("name", "labels", "kind", "le", "value", "at")


def labelled(**labels: Column) -> Column:
    """Labels as one text, in the order of their names, quotes, backslashes and line breaks escaped; null is empty."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    parts = [F.concat(F.lit(f'{k}="'), escaped(labels[k]), F.lit('"')) for k in sorted(labels)]
    return F.concat_ws(",", *parts) if parts else F.lit("")


def _points(events: DataFrame, name: str, kind: str, labels: Column, points: Column) -> DataFrame:
    return events.select(F.lit(name).alias("name"), labels.alias("labels"), F.lit(kind).alias("kind"), F.explode(points).alias("p")).select("name", "labels", "kind", "p.*")


def counter(events: DataFrame, name: str, labels: Column, by: Column | None = None) -> DataFrame:
    """(name, labels, kind, le, value): how often, or by how much, for each value of the labels; nulls of ``by`` add nothing."""
    amount = F.lit(1.0) if by is None else F.coalesce(by.cast("double"), F.lit(0.0))
    return summed(_points(events, name, "counter", labels, F.array(F.struct(F.lit(None).cast("double").alias("le"), amount.alias("value")))))


def histogram(events: DataFrame, name: str, labels: Column, value: Column, buckets: Sequence[float] = LATENCY_MS) -> DataFrame:
    """Cumulative buckets and the sum of ``value``; null values are not observed. An event gives one point for each bucket that holds it, and two more."""
    v = value.cast("double")
    bounds = F.array(*[F.lit(float(b)) for b in sorted({float(b) for b in buckets})], F.lit(float("inf")))
    point = lambda le, x: F.struct(le.alias("le"), x.alias("value"))
    held = F.transform(F.filter(bounds, lambda b: v <= b), lambda b: point(b, F.lit(1.0)))
    total = F.array(point(F.lit(None).cast("double"), v))
    return summed(_points(events.where(v.isNotNull() & ~F.isnan(v)), name, "histogram", labels, F.concat(held, total)))


def summed(points: DataFrame) -> DataFrame:
    # Decimals, so that the order in which parts are added does not show.
    return points.groupBy("name", "labels", "kind", "le").agg(F.sum(F.col("value").cast("decimal(28,6)")).cast("double").alias("value"))


def gauge(events: DataFrame, name: str, labels: Column, value: Column, at: Column) -> DataFrame:
    """(name, labels, kind, le, value, at): the latest value, of equal times the greatest."""
    latest = F.max(F.struct(at.alias("at"), value.cast("double").alias("value")))
    d = events.where(value.isNotNull()).groupBy(labels.alias("labels")).agg(latest.alias("m"))
    return d.select(F.lit(name).alias("name"), "labels", F.lit("gauge").alias("kind"), F.lit(None).cast("double").alias("le"), "m.value", "m.at")


def merged(*parts: DataFrame) -> DataFrame:
    """Metrics of parts as those of the whole; parts without ``at`` have no gauges."""
    out = None
    for p in parts:
        p = p if "at" in p.columns else p.withColumn("at", F.lit(None).cast("timestamp"))
        out = p.select(*COLUMNS) if out is None else out.unionByName(p.select(*COLUMNS))
    added = summed(out.where("kind <> 'gauge'")).withColumn("at", F.lit(None).cast("timestamp"))
    latest = out.where("kind = 'gauge'").groupBy("name", "labels", "kind", "le").agg(F.max(F.struct("at", "value")).alias("m")).select("name", "labels", "kind", "le", "m.value", "m.at")
    return added.select(*COLUMNS).unionByName(latest.select(*COLUMNS))


def quantile(metrics: DataFrame, q: float) -> DataFrame:
    """(name, labels, value): the bucket bound under which a share ``q`` of a histogram's observations lies; null where that is beyond the last bound."""
    count = metrics.where("kind = 'histogram' AND isnotnull(le) AND le = double('inf')").select("name", "labels", F.col("value").alias("n"))
    d = metrics.where("kind = 'histogram' AND le < double('inf')").join(count, ["name", "labels"], "right")
    return d.groupBy("name", "labels").agg(F.min(F.when(F.col("value") >= F.col("n") * q, F.col("le"))).alias("value"))


def exposition(metrics: DataFrame) -> DataFrame:
    """(name, place, line): the lines of the text format, in order of name, labels and bound within ``place``; sums and counts after the buckets."""
    le = F.when(F.col("le") == float("inf"), "+Inf").when(F.col("le") == F.floor("le"), F.col("le").cast("long").cast("string")).otherwise(F.col("le").cast("string"))
    joined = lambda *parts: F.concat_ws(",", *[F.when(p != "", p) for p in parts])
    wrap = lambda labels: F.when(labels == "", "").otherwise(F.concat(F.lit("{"), labels, F.lit("}")))
    is_sum = (F.col("kind") == "histogram") & F.col("le").isNull()
    suffix = F.when(is_sum, "_sum").when(F.col("le").isNotNull(), "_bucket").otherwise("")
    labels = F.when(F.col("le").isNotNull(), joined(F.col("labels"), F.concat(F.lit('le="'), le, F.lit('"')))).otherwise(F.col("labels"))
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    lines = metrics.select("name", "labels", F.coalesce("le", F.lit(float("nan"))).alias("bound"), F.concat(F.col("name"), suffix, wrap(labels), F.lit(" "), number).alias("line"))
    counts = metrics.where(F.col("le") == float("inf")).select("name", "labels", F.lit(float("nan")).alias("bound"), F.concat(F.col("name"), F.lit("_count"), wrap(F.col("labels")), F.lit(" "), number).alias("line"))
    # Two lines may share a bound (sum and count): the text decides, count before sum.
    return lines.unionByName(counts).select("name", F.struct("labels", "bound", "line").alias("place"), "line")
