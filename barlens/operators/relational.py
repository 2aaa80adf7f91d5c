"""Point-in-time and interval joins, grids, reconciliation, de-duplication and labels of events, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Point in time.


def visible_at(facts: DataFrame, asof: str | Column) -> DataFrame:
    """For each (symbol, field) the fact of the latest report that was published by ``asof``; later restatements win."""
    moment = F.lit(asof).cast("timestamp") if isinstance(asof, str) else asof
    latest = Window.partitionBy("symbol", "field").orderBy(F.desc("report_date"), F.desc("publish"), F.desc("report_id"))
    return facts.where(F.col("publish") <= moment).withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str, right_order: str) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before its time, by key.

    One shuffle and sort on (key, time) of the union, no range join: within a key, the last right value is carried on.
    """
    l = left.withColumns({"__t": F.col(left_time).cast("timestamp"), "__side": F.lit(1), "__v": F.lit(None).cast(right.schema[value].dataType), "__o": F.lit(None).cast(right.schema[right_order].dataType), "__row": F.struct(*left.columns)})
    r = right.select(by, F.col(right_time).cast("timestamp").alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"), F.col(right_order).alias("__o"), F.lit(None).cast(l.schema["__row"].dataType).alias("__row"))
    both = l.select(by, "__t", "__side", "__v", "__o", "__row").unionByName(r)
    past = Window.partitionBy(by).orderBy("__t", "__side", "__o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__last", F.last("__v", ignorenulls=True).over(past)).where("__side = 1").select("__row.*", F.col("__last").alias(value))


def snapshot(facts: DataFrame, asof: str, fields: list[str]) -> DataFrame:
    """(symbol, one column for each field): what was visible at ``asof``."""
    return visible_at(facts, asof).groupBy("symbol").pivot("field", fields).agg(F.first("value"))


def upsert(rows: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """One row for each key: the last by ``newest``."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in newest])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def new_rows(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: first of each key among ``incoming`` whose key is not stored."""
    return incoming.join(stored.select(*keys).distinct(), keys, "left_anti")


# Intervals and grids.


def members_at(intervals: DataFrame, dates: DataFrame) -> DataFrame:
    """(t, universe, asset) for each date of the short table ``dates``: an interval join with the dates broadcast."""
    inside = F.col("t").between(F.col("start"), F.coalesce("end", F.lit("2999-12-31").cast("date")))
    return intervals.join(F.broadcast(dates), inside).select("t", "universe", "asset").distinct()


def aligned_panel(bars: DataFrame, max_gap: int = 5, least_rows: int = 30) -> DataFrame:
    """(asset, idx, t, close, valid, r): every asset on every calendar date; returns across at most ``max_gap`` bars.

    Assets with fewer than ``least_rows`` valid bars are left out."""
    dates = bars.select("t").distinct()
    calendar = dates.withColumn("idx", F.row_number().over(Window.orderBy("t")))  # one row for each date
    assets = bars.where("close > 0").groupBy("asset").count().where(F.col("count") >= least_rows).select("asset")
    grid = assets.crossJoin(F.broadcast(calendar))  # the calendar has one row for each date
    joined = grid.join(bars.select("asset", "t", "close"), ["asset", "t"], "left").withColumn("valid", F.coalesce(F.col("close") > 0, F.lit(False)))
    prior = Window.partitionBy("asset").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    last_idx = F.last(F.when(F.col("valid"), F.col("idx")), ignorenulls=True).over(prior)
    last_close = F.last(F.when(F.col("valid"), F.col("close")), ignorenulls=True).over(prior)
    r = F.when(F.col("valid") & (F.col("idx") - last_idx <= max_gap), F.col("close") / last_close - 1)
    return joined.select("asset", "idx", "t", "close", "valid", r.alias("r"))


def common_dates(bars: DataFrame) -> DataFrame:
    """Dates on which every asset has a bar."""
    n = bars.agg(F.count_distinct("asset").alias("n"))
    return bars.groupBy("t").agg(F.count_distinct("asset").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("t")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two closed intervals share a point."""
    return (a_start <= b_end) & (b_start <= a_end)


def parameter_grid(spark: SparkSession, space: dict[str, list]) -> DataFrame:
    """All combinations of a stated parameter space."""
    grid = spark.range(1).drop("id")
    for name, values in space.items():
        grid = grid.crossJoin(spark.createDataFrame([(v,) for v in values], f"{name} {'string' if isinstance(values[0], str) else 'double'}"))
    return grid


# Reconciliation.


def order_changes(target: DataFrame, current: DataFrame, value: float, least: float = 0.001) -> DataFrame:
    """(asset, target, current, delta, side, notional) for weights that differ by at least ``least``."""
    j = target.withColumnRenamed("weight", "target").join(current.withColumnRenamed("weight", "current"), "asset", "full")
    j = j.select("asset", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("current", F.lit(0.0)).alias("current")).withColumn("delta", F.col("target") - F.col("current"))
    return j.where(F.abs("delta") >= least).withColumns({"side": F.when(F.col("delta") > 0, "buy").otherwise("sell"), "notional": F.abs("delta") * value})


def reconcile(internal: DataFrame, broker: DataFrame, tolerance: float = 0.0, critical: float = 100.0) -> DataFrame:
    """(asset, internal, broker, diff, severity) over the union of both sides' positions (asset, qty)."""
    j = internal.withColumnRenamed("qty", "internal").join(broker.withColumnRenamed("qty", "broker"), "asset", "full").na.fill(0.0, ["internal", "broker"])
    diff = F.col("broker") - F.col("internal")
    return j.withColumn("diff", diff).withColumn("severity", F.when(F.abs("diff") <= tolerance, "ok").when(F.abs("diff") < critical, "warn").otherwise("critical"))


# Labels of events (event_id, asset, i0, i1, width) on numbered bars (asset, i, close).


def concurrency(events: DataFrame, bars: DataFrame) -> DataFrame:
    """(asset, i, n): how many events' intervals hold each bar. Events are exploded to the bars they hold, then counted."""
    held = events.select("asset", F.explode(F.sequence("i0", "i1")).alias("i")).groupBy("asset", "i").agg(F.count(F.lit(1)).alias("n"))
    return bars.select("asset", "i").join(held, ["asset", "i"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def sample_weights(events: DataFrame, bars: DataFrame, decay: float = 0.9) -> DataFrame:
    """(event_id, uniqueness, weight): mean of 1 / concurrency over the event, times decay to the power of its age rank."""
    c = concurrency(events, bars)
    spread = events.select("event_id", "asset", "i0", F.explode(F.sequence("i0", "i1")).alias("i")).join(c, ["asset", "i"])
    u = spread.groupBy("event_id", "asset", "i0").agg(F.avg(1 / F.col("n")).alias("uniqueness"))
    age = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("i0"), F.desc("event_id"))) - 1
    return u.select("event_id", "uniqueness", (F.col("uniqueness") * F.pow(F.lit(decay), age)).alias("weight"))


def triple_barrier(events: DataFrame, bars: DataFrame, up: float = 1.0, down: float = 1.0) -> DataFrame:
    """(event_id, label, touch): 1 / -1 if the upper / lower barrier (times ``width``) is touched first by i1, else 0."""
    path = events.select("event_id", "asset", "i0", "width", F.explode(F.sequence("i0", "i1")).alias("i")).join(bars.select("asset", "i", "close"), ["asset", "i"])
    start = F.first("close").over(Window.partitionBy("event_id").orderBy("i"))
    move = path.withColumn("move", F.col("close") / start - 1)
    first = move.groupBy("event_id").agg(
        F.min(F.when(F.col("move") >= up * F.col("width"), F.col("i"))).alias("u"), F.min(F.when(F.col("move") <= -down * F.col("width"), F.col("i"))).alias("d"), F.max("i").alias("end")
    )
    label = F.when(F.col("u").isNotNull() & (F.col("d").isNull() | (F.col("u") < F.col("d"))), 1).when(F.col("d").isNotNull(), -1).otherwise(0)
    return first.select("event_id", label.alias("label"), F.coalesce(F.least("u", "d"), "end").alias("touch"))


def meta_labels(events: DataFrame, bars: DataFrame, cost: float = 0.001) -> DataFrame:
    """(event_id, r, meta): the return in the direction of ``side`` from i0 to i1 after cost, and whether it is positive."""
    at = lambda k, name: bars.select("asset", F.col("i").alias(k), F.col("close").alias(name))
    j = events.join(at("i0", "c0"), ["asset", "i0"]).join(at("i1", "c1"), ["asset", "i1"])
    r = F.col("side") * (F.col("c1") / F.col("c0") - 1) - cost
    return j.select("event_id", r.alias("r"), (r > 0).cast("int").alias("meta"))


# Top-k and states.


def top_weights(scores: DataFrame, n_hold: int, cap: float) -> DataFrame:
    """(t, asset, weight): equal weights of the ``n_hold`` best of each date, at most ``cap``, scaled to one."""
    w = Window.partitionBy("t").orderBy(F.desc("score"), "asset")
    held = scores.where(F.col("score").isNotNull()).withColumn("k", F.row_number().over(w)).where(F.col("k") <= n_hold)
    raw = F.least(1 / F.count(F.lit(1)).over(Window.partitionBy("t")), F.lit(cap))
    return held.withColumn("raw", raw).select("t", "asset", (F.col("raw") / F.sum("raw").over(Window.partitionBy("t"))).alias("weight"))


def streaks(series: DataFrame, bad: Column, order: str = "t") -> DataFrame:
    """(t, bad, streak): length of the run of bad rows that ends at each date of a short series."""
    w = Window.orderBy(order)
    d = series.withColumn("bad", bad).withColumn("run", F.sum((~F.col("bad")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.select(order, "bad", F.sum(F.col("bad").cast("int")).over(Window.partitionBy("run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).alias("streak"))


def legal_transitions(log: DataFrame, allowed: DataFrame) -> DataFrame:
    """The changes of the log (key, state in order ``t``) that the table of (from_state, to_state) pairs allows."""
    steps = log.withColumn("from_state", F.lag("state").over(Window.partitionBy("key").orderBy("t", "id"))).withColumnRenamed("state", "to_state")
    return steps.where(F.col("from_state").isNotNull()).join(F.broadcast(allowed), ["from_state", "to_state"], "left_semi")


def winsorised(panel: DataFrame, value: str, k: float = 3.0) -> DataFrame:
    """(asset, t, z): within each date clipped to median +- k * 1.4826 * MAD, then z-scored."""
    x = panel.where(F.col(value).isNotNull()).select("asset", "t", F.col(value).alias("x"))
    m = x.join(x.groupBy("t").agg(F.percentile("x", 0.5).alias("m")), "t")
    d = m.join(m.groupBy("t").agg(F.percentile(F.abs(F.col("x") - F.col("m")), 0.5).alias("mad")), "t")
    low, high = F.col("m") - k * 1.4826 * F.col("mad"), F.col("m") + k * 1.4826 * F.col("mad")
    c = d.select("asset", "t", F.greatest(F.least("x", high), low).alias("x"))
    w = Window.partitionBy("t")
    sd = F.stddev_pop("x").over(w)
    return c.select("asset", "t", F.when(sd > 1e-10, (F.col("x") - F.avg("x").over(w)) / sd).otherwise(0.0).alias("z"))


def tail_plan(bars: DataFrame, n_back: int = 3) -> DataFrame:
    """(asset, missing, action): bars missing at the end of the calendar: none, a few to append, or too many."""
    dates = bars.select("t").distinct().withColumn("idx", F.row_number().over(Window.orderBy("t")))
    last = dates.agg(F.max("idx").alias("last"))
    own = bars.join(F.broadcast(dates), "t").groupBy("asset").agg(F.max("idx").alias("own")).crossJoin(F.broadcast(last))
    missing = F.col("last") - F.col("own")
    return own.select("asset", missing.alias("missing"), F.when(missing == 0, "skip").when(missing <= n_back, "append").otherwise("reject").alias("action"))


def trailing_four(singles: DataFrame) -> DataFrame:
    """(symbol, ttm, n): sum of the last four quarters (symbol, quarter, value), scaled up where there are fewer."""
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("quarter")))
    last = singles.withColumn("k", k).where("k <= 4")
    return last.groupBy("symbol").agg((F.sum("value") * 4 / F.count(F.lit(1))).alias("ttm"), F.count(F.lit(1)).alias("n"))


def singles_from_cumulative(cumulative: DataFrame) -> DataFrame:
    """(symbol, quarter, value): each quarter's own part of values that accumulate within a year."""
    w = Window.partitionBy("symbol", F.year("quarter")).orderBy("quarter")
    return cumulative.withColumn("value", F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0)))
