"""Queries of joins, grids, labels, top-k and set operations, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.columns import quantised
from barlens.operators import expression, factors, relational, stats
from barlens.plans.stat_plans import _BARS, _IC, _PAIRS, _S, panel, q, quantise
from barlens.sources import views

ASOF = "1998-06-01"
FIELDS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def pit_asof(spark, sf_dir):
    return relational.visible_at(views.point_in_time(spark, sf_dir), ASOF).select("symbol", "field", "report_date", "value")


def pit_asof_join(spark, sf_dir):
    """Each customer's last visible report at each half-year start."""
    facts = views.point_in_time(spark, sf_dir)
    dates = spark.sql("SELECT explode(sequence(DATE'1995-07-01', DATE'2001-07-01', INTERVAL 6 MONTHS)) AS asof")
    grid = facts.select("symbol").distinct().crossJoin(F.broadcast(dates))
    latest = facts.groupBy("symbol", "publish").agg(F.max("report_id").alias("report_id"), F.max_by("value", "report_id").alias("value"))
    return relational.asof_join(grid, latest, "symbol", "asof", "publish", "value", "report_id")


def pit_snapshot(spark, sf_dir):
    wide = relational.snapshot(views.point_in_time(spark, sf_dir), ASOF, FIELDS)
    return wide.select("symbol", *[F.col(f"`{f}`").alias(f"f{i + 1}") for i, f in enumerate(FIELDS)])


def upsert_latest(spark, sf_dir):
    return relational.upsert(views.point_in_time(spark, sf_dir), ["symbol", "field"], ["publish", "report_id"]).select("symbol", "field", "report_id", "value")


def membership_asof(spark, sf_dir):
    dates = spark.sql("SELECT explode(sequence(DATE'1995-01-15', DATE'2001-11-15', INTERVAL 1 YEAR)) AS t")
    return relational.members_at(views.membership(spark, sf_dir), dates).groupBy("t", "universe").agg(F.count(F.lit(1)).alias("members"), F.min("asset").alias("first_asset"))


def aligned(spark, sf_dir):
    p = relational.aligned_panel(views.supplier_bars(spark, sf_dir))
    return p.select("asset", "idx", "t", "close", "valid", quantised("r").alias("r")).drop("close")


def common(spark, sf_dir):
    return relational.common_dates(views.brand_bars(spark, sf_dir))


def _last_weights(spark, sf_dir, offset: int, column: str) -> DataFrame:
    bars = views.supplier_bars(spark, sf_dir)
    t = bars.select("t").distinct().orderBy(F.desc("t")).limit(offset + 1).agg(F.min("t").alias("d"))
    day = bars.join(F.broadcast(t), F.col("t") == F.col("d")).select("asset", F.col(column).alias("x"))
    top = day.orderBy(F.desc("x"), "asset").limit(20)
    return top.crossJoin(F.broadcast(top.agg(F.sum("x").alias("s")))).select("asset", (F.col("x") / F.col("s")).alias("weight"))


def orders(spark, sf_dir):
    return quantise(relational.order_changes(_last_weights(spark, sf_dir, 0, "volume"), _last_weights(spark, sf_dir, 1, "volume"), 1e6), "asset", "side")


def reconciled(spark, sf_dir):
    qty = lambda o: _volumes(spark, sf_dir, o)
    return relational.reconcile(qty(0), qty(1), 10.0, 60.0)


def _volumes(spark, sf_dir, offset: int) -> DataFrame:
    bars = views.supplier_bars(spark, sf_dir)
    t = bars.select("t").distinct().orderBy(F.desc("t")).limit(offset + 1).agg(F.min("t").alias("d"))
    return bars.join(F.broadcast(t), F.col("t") == F.col("d")).select("asset", F.col("volume").alias("qty"))


def _numbered(spark, sf_dir) -> DataFrame:
    return views.supplier_bars(spark, sf_dir).select("asset", "t", "close", F.row_number().over(expression.series()).alias("i"))


def _label_events(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """An event on every bar, for up to six bars, as wide as 0.2 + 0.05 * (bar modulo 3)."""
    bars = _numbered(spark, sf_dir)
    last = F.max("i").over(Window.partitionBy("asset"))
    e = bars.withColumn("last", last).select(
        (F.col("asset") * 1000 + F.col("i")).alias("event_id"), "asset", F.col("i").alias("i0"), F.least(F.col("i") + 5 + F.col("asset") % 2, F.col("last")).cast("int").alias("i1"), (F.lit(0.2) + F.lit(0.05) * (F.col("i") % 3)).alias("width"), F.when(F.col("i") % 2 == 0, -1).otherwise(1).alias("side")
    )
    return e, bars


def concurrent(spark, sf_dir):
    return relational.concurrency(*_label_events(spark, sf_dir))


def weights(spark, sf_dir):
    return quantise(relational.sample_weights(*_label_events(spark, sf_dir)), "event_id")


def barriers(spark, sf_dir):
    return relational.triple_barrier(*_label_events(spark, sf_dir))


def meta(spark, sf_dir):
    return quantise(relational.meta_labels(*_label_events(spark, sf_dir)), "event_id", "meta")


def industries(spark, sf_dir):
    bars = views.supplier_bars(spark, sf_dir).join(views.supplier_industry(spark, sf_dir), "asset", "left")
    return bars.groupBy(F.coalesce("industry", F.lit("Unknown")).alias("industry")).agg(F.count_distinct("asset").alias("assets"), F.count(F.lit(1)).alias("bars"), quantised(F.avg("close")).alias("close"))


def dedupe_first(spark, sf_dir):
    """First event of each (user, type, day)."""
    e = views.table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    w = Window.partitionBy("user_id", "event_type", "day").orderBy("ts", "event_id")
    return e.withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_type", "day", "event_id")


def incremental(spark, sf_dir):
    """Keys (user, value band) of the second half that a store of the first half lacks."""
    e = views.table(spark, sf_dir, "events").withColumn("band", F.floor(F.col("value") / 5).cast("long"))
    cut = e.agg(F.percentile("event_id", 0.5).alias("c"))
    both = e.crossJoin(F.broadcast(cut))
    return relational.new_rows(both.where("event_id > c").select("user_id", "band"), both.where("event_id <= c"), ["user_id", "band"]).distinct()


def grid(spark, sf_dir):
    g = relational.parameter_grid(spark, {"n_hold": [5.0, 10.0, 20.0], "cost_bps": [10.0, 17.0], "method": ["equal", "score"]})
    g = g.withColumn("key", F.concat_ws("|", F.col("n_hold").cast("int"), F.col("cost_bps").cast("int"), "method"))
    # Every supplier's balance under each of the twelve settings.
    s = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset"), "s_acctbal")
    each = F.col("s_acctbal") / F.when(F.col("method") == "equal", F.col("n_hold")).otherwise(F.col("n_hold") / 2)
    return s.crossJoin(F.broadcast(g)).select("asset", "n_hold", "cost_bps", "method", "key", quantised(each * (1 - F.col("cost_bps") / 1e4)).alias("position"))


def transitions(spark, sf_dir):
    log = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("state"), F.col("ts").alias("t"), F.col("event_id").alias("id"))
    kinds = log.select("state").distinct()
    allowed = kinds.withColumnRenamed("state", "from_state").crossJoin(kinds.withColumnRenamed("state", "to_state")).where("from_state < to_state")
    return relational.legal_transitions(log, allowed).groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


def top(spark, sf_dir):
    return quantise(relational.top_weights(panel(spark, sf_dir)[0], 15, 0.05), "t", "asset")


def kill_streak(spark, sf_dir):
    ic = stats.rank_ic(stats.paired(*panel(spark, sf_dir)))
    return relational.streaks(ic, F.floor(F.col("ic") * 1e4 + 0.5) < 0)


def winsor(spark, sf_dir):
    return quantise(relational.winsorised(views.supplier_bars(spark, sf_dir), "amount"), "asset", "t")


def tails(spark, sf_dir):
    return relational.tail_plan(views.supplier_bars(spark, sf_dir))


def _quarterly(spark, sf_dir) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("symbol"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("quarter")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))


def ttm(spark, sf_dir):
    return quantise(relational.trailing_four(_quarterly(spark, sf_dir)), "symbol", "n")


def singles(spark, sf_dir):
    w = Window.partitionBy("symbol", F.year("quarter")).orderBy("quarter").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = _quarterly(spark, sf_dir).withColumn("value", F.sum(F.col("value").cast("decimal(18,2)")).over(w).cast("double"))
    return quantise(relational.singles_from_cumulative(cumulative), "symbol", "quarter")


def comps(spark, sf_dir):
    """Quartiles of balance by segment over positive values, and customers beyond two deviations."""
    c = views.table(spark, sf_dir, "customer").where("c_acctbal > 0")
    s = c.groupBy("c_mktsegment").agg(F.percentile("c_acctbal", 0.25).alias("p25"), F.percentile("c_acctbal", 0.5).alias("p50"), F.percentile("c_acctbal", 0.75).alias("p75"), F.avg("c_acctbal").alias("mean"), F.stddev_samp("c_acctbal").alias("sd"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    out = c.join(F.broadcast(s), "c_mktsegment").groupBy("c_mktsegment", "p25", "p50", "p75", "mean", "sd", "n").agg(F.sum((F.abs(F.col("c_acctbal") - F.col("mean")) > 2 * F.col("sd")).cast("long")).alias("outliers"))
    return quantise(out, "c_mktsegment", "n", "outliers")


def set_operations(spark, sf_dir):
    """Sizes of union, intersection and difference of the users seen in the first and the second half of the days."""
    e = views.table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    mid = e.agg(F.date_add(F.min("day"), 2).alias("m"))
    both = e.crossJoin(F.broadcast(mid))
    a, b = both.where("day < m").select("user_id"), both.where("day >= m").select("user_id")
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    return n(a.union(b).distinct(), "union").union(n(a.intersect(b), "intersect")).union(n(a.subtract(b), "except")).union(n(a.exceptAll(b), "except_all"))


def regimes(spark, sf_dir):
    """Mean return of the equal-weight market by trend regime, from moving averages of prior bars only."""
    bars = views.supplier_bars(spark, sf_dir).withColumn("r", factors.change(F.col("close")))
    m = bars.groupBy("t").agg(F.avg("r").alias("r"), F.avg("close").alias("p"))
    w = Window.orderBy("t")
    d = m.withColumns({"fast": F.avg("p").over(w.rowsBetween(-5, -1)), "slow": F.avg("p").over(w.rowsBetween(-20, -1)), "k": F.row_number().over(w)}).where("k > 20 AND r IS NOT NULL")
    regime = F.when(F.col("fast") > F.col("slow") * 1.01, "bull").when(F.col("fast") < F.col("slow") * 0.99, "bear").otherwise("range")
    return quantise(d.groupBy(regime.alias("regime")).agg(F.avg("r").alias("r"), F.count(F.lit(1)).alias("n")).where("n >= 5"), "regime", "n")


def expanding(spark, sf_dir):
    """Expanding z-score of each asset's close with at least 12 prior bars."""
    past = expression.series().rowsBetween(Window.unboundedPreceding, -1)
    n, m, s = F.count("close").over(past), F.avg("close").over(past), F.stddev_pop("close").over(past)
    return quantise(views.supplier_bars(spark, sf_dir).select("asset", "t", F.when((n >= 12) & (s > 1e-10), (F.col("close") - m) / s).alias("z")), "asset", "t")


def minute_quality(spark, sf_dir):
    """Counts of duplicates, backward times and jumps over 11 % in each user's events."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = views.table(spark, sf_dir, "events")
    d = e.select("user_id", (F.col("ts") == F.lag("ts").over(w)).alias("same"), (F.col("ts") < F.lag("ts").over(w)).alias("back"), (F.abs(F.try_divide(F.col("value"), F.lag("value").over(w)) - 1) > 0.11).alias("jump"))
    n = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")).alias(f"n_{c}")
    return d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), n("same"), n("back"), n("jump"))


def priority(spark, sf_dir):
    """Order of states by priority, then strongest value, ten for each type; the rank is the feature."""
    w = Window.partitionBy("event_type").orderBy(F.desc(F.abs("value")), "event_id")
    order = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    e = views.table(spark, sf_dir, "events").withColumns({"k": F.row_number().over(w), "priority": order})
    return e.where("k <= 10").select("priority", "event_type", "k", "event_id", "value")


def decayed(spark, sf_dir):
    """Half-life weighted mean value of each user at the last moment, clipped to +-3 around the type's mean."""
    e = views.table(spark, sf_dir, "events")
    end = e.agg(F.max("ts").alias("end"))
    hours = (F.unix_timestamp("end") - F.unix_timestamp("ts")) / 3600
    w = F.pow(F.lit(0.5), hours / 24)
    score = F.least(F.greatest(F.col("value") / 100 - 0.5, F.lit(-3.0)), F.lit(3.0))
    return quantise(e.crossJoin(F.broadcast(end)).groupBy("user_id").agg((F.sum(w * score) / F.sum(w)).alias("score")), "user_id")


def histogram(spark, sf_dir):
    """Cumulative counts of values by bucket bound and type."""
    bounds = spark.createDataFrame([(float(b),) for b in (1, 5, 10, 25, 50, 100, 250)], "le double")
    e = views.table(spark, sf_dir, "events").select("event_type", F.expr("CASE WHEN value <= 1 THEN 1D WHEN value <= 5 THEN 5D WHEN value <= 10 THEN 10D WHEN value <= 25 THEN 25D WHEN value <= 50 THEN 50D WHEN value <= 100 THEN 100D WHEN value <= 250 THEN 250D END").alias("b"))
    counts = e.groupBy("event_type", "b").agg(F.count(F.lit(1)).alias("k"))
    return counts.join(F.broadcast(bounds), F.col("b") <= F.col("le")).groupBy("event_type", "le").agg(F.sum("k").alias("n"))


def weekly(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return e.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), "event_type").agg(F.count(F.lit(1)).alias("n"), quantised(F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count(F.lit(1))).alias("mean"), F.count_distinct("user_id").alias("users"))


_EVENTS = (
    _BARS
    + f""", n AS (SELECT asset, t, close, row_number() {_S} AS i FROM bars
), e AS (SELECT asset * 1000 + i AS event_id, asset, i AS i0, least(i + 5 + asset % 2, max(i) OVER (PARTITION BY asset)) AS i1, 0.2::DOUBLE + 0.05::DOUBLE * (i % 3) AS width, CASE WHEN i % 2 = 0 THEN -1 ELSE 1 END AS side FROM n
), c AS (SELECT n.asset, n.i, count(e.event_id) AS n FROM n LEFT JOIN e ON n.asset = e.asset AND n.i BETWEEN e.i0 AND e.i1 GROUP BY ALL)"""
)


def _weights_sql(name: str, offset: int) -> str:
    return f"{name} AS (SELECT asset, volume / sum(volume) OVER () AS w FROM (SELECT asset, volume FROM bars WHERE t = (SELECT DISTINCT t FROM bars ORDER BY t DESC LIMIT 1 OFFSET {offset}) ORDER BY volume DESC, asset LIMIT 20))"


QUERIES = {
    "pit_asof": pit_asof,
    "pit_asof_join": pit_asof_join,
    "pit_snapshot": pit_snapshot,
    "upsert_latest": upsert_latest,
    "membership_asof": membership_asof,
    "aligned_panel": aligned,
    "common_dates": common,
    "order_changes": orders,
    "reconcile_positions": reconciled,
    "concurrency": concurrent,
    "sample_weights": weights,
    "triple_barrier": barriers,
    "meta_labels": meta,
    "industry_lookup": industries,
    "dedupe_first": dedupe_first,
    "incremental_sync": incremental,
    "parameter_grid": grid,
    "state_transitions": transitions,
    "top_weights": top,
    "kill_streak": kill_streak,
    "winsorised_scores": winsor,
    "tail_plan": tails,
    "trailing_four_quarters": ttm,
    "single_quarters": singles,
    "comparable_stats": comps,
    "set_operations": set_operations,
    "trend_regimes": regimes,
    "expanding_zscore": expanding,
    "minute_quality": minute_quality,
    "priority_order": priority,
    "decayed_score": decayed,
    "value_histogram": histogram,
    "weekly_report": weekly,
}
_PIT = "WITH " + views.SQL["pit"]
_QUARTERLY = "qv AS (SELECT o_custkey AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY ALL)"
ORACLE_SQL = {
    "pit_asof": _PIT + f" SELECT symbol, field, report_date, value FROM pit WHERE publish <= TIMESTAMP '{ASOF}' QUALIFY row_number() OVER (PARTITION BY symbol, field ORDER BY report_date DESC, publish DESC, report_id DESC) = 1",
    "pit_asof_join": _PIT
    + """, d AS (SELECT CAST(unnest(generate_series(DATE '1995-07-01', DATE '2001-07-01', INTERVAL 6 MONTH)) AS DATE) AS asof), g AS (SELECT * FROM (SELECT DISTINCT symbol FROM pit), d
    ), l AS (SELECT symbol, publish, arg_max(value, report_id) AS value FROM pit GROUP BY ALL) SELECT g.symbol, g.asof, l.value FROM g ASOF LEFT JOIN l ON g.symbol = l.symbol AND g.asof >= l.publish""",
    "pit_snapshot": _PIT
    + f", v AS (SELECT * FROM pit WHERE publish <= TIMESTAMP '{ASOF}' QUALIFY row_number() OVER (PARTITION BY symbol, field ORDER BY report_date DESC, publish DESC, report_id DESC) = 1) SELECT symbol, "
    + ", ".join(f"max(value) FILTER (field = '{f}') AS f{i + 1}" for i, f in enumerate(FIELDS))
    + " FROM v GROUP BY symbol",
    "upsert_latest": _PIT + " SELECT symbol, field, report_id, value FROM pit QUALIFY row_number() OVER (PARTITION BY symbol, field ORDER BY publish DESC, report_id DESC) = 1",
    "membership_asof": "WITH "
    + views.SQL["membership"]
    + ", d AS (SELECT CAST(unnest(generate_series(DATE '1995-01-15', DATE '2001-11-15', INTERVAL 1 YEAR)) AS DATE) AS t) SELECT t, universe, count(*) AS members, min(asset) AS first_asset FROM d JOIN membership ON t BETWEEN start_date AND end_date GROUP BY ALL",
    "aligned_panel": _BARS
    + """, cal AS (SELECT t, row_number() OVER (ORDER BY t) AS idx FROM (SELECT DISTINCT t FROM bars)), a AS (SELECT asset FROM bars WHERE close > 0 GROUP BY asset HAVING count(*) >= 30
    ), g AS (SELECT a.asset, idx, cal.t, close, coalesce(close > 0, false) AS valid FROM a CROSS JOIN cal LEFT JOIN bars ON bars.asset = a.asset AND bars.t = cal.t
    ), p AS (SELECT *, last_value(CASE WHEN valid THEN idx END IGNORE NULLS) OVER w AS li, last_value(CASE WHEN valid THEN close END IGNORE NULLS) OVER w AS lc FROM g WINDOW w AS (PARTITION BY asset ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT asset, idx, t, valid, """
    + q({"r": "CASE WHEN valid AND idx - li <= 5 THEN close / lc - 1 END"})
    + " FROM p",
    "common_dates": "WITH " + views.SQL["brand_bars"] + " SELECT t FROM bars GROUP BY t HAVING count(DISTINCT asset) = (SELECT count(DISTINCT asset) FROM bars)",
    "order_changes": _BARS
    + f", {_weights_sql('tg', 0)}, {_weights_sql('cu', 1)}, j AS (SELECT coalesce(tg.asset, cu.asset) AS asset, coalesce(tg.w, 0) AS target, coalesce(cu.w, 0) AS current FROM tg FULL JOIN cu ON tg.asset = cu.asset) SELECT asset, CASE WHEN target > current THEN 'buy' ELSE 'sell' END AS side, "
    + q({"target": "target", "current": "current", "delta": "target - current", "notional": "abs(target - current) * 1e6"})
    + " FROM j WHERE abs(target - current) >= 0.001",
    "reconcile_positions": _BARS
    + """, d AS (SELECT DISTINCT t FROM bars ORDER BY t DESC LIMIT 2), a AS (SELECT asset, volume FROM bars WHERE t = (SELECT max(t) FROM d)), b AS (SELECT asset, volume FROM bars WHERE t = (SELECT min(t) FROM d)
    ), j AS (SELECT coalesce(a.asset, b.asset) AS asset, coalesce(a.volume, 0) AS internal, coalesce(b.volume, 0) AS broker FROM a FULL JOIN b ON a.asset = b.asset)
    SELECT *, broker - internal AS diff, CASE WHEN abs(broker - internal) <= 10 THEN 'ok' WHEN abs(broker - internal) < 60 THEN 'warn' ELSE 'critical' END AS severity FROM j""",
    "concurrency": _EVENTS + " SELECT asset, i, n FROM c",
    "sample_weights": _EVENTS
    + ", u AS (SELECT event_id, e.asset, i0, avg(1.0::DOUBLE / c.n) AS u FROM e JOIN c ON e.asset = c.asset AND c.i BETWEEN i0 AND i1 GROUP BY ALL) SELECT event_id, "
    + q({"uniqueness": "u", "weight": "u * pow(0.9::DOUBLE, row_number() OVER (PARTITION BY asset ORDER BY i0 DESC, event_id DESC) - 1)"})
    + " FROM u",
    "triple_barrier": _EVENTS
    + """, p AS (SELECT event_id, width, n.i, n.close / first_value(n.close) OVER (PARTITION BY event_id ORDER BY n.i) - 1 AS move FROM e JOIN n ON e.asset = n.asset AND n.i BETWEEN i0 AND i1
    ), f AS (SELECT event_id, min(i) FILTER (move >= width) AS u, min(i) FILTER (move <= -width) AS d, max(i) AS last FROM p GROUP BY event_id)
    SELECT event_id, CASE WHEN u IS NOT NULL AND (d IS NULL OR u < d) THEN 1 WHEN d IS NOT NULL THEN -1 ELSE 0 END AS label, coalesce(least(u, d), last) AS touch FROM f""",
    "meta_labels": _EVENTS
    + ", r AS (SELECT event_id, side * (b.close / a.close - 1) - 0.001::DOUBLE AS r FROM e JOIN n a ON a.asset = e.asset AND a.i = i0 JOIN n b ON b.asset = e.asset AND b.i = i1) SELECT event_id, (r > 0)::INT AS meta, "
    + q({"r": "r"})
    + " FROM r",
    "industry_lookup": _BARS + ", " + views.SQL["industry"] + " SELECT coalesce(industry, 'Unknown') AS industry, count(DISTINCT asset) AS assets, count(*) AS bars, " + q({"close": "avg(close)"}) + " FROM bars LEFT JOIN industry USING (asset) GROUP BY 1",
    "dedupe_first": "SELECT user_id, event_type, CAST(ts AS DATE) AS day, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) = 1",
    "incremental_sync": "WITH c AS (SELECT quantile_cont(event_id, 0.5) AS c FROM events), e AS (SELECT event_id, user_id, CAST(floor(value / 5) AS BIGINT) AS band FROM events) SELECT DISTINCT user_id, band FROM e, c WHERE event_id > c AND (user_id, band) NOT IN (SELECT (user_id, band) FROM e, c WHERE event_id <= c)",
    "parameter_grid": "SELECT s_suppkey AS asset, n_hold, cost_bps, method, n_hold::INT || '|' || cost_bps::INT || '|' || method AS key, floor(s_acctbal / CASE method WHEN 'equal' THEN n_hold ELSE n_hold / 2 END * (1 - cost_bps / 1e4) * 1e4 + 0.5) / 1e4 AS position FROM supplier, (SELECT unnest([5.0, 10.0, 20.0])::DOUBLE AS n_hold), (SELECT unnest([10.0, 17.0])::DOUBLE AS cost_bps), (SELECT unnest(['equal', 'score']) AS method)",
    "state_transitions": "WITH s AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events) SELECT from_state, to_state, count(*) AS n FROM s WHERE from_state < to_state GROUP BY ALL",
    "top_weights": _PAIRS
    + ", k AS (SELECT t, asset FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY t ORDER BY score DESC, asset) <= 15), w AS (SELECT t, asset, least(1.0::DOUBLE / count(*) OVER (PARTITION BY t), 0.05::DOUBLE) AS raw FROM k) SELECT t, asset, "
    + q({"weight": "raw / sum(raw) OVER (PARTITION BY t)"})
    + " FROM w",
    "kill_streak": _IC
    + """, b AS (SELECT t, floor(ic * 1e4 + 0.5) < 0 AS bad FROM ic), g AS (SELECT *, sum((NOT bad)::INT) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM b)
    SELECT t, bad, CAST(sum(bad::INT) OVER (PARTITION BY run ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM g""",
    "winsorised_scores": _BARS
    + """, m AS (SELECT t, quantile_cont(amount, 0.5) AS m FROM bars GROUP BY t), d AS (SELECT t, quantile_cont(abs(amount - m), 0.5) AS mad FROM bars JOIN m USING (t) GROUP BY t
    ), c AS (SELECT asset, t, greatest(least(amount, m + 3.0::DOUBLE * 1.4826::DOUBLE * mad), m - 3.0::DOUBLE * 1.4826::DOUBLE * mad) AS x FROM bars JOIN m USING (t) JOIN d USING (t))
    SELECT asset, t, """
    + q({"z": "CASE WHEN stddev_pop(x) OVER (PARTITION BY t) > 1e-10 THEN (x - avg(x) OVER (PARTITION BY t)) / stddev_pop(x) OVER (PARTITION BY t) ELSE 0 END"})
    + " FROM c",
    "tail_plan": _BARS
    + ", cal AS (SELECT t, row_number() OVER (ORDER BY t) AS idx FROM (SELECT DISTINCT t FROM bars)), m AS (SELECT asset, (SELECT max(idx) FROM cal) - max(idx) AS missing FROM bars JOIN cal USING (t) GROUP BY asset) SELECT asset, missing, CASE WHEN missing = 0 THEN 'skip' WHEN missing <= 3 THEN 'append' ELSE 'reject' END AS action FROM m",
    "trailing_four_quarters": f"WITH {_QUARTERLY}, k AS (SELECT * FROM qv QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY quarter DESC) <= 4) SELECT symbol, count(*) AS n, " + q({"ttm": "sum(value) * 4 / count(*)"}) + " FROM k GROUP BY symbol",
    "single_quarters": f"WITH {_QUARTERLY} SELECT symbol, quarter, " + q({"value": "value"}) + " FROM qv",
    "comparable_stats": """WITH c AS (SELECT * FROM customer WHERE c_acctbal > 0), s AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS p25, quantile_cont(c_acctbal, 0.5) AS p50, quantile_cont(c_acctbal, 0.75) AS p75, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 3)
    SELECT c_mktsegment, any_value(n) AS n, count(*) FILTER (abs(c_acctbal - mean) > 2 * sd) AS outliers, """
    + q({x: f"any_value({x})" for x in ("p25", "p50", "p75", "mean", "sd")})
    + " FROM c JOIN s USING (c_mktsegment) GROUP BY c_mktsegment",
    "set_operations": """WITH m AS (SELECT CAST(min(ts) AS DATE) + 2 AS m FROM events), a AS (SELECT user_id FROM events, m WHERE CAST(ts AS DATE) < m), b AS (SELECT user_id FROM events, m WHERE CAST(ts AS DATE) >= m)
    SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
    UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'except_all', count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""",
    "trend_regimes": _BARS
    + f""", r AS (SELECT t, close, close / nullif(lag(close) {_S}, 0) - 1 AS r FROM bars), m AS (SELECT t, avg(r) AS r, avg(close) AS p FROM r GROUP BY t
    ), d AS (SELECT *, avg(p) OVER (ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS fast, avg(p) OVER (ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS slow, row_number() OVER (ORDER BY t) AS k FROM m)
    SELECT CASE WHEN fast > slow * 1.01::DOUBLE THEN 'bull' WHEN fast < slow * 0.99::DOUBLE THEN 'bear' ELSE 'range' END AS regime, count(*) AS n, """
    + q({"r": "avg(r)"})
    + " FROM d WHERE k > 20 AND r IS NOT NULL GROUP BY 1 HAVING count(*) >= 5",
    "expanding_zscore": _BARS
    + " SELECT asset, t, "
    + q({"z": "CASE WHEN count(close) OVER w >= 12 AND stddev_pop(close) OVER w > 1e-10 THEN (close - avg(close) OVER w) / stddev_pop(close) OVER w END"})
    + " FROM bars WINDOW w AS (PARTITION BY asset ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "minute_quality": """WITH d AS (SELECT user_id, ts = lag(ts) OVER w AS same, ts < lag(ts) OVER w AS back, abs(value / nullif(lag(value) OVER w, 0) - 1) > 0.11 AS jump FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, count(*) AS n, count(*) FILTER (same) AS n_same, count(*) FILTER (back) AS n_back, count(*) FILTER (jump) AS n_jump FROM d GROUP BY user_id""",
    "priority_order": "SELECT CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS priority, event_type, row_number() OVER (PARTITION BY event_type ORDER BY abs(value) DESC, event_id) AS k, event_id, value FROM events QUALIFY k <= 10",
    "decayed_score": "WITH w AS (SELECT user_id, pow(0.5::DOUBLE, (epoch(date_trunc('second', (SELECT max(ts) FROM events))) - epoch(date_trunc('second', ts))) / 3600.0::DOUBLE / 24) AS w, least(greatest(value / 100 - 0.5::DOUBLE, -3), 3) AS s FROM events) SELECT user_id, " + q({"score": "sum(w * s) / sum(w)"}) + " FROM w GROUP BY user_id",
    "value_histogram": "WITH b AS (SELECT unnest([1, 5, 10, 25, 50, 100, 250])::DOUBLE AS le) SELECT event_type, le, count(*) AS n FROM events JOIN b ON value <= le GROUP BY ALL",
    "weekly_report": "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n, " + q({"mean": "CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*)"}) + ", count(DISTINCT user_id) AS users FROM events GROUP BY ALL",
}
