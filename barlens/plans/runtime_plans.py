"""Queries of the stateful runtime and of versioned tables: gateway, replay, index rebuild and tail append, with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.columns import quantised, quantised_sql
from barlens.plans.stat_plans import _BARS
from barlens.sources import versions, views
from barlens.streaming import gateway, replay
from barlens.streaming.runtime import checkpoint_root

LIMITS = gateway.Limits(max_order_value=60_000.0, max_weight=0.2, window=10, min_fill_ratio=0.6)
EQUITY = 250_000.0
#: What an order's priority does to its account before its lines are judged.
CONTROL = {"1-URGENT": "kill", "2-HIGH": "halt", "3-MEDIUM": "resume", "4-NOT SPECIFIED": "revive"}


def gateway_events(spark, sf_dir) -> DataFrame:
    """Each customer's orders as batches of intents, one a line: a control event by priority, the lines, and what became of each.

    An order of status P is judged in panic. Lines of one part bear one number in a customer's quarter, so some numbers come again; returned lines were rejects."""
    orders, lines = views.table(spark, sf_dir, "orders"), views.table(spark, sf_dir, "lineitem")
    control = F.create_map(*[F.lit(x) for kv in CONTROL.items() for x in kv])
    # Line numbers repeat within some orders; a place of its own makes the order total.
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"))
    j = lines.withColumn("place", place).join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "right")
    side = F.when((F.col("l_linenumber") + F.col("o_orderkey")) % 3 == 0, "sell").otherwise("buy")
    # One row a line (or an order without any) to its account; only there is it made into events.
    j = j.select(
        F.col("o_custkey").alias("account"), F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("order"), "place", control[F.col("o_orderpriority")].alias("control"), (F.col("o_orderstatus") == "P").alias("panics"),
        F.concat_ws("-", F.year("o_orderdate"), F.quarter("o_orderdate"), F.col("l_partkey") % 40).alias("order_id"), (F.col("l_partkey") % 8).cast("long").alias("asset"), side.alias("side"),
        F.col("l_quantity").cast("double").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"), (F.col("l_returnflag") == "R").alias("returned"),
    )
    whole = Window.partitionBy("account")
    j = j.withColumns({"k": F.row_number().over(whole.orderBy("day", "order", "place")), "begins": F.min("day").over(whole)})
    line, head = F.col("place").isNotNull(), F.coalesce(F.col("place") == 1, F.lit(True))
    plain = {"line": F.lit(0), "order_id": F.lit(None).cast("string"), "asset": F.lit(None).cast("long"), "side": F.lit(None).cast("string"), "qty": F.lit(0.0), "price": F.lit(0.0)}
    own = {"line": F.col("place"), **{c: F.col(c) for c in ("order_id", "asset", "side", "qty", "price")}}
    event = lambda stage, when, kind, of=plain: F.when(when, F.struct(F.lit(stage).alias("stage"), kind.alias("kind"), *[c.alias(n) for n, c in of.items()]))
    made = F.array(
        event(0, F.col("k") == 1, F.lit("equity"), plain | {"price": F.lit(EQUITY)}), event(1, head & F.col("control").isNotNull(), F.col("control")), event(2, head & F.col("panics"), F.lit("panic")),
        event(3, line, F.lit("order"), own), event(4, head & F.col("panics"), F.lit("calm")), event(5, line, F.when(F.col("returned"), "reject").otherwise("fill"), own),
    )
    events = j.select("account", "day", "order", "begins", F.explode(F.array_compact(made)).alias("e")).select("account", "day", "order", "begins", "e.*")
    first = F.col("stage") == 0
    events = events.withColumns({"day": F.when(first, F.col("begins")).otherwise(F.col("day")), "order": F.when(first, F.lit(-1)).otherwise(F.col("order"))})
    # All of an order's intents come before what became of them, so one order of an account's events shows where a batch ends, too.
    ordered = whole.orderBy("day", "order", "stage", "line")
    ends = (F.col("kind") != "order") | (F.coalesce(F.lead("stage").over(ordered), F.lit(-1)) != 3)
    return events.withColumns({"seq": F.row_number().over(ordered).cast("long"), "ends": ends}).select("account", *gateway.COLUMNS)


def pretrade_gateway(spark, sf_dir):
    """What became of every line of every order."""
    return gateway.judged(gateway_events(spark, sf_dir), LIMITS, ordered=True)


def gateway_reasons(spark, sf_dir):
    """How often each customer was denied for each reason."""
    out = gateway.judged(gateway_events(spark, sf_dir), LIMITS, ordered=True)
    return out.groupBy("account", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


STRATEGY, SHARE, LOUD = replay.Reversion(4, 0.05, 20.0, 60.0), 0.1, 49


def replay_events(spark, sf_dir) -> DataFrame:
    """Two sources of each supplier: its bars, and an alert at every day on which a large line came back."""
    at = replay.micros(F.col("t"))
    zero = F.lit(0.0)
    bars = views.supplier_bars(spark, sf_dir).select(F.col("asset").alias("key"), at.alias("ts"), (at + 5000).alias("local_ts"), F.lit(0).cast("long").alias("seq"), F.lit("bar").alias("kind"), F.col("close").alias("price"), F.col("volume").alias("qty"))
    back = views.table(spark, sf_dir, "lineitem").where(f"l_returnflag = 'R' AND l_quantity >= {LOUD}").select(F.col("l_suppkey").alias("key"), F.to_date("l_shipdate").alias("t")).distinct()
    alerts = back.select("key", at.alias("ts"), at.alias("local_ts"), F.lit(0).cast("long").alias("seq"), F.lit("alert").alias("kind"), zero.alias("price"), zero.alias("qty"))
    return replay.merged(bars=bars, alerts=alerts)


def replay_intents(spark, sf_dir):
    """Intents and fills of a band strategy on every supplier, with position and cash after each."""
    out = replay.replayed(replay_events(spark, sf_dir), STRATEGY, SHARE)
    return out.select("key", "step", "ts", "action", "qty", quantised("price").alias("price"), "position", quantised("cash").alias("cash"))


def _table(spark, name: str) -> versions.VersionedTable:
    return versions.VersionedTable(spark, f"{checkpoint_root(spark)}/barlens-{name}-{uuid.uuid4().hex}")


def index_rebuild(spark, sf_dir):
    """A market index of plain means, rebuilt from 1996 on by weighted means: both as versions of one table."""
    bars = views.supplier_bars(spark, sf_dir)
    table = _table(spark, "index")
    old = bars.where("t < DATE '1997-07-01'").groupBy("t").agg(F.avg("close").alias("level"), F.lit("mean").alias("made_by"))
    now = table.replace(old, lambda d: d.where("level <= 0").isEmpty(), "first")
    new = bars.where("t >= DATE '1996-01-01'").groupBy("t").agg((F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("level"), F.lit("weighted").alias("made_by"))
    table.replace(versions.rebuilt(table.read(now), new, ["t"]), lambda d: d.count() == d.select("t").distinct().count(), "rebuild", now)
    calendar = versions.extended_calendar(table.read(now).select("t"), bars)
    return table.read().join(calendar, "t").select("t", quantised("level").alias("level"), "made_by")


def tail_versions(spark, sf_dir):
    """Bars kept up to differing dates, then appended to: what each version of the table has of each supplier."""
    bars = views.supplier_bars(spark, sf_dir).select("asset", "t", "close")
    table = _table(spark, "bars")
    known = bars.where(F.year("t") < 1994 + F.col("asset") % 5).where("asset % 7 <> 0")
    table.replace(known, why="known")
    versions.tail_append(table, bars)
    table.append(bars.limit(0))
    table.rollback(2)
    each = [table.read(v).groupBy("asset").agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("n"), F.max("t").alias("last")) for v in table.versions()]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


_LINE = "concat_ws('-', year(o_orderdate), quarter(o_orderdate), l_partkey % 40) AS order_id, l_partkey % 8 AS asset, CASE WHEN (l_linenumber + o_orderkey) % 3 = 0 THEN 'sell' ELSE 'buy' END AS side, l_quantity AS qty, l_extendedprice / l_quantity AS price"
_NONE = "NULL::VARCHAR AS order_id, NULL::BIGINT AS asset, NULL::VARCHAR AS side, 0.0::DOUBLE AS qty, {price}::DOUBLE AS price"
_JUDGED = f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS place FROM lineitem
), j AS (SELECT * FROM l JOIN orders ON l_orderkey = o_orderkey
), ev AS (
  SELECT o_custkey AS account, min(o_orderdate) AS day, -1::BIGINT AS "order", 0 AS stage, 0 AS line, 'equity' AS kind, {_NONE.format(price=EQUITY)} FROM orders GROUP BY o_custkey
  UNION ALL SELECT o_custkey, o_orderdate, o_orderkey, 1, 0, CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CONTROL.items())} END, {_NONE.format(price='0.0')} FROM orders WHERE o_orderpriority IN ({', '.join(f"'{k}'" for k in CONTROL)})
  UNION ALL SELECT o_custkey, o_orderdate, o_orderkey, 2, 0, 'panic', {_NONE.format(price='0.0')} FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_custkey, o_orderdate, o_orderkey, 3, place, 'order', {_LINE} FROM j
  UNION ALL SELECT o_custkey, o_orderdate, o_orderkey, 4, 0, 'calm', {_NONE.format(price='0.0')} FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_custkey, o_orderdate, o_orderkey, 5, place, CASE WHEN l_returnflag = 'R' THEN 'reject' ELSE 'fill' END, {_LINE} FROM j
), e AS MATERIALIZED (SELECT account, row_number() OVER (PARTITION BY account ORDER BY day, "order", stage, line) AS seq, kind, order_id, asset, side, qty, price,
    coalesce(bool_or(kind = 'order' AND side = 'buy') OVER (PARTITION BY account, "order", stage, asset), false) AS crossed FROM ev
), s(account, seq, kind, order_id, reason, panic, kill, halt, equity, sent, outcomes, held, last) AS (
  SELECT DISTINCT account, 0::BIGINT, '', '', '', false, false, false, 0.0::DOUBLE, CAST([] AS VARCHAR[]), CAST([] AS BOOLEAN[]), MAP {{}}::MAP(BIGINT, DOUBLE), MAP {{}}::MAP(BIGINT, DOUBLE) FROM e
  UNION ALL
  SELECT account, seq, kind, order_id, reason,
    CASE kind WHEN 'panic' THEN true WHEN 'calm' THEN false ELSE panic END, CASE kind WHEN 'kill' THEN true WHEN 'revive' THEN false ELSE kill END,
    CASE kind WHEN 'halt' THEN true WHEN 'resume' THEN false ELSE halt END, CASE kind WHEN 'equity' THEN price ELSE equity END,
    CASE WHEN kind = 'order' AND reason = '' THEN list_append(sent, order_id) ELSE sent END,
    CASE WHEN (kind = 'order' AND reason = '') OR known THEN list_append(outcomes, kind = 'reject')[-{LIMITS.window}:] ELSE outcomes END,
    CASE WHEN kind = 'fill' AND known THEN map_concat(held, MAP([asset], [coalesce(held[asset], 0) + CASE WHEN side = 'buy' THEN qty ELSE -qty END])) ELSE held END,
    CASE WHEN kind = 'fill' AND known THEN map_concat(last, MAP([asset], [price])) ELSE last END
  FROM (SELECT e.*, s.panic, s.kill, s.halt, s.equity, s.sent, s.outcomes, s.held, s.last, e.kind IN ('fill', 'reject') AND list_contains(s.sent, e.order_id) AS known,
      CASE WHEN e.kind <> 'order' THEN ''
        WHEN s.panic THEN 'panic' WHEN list_contains(s.sent, e.order_id) THEN 'duplicate'
        WHEN e.side <> 'sell' AND s.kill THEN 'kill'
        WHEN e.side <> 'sell' AND len(s.outcomes) >= {LIMITS.window} AND len(list_filter(s.outcomes, lambda x: x)) / {LIMITS.window}.0::DOUBLE > {1 - LIMITS.min_fill_ratio!r}::DOUBLE THEN 'rejects'
        WHEN e.side <> 'sell' AND s.halt THEN 'drift'
        WHEN e.side <> 'sell' AND s.equity > 0 AND (coalesce(s.held[e.asset], 0) * coalesce(s.last[e.asset], 0) + e.qty * e.price) / s.equity > {LIMITS.max_weight}::DOUBLE THEN 'concentration'
        WHEN e.qty * e.price > {LIMITS.max_order_value}::DOUBLE THEN 'value'
        WHEN e.side = 'sell' AND e.qty > coalesce(s.held[e.asset], 0) AND e.crossed THEN 'self_match' ELSE '' END AS reason
    FROM s JOIN e ON e.account = s.account AND e.seq = s.seq + 1)
), judged AS (SELECT account, seq, order_id, reason = '' AS allowed, reason FROM s WHERE kind = 'order')"""

_WANTED = f"""CASE WHEN len(closes) < {STRATEGY.bars} THEN 0 WHEN price < mean * {1 - STRATEGY.band!r}::DOUBLE AND NOT alert AND pos + {STRATEGY.lot} <= {STRATEGY.most} THEN {STRATEGY.lot}
    WHEN price > mean * {1 + STRATEGY.band!r}::DOUBLE AND pos > 0 THEN -least({STRATEGY.lot}, pos) ELSE 0 END"""
_REPLAY = (
    _BARS.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", ev AS (SELECT asset AS key, epoch_us(t::TIMESTAMP) AS ts, 'bars' AS source, close AS price, volume AS qty FROM bars
  UNION ALL SELECT DISTINCT l_suppkey, epoch_us(l_shipdate::DATE::TIMESTAMP), 'alerts', 0.0::DOUBLE, 0.0::DOUBLE FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= {LOUD}
), e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, source) AS n FROM ev
), s(key, n, ts, price, filled, wanted, pos, cash, alert, closes) AS (
  SELECT DISTINCT key, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, false, CAST([] AS DOUBLE[]) FROM e
  UNION ALL
  SELECT key, n, ts, price, filled, CASE WHEN source = 'bars' THEN {_WANTED} ELSE open END, pos, cash, source <> 'bars', CASE WHEN source = 'bars' THEN list_append(closes, price)[-{STRATEGY.bars}:] ELSE closes END
  FROM (SELECT *, pos0 + filled AS pos, cash0 - filled * price AS cash, list_reduce(list_prepend(0.0::DOUBLE, closes), lambda a, x: a + x) / {STRATEGY.bars} AS mean FROM (
    SELECT e.key, e.n, e.ts, e.source, e.price, s.wanted AS open, s.alert, s.closes, s.pos AS pos0, s.cash AS cash0,
      CASE WHEN e.source <> 'bars' THEN 0 ELSE sign(s.wanted) * least(abs(s.wanted), floor({SHARE}::DOUBLE * e.qty)) END AS filled FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1))
), a AS (SELECT s.key, s.n, 0 AS k, s.ts, 'fill' AS action, filled AS qty, s.price, pos, cash FROM s WHERE filled <> 0
  UNION ALL SELECT s.key, s.n, 1, s.ts, 'intent', wanted, s.price, pos, cash FROM s JOIN e USING (key, n) WHERE wanted <> 0 AND source = 'bars')
SELECT key, row_number() OVER (PARTITION BY key ORDER BY n, k) - 1 AS step, ts, action, qty, {quantised_sql('a.price')} AS price, pos AS position, {quantised_sql('a.cash')} AS cash FROM a"""
)
QUERIES = {"pretrade_gateway": pretrade_gateway, "gateway_reasons": gateway_reasons, "replay_intents": replay_intents, "index_rebuild": index_rebuild, "tail_versions": tail_versions}
ORACLE_SQL = {
    "replay_intents": _REPLAY,
    "index_rebuild": _BARS
    + ", o AS (SELECT t, avg(close) AS level, 'mean' AS made_by FROM bars WHERE t < DATE '1997-07-01' GROUP BY t), n AS (SELECT t, sum(close * volume) / sum(volume) AS level, 'weighted' AS made_by FROM bars WHERE t >= DATE '1996-01-01' GROUP BY t) SELECT t, "
    + quantised_sql("coalesce(n.level, o.level)")
    + " AS level, coalesce(n.made_by, o.made_by) AS made_by FROM o FULL JOIN n USING (t)",
    "tail_versions": _BARS
    + """, v(version, whole) AS (VALUES (1, false), (2, true), (3, true), (4, true)) SELECT asset, version, count(*) AS n, max(t) AS last FROM bars, v
    WHERE whole OR (year(t) < 1994 + asset % 5 AND asset % 7 <> 0) GROUP BY asset, version""",
    "pretrade_gateway": _JUDGED + " SELECT * FROM judged",
    "gateway_reasons": _JUDGED + " SELECT account, reason, count(*) AS n, min(seq) AS first, max(seq) AS last FROM judged GROUP BY account, reason",
}
