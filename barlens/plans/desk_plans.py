"""Queries of the desk's rules over the tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions import gates
from barlens.functions.columns import quantised, quantised_sql
from barlens.operators import desk
from barlens.plans import risk_plans
from barlens.plans.stat_plans import _BARS, q, quantise
from barlens.sources import views

URGENCY = {"1-URGENT": "high", "2-HIGH": "high", "5-LOW": "low"}
EQUITY, DAYS = 2e6, 20
MONEY = "decimal(18,2)"


def plan_costs(spark, sf_dir):
    """Every order as a plan whose lines are its trades, against the value that a part trades on a day."""
    orders, lines = views.table(spark, sf_dir, "orders"), views.table(spark, sf_dir, "lineitem")
    daily = lines.groupBy(F.col("l_partkey").alias("part"), "l_shipdate").agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double").alias("v"))
    daily = daily.groupBy("part").agg((F.sum(F.col("v").cast("decimal(20,2)")).cast("double") / F.count("v")).alias("daily"))
    urgency = F.lit("normal")
    for k, v in URGENCY.items():
        urgency = F.when(F.col("o_orderpriority") == k, v).otherwise(urgency)
    side = F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(daily, F.col("l_partkey") == F.col("part"))
    rows = rows.select(F.col("l_orderkey").alias("plan"), urgency.alias("urgency"), F.col("l_partkey").alias("asset"), side.alias("side"), F.col("l_extendedprice").alias("value"), "daily")
    return quantise(desk.plan_report(rows), "plan", "urgency", "n", "algorithm", "over_limit")


def _held(spark, sf_dir) -> DataFrame:
    """Customers' parts by their share of what they paid, at the part's price."""
    j = views.table(spark, sf_dir, "lineitem").join(views.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    h = j.groupBy(F.col("o_custkey").alias("account"), F.col("l_partkey").alias("asset")).agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double").alias("v"))
    total = F.sum(F.col("v").cast(MONEY)).over(Window.partitionBy("account")).cast("double")
    return h.withColumn("weight", F.col("v") / total).join(views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset"), F.col("p_retailprice").alias("price")), "asset")


def shadow_gaps(spark, sf_dir):
    """What a shadow account of two millions can place of each customer's weights in lots of ten."""
    return quantise(desk.shadow_gaps(_held(spark, sf_dir), EQUITY, 10), "account", "asset", "qty", "placed")


def _facts(spark, sf_dir) -> DataFrame:
    """Suppliers as companies: revenue, margins after discount and tax, and growth by year; balance, cash and debt from the account's balance; multiples of price over earnings."""
    money = lambda c: F.sum(c.cast("decimal(30,6)")).cast("double")
    lines = views.table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    gross, net = F.col("l_extendedprice") * (1 - F.col("l_discount") * 6), F.col("l_extendedprice") * (1 - F.col("l_discount") * 6 - F.col("l_tax") * 7)
    by = lines.groupBy(F.col("l_suppkey").alias("asset"), "year").agg(money(F.col("l_extendedprice")).alias("revenue"), money(gross).alias("gross"), money(net).alias("net"), money(F.col("l_quantity")).alias("units"))
    w = Window.partitionBy("asset").orderBy("year")
    by = by.withColumns({"grew": (F.col("revenue") > F.lag("revenue").over(w)).cast("double"), "multiple": F.col("revenue") / F.when(F.col("net") > 0, F.col("net"))})
    last = Window.partitionBy("asset")
    by = by.withColumn("now", F.max_by("multiple", "year").over(last))
    span = F.max("year") - F.min("year")
    cagr = lambda c: F.when((span > 0) & (F.min_by(c, "year") > 0) & (F.max_by(c, "year") > 0), F.pow(F.max_by(c, "year") / F.min_by(c, "year"), 1 / span) - 1).otherwise(0.0)
    d = by.groupBy("asset").agg(
        F.max_by("revenue", "year").alias("revenue"), (F.max_by("gross", "year") / F.max_by("revenue", "year")).alias("gross"), (F.max_by("net", "year") / F.max_by("revenue", "year")).alias("net"), F.max_by("net", "year").alias("earned"),
        F.min_by(F.col("net") / F.col("revenue"), "year").alias("first_net"), F.max_by(F.col("net") / F.col("revenue"), "year").alias("last_net"), cagr("revenue").alias("revenue_cagr"), cagr("net").alias("earnings_cagr"),
        F.coalesce(F.avg("grew"), F.lit(0.0)).alias("consistency"), F.max("now").alias("multiple"), F.coalesce(F.avg((F.col("multiple") < F.col("now")).cast("double")), F.lit(0.5)).alias("below"),
    )
    s = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset"), "s_acctbal", "s_nationkey")
    sector = by.join(s, "asset").groupBy("s_nationkey").agg(F.percentile("multiple", 0.5).alias("sector"))
    d = d.join(s, "asset").join(sector, "s_nationkey")
    balance = F.col("s_acctbal") * 300
    return d.withColumns(
        {
            "roe": F.col("earned") / (F.abs(balance) + 1e6), "debt_to_equity": 2 - F.col("s_acctbal") / 5000, "current_ratio": 1 + F.col("s_acctbal") / 4000, "cash_conversion": balance / F.when(F.col("earned") > 0, F.col("earned")),
            "management": F.when(F.col("asset") % 3 > 0, F.col("asset") % 11), "moat": F.when(F.col("s_nationkey") % 4 > 0, F.col("s_nationkey") * 0.5), "cash_conversion_known": F.lit(True),
        }
    ).fillna(0.0, ["cash_conversion", "multiple", "sector"])


def scorecards(spark, sf_dir):
    """Six dimensions of every supplier, their total, and the weakest."""
    return quantise(desk.scorecard(_facts(spark, sf_dir), ("asset",)), "asset", "weakest")


def instruments(spark, sf_dir):
    """What the rules make of symbols: every part's number, with a prefix by its size."""
    p = views.table(spark, sf_dir, "part")
    number = F.lpad((F.col("p_partkey") * 7919 % 1000000).cast("string"), 6, "0")
    symbol = F.when(F.col("p_size") % 9 == 0, F.concat(F.element_at(F.array(*map(F.lit, ("if", "IH", "ic", "IM", "XX"))), (F.col("p_partkey") % 5 + 1).cast("int")), F.substring(number, 3, 4))).when(F.col("p_size") % 9 == 1, F.concat(F.lit(" 51"), F.substring(number, 3, 4))).when(F.col("p_partkey") % 97 == 0, "588000").otherwise(number)
    return p.withColumn("symbol", symbol).select("p_partkey", "symbol", desk.instrument(F.col("symbol")).alias("s")).select("p_partkey", "symbol", "s.*")


def _events(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = views.table(spark, sf_dir, "events")
    sign = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    return e.select(F.col("user_id").alias("asset"), F.col("event_id").alias("id"), "ts", (F.col("value") / 100 * sign).alias("score"), "event_type"), e.agg(F.max("ts").alias("now"))


def recent_events(spark, sf_dir):
    """Each user's events of the last twenty days but views, the strongest first."""
    events, now = _events(spark, sf_dir)
    return quantise(desk.recent_events(events, now, DAYS, F.col("event_type") != "view"), "asset", "place", "id", "ts")


def todays_events(spark, sf_dir):
    events, now = _events(spark, sf_dir)
    return quantise(desk.events_of_day(events, now), "id", "asset", "ts", "place")


FIELDS = ("shares", "equity", "revenue", "profit", "debt", "cash_flow")


def valuation_inputs(spark, sf_dir):
    """Customers as companies: each order a fact, by its key one of six fields, some in thousands; the latest one counts."""
    o = views.table(spark, sf_dir, "orders")
    field = F.element_at(F.array(*map(F.lit, FIELDS)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    latest = o.groupBy(F.col("o_custkey").alias("asset"), field.alias("field")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("value"))
    prices = views.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("asset"), (F.col("c_acctbal") / 100).alias("price"))
    return quantise(desk.valuation_inputs(latest, prices, {"shares": 0.001}), "asset", "n")


CAP, FRESH_DAYS = 0.2, 45
REGIMES = ("bull", "bear", "range", "stress")


def output_gates(spark, sf_dir):
    """One gate a row: the cost of every plan, every customer's weights, every supplier's last bar, and the regime of every date."""
    cost = plan_costs(spark, sf_dir)
    impact = F.col("cost_bps") - desk.by_urgency(F.col("urgency"), "penalty") - desk.BASE_BPS
    weights = _held(spark, sf_dir).groupBy("account").agg(F.max("weight").alias("most"), F.min("weight").alias("least"), F.sum("weight").alias("total"))
    bars = views.supplier_bars(spark, sf_dir)
    age = bars.groupBy("asset").agg(F.max("t").alias("last")).crossJoin(F.broadcast(bars.agg(F.max("t").alias("now"))))
    parts = {
        "cost": cost.select(F.col("plan").cast("string").alias("subject"), gates.reasonable_cost(F.col("cost_bps"), impact).alias("g")),
        "constraints": weights.select(F.col("account").cast("string").alias("subject"), gates.constraints(F.col("most"), F.col("least"), F.col("total"), CAP).alias("g")),
        "freshness": age.select(F.col("asset").cast("string").alias("subject"), gates.fresh(F.datediff("now", "last"), FRESH_DAYS).alias("g")),
        "regime": risk_plans.regimes(spark, sf_dir).select(F.col("t").cast("string").alias("subject"), gates.confident([F.col(c) for c in REGIMES]).alias("g")),
    }
    out = None
    for name, part in parts.items():
        one = part.select(F.lit(name).alias("gate"), "subject", "g.passed", quantised("g.score").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def _case(c: str, what: str) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE"
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {text(v[what])}" for k, v in desk.URGENCIES.items()) + " END"


def _ten(x: str) -> str:
    return f"round(least(greatest({x}, 0), 10), 1)"


_SPEC = "{{'kind': '{}', 'multiplier': {}::DOUBLE, 'margin': {}::DOUBLE, 'tick': {}::DOUBLE, 'lot': {}, 't_plus': {}, 'price_limit': {}::DOUBLE, 'commission_bps': {}::DOUBLE}}"
_EV = f"WITH e AS (SELECT user_id AS asset, event_id AS id, ts, value / 100 * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS score, event_type, (SELECT max(ts) FROM events) AS now FROM events)"
QUERIES = {
    "plan_costs": plan_costs,
    "shadow_gaps": shadow_gaps,
    "scorecards": scorecards,
    "instruments": instruments,
    "recent_events": recent_events,
    "todays_events": todays_events,
    "valuation_inputs": valuation_inputs,
    "output_gates": output_gates,
}
ORACLE_SQL = {
    "plan_costs": f"""WITH d AS (SELECT l_partkey, CAST(sum(CAST(v AS DECIMAL(20,2))) AS DOUBLE) / count(*) AS daily FROM (SELECT l_partkey, l_shipdate, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem GROUP BY ALL) GROUP BY l_partkey
    ), r AS (SELECT l_orderkey AS plan, CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in URGENCY.items())} ELSE 'normal' END AS urgency, l_extendedprice AS value, l_returnflag = 'R' AS sold, l_extendedprice / greatest(daily, 1) AS part
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN d USING (l_partkey)
    ), s AS (SELECT plan, urgency, count(*) AS n, sum(value) AS value, sum((3.0::DOUBLE + CASE WHEN sold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + least(sqrt(part) * 45, 60)) * value) AS paid, sum((part > {_case('urgency', 'participation')})::INT)::BIGINT AS over_limit FROM r GROUP BY ALL
    ) SELECT plan, urgency, n, {_case('urgency', 'algorithm')} AS algorithm, over_limit, """
    + q({"value": "s.value", "cost_bps": f"paid / s.value + {_case('urgency', 'penalty')}", "completion": "CASE urgency WHEN 'high' THEN 0.92::DOUBLE - 0.02::DOUBLE WHEN 'low' THEN 0.98::DOUBLE ELSE 0.95::DOUBLE + 0.01::DOUBLE END", "max_deviation": _case("urgency", "deviation"), "max_participation": _case("urgency", "participation"), "breaker": f"2 * {_case('urgency', 'deviation')}"})
    + " FROM s",
    "shadow_gaps": f"""WITH h AS (SELECT o_custkey AS account, l_partkey AS asset, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
    ), w AS (SELECT account, asset, v / CAST(sum(CAST(v AS DECIMAL(18,2))) OVER (PARTITION BY account) AS DOUBLE) AS weight, p_retailprice AS price FROM h JOIN part ON asset = p_partkey
    ), s AS (SELECT *, floor({EQUITY}::DOUBLE * weight / price)::BIGINT AS shares FROM w), l AS (SELECT *, CASE WHEN shares - shares % 10 >= 10 THEN shares - shares % 10 ELSE 0 END AS qty FROM s)
    SELECT account, asset, qty, qty > 0 AS placed, """
    + q({"weight": "l.weight", "gap": f"l.weight - qty * price / {EQUITY}::DOUBLE"})
    + " FROM l",
    "scorecards": f"""WITH b AS (SELECT l_suppkey AS asset, year(l_shipdate) AS year, CAST(sum(CAST(l_extendedprice AS DECIMAL(30,6))) AS DOUBLE) AS revenue, CAST(sum(CAST(l_extendedprice * (1 - l_discount * 6) AS DECIMAL(30,6))) AS DOUBLE) AS gross,
      CAST(sum(CAST(l_extendedprice * (1 - l_discount * 6 - l_tax * 7) AS DECIMAL(30,6))) AS DOUBLE) AS net FROM lineitem GROUP BY ALL
    ), m AS (SELECT *, (revenue > lag(revenue) OVER (PARTITION BY asset ORDER BY year))::INT::DOUBLE AS grew, revenue / CASE WHEN net > 0 THEN net END AS multiple, row_number() OVER (PARTITION BY asset ORDER BY year DESC) AS back FROM b
    ), n AS (SELECT *, max(CASE WHEN multiple IS NOT NULL THEN year END) OVER (PARTITION BY asset) AS latest FROM m
    ), o AS (SELECT n.*, max(CASE WHEN year = latest THEN multiple END) OVER (PARTITION BY asset) AS now FROM n
    ), d AS (SELECT asset, arg_max(revenue, year) AS revenue, arg_max(gross, year) AS gross, arg_max(net, year) AS earned, arg_min(net / revenue, year) AS first_net, arg_max(net / revenue, year) AS last_net, max(year) - min(year) AS span,
      arg_min(revenue, year) AS r0, arg_min(net, year) AS e0, coalesce(avg(grew), 0) AS consistency, max(now) AS multiple, coalesce(avg((multiple < now)::INT::DOUBLE), 0.5) AS below FROM o GROUP BY asset
    ), k AS (SELECT s_nationkey, quantile_cont(multiple, 0.5) AS sector FROM o JOIN supplier ON asset = s_suppkey GROUP BY s_nationkey
    ), f AS (SELECT asset, earned / (abs(s_acctbal * 300) + 1e6) AS roe, gross / revenue AS gross, earned / revenue AS net, first_net, last_net,
      CASE WHEN span > 0 AND r0 > 0 AND revenue > 0 THEN pow(revenue / r0, 1.0::DOUBLE / span) - 1 ELSE 0 END AS rc, CASE WHEN span > 0 AND e0 > 0 AND earned > 0 THEN pow(earned / e0, 1.0::DOUBLE / span) - 1 ELSE 0 END AS ec, consistency,
      2 - s_acctbal / 5000 AS de, 1 + s_acctbal / 4000 AS cr, coalesce(s_acctbal * 300 / CASE WHEN earned > 0 THEN earned END, 0) AS cc, coalesce(multiple, 0) AS multiple, below, coalesce(sector, 0) AS sector,
      CASE WHEN asset % 3 > 0 THEN (asset % 11)::DOUBLE END AS mg, CASE WHEN s_nationkey % 4 > 0 THEN s_nationkey * 0.5::DOUBLE END AS mo FROM d JOIN supplier ON asset = s_suppkey JOIN k USING (s_nationkey)
    ), g AS (SELECT asset,
      {_ten("0.5::DOUBLE * least(roe / 0.2::DOUBLE, 1) * 10 + 0.3::DOUBLE * least(0.5::DOUBLE * gross / 0.5::DOUBLE + 0.5::DOUBLE * net / 0.15::DOUBLE, 1) * 10 + 0.2::DOUBLE * CASE WHEN last_net > first_net THEN 10 WHEN last_net < first_net * 0.95::DOUBLE THEN 3 ELSE 6 END")} AS profitability,
      {_ten("0.4::DOUBLE * least(rc / 0.2::DOUBLE, 1) * 10 + 0.4::DOUBLE * least(ec / 0.2::DOUBLE, 1) * 10 + 0.2::DOUBLE * consistency * 10")} AS growth,
      {_ten("0.4::DOUBLE * CASE WHEN de <= 0.5::DOUBLE THEN 10 ELSE greatest(10 - (de - 0.5::DOUBLE) * 2.5::DOUBLE, 0) END + 0.3::DOUBLE * CASE WHEN cr BETWEEN 1.2::DOUBLE AND 2.5::DOUBLE THEN 10 ELSE greatest(10 - abs(cr - 2) * 4, 2) END + 0.3::DOUBLE * least(cc, 1) * 10")} AS health,
      {_ten("(1 - below) * 10 + CASE WHEN multiple > sector * 1.3::DOUBLE THEN -1.5::DOUBLE WHEN multiple < sector * 0.7::DOUBLE THEN 1.5::DOUBLE ELSE 0 END")} AS fair_value, {_ten('coalesce(mg, 5)')} AS management, {_ten('coalesce(mo, 5)')} AS moat FROM f
    ), t AS (SELECT *, {' + '.join(f'{k} * {w!r}::DOUBLE' for k, w in desk.DIMENSIONS.items())} AS total, least({', '.join(desk.DIMENSIONS)}) AS lowest FROM g)
    SELECT asset, CASE {' '.join(f"WHEN {k} = lowest THEN '{k}'" for k in desk.DIMENSIONS)} END AS weakest, """
    + q({c: f"t.{c}" for c in (*desk.DIMENSIONS, "total")})
    + " FROM t",
    "instruments": f"""WITH n AS (SELECT p_partkey, p_size, lpad((p_partkey * 7919 % 1000000)::VARCHAR, 6, '0') AS number FROM part
    ), y AS (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN (['if', 'IH', 'ic', 'IM', 'XX'])[p_partkey % 5 + 1] || substr(number, 3, 4) WHEN p_size % 9 = 1 THEN ' 51' || substr(number, 3, 4) WHEN p_partkey % 97 = 0 THEN '588000' ELSE number END AS symbol FROM n
    ), u AS (SELECT *, upper(trim(symbol)) AS s FROM y), v AS (SELECT p_partkey, symbol, CASE WHEN s IN ({', '.join(f"'{x}'" for x in desk.FUNDS)}) OR regexp_matches(s, '^(51|15)[0-9]{{4}}$') THEN {_SPEC.format('fund', 1.0, 1.0, 0.001, 100, 1, 0.1, 2.5)}
      WHEN regexp_matches(s, '^[0-9]{{6}}$') THEN {_SPEC.format('stock', 1.0, 1.0, 0.01, 100, 1, 0.1, 2.5)} {' '.join(f"WHEN starts_with(s, '{p}') THEN " + _SPEC.format(k, m, l, 0.2, 1, 0, l, 0.23) for p, (k, m, l) in desk.CONTRACTS.items())} END AS spec FROM u)
    SELECT p_partkey, symbol, spec.kind, spec.multiplier, spec.margin, spec.tick, spec.lot, spec.t_plus, spec.price_limit, spec.commission_bps FROM v""",
    "recent_events": _EV + f" SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY abs(e.score) DESC, ts DESC, id DESC) AS place, id, ts, {quantised_sql('e.score')} AS score FROM e WHERE ts >= now - INTERVAL {DAYS} DAY AND event_type <> 'view'",
    "todays_events": _EV + f" SELECT id, asset, ts, {quantised_sql('e.score')} AS score, row_number() OVER (PARTITION BY asset ORDER BY e.score DESC, id DESC) AS place FROM e WHERE ts::DATE = now::DATE",
    "valuation_inputs": f"""WITH f AS (SELECT o_custkey AS asset, ([{', '.join(f"'{x}'" for x in FIELDS)}])[o_orderkey % 6 + 1] AS field, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS value FROM orders GROUP BY ALL
    ), w AS (SELECT asset, {', '.join(f"max(value{' * 0.001::DOUBLE' if x == 'shares' else ''}) FILTER (field = '{x}') AS {x}" for x in FIELDS)} FROM f GROUP BY asset
    ), j AS (SELECT coalesce(asset, c_custkey) AS asset, c_acctbal / 100 AS price, w.* EXCLUDE (asset) FROM w FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON asset = c_custkey
    ), r AS (SELECT asset, price, CASE WHEN shares > 0 THEN profit / shares END AS eps, CASE WHEN equity > 0 THEN profit / equity END AS roe, CASE WHEN shares > 0 THEN equity / shares END AS bvps, CASE WHEN shares > 0 THEN revenue / shares END AS revenue_per_share,
      CASE WHEN equity > 0 THEN debt / equity END AS debt_to_equity, CASE WHEN profit <> 0 THEN cash_flow / profit END AS cash_ratio FROM j
    ), p AS (SELECT *, CASE WHEN eps > 0 THEN price / eps END AS pe, CASE WHEN bvps > 0 THEN price / bvps END AS pb FROM r)
    SELECT asset, {' + '.join(f'(p.{c} IS NOT NULL)::BIGINT' for c in ('price', 'eps', 'roe', 'bvps', 'revenue_per_share', 'debt_to_equity', 'cash_ratio', 'pe', 'pb'))} AS n, """
    + q({c: f"p.{c}" for c in ("price", "eps", "roe", "bvps", "revenue_per_share", "debt_to_equity", "cash_ratio", "pe", "pb")})
    + " FROM p",
}
_ENTROPY = " + ".join(f'CASE WHEN "{c}" > 0 THEN -"{c}" * ln("{c}") ELSE 0 END' for c in REGIMES)
_MOST = "greatest(" + ", ".join(f'"{c}"' for c in REGIMES) + ")"
_SCORED = "SELECT '{gate}' AS gate, subject, passed, {score} AS score FROM (SELECT {subject}::VARCHAR AS subject, {passed} AS passed, {value} AS v FROM {source})"


def _gate_sql(gate: str, subject: str, passed: str, value: str, source: str) -> str:
    return _SCORED.format(gate=gate, subject=subject, passed=passed, value=f"least(greatest({value}, 0), 1)", source=source, score=quantised_sql("v"))


ORACLE_SQL["output_gates"] = " UNION ALL ".join(
    [
        _gate_sql(
            "cost", "plan", f"cost_bps < {gates.COST_BPS} AND impact < {gates.IMPACT_BPS} AND CASE WHEN cost_bps > 1e-9 THEN impact / cost_bps ELSE 0 END < {gates.IMPACT_SHARE}::DOUBLE", f"({gates.COST_BPS}::DOUBLE - cost_bps) / {gates.COST_BPS}::DOUBLE",
            f"(SELECT *, cost_bps - {_case('urgency', 'penalty')} - {desk.BASE_BPS}::DOUBLE AS impact FROM ({ORACLE_SQL['plan_costs']}))",
        ),
        _gate_sql(
            "constraints", "account", f"most <= {CAP}::DOUBLE + 1e-6 AND least >= -1e-9 AND abs(total - 1) <= 1e-6", f"CASE WHEN most <= {CAP}::DOUBLE + 1e-6 AND least >= -1e-9 AND abs(total - 1) <= 1e-6 THEN 1.0::DOUBLE ELSE 0 END",
            """(SELECT account, max(weight) AS most, min(weight) AS least, sum(weight) AS total FROM (SELECT account, v / CAST(sum(CAST(v AS DECIMAL(18,2))) OVER (PARTITION BY account) AS DOUBLE) AS weight FROM (
              SELECT o_custkey AS account, l_partkey AS asset, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) SEMI JOIN part ON asset = p_partkey) GROUP BY account)""",
        ),
        _gate_sql("freshness", "asset", f"age BETWEEN 0 AND {FRESH_DAYS}", f"1 - age / {2.0 * FRESH_DAYS}::DOUBLE", f"({_BARS} SELECT asset, date_diff('day', max(t), (SELECT max(t) FROM bars)) AS age FROM bars GROUP BY asset)"),
        _gate_sql("regime", "t", f"{_MOST} > {gates.CHANCE} AND {_ENTROPY} < {gates.ENTROPY}", _MOST, f"({risk_plans.ORACLE_SQL['rule_regimes']})"),
    ]
)
