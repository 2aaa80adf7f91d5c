"""Desk rules over tables: cost and limits of plans, gaps of a shadow account, six-dimension scorecards, instruments by rule, recent events, valuation inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.columns import clip

#: Fixed values by urgency: penalty and expected completion of a plan, allowed price deviation and participation, and the algorithm that an adaptive plan takes.
URGENCIES = {
    "high": {"penalty": 10.0, "completion": 0.92, "deviation": 0.03, "participation": 0.15, "algorithm": "shortfall"},
    "normal": {"penalty": 0.0, "completion": 0.95, "deviation": 0.02, "participation": 0.10, "algorithm": "vwap"},
    "low": {"penalty": -3.0, "completion": 0.98, "deviation": 0.01, "participation": 0.05, "algorithm": "twap"},
}
#: What an algorithm adds to the completion; commission and levy in bps, impact per root of participation and its limit, the cost of an empty plan.
COMPLETION = {"vwap": 0.01, "shortfall": -0.02}
BASE_BPS, SALE_BPS, IMPACT_BPS, MOST_IMPACT_BPS, EMPTY_BPS = 3.0, 1.0, 45.0, 60.0, 20.0
DAILY_VALUE = 1e8


def by_urgency(urgency: Column, what: str) -> Column:
    """A value of :data:`URGENCIES`; an unknown urgency is a normal one."""
    out = F.lit(URGENCIES["normal"][what])
    for name, values in URGENCIES.items():
        out = F.when(urgency == name, values[what]).otherwise(out)
    return out


def plan_report(orders: DataFrame, daily_value: Column | None = None) -> DataFrame:
    """(plan, urgency, n, value, algorithm, cost_bps, completion, max_deviation, max_participation, breaker, over_limit) from (plan, urgency, asset, side, value, daily).

    The cost is the orders' mean by value: commission and levy, a duty on sales, impact by the root of the share of the day's value, and the urgency's penalty;
    ``over_limit``: orders whose share exceeds what the urgency allows. Orders without a daily value are taken against :data:`DAILY_VALUE`."""
    daily = F.coalesce(F.col("daily") if daily_value is None else daily_value, F.lit(DAILY_VALUE))
    part = F.col("value") / F.greatest(daily, F.lit(1.0))
    bps = BASE_BPS + F.when(F.col("side") == "buy", 0.0).otherwise(SALE_BPS) + F.least(F.sqrt(part) * IMPACT_BPS, F.lit(MOST_IMPACT_BPS))
    u = F.col("urgency")
    over = F.sum((part > by_urgency(u, "participation")).cast("long"))
    d = orders.groupBy("plan", "urgency").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"), F.sum(bps * F.col("value")).alias("paid"), over.alias("over_limit"))
    algorithm, bonus = by_urgency(u, "algorithm"), F.lit(0.0)
    for name, extra in COMPLETION.items():
        bonus = F.when(algorithm == name, extra).otherwise(bonus)
    deviation = by_urgency(u, "deviation")
    cost = F.when(F.col("value") > 0, F.col("paid") / F.col("value")).otherwise(EMPTY_BPS) + by_urgency(u, "penalty")
    return d.select(
        "plan", "urgency", "n", "value", algorithm.alias("algorithm"), cost.alias("cost_bps"), F.least(by_urgency(u, "completion") + bonus, F.lit(0.99)).alias("completion"),
        deviation.alias("max_deviation"), by_urgency(u, "participation").alias("max_participation"), (deviation * 2).alias("breaker"), "over_limit",
    )


def shadow_gaps(targets: DataFrame, equity: float, lot: int = 100) -> DataFrame:
    """(account, asset, weight, qty, gap, placed) from (account, asset, weight, price): whole lots that the account's equity buys, and what they miss of the target.

    Below one lot nothing is placed and the whole weight is missed, as without a positive price; the weights of an account have to sum to one, otherwise ``placed`` is null for all of it."""
    total = F.sum("weight").over(Window.partitionBy("account"))
    shares = F.when(F.col("price") > 0, F.floor(F.lit(equity) * F.col("weight") / F.col("price"))).otherwise(0)
    qty = shares - shares % lot
    d = targets.withColumns({"qty": F.when(qty >= lot, qty).otherwise(0).cast("long"), "sound": F.abs(total - 1) <= 1e-6})
    gap = F.col("weight") - F.when(F.col("qty") > 0, F.col("qty") * F.col("price") / equity).otherwise(0.0)
    return d.select("account", "asset", "weight", "qty", gap.alias("gap"), F.when(F.col("sound"), F.col("qty") > 0).alias("placed"))


# Scorecards: each dimension from 0 to 10.


def ten(c: Column) -> Column:
    return F.round(clip(c, 0.0, 10.0), 1)


def profitability(roe: Column, gross: Column, net: Column, first_net: Column, last_net: Column) -> Column:
    trend = F.when(last_net > first_net, 10.0).when(last_net < first_net * 0.95, 3.0).otherwise(6.0)
    return ten(0.5 * F.least(roe / 0.2, F.lit(1.0)) * 10 + 0.3 * F.least(0.5 * gross / 0.5 + 0.5 * net / 0.15, F.lit(1.0)) * 10 + 0.2 * trend)


def growth(revenue_cagr: Column, earnings_cagr: Column, consistency: Column) -> Column:
    """``consistency``: the share of years in which revenue grew."""
    return ten(0.4 * F.least(revenue_cagr / 0.2, F.lit(1.0)) * 10 + 0.4 * F.least(earnings_cagr / 0.2, F.lit(1.0)) * 10 + 0.2 * consistency * 10)


def health(debt_to_equity: Column, current_ratio: Column, cash_conversion: Column) -> Column:
    debt = F.when(debt_to_equity <= 0.5, 10.0).otherwise(F.greatest(10 - (debt_to_equity - 0.5) * 2.5, F.lit(0.0)))
    current = F.when(current_ratio.between(1.2, 2.5), 10.0).otherwise(F.greatest(10 - F.abs(current_ratio - 2) * 4, F.lit(2.0)))
    return ten(0.4 * debt + 0.3 * current + 0.3 * F.least(cash_conversion, F.lit(1.0)) * 10)


def fair_value(multiple: Column, below: Column, sector: Column) -> Column:
    """``below``: the share of its own history that was cheaper; a multiple far from the sector's moves it by 1.5."""
    return ten((1 - below) * 10 + F.when(multiple > sector * 1.3, -1.5).when(multiple < sector * 0.7, 1.5).otherwise(0.0))


def given(score: Column | None) -> Column:
    """A judgement from outside, 5 where there is none."""
    return ten(F.coalesce(score.cast("double"), F.lit(5.0)) if score is not None else F.lit(5.0))


#: Weights of the dimensions in the total.
DIMENSIONS = {"profitability": 0.25, "growth": 0.2, "health": 0.2, "fair_value": 0.15, "management": 0.1, "moat": 0.1}


def scorecard(facts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, the six dimensions, total, weakest) from facts named as the dimensions' arguments; the weakest is the first of the lowest."""
    c = F.col
    d = facts.select(
        *keys, profitability(c("roe"), c("gross"), c("net"), c("first_net"), c("last_net")).alias("profitability"), growth(c("revenue_cagr"), c("earnings_cagr"), c("consistency")).alias("growth"),
        health(c("debt_to_equity"), c("current_ratio"), c("cash_conversion")).alias("health"), fair_value(c("multiple"), c("below"), c("sector")).alias("fair_value"), given(c("management")).alias("management"), given(c("moat")).alias("moat"),
    )
    total = sum((F.col(k) * w for k, w in DIMENSIONS.items()), F.lit(0.0))
    lowest, weakest = F.least(*DIMENSIONS), F.lit(None).cast("string")
    for k in reversed(DIMENSIONS):
        weakest = F.when(F.col(k) == lowest, k).otherwise(weakest)
    return d.select("*", total.alias("total"), weakest.alias("weakest"))


# Instruments.

#: Contracts by prefix (kind, multiplier, margin, tick, lot, settlement days, price limit, commission in bps).
CONTRACTS = {"IF": ("index_future", 300.0, 0.12), "IH": ("index_future", 300.0, 0.12), "IC": ("index_future", 200.0, 0.14), "IM": ("index_future", 200.0, 0.15)}
FUNDS = ("510300", "510500", "512100", "588000")


def instrument(symbol: Column) -> Column:
    """(kind, multiplier, margin, tick, lot, t_plus, price_limit, commission_bps) of a symbol: listed funds, six digits (51 and 15 are funds, the rest stocks), contracts
    by their first two letters; null for anything else."""
    s = F.upper(F.trim(symbol))
    spec = lambda kind, m, margin, tick, lot, t, limit, bps: F.struct(F.lit(kind).alias("kind"), F.lit(m).alias("multiplier"), F.lit(margin).alias("margin"), F.lit(tick).alias("tick"), F.lit(lot).alias("lot"), F.lit(t).alias("t_plus"), F.lit(limit).alias("price_limit"), F.lit(bps).alias("commission_bps"))
    digits = s.rlike("^[0-9]{6}$")
    out = F.when(s.isin(*FUNDS) | (digits & s.rlike("^(51|15)")), spec("fund", 1.0, 1.0, 0.001, 100, 1, 0.1, 2.5)).when(digits, spec("stock", 1.0, 1.0, 0.01, 100, 1, 0.1, 2.5))
    for prefix, (kind, multiplier, limit) in CONTRACTS.items():
        out = out.when(s.startswith(prefix), spec(kind, multiplier, limit, 0.2, 1, 0, limit, 0.23))
    return out


def recent_events(events: DataFrame, now: DataFrame, days: int, source: Column | None = None) -> DataFrame:
    """(asset, place, id, ts, score) of each asset's events (asset, id, ts, score) in the ``days`` before ``now`` (one row, now), the strongest of either sign first, ties to the later, then the greater id."""
    d = events.crossJoin(F.broadcast(now)).where((F.col("ts") >= F.col("now") - F.make_interval(days=F.lit(days))) & (F.col("ts") <= F.col("now")))
    d = d if source is None else d.where(source)
    order = Window.partitionBy("asset").orderBy(F.desc(F.abs("score")), F.desc("ts"), F.desc("id"))
    return d.select("asset", F.row_number().over(order).alias("place"), "id", "ts", "score")


def events_of_day(events: DataFrame, now: DataFrame) -> DataFrame:
    """(id, asset, ts, score, place) of all events of the date of ``now``, the highest score first within each asset."""
    d = events.crossJoin(F.broadcast(now)).where(F.to_date("ts") == F.to_date("now"))
    return d.select("id", "asset", "ts", "score", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("score"), F.desc("id"))).alias("place"))


def valuation_inputs(facts: DataFrame, prices: DataFrame, unit: dict[str, float] | None = None) -> DataFrame:
    """(asset, price, eps, roe, pe, bvps, pb, revenue_per_share, profit_per_share, debt_to_equity, cash_ratio, n) from long facts (asset, field, value) and (asset, price).

    ``unit`` multiplies fields that are kept in other units. A ratio without its parts, or over what is not positive, is null; ``n`` counts what is known."""
    names = ("shares", "equity", "revenue", "profit", "debt", "cash_flow")
    value = F.col("value") * F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in (unit or {"": 1.0}).items() for x in kv]), F.col("field")), F.lit(1.0))
    wide = facts.withColumn("value", value).groupBy("asset").pivot("field", list(names)).agg(F.max("value")).join(prices, "asset", "full")
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    d = wide.select("asset", "price", over("profit", "shares").alias("eps"), over("profit", "equity").alias("roe"), over("equity", "shares").alias("bvps"), over("revenue", "shares").alias("revenue_per_share"), over("debt", "equity").alias("debt_to_equity"), F.when(F.col("profit") != 0, F.col("cash_flow") / F.col("profit")).alias("cash_ratio"))
    d = d.withColumns({"pe": F.when(F.col("eps") > 0, F.col("price") / F.col("eps")), "pb": F.when(F.col("bvps") > 0, F.col("price") / F.col("bvps"))})
    known = sum((F.col(c).isNotNull().cast("long") for c in d.columns if c != "asset"), F.lit(0).cast("long"))
    return d.withColumn("n", known)
