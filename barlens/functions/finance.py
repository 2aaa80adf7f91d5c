"""Valuation, costs, sizing and risk rules as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from barlens.functions.columns import clip, col

COMMISSION_BPS, SLIPPAGE_BPS, STAMP_BPS = 2.0, 5.0, 10.0


def turnover_cost(turnover: Column | str, bps: float = COMMISSION_BPS + SLIPPAGE_BPS + STAMP_BPS) -> Column:
    return col(turnover) * F.lit(bps / 1e4)


def impact(value: Column, daily_value: Column, sigma_annual: float = 0.3, permanent: float = 0.1, temporary: float = 0.142) -> Column:
    """Cost share of an order: sigma_daily * (permanent * participation + temporary * participation ** 0.6), participation at most 1."""
    p = F.least(F.try_divide(value, daily_value), F.lit(1.0))
    return F.coalesce(F.lit(sigma_annual / math.sqrt(252)) * (permanent * p + temporary * F.pow(p, F.lit(0.6))), F.lit(0.0))


def square_root_impact(quantity: Column, adv: Column, bps: float = 45.0) -> Column:
    """bps * sqrt(participation) as a share of the price."""
    return F.lit(bps / 1e4) * F.sqrt(F.coalesce(F.try_divide(quantity, adv), F.lit(0.0)))


def wacc(equity: Column, debt: Column, beta: Column, risk_free: float = 0.025, premium: float = 0.06, debt_cost: float = 0.045, tax: float = 0.25) -> Column:
    """Weighted cost of capital, between 5 % and 20 %."""
    total = F.when(equity + debt > 0, equity + debt)
    return clip(F.coalesce(equity / total * (risk_free + beta * premium) + debt / total * F.lit(debt_cost * (1 - tax)), F.lit(0.1)), 0.05, 0.2)


def dcf(cash: Column, growth: Column, rate: Column, terminal: float = 0.025, years: int = 5) -> Column:
    """Two-stage value: ``years`` of growth, then a perpetuity; null where the rate does not exceed the terminal growth."""
    flows = F.aggregate(F.sequence(F.lit(1), F.lit(years)), F.lit(0.0), lambda acc, y: acc + cash * F.pow(1 + growth, y.cast("double")) / F.pow(1 + rate, y.cast("double")))
    last = cash * F.pow(1 + growth, F.lit(float(years))) * (1 + terminal) / (rate - terminal) / F.pow(1 + rate, F.lit(float(years)))
    return F.when(rate > terminal, flows + last)


def weighted_target(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the methods that gave a positive value, weights scaled to those."""
    ok = {m: v.isNotNull() & (v > 0) for m, v in values.items()}
    top = sum((F.when(ok[m], v * weights[m]).otherwise(0.0) for m, v in values.items()), F.lit(0.0))
    bottom = sum((F.when(ok[m], F.lit(float(weights[m]))).otherwise(0.0) for m in values), F.lit(0.0))
    return F.when(bottom > 0, top / bottom)


def linear_score(x: Column, low: float, high: float) -> Column:
    """0 at ``low``, 100 at ``high``, clipped."""
    return clip((x - low) / (high - low) * 100, 0.0, 100.0)


def flags(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order."""
    return F.filter(F.array(*[F.when(r, name) for name, r in rules.items()]), lambda x: x.isNotNull())


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that does not hold (null counts as a failure); null if all hold."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules])


def target_shares(weight: Column, equity: float, price: Column, lot: int = 100) -> Column:
    """Whole lots that the weight buys; 0 without a price."""
    return F.when(price > 0, F.floor(weight * equity / price / lot) * lot).otherwise(0).cast("long")


def limit_blocked(side: Column, price: Column, previous: Column, ratio: Column) -> Column:
    """Whether a buy at the upper or a sell at the lower price limit cannot be filled."""
    up, down = F.round(previous * (1 + ratio), 2), F.round(previous * (1 - ratio), 2)
    return F.when(side == "buy", price >= up - 1e-9).otherwise(price <= down + 1e-9)


def bar_fill(requested: Column, bar_volume: Column, blocked: Column, share: float = 0.1) -> Column:
    """Filled quantity: at most a share of the bar's volume, nothing where blocked."""
    return F.when(blocked | (bar_volume <= 0), 0.0).otherwise(F.least(requested, bar_volume * share))


def debate(points: dict[str, tuple[Column, Column]]) -> tuple[Column, Column, Column]:
    """Bull points, bear points and verdict: each topic argues for (first condition) or against (second); a lead of two decides."""
    count = lambda k: sum((F.coalesce(p[k], F.lit(False)).cast("int") for p in points.values()), F.lit(0))
    bull, bear = count(0), count(1)
    return bull, bear, F.when(bull - bear >= 2, "buy").when(bear - bull >= 2, "avoid").otherwise("wait")


def private_value(revenue: Column, multiples: Column, liquidity_discount: float = 0.25, control_premium: float = 0.1, low: float = 0.2, high: float = 30.0) -> Column:
    """Revenue times the median of an array of sales multiples within [low, high], less a discount, plus a premium; null without multiples."""
    m = F.sort_array(F.filter(multiples, lambda x: x.between(low, high)))
    n = F.size(m)
    middle = (F.get(m, F.floor((n - 1) / 2).cast("int")) + F.get(m, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, revenue * middle * (1 - liquidity_discount) * (1 + control_premium))


def retrain_due(ic_recent: Column, ic_before: Column, days_since: Column, max_days: int = 90, decay: float = 0.5) -> Column:
    """Why a model is due: "age", "decay" of its IC below a share of what it was, "sign" if it turned negative; else null."""
    return F.when(ic_recent < 0, "sign").when(ic_recent < decay * ic_before, "decay").when(days_since > max_days, "age")


def traded_weight(target: Column, current: Column, alpha: Column, cost: float) -> Column:
    """The new weight: the target where the gain |alpha * change| exceeds the cost of the change, else the current one."""
    delta = target - current
    return F.when(F.abs(alpha * delta) > cost * F.abs(delta), target).otherwise(current)
