"""Orders under a cash budget, margin, fills, risk decomposition and three-factor triggers, set-wise."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def generated_orders(targets: DataFrame, cash: Column, lot: int = 1, max_positions: int = 50) -> DataFrame:
    """(account, asset, side, qty) from ``targets`` (account, asset, weight, price, held, target; whole shares).

    Each account keeps the ``max_positions`` targets of largest weight, ties to the smaller asset, and sells what exceeds its target
    (all of what is not kept). Buys follow by weight: each takes whole lots as far as the account's remaining ``cash`` goes; what one
    leaves, a cheaper one after it may use. Only an account's kept targets, a bounded number, are folded together. Assets without a
    positive price are not bought; an account without targets has no orders."""
    place = F.row_number().over(Window.partitionBy("account").orderBy(F.desc("weight"), "asset"))
    t = targets.withColumn("cash", cash).withColumn("place", place).withColumn("target", F.when(F.col("place") <= max_positions, F.col("target")).otherwise(0))
    sells = t.where("held > target").select("account", "asset", F.lit("sell").alias("side"), (F.col("held") - F.col("target")).cast("double").alias("qty"))
    wanted = t.where((F.col("target") > F.col("held")) & (F.col("price") > 0)).withColumn("want", F.floor((F.col("target") - F.col("held")) / lot) * lot).where("want > 0")
    per = wanted.groupBy("account").agg(F.max("cash").alias("cash"), F.array_sort(F.collect_list(F.struct("place", "asset", "price", F.col("want").cast("double").alias("want")))).alias("buys"))
    kind = targets.schema["asset"].dataType.simpleString()
    empty = F.array().cast(f"array<struct<asset:{kind},qty:double>>")

    def step(state: Column, buy: Column) -> Column:
        lots = F.floor(state["cash"] / (buy["price"] * lot)) * lot
        qty = F.when(buy["want"] * buy["price"] <= state["cash"], buy["want"]).otherwise(F.greatest(lots.cast("double"), F.lit(0.0)))
        return F.struct((state["cash"] - qty * buy["price"]).alias("cash"), F.concat(state["orders"], F.array(F.struct(buy["asset"].alias("asset"), qty.alias("qty")))).alias("orders"))

    done = F.aggregate("buys", F.struct(F.col("cash").cast("double").alias("cash"), empty.alias("orders")), step, lambda s: s["orders"])
    bought = per.select("account", F.inline(done)).where("qty > 0").select("account", "asset", F.lit("buy").alias("side"), "qty")
    return sells.unionByName(bought)


def realised_weights(fills: DataFrame, equity: float = 1.0) -> DataFrame:
    """(account, asset, weight) from ``fills`` (account, asset, side, value): signed value over the account's sum of absolute ones.

    Fills without a positive value are left out, as are accounts whose fills cancel in every asset."""
    net = fills.where("value > 0").groupBy("account", "asset").agg(F.sum(F.when(F.col("side") == "buy", F.col("value")).otherwise(-F.col("value"))).alias("net"))
    gross = F.sum(F.abs("net")).over(Window.partitionBy("account"))
    return net.withColumn("gross", gross).where("gross > 0").select("account", "asset", (F.col("net").cast("double") / F.col("gross").cast("double") * equity).alias("weight"))


def sized_lots(notional: Column, unit: Column, margin_rate: Column, cash: Column) -> tuple[Column, Column, Column]:
    """(lots, margin, note) of a target ``notional`` in contracts of value ``unit``, as far as ``cash`` covers the margin."""
    lots, most = F.floor(notional / unit), F.floor(cash / (unit * margin_rate))
    note = F.when(unit <= 0, "invalid").when(lots < 1, "below one lot").when(lots * unit * margin_rate <= cash, "").when(most < 1, "no cash").otherwise("capped")
    taken = F.when(note == "", lots).when(note == "capped", most).otherwise(0)
    return taken, taken * unit * margin_rate, note


def one_hot(assets: DataFrame, group: str, groups: list[str]) -> DataFrame:
    """(asset, one column of 0 or 1 for each of ``groups``)."""
    return assets.select("asset", *[(F.col(group) == g).cast("int").alias(g) for g in groups])


def group_risk(returns: DataFrame, groups: DataFrame, weights: DataFrame) -> DataFrame:
    """(factor, exposure, variance, share) of a portfolio's variance under a model of groups.

    Factors are the ``groups`` (asset, g): a group's return is the mean of its assets' (``returns``: asset, t, r), which is least squares on one-hot
    exposures; the rest of each asset's return is its own. A factor's contribution is its exposure times its covariance with the portfolio's
    factor return; the row 'specific' sums weight squared times own variance. Pairs of factors, not of assets, are joined."""
    r = returns.where("r is not null").join(groups, "asset")
    factor = r.groupBy("g", "t").agg(F.avg("r").alias("f"))
    own = r.join(factor, ["g", "t"]).groupBy("asset").agg(F.var_samp(F.col("r") - F.col("f")).alias("own"))
    w = weights.crossJoin(F.broadcast(weights.agg(F.sum("weight").alias("total")))).select("asset", (F.col("weight") / F.col("total")).alias("h"))
    exposure = w.join(groups, "asset").groupBy("g").agg(F.sum("h").alias("exposure"))
    a, b = factor.select(F.col("g").alias("a"), "t", F.col("f").alias("fa")), factor.select(F.col("g").alias("b"), "t", F.col("f").alias("fb"))
    cov = a.join(b, "t").groupBy("a", "b").agg(F.covar_samp("fa", "fb").alias("c"))
    part = cov.join(exposure.select(F.col("g").alias("b"), F.col("exposure").alias("eb")), "b").groupBy("a").agg(F.sum(F.col("c") * F.col("eb")).alias("marginal"))
    systematic = exposure.join(part, F.col("g") == F.col("a")).select(F.col("g").alias("factor"), "exposure", (F.col("exposure") * F.col("marginal")).alias("variance"))
    specific = w.join(own, "asset").agg(F.lit("specific").alias("factor"), F.lit(1.0).alias("exposure"), F.coalesce(F.sum(F.col("h") * F.col("h") * F.col("own")), F.lit(0.0)).alias("variance"))
    out = systematic.unionByName(specific)
    total = out.agg(F.sum("variance").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("factor", "exposure", "variance", F.when(F.col("total") > 0, F.col("variance") / F.col("total")).otherwise(0.0).alias("share"))


def simulated_losses(draws: DataFrame, exposure: np.ndarray, covariance: np.ndarray, shock: np.ndarray) -> DataFrame:
    """(draw, loss) for ``draws`` (draw): joint normal factor moves from hashes of the draw's number, so that reruns agree.

    The driver holds the factors' covariance only. loss = -exposure . (L z + shock), L L' = covariance."""
    values, vectors = np.linalg.eigh(covariance)
    load = (vectors * np.sqrt(np.clip(values, 0, None))).T @ exposure
    uniform = lambda k, s: (F.pmod(F.xxhash64("draw", F.lit(k), F.lit(s)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = lambda k: F.sqrt(-2 * F.log(uniform(k, 1))) * F.cos(2 * np.pi * uniform(k, 2))
    move = sum((float(x) * normal(k) for k, x in enumerate(load)), F.lit(float(shock @ exposure)))
    return draws.select("draw", (-move).alias("loss"))


def loss_summary(losses: DataFrame) -> DataFrame:
    return losses.agg(F.avg("loss").alias("mean_loss"), F.percentile("loss", 0.95).alias("p95_loss"), F.percentile("loss", 0.99).alias("p99_loss"), F.max("loss").alias("max_loss"))


def valuation_tier(implied: Column) -> Column:
    """Score of an implied return; an unknown one is neutral."""
    return F.when(implied.isNull(), 0.5).when(implied >= 0.3, 1.0).when(implied >= 0.15, 0.8).when(implied >= 0, 0.5).when(implied >= -0.1, 0.3).otherwise(0.1)


def technical_score(close: Column, mean: Column, high: Column, volume: Column, mean_volume: Column, n: Column, least: int = 25) -> Column:
    """Of a close near the window's high, above its mean, and of volume above 1.2 times its mean; neutral with fewer than ``least`` bars."""
    out, above, loud = close >= high * 0.995, close > mean, volume > 1.2 * mean_volume
    return F.when(n < least, 0.5).when(out & above & loud, 1.0).when(out | (above & loud), 0.7).when(above, 0.5).otherwise(0.3)


def catalyst_score(score: Column) -> Column:
    """Of the strongest recent event's score: positive ones count one half at least, negative ones a tenth; none is neutral."""
    return F.when(score.isNull(), 0.5).when(score > 0, F.greatest(score, F.lit(0.5))).when(score < 0, F.greatest(score, F.lit(0.1))).otherwise(0.0)


def trigger(catalyst: Column, value: Column, technical: Column, least: float = 0.6, strong: float = 0.7) -> tuple[Column, Column]:
    """(score, triggered) of the three factors: cheap enough, and one of the other two strong."""
    score = 0.4 * catalyst + 0.3 * value + 0.3 * technical
    return score, (score >= least) & (value >= 0.6) & ((catalyst >= strong) | (technical >= 0.7))


def percentile_target(history: str, current: Column, per_share: Column) -> tuple[Column, Column]:
    """(percentile, target), aggregates over a group: the share of ``history`` below the last ratio, and the ratio it should return to, per share."""
    low, middle, high = (F.percentile(history, p) for p in (0.25, 0.5, 0.75))
    below = F.avg((F.col(history) < current).cast("double"))
    ratio = F.when(below > 0.7, F.greatest(low, middle * 0.9)).when(below < 0.3, F.least(high, middle * 1.1)).otherwise(middle)
    return below, ratio * per_share


def pb_roe_target(pe: Column, roe: Column, book: Column) -> Column:
    """Book value times return on equity over the return that the price implies."""
    return roe / F.when(pe > 0, 1 / pe).otherwise(0.1) * book


def enterprise_value(cap: Column, debts: list[Column], cash: list[Column]) -> Column:
    """Market value and debt less cash; null where no debt is known."""
    total = lambda cs: sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0))
    return F.when(total(debts) > 0, cap + total(debts) - total(cash))


def ev_ebitda_target(mean_ratio: Column, ebitda: Column, net_debt: Column, premium: float = 0.05) -> Column:
    return mean_ratio * (1 + premium) * ebitda - net_debt


def constant_rate(volatility: Column, impact: float, aversion: float, horizon: int) -> Column:
    """Share traded in each period that balances impact against the risk of waiting, between 0 and 1."""
    return F.least(F.greatest(aversion * F.greatest(volatility, F.lit(0.0)) / (2 * impact * horizon + 1e-9), F.lit(0.0)), F.lit(1.0))


def capacity_curve(volumes: DataFrame, capitals: DataFrame, gross: float, turnover: float, bps: float = 45.0) -> DataFrame:
    """(capital, participation, net) for equal holdings in ``volumes`` (asset, adv): square-root impact at each capital."""
    n = volumes.where("adv > 0").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("capital") / F.col("n") / F.col("adv")
    grid = volumes.where("adv > 0").crossJoin(F.broadcast(capitals)).crossJoin(F.broadcast(n))
    cost = F.avg(F.sqrt(share)) * bps / 1e4 * turnover
    return grid.groupBy("capital").agg(F.percentile(share, 0.5).alias("participation"), (F.lit(gross) - cost).alias("net"))


def robustness(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, median, mean, dispersion) of ``value`` over the parameters that ``runs`` varies; dispersion: deviation over absolute mean."""
    mean = F.avg(value)
    return runs.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile(value, 0.5).alias("median"), mean.alias("mean"), F.when(F.abs(mean) > 1e-10, F.stddev_samp(value) / F.abs(mean)).alias("dispersion"))


def buy_and_hold(bars: DataFrame, coverage: float = 0.9, year: int = 244) -> DataFrame:
    """(assets, annual, sharpe, drawdown) of the mean price of the assets with bars at that share of all dates, where all have one."""
    dates = bars.agg(F.count_distinct("t").alias("dates"))
    covered = bars.groupBy("asset").agg(F.count(F.lit(1)).alias("own")).crossJoin(F.broadcast(dates)).where(F.col("own") >= F.col("dates") * coverage).select("asset")
    price = bars.join(covered, "asset").groupBy("t").agg(F.avg("close").alias("p"), F.count(F.lit(1)).alias("n"))
    # One row a date from here on.
    w = Window.orderBy("t")
    path = price.withColumn("r", F.col("p") / F.lag("p").over(w) - 1).withColumn("d", F.col("p") / F.max("p").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    years = F.count(F.lit(1)) / float(year)
    return path.agg(F.max("n").alias("assets"), (F.pow(F.max_by("p", "t") / F.min_by("p", "t"), 1 / years) - 1).alias("annual"), (F.avg("r") / F.stddev_samp("r") * float(np.sqrt(year))).alias("sharpe"), F.min("d").alias("drawdown"))


def settled_account(trades: DataFrame, commission: float = 2.5e-4, minimum: float = 5.0, stamp: float = 5e-4) -> DataFrame:
    """(account, asset, day, bought, sold, kept, fees) from ``trades`` (account, asset, day, side, qty, price): what is bought may be sold from the next day on.

    A day's sales go as far as settled holdings do; ``kept`` is what is left of these. Holdings follow x = max(x + bought the day before - asked, 0),
    which running sums and their least value give, so no account is folded row by row. Fees: commission on either side's value of the day, ``minimum`` at least,
    and stamp duty on sales. Trades without a positive quantity and price are left out."""
    buys, sells = F.col("side") == "buy", F.col("side") == "sell"
    total = lambda side, c: F.coalesce(F.sum(F.when(side, c)), F.lit(0.0))
    value = (F.col("qty") * F.col("price")).cast("decimal(38,4)")
    d = trades.where("qty > 0 and price > 0").groupBy("account", "asset", "day").agg(
        total(buys, F.col("qty")).alias("bought"), total(sells, F.col("qty")).alias("asked"), total(buys, value).cast("double").alias("paid"), total(sells, value).cast("double").alias("worth")
    )
    w = Window.partitionBy("account", "asset").orderBy("day")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("step", F.lag("bought", 1, 0.0).over(w) - F.col("asked")).withColumn("s", F.sum("step").over(so_far))
    d = d.withColumn("kept", F.col("s") - F.least(F.lit(0.0), F.min("s").over(so_far)))
    d = d.withColumn("sold", F.lag("kept", 1, 0.0).over(w) + F.lag("bought", 1, 0.0).over(w) - F.col("kept"))
    got = F.coalesce(F.try_divide(F.col("worth") * F.col("sold"), "asked"), F.lit(0.0))
    fee = lambda v: F.when(v > 0, F.greatest(v * commission, F.lit(minimum))).otherwise(0.0)
    return d.select("account", "asset", "day", "bought", "sold", "kept", (fee(F.col("paid")) + fee(got) + got * stamp).alias("fees"))


def event_veto(orders: DataFrame, days: float = 3.0) -> DataFrame:
    """``orders`` (key, id, ts, side, negative) with ``vetoed``: a buy within so many days after the key's last negative row before it (by ts, id)."""
    before = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("negative"), F.col("ts")), ignorenulls=True).over(before)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    age = micros(F.col("ts")) - micros(last)
    return orders.withColumn("vetoed", (F.col("side") == "buy") & F.coalesce(age <= int(days * 86400 * 1e6), F.lit(False)))


def shrunk_to_tracking(weights: DataFrame, returns: DataFrame, most: float, periods: int = 252) -> DataFrame:
    """(asset, weight) from (asset, weight, benchmark) and (asset, t, r): the active part is scaled down until its tracking error is at most ``most``."""
    active = returns.where("r is not null").join(weights, "asset").groupBy("t").agg(F.sum((F.col("weight") - F.col("benchmark")) * F.col("r")).alias("a"))
    te = active.agg((F.stddev_pop("a") * float(np.sqrt(periods))).alias("te"))
    k = F.when(F.col("te") > most, most / F.col("te")).otherwise(1.0)
    return weights.crossJoin(F.broadcast(te)).select("asset", (F.col("benchmark") + k * (F.col("weight") - F.col("benchmark"))).alias("weight"))


def index_returns(bars: DataFrame, index: Column, dates: DataFrame) -> DataFrame:
    """(t, r) of the asset that ``index`` picks, on every row of ``dates`` (t): close over the index's last close before; 0 where there is none, or it is not finite."""
    w = Window.orderBy("t")  # one asset's bars
    r = bars.where(index).select("t", (F.try_divide("close", F.lag("close").over(w)) - 1).alias("r"))
    finite = F.col("r").isNotNull() & ~F.isnan("r") & (F.abs("r") != float("inf"))
    return dates.select("t").distinct().join(r, "t", "left").select("t", F.when(finite, F.col("r")).otherwise(0.0).alias("r"))
