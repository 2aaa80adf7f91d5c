"""Validation statistics of signals: rank-IC, group returns, half-life, crowding, combination, performance and tail metrics.

A signal is (asset, t, score); a label is (asset, t, fwd). All are aggregated in Spark; only formulas on a handful of moments
(normal quantiles) run on the driver.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.columns import TINY, guarded_corr
from barlens.operators.expression import cross, series, tied_rank

YEAR = 252


def forward_return(horizon: int = 1) -> Column:
    """Return to the bar ``horizon`` later."""
    return F.try_divide(F.lead("close", horizon).over(series()), F.when(F.col("close") > 0, F.col("close"))) - 1


def forward_returns(bars: DataFrame, horizon: int = 1, max_gap_days: int | None = None) -> DataFrame:
    """(asset, t, fwd): return to the bar ``horizon`` later; null across a gap of more than ``max_gap_days`` days."""
    fwd = forward_return(horizon)
    if max_gap_days is not None:
        fwd = F.when(F.datediff(F.lead("t", horizon).over(series()), F.col("t")) <= max_gap_days, fwd)
    return bars.select("asset", "t", fwd.alias("fwd"))


def paired(signal: DataFrame, forward: DataFrame) -> DataFrame:
    """Rows on which both are present."""
    return signal.join(forward, ["asset", "t"]).where(F.col("score").isNotNull() & F.col("fwd").isNotNull())


def average_rank(c: str) -> Column:
    return tied_rank(cross(), c)


def rank_ic(pairs: DataFrame, ties: str = "average", least: int = 10) -> DataFrame:
    """(t, ic, n): correlation of ranks for each date; 0 where a side does not vary, and no row below ``least`` pairs.

    ``ties``: "average" (Spearman) or "ordinal" (by asset).
    """
    if ties == "average":
        ranked = pairs.select("t", average_rank("score").alias("x"), average_rank("fwd").alias("y"))
    else:
        place = lambda c: F.row_number().over(cross().orderBy(c, "asset")).cast("double")
        ranked = pairs.select("t", place("score").alias("x"), place("fwd").alias("y"))
    return ranked.groupBy("t").agg(F.coalesce(guarded_corr(F.col("x"), F.col("y")), F.lit(0.0)).alias("ic"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def ic_summary(ic: DataFrame) -> DataFrame:
    """One row: mean, sample deviation, their ratio, share of positive dates, and number of dates."""
    m, s = F.avg("ic"), F.stddev_samp("ic")
    return ic.agg(m.alias("ic_mean"), s.alias("ic_std"), F.when(s > TINY, m / s).otherwise(0.0).alias("icir"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"), F.count(F.lit(1)).alias("n_dates"))


def group_returns(pairs: DataFrame, n_groups: int = 5, top_first: bool = False) -> DataFrame:
    """(group, ret): annual mean over dates of the equal-weight return of each score group.

    ``top_first`` False: groups by place over n - 1, 0 the lowest; dates with fewer rows than groups are left out.
    ``top_first`` True: groups by place over n, 0 the highest.
    """
    n = F.count(F.lit(1)).over(cross())
    place = F.row_number().over(cross().orderBy("score", "asset")) - 1
    if top_first:
        group = F.lit(n_groups - 1) - F.least(F.floor(place / n * n_groups), F.lit(n_groups - 1))
        rows = pairs.select("t", "fwd", group.cast("int").alias("group"))
    else:
        group = F.least(F.floor(place / F.greatest(n - 1, F.lit(1)) * n_groups), F.lit(n_groups - 1))
        rows = pairs.select("t", "fwd", group.cast("int").alias("group"), n.alias("n")).where(F.col("n") >= n_groups)
    return rows.groupBy("t", "group").agg(F.avg("fwd").alias("r")).groupBy("group").agg((F.avg("r") * YEAR).alias("ret"))


def monotonicity(groups: DataFrame) -> DataFrame:
    """One row: the share of neighbouring groups whose return rises, and top minus bottom. There are a handful of groups."""
    w = Window.orderBy("group")
    rises = groups.withColumn("rises", (F.col("ret") > F.lag("ret").over(w)).cast("double"))
    return rises.agg(F.coalesce(F.avg("rises"), F.lit(0.0)).alias("monotonicity"), (F.max_by("ret", "group") - F.min_by("ret", "group")).alias("spread"))


def half_life(ic: DataFrame) -> DataFrame:
    """One row: AR(1) coefficient of the demeaned IC series and its half-life (0 where the coefficient is outside (0, 1)).

    One value a date: the series is short, its window has one row for each date."""
    d = ic.crossJoin(F.broadcast(ic.agg(F.avg("ic").alias("m")))).select("t", (F.col("ic") - F.col("m")).alias("x"))
    d = d.withColumn("before", F.lag("x").over(Window.orderBy("t")))
    phi = F.try_divide(F.sum(F.col("x") * F.col("before")), F.sum(F.when(F.col("before").isNotNull(), F.col("before") * F.col("before"))))
    return d.agg(phi.alias("phi")).withColumn("half_life", F.when((F.col("phi") > 0) & (F.col("phi") < 1), F.log(F.lit(0.5)) / F.log("phi")).otherwise(0.0))


def pair_correlations(panel: DataFrame, value: str, least: int = 5) -> DataFrame:
    """(a, b, corr, n) for all pairs of a bounded universe of assets with at least ``least`` common dates."""
    x = panel.where(F.col(value).isNotNull()).select(F.col("asset").alias("a"), "t", F.col(value).alias("x"))
    y = panel.where(F.col(value).isNotNull()).select(F.col("asset").alias("b"), "t", F.col(value).alias("y"))
    return x.join(y, "t").where("a < b").groupBy("a", "b").agg(guarded_corr(F.col("x"), F.col("y")).alias("corr"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def conditional_ic(ic: DataFrame, market: DataFrame, window: int = 20) -> DataFrame:
    """(regime, ic, n): mean IC on days whose trailing volatility of the market return (t, r) is below or above its terciles."""
    past = Window.orderBy("t").rowsBetween(-(window - 1), 0)
    vol = market.select("t", F.stddev_pop("r").over(past).alias("vol"))
    cuts = vol.agg(F.percentile("vol", 1 / 3).alias("lo"), F.percentile("vol", 2 / 3).alias("hi"))
    regime = F.when(F.col("vol") <= F.col("lo"), "calm").when(F.col("vol") <= F.col("hi"), "normal").otherwise("stressed")
    return ic.join(vol, "t").crossJoin(F.broadcast(cuts)).groupBy(regime.alias("regime")).agg(F.avg("ic").alias("ic"), F.count(F.lit(1)).alias("n"))


def combine(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(asset, t, score): weighted mean of the factor columns that are present, from a wide frame."""
    present = lambda f: F.when(F.col(f).isNotNull(), F.lit(float(weights[f])))
    top = sum((F.coalesce(F.col(f) * weights[f], F.lit(0.0)) for f in weights), F.lit(0.0))
    bottom = sum((F.coalesce(present(f), F.lit(0.0)) for f in weights), F.lit(0.0))
    return scores.select("asset", "t", F.when(bottom != 0, top / bottom).alias("score"))


# Performance of one return series for each key.


def performance(returns: DataFrame, keys: tuple[str, ...] = ("asset",), periods: int = YEAR) -> DataFrame:
    """(keys, ann_return, ann_vol, sharpe, sortino, max_drawdown, calmar, hit_rate, n) from (keys, t, r)."""
    w = Window.partitionBy(*keys).orderBy("t")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    eq = returns.where(F.col("r").isNotNull()).withColumn("equity", F.product(1 + F.col("r")).over(so_far))
    eq = eq.withColumn("peak", F.greatest(F.max("equity").over(so_far), F.lit(1.0))).withColumn("dd", F.col("equity") / F.col("peak") - 1)
    mean, sd, n = F.avg("r"), F.stddev_samp("r"), F.count(F.lit(1))
    down = F.sqrt(F.avg(F.pow(F.least(F.col("r"), F.lit(0.0)), 2)))
    out = eq.groupBy(*keys).agg(
        (F.pow(F.max_by("equity", "t"), F.lit(float(periods)) / n) - 1).alias("ann_return"),
        (sd * math.sqrt(periods)).alias("ann_vol"),
        F.when(sd > TINY, mean / sd * math.sqrt(periods)).otherwise(0.0).alias("sharpe"),
        F.when(down > TINY, mean / down * math.sqrt(periods)).otherwise(0.0).alias("sortino"),
        F.min("dd").alias("max_drawdown"),
        F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"),
        n.alias("n"),
    )
    return out.withColumn("calmar", F.when(F.col("max_drawdown") < -TINY, F.col("ann_return") / -F.col("max_drawdown")).otherwise(0.0))


def moments(returns: DataFrame, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """(keys, n, mean, sd, skew, kurt): population moments; kurtosis is not in excess. 0 and 3 where nothing varies."""
    m = returns.where(F.col("r").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"))
    d = returns.where(F.col("r").isNotNull()).join(m, list(keys))
    z = (F.col("r") - F.col("mean")) / F.when(F.col("sd") > TINY, F.col("sd"))
    return d.groupBy(*keys, "n", "mean", "sd").agg(F.coalesce(F.avg(z * z * z), F.lit(0.0)).alias("skew"), F.coalesce(F.avg(z * z * z * z), F.lit(3.0)).alias("kurt"))


def tail_metrics(returns: DataFrame, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """(keys, var95, var99, cvar95, cvar99, worst, best): historical, as positive losses."""
    r = returns.where(F.col("r").isNotNull())
    cuts = r.groupBy(*keys).agg(F.percentile("r", 0.05).alias("p5"), F.percentile("r", 0.01).alias("p1"), F.min("r").alias("worst"), F.max("r").alias("best"))
    joined = r.join(cuts, list(keys))
    tail = joined.groupBy(*keys, "p5", "p1", "worst", "best").agg(F.avg(F.when(F.col("r") <= F.col("p5"), F.col("r"))).alias("t5"), F.avg(F.when(F.col("r") <= F.col("p1"), F.col("r"))).alias("t1"))
    return tail.select(*keys, (-F.col("p5")).alias("var95"), (-F.col("p1")).alias("var99"), (-F.col("t5")).alias("cvar95"), (-F.col("t1")).alias("cvar99"), "worst", "best")


def parametric_var(m: DataFrame, confidence: float = 0.95) -> DataFrame:
    """``m`` (of :func:`moments`) with normal and Cornish-Fisher value at risk, as positive losses."""
    z = NormalDist().inv_cdf(1 - confidence)
    s, k = F.col("skew"), F.col("kurt") - 3
    cf = F.lit(z) + (z**2 - 1) / 6 * s + (z**3 - 3 * z) / 24 * k - (2 * z**3 - 5 * z) / 36 * s * s
    return m.withColumns({"var_normal": -(F.col("mean") + z * F.col("sd")), "var_cornish_fisher": -(F.col("mean") + cf * F.col("sd"))})


def probabilistic_sharpe(sharpe: float, n: int, skew: float, kurt: float, benchmark: float = 0.0) -> float:
    """Probability that the true Sharpe ratio (per period) exceeds ``benchmark``."""
    spread = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2
    return NormalDist().cdf((sharpe - benchmark) * math.sqrt(max(n - 1, 1)) / math.sqrt(max(spread, 1e-12)))


def expected_best_sharpe(n_trials: int, variance: float) -> float:
    """Expected largest Sharpe ratio of ``n_trials`` strategies without skill."""
    if n_trials < 2:
        return 0.0
    g, ppf = 0.5772156649015329, NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - g) * ppf(1 - 1 / n_trials) + g * ppf(1 - 1 / (n_trials * math.e)))


def deflated_sharpe(sharpe: float, n: int, skew: float, kurt: float, n_trials: int, variance: float | None = None) -> float:
    """Probabilistic Sharpe ratio against the expected best of the trials; by default their variance is 1 / (n - 1)."""
    return probabilistic_sharpe(sharpe, n, skew, kurt, expected_best_sharpe(n_trials, 1 / max(n - 1, 1) if variance is None else variance))


def minimum_track_record(sharpe: float, skew: float, kurt: float, benchmark: float = 0.0, confidence: float = 0.95) -> float:
    """Observations needed for the probabilistic Sharpe ratio to reach ``confidence``."""
    if sharpe <= benchmark:
        return math.inf
    return 1 + (1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2) * (NormalDist().inv_cdf(confidence) / (sharpe - benchmark)) ** 2


def bootstrap_var(returns: DataFrame, n_sims: int = 1000, horizon: int = 5, confidence: float = 0.95, seed: int = 5) -> DataFrame:
    """One row (var, cvar) of compound returns over ``horizon`` periods drawn with replacement from (t, r).

    The draws are hashes of (simulation, step), so that reruns agree."""
    numbered = returns.where(F.col("r").isNotNull()).select("r", (F.row_number().over(Window.orderBy("t")) - 1).alias("i"))
    n = numbered.count()
    spark = returns.sparkSession
    draws = spark.range(n_sims).select(F.col("id").alias("sim"), F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("step"))
    draws = draws.withColumn("i", F.pmod(F.xxhash64("sim", "step", F.lit(seed)), F.lit(max(n, 1))).cast("int"))
    sims = draws.join(numbered, "i").groupBy("sim").agg((F.product(1 + F.col("r")) - 1).alias("r"), F.lit("all").alias("k"))
    cut = sims.agg(F.percentile("r", 1 - confidence).alias("p"))
    return sims.crossJoin(F.broadcast(cut)).agg((-F.first("p")).alias("var"), (-F.avg(F.when(F.col("r") <= F.col("p"), F.col("r")))).alias("cvar"))


def ewma_covariance(panel: DataFrame, value: str = "r", decay: float = 0.94) -> DataFrame:
    """(a, b, cov) for a <= b of a bounded universe: exponentially weighted, from dates on which both are present."""
    age = F.dense_rank().over(Window.orderBy(F.desc("t"))) - 1
    dates = panel.select("t").distinct().withColumn("w", F.pow(F.lit(decay), age))
    rows = panel.where(F.col(value).isNotNull()).join(F.broadcast(dates), "t")
    means = rows.groupBy("asset").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    d = rows.join(means, "asset").select("asset", "t", "w", (F.col(value) - F.col("m")).alias("d"))
    x, y = d.select(F.col("asset").alias("a"), "t", "w", F.col("d").alias("x")), d.select(F.col("asset").alias("b"), "t", F.col("d").alias("y"))
    return x.join(y, "t").where("a <= b").groupBy("a", "b").agg((F.sum(F.col("w") * F.col("x") * F.col("y")) / F.sum("w")).alias("cov"))


def brinson(holdings: DataFrame, min_coverage: float = 0.5) -> DataFrame:
    """One row (allocation, selection, coverage, n_groups) from (asset, industry, weight, r): the benchmark weighs assets equally.

    Empty where fewer than ``min_coverage`` of the assets have an industry."""
    n = holdings.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("industry").isNotNull() & (F.col("industry") != "Unknown")).cast("double")).alias("coverage"))
    g = holdings.groupBy(F.coalesce("industry", F.lit("Unknown")).alias("industry")).agg(
        F.count(F.lit(1)).alias("k"), F.avg("r").alias("rb"), F.sum("weight").alias("wp"), F.sum(F.col("weight") * F.col("r")).alias("wr")
    )
    g = g.crossJoin(F.broadcast(n)).withColumns({"wb": F.col("k") / F.col("n"), "rp": F.when(F.col("wp") > 1e-12, F.col("wr") / F.col("wp")).otherwise(F.col("rb"))})
    g = g.crossJoin(F.broadcast(g.agg(F.sum(F.col("wb") * F.col("rb")).alias("total"))))
    out = g.agg(
        F.sum((F.col("wp") - F.col("wb")) * (F.col("rb") - F.col("total"))).alias("allocation"),
        F.sum(F.col("wp") * (F.col("rp") - F.col("rb"))).alias("selection"),
        F.first("coverage").alias("coverage"),
        F.count(F.lit(1)).alias("n_groups"),
    )
    return out.where(F.col("coverage") >= min_coverage)


def quality_report(bars: DataFrame, jump: float = 0.3, low_volume: float = 10.0) -> DataFrame:
    """(asset, n, n_jumps, n_high_low, n_bad_price, n_duplicates, first_t, last_t): what a check of bars counts."""
    r = F.abs(F.try_divide(F.col("close"), F.lag("close").over(series())) - 1)
    d = bars.withColumns({"jump": r > jump, "copies": F.count(F.lit(1)).over(Window.partitionBy("asset", "t"))})
    as_count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return d.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"),
        as_count(F.col("jump")).alias("n_jumps"),
        as_count(F.col("high") < F.col("low")).alias("n_high_low"),
        as_count(F.col("close") <= 0).alias("n_bad_price"),
        as_count(F.col("copies") > 1).alias("n_duplicates"),
        as_count(F.col("volume") < low_volume).alias("n_thin"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
    )
