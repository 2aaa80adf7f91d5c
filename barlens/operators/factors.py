"""Factor libraries over bars (asset, t, open ... amount) as staged windows.

Every function adds columns. Trailing statistics are null until the asset has a full window; what divides by zero is null.
A factor that ranks a rolling value first fixes it to a grid of 1e-6, so that ties do not hang on a last bit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.columns import guarded_corr, quantised
from barlens.operators.expression import cross, cross_zscore, series, tied_rank, trailing, when_full


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def change(c: Column, n: int = 1) -> Column:
    """c / c n bars ago - 1."""
    return ratio(c, F.lag(c, n).over(series())) - 1


def mean(c: Column, w: int) -> Column:
    return when_full(F.avg(c).over(trailing(w)), w)


def total(c: Column, w: int) -> Column:
    return when_full(F.sum(c).over(trailing(w)), w)


def percent_rank(c: Column) -> Column:
    """Cross-sectional rank over count, ties by average; null stays null."""
    return F.when(c.isNotNull(), tied_rank(cross(), c.asc_nulls_last()) / F.count(c).over(cross()))


def last_rank(c: Column, w: int) -> Column:
    """Share of the window's values that are at most the last."""
    values = F.collect_list(c).over(trailing(w))
    return when_full(F.size(F.filter(values, lambda x: x <= c)) / F.size(values), w)


def with_emas(df: DataFrame, value: str, spans: dict[str, float]) -> DataFrame:
    """Adds exponential means of all bars so far, with weights adjusted to the bars there are; a null value is no bar.

    An asset's bars are summed in blocks with weights that grow by bar and are taken back at each row. A block of a span is so long that its first weight
    is e^-37 of its last, below the last bit of a double: then no weight overflows, and a bar needs its own block and the end of the one before it."""
    so_far = series().rowsBetween(Window.unboundedPreceding, 0)
    before = series().rowsBetween(Window.unboundedPreceding, -1)
    bar = "__ema_bar"
    df = df.withColumn(bar, F.count(value).over(so_far) - 1)
    helpers, out = [bar], {}
    for j, (n, span) in enumerate(spans.items()):
        keep = 1 - 2 / (span + 1)
        length = max(1, math.ceil(37 / -math.log(keep))) if keep > 0 else 1
        block, local, old = (f"__ema_{x}_{j}" for x in ("block", "sum", "old"))
        helpers += [block, local, old]
        place = F.pmod(F.col(bar), F.lit(length))
        power = lambda k, keep=keep: F.pow(F.lit(float(keep)), k) if keep > 0 else (k == 0).cast("double")
        df = df.withColumn(block, F.floor(F.col(bar) / length))
        within = Window.partitionBy("asset", block).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(local, F.sum(F.col(value) * power(-place)).over(within) * power(place))
        ended = F.col(value).isNotNull() & (place == length - 1)
        df = df.withColumn(old, F.coalesce(F.last(F.when(ended, F.col(local)), ignorenulls=True).over(before), F.lit(0.0)))
        bars = place + F.when(F.col(block) > 0, F.lit(length)).otherwise(0) + 1
        # A row without a value has the mean of the last bar.
        out[n] = F.last(F.when(F.col(value).isNotNull(), (F.col(local) + F.col(old) * power(place + 1)) * (1 - keep) / (1 - power(bars))), ignorenulls=True).over(so_far)
    return df.withColumns(out).drop(*helpers)


def library_factors(bars: DataFrame, shares: Column | None = None) -> DataFrame:
    """(asset, t, momentum ... alpha10): the twenty-one library factors."""
    o, c, v, low = F.col("open"), F.col("close"), F.col("volume"), F.col("low")
    d = F.col("d1")
    df = with_emas(bars, "close", {"ema12": 12, "ema26": 26})
    df = df.withColumns({"r": change(c), "d1": c - F.lag(c).over(series()), "d2lnv": F.log(v) - F.log(F.lag(v, 2).over(series())), "body": ratio(c - o, o), "rank_low": percent_rank(low), "shares": F.lit(9973.0) if shares is None else shares})
    r = F.col("r")
    df = df.withColumns(
        {
            "ma20": mean(c, 20),
            "sd20": when_full(F.stddev_samp(c).over(trailing(20)), 20),
            "up14": mean(F.greatest(d, F.lit(0.0)), 14),
            "dn14": mean(F.greatest(-d, F.lit(0.0)), 14),
            "rsd20": when_full(F.stddev_samp("r").over(trailing(20)), 20),
            "c6": quantised(when_full(guarded_corr(F.col("d2lnv"), F.col("body"), trailing(6)), 6), 1e6),
            "c10": quantised(when_full(guarded_corr(o, v, trailing(10)), 10), 1e6),
            "rank_low9": last_rank(F.col("rank_low"), 9),
            "adv20": mean(v, 20),
            "d7": c - F.lag(c, 7).over(series()),
            "so_sr": quantised(total(o, 5) * total(r, 5), 1e6),
            "lo5": when_full(F.min("d1").over(trailing(5)), 6),
            "hi5": when_full(F.max("d1").over(trailing(5)), 6),
            "lo4": when_full(F.min("d1").over(trailing(4)), 5),
            "hi4": when_full(F.max("d1").over(trailing(4)), 5),
        }
    )
    df = df.withColumns(
        {
            "signed": F.pow(F.when(r < 0, F.col("rsd20")).otherwise(c), 2),
            "abs_d7_rank": last_rank(F.abs(F.col("d7")), 20),
            "so_sr_lag": F.lag("so_sr", 10).over(series()),
        }
    )
    window = F.collect_list(F.coalesce("signed", F.lit(0.0))).over(trailing(5))
    df = df.withColumn("argmax5", when_full(F.array_position(window, F.array_max(window)).cast("double"), 5))
    same_sign = lambda lo, hi: F.when(F.col(lo) > 0, d).when(F.col(hi) < 0, d).otherwise(F.when(F.col(lo).isNotNull(), -d))
    return df.select(
        "asset",
        "t",
        change(c, 20).alias("momentum"),
        ratio(c - F.col("ma20"), F.col("sd20")).alias("mean_reversion"),
        F.when(F.col("dn14") == 0, 100.0).otherwise(100 - 100 / (1 + ratio(F.col("up14"), F.col("dn14")))).alias("rsi"),
        (F.col("ema12") - F.col("ema26")).alias("macd"),
        ratio(c - F.col("ma20"), 4 * F.col("sd20")).alias("bollinger"),
        ratio(total(v * r, 20), total(v, 20)).alias("vwm"),
        change(v, 10).alias("vol_roc"),
        F.sum(F.coalesce(F.signum("d1"), F.lit(0.0)) * v).over(series().rowsBetween(Window.unboundedPreceding, 0)).alias("obv"),
        ratio(c - F.col("vwap"), F.col("vwap")).alias("vwap_dev"),
        mean(ratio(F.abs(r), v), 20).alias("illiquidity"),
        mean(ratio(v, F.col("shares")), 20).alias("turnover"),
        (percent_rank(F.col("argmax5")) - 0.5).alias("alpha1"),
        (-percent_rank(F.col("c6"))).alias("alpha2"),
        (-percent_rank(F.col("c10"))).alias("alpha3"),
        (-F.col("rank_low9")).alias("alpha4"),
        ((percent_rank(o) - percent_rank(c)) * percent_rank(v)).alias("alpha5"),
        (-F.col("c10")).alias("alpha6"),
        F.when(F.col("adv20") < v, -F.col("abs_d7_rank") * F.signum("d7")).otherwise(-1.0).alias("alpha7"),
        (-percent_rank(quantised(F.col("so_sr") - F.col("so_sr_lag"), 1e6))).alias("alpha8"),
        same_sign("lo5", "hi5").alias("alpha9"),
        percent_rank(same_sign("lo4", "hi4")).alias("alpha10"),
    )


LIBRARY_CATEGORIES = {
    "momentum": ("momentum", "rsi", "macd", "vwm"),
    "mean_reversion": ("mean_reversion", "bollinger", "vwap_dev"),
    "volume": ("vol_roc", "obv", "illiquidity", "turnover"),
    "alpha": tuple(f"alpha{i}" for i in range(1, 11)),
}


def library_by_category(bars: DataFrame, categories: tuple[str, ...] | None = None) -> DataFrame:
    """The library factors of some categories (all by default); columns that are not asked for are pruned from the plan."""
    wanted = [f for c in (categories or tuple(LIBRARY_CATEGORIES)) for f in LIBRARY_CATEGORIES[c]]
    return library_factors(bars).select("asset", "t", *wanted)


def family_factors(bars: DataFrame) -> DataFrame:
    """(asset, t, KMID ... VSTD10): the six families of bar, trend, volatility, price-volume, RSI and volume factors."""
    o, h, low, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    span = h - low + 1e-12
    df = bars.withColumns({"r": change(c), "d": c - F.lag(c).over(series()), "vc": change(v)})
    up, down = F.coalesce(F.greatest(F.col("d"), F.lit(0.0)), F.lit(0.0)), F.coalesce(F.greatest(-F.col("d"), F.lit(0.0)), F.lit(0.0))
    columns = {
        "KMID": ratio(c - o, o),
        "KLEN": ratio(h - low, o),
        "KMID2": (c - o) / span,
        "KUP": (h - F.greatest(o, c)) / span,
        "KLOW": (F.least(o, c) - low) / span,
        **{f"ROC{n}": change(c, n) for n in (5, 10, 20)},
        **{f"MA{n}": ratio(c, mean(c, n)) - 1 for n in (5, 10, 20)},
        "RSV20": (c - when_full(F.min(low).over(trailing(20)), 20)) / (F.max(h).over(trailing(20)) - F.min(low).over(trailing(20)) + 1e-12),
        **{f"STD{n}": when_full(F.stddev_pop("r").over(trailing(n)), n) for n in (5, 10, 20)},
        "ATR10": ratio(mean(h - low, 10), mean(c, 10)),
        "CORR_CR": when_full(guarded_corr(c, F.col("vc"), trailing(10), 5), 10),
        "CORD": when_full(guarded_corr(F.col("r"), F.col("vc"), trailing(10), 5), 10),
        **{f"RSI{n}": mean(up, n) / (mean(up, n) + mean(down, n) + 1e-12) for n in (5, 14)},
        **{f"VMA{n}": v / (mean(v, n) + 1e-12) - 1 for n in (5, 10)},
        **{f"VSTD{n}": when_full(F.stddev_pop(v).over(trailing(n)), n) / (mean(v, n) + 1e-12) for n in (5, 10)},
    }
    return df.select("asset", "t", *[x.alias(n) for n, x in columns.items()])


def model_features(bars: DataFrame) -> DataFrame:
    """(asset, t, mom20, mom5, vol20, vol_ratio, range): z-scored within each date, null as 0."""
    c = F.col("close")
    df = bars.withColumn("r", change(c))
    vol5, vol20 = (when_full(F.stddev_pop("r").over(trailing(n)), n + 1) for n in (5, 20))
    df = df.withColumns({"mom20": change(c, 20), "mom5": change(c, 5), "vol20": vol20, "vol_ratio": ratio(vol5, vol20), "range": ratio(F.col("high") - F.col("low"), c)})
    names = ("mom20", "mom5", "vol20", "vol_ratio", "range")
    return df.select("asset", "t", *[F.coalesce(cross_zscore(F.col(n)), F.lit(0.0)).alias(n) for n in names])


def volatility(bars: DataFrame) -> DataFrame:
    """(asset, t, daily_vol, realised_vol, causal_z): rolling deviation of returns, its annual size, and an expanding z-score."""
    df = bars.withColumn("r", change(F.col("close")))
    sd = when_full(F.stddev_samp("r").over(trailing(20)), 21)
    past = series().rowsBetween(-60, 0)
    m, s = F.avg("close").over(past), F.stddev_pop("close").over(past)
    return df.select("asset", "t", sd.alias("daily_vol"), (when_full(F.stddev_pop("r").over(trailing(12)), 13) * F.sqrt(F.lit(252.0))).alias("realised_vol"), F.when(s > 1e-10, (F.col("close") - m) / s).otherwise(0.0).alias("causal_z"))
