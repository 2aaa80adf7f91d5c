"""Back-tests: set-based where weights change on known dates only, an ordered fold per strategy where fills depend on the path."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlens.functions.columns import clip, guarded_corr


def numbered(panel: DataFrame) -> DataFrame:
    """``panel`` with ``idx`` from 0 by date; there is one row for each date in the table of dates."""
    dates = panel.select("t").distinct().withColumn("idx", F.row_number().over(Window.orderBy("t")) - 1)
    return panel.join(F.broadcast(dates), "t")


def rebalanced(panel: DataFrame, n_hold: int, every: int, cost_bps: float) -> DataFrame:
    """(t, gross, cost, net) from (asset, t, score, r): equal weights of the best by score on each ``every``-th date.

    Weights chosen at a date earn from the next date on, until the next choice's. Costs fall on the first day: bps of turnover.
    """
    p = numbered(panel)
    best = Window.partitionBy("idx").orderBy(F.desc("score"), "asset")
    chosen = p.where((F.col("idx") % every == 0) & F.col("score").isNotNull()).withColumn("k", F.row_number().over(best)).where(F.col("k") <= n_hold)
    period = F.floor((F.col("idx") - 1) / every).cast("int")
    held = chosen.select((F.col("idx") / every).cast("int").alias("period"), "asset", (1 / F.count(F.lit(1)).over(Window.partitionBy("idx"))).alias("w"))
    days = p.where("idx > 0").select("asset", "t", "idx", "r", period.alias("period"))
    gross = days.join(held, ["period", "asset"]).groupBy("period", "t", "idx").agg(F.sum(F.col("w") * F.coalesce("r", F.lit(0.0))).alias("gross"))
    before = held.select((F.col("period") + 1).alias("period"), "asset", F.col("w").alias("w0"))
    moved = held.join(before, ["period", "asset"], "full").groupBy("period").agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0)))).alias("moved"))
    cost = F.when(F.col("idx") == F.col("period") * every + 1, F.col("moved") * cost_bps / 1e4).otherwise(0.0)
    return gross.join(moved, "period").select("t", "gross", cost.alias("cost"), (F.col("gross") - cost).alias("net"))


def path_rows(panel: DataFrame, strategies: DataFrame) -> DataFrame:
    """What the fold of each strategy needs, (strategy, t, asset, r, pick): every date, the best ``n_hold`` of each rebalance date
    (pick), and returns of assets from the day after they were first chosen. Bounded by dates and choices, not by assets."""
    p = numbered(panel)
    grid = strategies.select("strategy", F.col("n_hold").cast("int").alias("n_hold"), F.col("every").cast("int").alias("every"))
    most = grid.agg(F.max("n_hold").alias("n")).first()["n"] or 0
    best = Window.partitionBy("strategy", "idx").orderBy(F.desc("score"), "asset")
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    open_ = p.where(finite).select("asset", "t", "idx", "score").crossJoin(F.broadcast(grid)).where("idx % every = 0")
    # The literal bound lets Spark drop rows before the shuffle.
    picks = open_.withColumn("k", F.row_number().over(best)).where(F.col("k") <= most).where("k <= n_hold").select("strategy", "t", "idx", "asset")
    since = picks.groupBy("strategy", "asset").agg(F.min("idx").alias("since"))
    held = p.select("asset", "t", "idx", "r").join(since, "asset").where("idx > since").select("strategy", "t", "asset", "r", F.lit(False).alias("pick"))
    none = F.lit(None)
    kinds = dict(held.dtypes)
    dates = p.select("t").distinct().crossJoin(F.broadcast(grid.select("strategy"))).select("strategy", "t", none.cast(kinds["asset"]).alias("asset"), none.cast(kinds["r"]).alias("r"), F.lit(False).alias("pick"))
    return held.unionByName(picks.select("strategy", "t", "asset", none.cast(kinds["r"]).alias("r"), F.lit(True).alias("pick"))).unionByName(dates)


def path_backtest(panel: DataFrame, strategies: DataFrame) -> DataFrame:
    """(strategy, t, equity, cash, blocked): the fold for each row of ``strategies`` (strategy, n_hold, every, cost_bps, limit).

    Buys of assets at their upper limit and sells of those at their lower limit are blocked, so weights depend on the path;
    weights drift with returns. One group for each strategy holds the assets that it ever chose; strategies run in parallel.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        cfg = rows.iloc[0]
        picks = rows[rows["pick"]]
        assets, dates = np.sort(picks["asset"].unique()), np.sort(rows["t"].unique())
        r = rows[rows["asset"].notna() & ~rows["pick"]].pivot(index="t", columns="asset", values="r").reindex(index=dates, columns=assets).to_numpy(dtype=float)
        chosen = {t: np.searchsorted(assets, own.to_numpy()) for t, own in picks.groupby("t")["asset"]}
        w, cash, equity, target, out = np.zeros(len(assets)), 1.0, 1.0, None, []
        for i, t in enumerate(dates):
            day = r[i]
            known = np.nan_to_num(day)
            blocked = 0
            grown = w * (1 + known)
            total = grown.sum() + cash
            equity *= total
            w, cash = grown / total, cash / total
            if target is not None:
                delta = target - w
                stop = ((delta > 0) & (day >= cfg["limit"])) | ((delta < 0) & (day <= -cfg["limit"])) | np.isnan(day)
                blocked = int((stop & (np.abs(delta) > 1e-12)).sum())
                delta[stop] = 0
                sells, buys = np.minimum(delta, 0), np.maximum(delta, 0)
                room = cash - sells.sum()
                if buys.sum() > room > 0:
                    buys *= room / buys.sum()
                traded = buys.sum() - sells.sum()
                w, cash = w + sells + buys, cash - sells.sum() - buys.sum()
                equity *= 1 - traded * cfg["cost_bps"] / 1e4
                target = None
            if i % int(cfg["every"]) == 0:
                target = np.zeros(len(w))
                if t in chosen:
                    target[chosen[t]] = 1 / len(chosen[t])
            out.append((cfg["strategy"], t, equity, cash, blocked))
        return pd.DataFrame(out, columns=["strategy", "t", "equity", "cash", "blocked"])

    rows = path_rows(panel, strategies).join(F.broadcast(strategies.select("strategy", "every", "cost_bps", "limit")), "strategy")
    return rows.groupBy("strategy").applyInPandas(fold, "strategy string, t date, equity double, cash double, blocked long")


def walk_forward(panel: DataFrame, train: int, test: int, step: int, n_hold: int) -> DataFrame:
    """(window, is_sharpe, oos_sharpe, n): the assets with the best mean score of a training window, held equally after it."""
    p = numbered(panel)
    last = p.agg(F.max("idx").alias("last")).first()["last"]
    windows = p.sparkSession.createDataFrame([(k, k * step) for k in range(max(0, ((last or 0) + 1 - train - test) // step + 1))], "window int, first int")
    inside = p.join(F.broadcast(windows), (F.col("idx") >= F.col("first")) & (F.col("idx") < F.col("first") + train + test))
    w = inside.withColumn("oos", F.col("idx") >= F.col("first") + train)
    ranked = w.where("not oos").groupBy("window", "asset").agg(F.avg("score").alias("s")).where("s is not null")
    best = ranked.withColumn("k", F.row_number().over(Window.partitionBy("window").orderBy(F.desc("s"), "asset"))).where(F.col("k") <= n_hold).select("window", "asset")
    daily = w.join(best, ["window", "asset"]).groupBy("window", "oos", "idx").agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("r"))
    sharpe = F.when(F.stddev_samp("r") > 1e-10, F.avg("r") / F.stddev_samp("r"))
    both = daily.groupBy("window", "oos").agg(sharpe.alias("sharpe"), F.count(F.lit(1)).alias("n"))
    return both.groupBy("window").agg(F.max(F.when(~F.col("oos"), F.col("sharpe"))).alias("is_sharpe"), F.max(F.when(F.col("oos"), F.col("sharpe"))).alias("oos_sharpe"), F.sum("n").alias("n"))


def block_edges(n: int, blocks: int) -> list[tuple[int, int]]:
    """Half-open ranges of nearly equal length; the first n % blocks are longer by one."""
    size, extra = divmod(n, blocks)
    starts = [k * size + min(k, extra) for k in range(blocks + 1)]
    return list(zip(starts, starts[1:], strict=False))


def combinatorial_paths(panel: DataFrame, blocks: int = 6, test_blocks: int = 2, purge: int = 1, n_hold: int = 10) -> DataFrame:
    """(combo, sharpe, n): for each choice of test blocks, assets chosen on what is left after purging, held on the test blocks."""
    p = numbered(panel)
    n = p.agg(F.max("idx").alias("m")).first()["m"]
    edges = block_edges((n or -1) + 1, blocks)
    combos = list(combinations(range(blocks), test_blocks))
    rows = [(c, i, any(edges[b][0] <= i < edges[b][1] for b in combo), any(edges[b][0] - purge <= i < edges[b][1] + purge for b in combo)) for c, combo in enumerate(combos) for i in range((n or -1) + 1)]
    masks = p.sparkSession.createDataFrame(rows, "combo int, idx int, test boolean, near boolean")  # combos times dates
    w = p.join(F.broadcast(masks), "idx")
    ranked = w.where("not near").groupBy("combo", "asset").agg(F.avg("score").alias("s")).where("s is not null")
    best = ranked.withColumn("k", F.row_number().over(Window.partitionBy("combo").orderBy(F.desc("s"), "asset"))).where(F.col("k") <= n_hold).select("combo", "asset")
    daily = w.where("test").join(best, ["combo", "asset"]).groupBy("combo", "idx").agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("r"))
    return daily.groupBy("combo").agg(F.when(F.stddev_samp("r") > 1e-10, F.avg("r") / F.stddev_samp("r")).alias("sharpe"), F.count(F.lit(1)).alias("n"))


def purged_splits(n: int, test: int, embargo: int, least_train: int, horizon: int) -> list[tuple[int, int, int]]:
    """(end of training, start and end of test): training ends ``horizon`` + ``embargo`` before its test."""
    return [(start - embargo - horizon, start, min(start + test, n)) for start in range(least_train + embargo + horizon, n, test)]


def long_short(panel: DataFrame, share: float = 0.2) -> DataFrame:
    """(t, r): mean return at or above the score's upper cut minus that at or below its lower one, by date."""
    x = panel.where("score is not null and fwd is not null")
    cuts = x.groupBy("t").agg(F.percentile("score", 1 - share).alias("hi"), F.percentile("score", share).alias("lo"))
    j = x.join(cuts, "t")
    return j.groupBy("t").agg((F.avg(F.when(F.col("score") >= F.col("hi"), F.col("fwd"))) - F.avg(F.when(F.col("score") <= F.col("lo"), F.col("fwd")))).alias("r"))


def rank_turnover(signal: DataFrame) -> DataFrame:
    """One row: mean absolute change of the score from an asset's bar to the next."""
    d = signal.withColumn("d", F.abs(F.col("score") - F.lag("score").over(Window.partitionBy("asset").orderBy("t"))))
    return d.agg(F.avg("d").alias("turnover"))


def redundancy(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: mean over dates of the two scores' cross-sectional correlation, and its absolute value."""
    j = a.join(b.withColumnRenamed("score", "other"), ["asset", "t"])
    c = j.groupBy("t").agg(guarded_corr(F.col("score"), F.col("other"), least=3).alias("c"))
    return c.agg(F.avg("c").alias("mean"), F.abs(F.avg("c")).alias("strength"))


def stressed(returns: DataFrame, scenarios: list[tuple[str, float, float, int]]) -> DataFrame:
    """(scenario, pnl, worst): (t, r) under (name, shock, volatility multiple, days): the first days are the shock spread over
    them plus the scaled deviation from the mean; a day loses at most 95 % and gains at most 100 %."""
    spark = returns.sparkSession
    table = spark.createDataFrame(scenarios, "scenario string, shock double, multiple double, days int")
    k = F.row_number().over(Window.orderBy("t"))
    r = returns.where("r is not null").select("t", "r", k.alias("k"))
    m = r.agg(F.avg("r").alias("m"))
    d = r.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(table)).where("k <= days")
    x = d.withColumn("x", clip(F.col("shock") / F.col("days") + (F.col("r") - F.col("m")) * F.col("multiple"), -0.95, 1.0))
    return x.groupBy("scenario").agg((F.product(1 + F.col("x")) - 1).alias("pnl"), F.min("x").alias("worst"))


def windows_report(returns: DataFrame, windows: list[tuple[str, str, str]]) -> DataFrame:
    """(window, ret, n): compound return of (t, r) in each named closed interval that holds any date."""
    table = returns.sparkSession.createDataFrame(windows, "window string, a string, b string").select("window", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    j = returns.where("r is not null").join(F.broadcast(table), F.col("t").between(F.col("a"), F.col("b")))
    return j.groupBy("window").agg((F.product(1 + F.col("r")) - 1).alias("ret"), F.count(F.lit(1)).alias("n"))


def dealt_assets(assets: DataFrame, n: int, each: int = 500) -> DataFrame:
    """``n`` assets (asset) in partitions of some ``each``, by asset: days that are made from them there need no shuffle of their own. The number is
    given, as one that goes by the size of the assets alone would leave all days to a task or two."""
    least = int(assets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return assets.repartition(max(-(-n // each), min(least, max(n, 1))), "asset")


def synthetic_bars(spark: SparkSession, n_assets: int, n_days: int, seed: int = 1) -> DataFrame:
    """Bars of random walks on numbered assets and days."""
    assets = dealt_assets(spark.range(n_assets).select(F.col("id").alias("asset")), n_assets)
    days = assets.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(n_days - 1))))
    return synthetic_walks(days.withColumn("t", F.date_add(F.lit("2020-01-01").cast("date"), F.col("day"))), seed)


def synthetic_walks(days: DataFrame, seed: int = 1) -> DataFrame:
    """Bars of a random walk from hashes of (asset, day) of ``days`` (asset, day, t), the same on every run and cluster. Days that lie by asset are not shuffled."""
    u = lambda k: (F.pmod(F.xxhash64("asset", "day", F.lit(seed), F.lit(k)), F.lit(1_000_003)) + 1) / 1_000_005.0
    z = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2))
    d = days.select("asset", "t", (0.0004 + 0.02 * z).alias("r"), u(3).alias("v"))
    walk = d.withColumn("close", 10 * F.exp(F.sum("r").over(Window.partitionBy("asset").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))))
    return walk.select("asset", "t", (F.col("close") / (1 + F.col("r") / 2)).alias("open"), (F.col("close") * 1.01).alias("high"), (F.col("close") * 0.99).alias("low"), "close", (1e6 * F.col("v")).alias("volume"), F.col("close").alias("vwap"), (F.col("close") * 1e6 * F.col("v")).alias("amount"))
