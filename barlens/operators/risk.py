"""Factor risk model, risk overlay, regimes, and models of returns: sums in Spark, small solves on the driver."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.operators.factors import change, with_emas

STYLES = ("momentum", "volatility", "size", "liquidity")


def style_exposures(bars: DataFrame) -> DataFrame:
    """(asset, momentum, volatility, size, liquidity): at each asset's last bar, z-scored over assets, null as 0."""
    d = bars.withColumns({"r": change(F.col("close")), "mom": change(F.col("close"), 20), "n": F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("t")))})
    x = d.groupBy("asset").agg(
        F.max(F.when(F.col("n") == 1, F.col("mom"))).alias("momentum"),
        F.stddev_pop(F.when(F.col("n") <= 20, F.col("r"))).alias("volatility"),
        F.log1p(F.max(F.when(F.col("n") == 1, F.col("amount")))).alias("size"),
        F.log1p(F.avg(F.when(F.col("n") <= 20, F.col("volume")))).alias("liquidity"),
    )
    s = x.agg(*[f(c).alias(f"{k}_{c}") for c in STYLES for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: F.coalesce(F.when(F.col(f"s_{c}") > 1e-10, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")), F.lit(0.0)).alias(c)
    return x.crossJoin(F.broadcast(s)).select("asset", *map(z, STYLES))


def factor_returns(returns: DataFrame, exposures: DataFrame, factors: tuple[str, ...]) -> DataFrame:
    """(t, factor, ret): each date's least-squares returns to the exposures and an intercept ("market").

    Spark sums the cross products by date; the K by K systems are solved in batches, so no date needs its assets together."""
    names = ("market", *factors)
    x = exposures.withColumn("market", F.lit(1.0))
    j = returns.where("r is not null").join(x, "asset")
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"x{i}_{k}") for i, a in enumerate(names) for k, b in enumerate(names) if i <= k] + [F.sum(F.col(a) * F.col("r")).alias(f"y{i}") for i, a in enumerate(names)]
    by_date = j.groupBy("t").agg(*sums)

    def solve(batches):
        for b in batches:
            out = []
            for _, row in b.iterrows():
                a = np.array([[row[f"x{min(i, k)}_{max(i, k)}"] for k in range(len(names))] for i in range(len(names))])
                y = np.array([row[f"y{i}"] for i in range(len(names))])
                out += [(row["t"], n, float(v)) for n, v in zip(names, np.linalg.lstsq(a, y, rcond=None)[0], strict=True)]
            yield pd.DataFrame(out, columns=["t", "factor", "ret"])

    return by_date.mapInPandas(solve, f"t {by_date.schema['t'].dataType.simpleString()}, factor string, ret double")


def newey_west(factor_series: DataFrame, lags: int = 2) -> DataFrame:
    """(a, b, cov): covariance of factor returns with Bartlett-weighted lags."""
    k = F.row_number().over(Window.partitionBy("factor").orderBy("t"))
    d = factor_series.withColumns({"k": k, "d": F.col("ret") - F.avg("ret").over(Window.partitionBy("factor"))})
    n = d.select("t").distinct().count()
    a = d.select(F.col("factor").alias("a"), F.col("k").alias("ka"), F.col("d").alias("x"))
    b = d.select(F.col("factor").alias("b"), F.col("k").alias("kb"), F.col("d").alias("y"))
    gap = F.abs(F.col("ka") - F.col("kb"))
    return a.join(b, gap <= lags).groupBy("a", "b").agg((F.sum((1 - gap / (lags + 1)) * F.col("x") * F.col("y")) / max(n, 1)).alias("cov"))


def tracking_error(active: DataFrame, periods: int = 252) -> DataFrame:
    """One row from (t, r, benchmark): annual deviation of the active return."""
    return active.agg((F.stddev_pop(F.col("r") - F.col("benchmark")) * math.sqrt(periods)).alias("tracking_error"))


def portfolio_var(weights: DataFrame, returns: DataFrame, confidence: float = 0.95) -> DataFrame:
    """One row (var, cvar) of the held returns (asset, weight) x (asset, t, r)."""
    p = returns.where("r is not null").join(weights, "asset").groupBy("t").agg(F.sum(F.col("weight") * F.col("r")).alias("r"))
    cut = p.agg(F.percentile("r", 1 - confidence).alias("p"))
    return p.crossJoin(F.broadcast(cut)).agg((-F.max("p")).alias("var"), (-F.avg(F.when(F.col("r") <= F.col("p"), F.col("r")))).alias("cvar"))


def overlay(state: DataFrame, max_vol: float = 0.35, max_drawdown: float = 0.2, max_cvar: float = 0.06) -> DataFrame:
    """``state`` (vol, drawdown, cvar) with ``multiplier`` and ``halt``: size falls with each breached gate, a doubled one halts."""
    breaches = [F.col("vol") / max_vol, -F.col("drawdown") / max_drawdown, F.col("cvar") / max_cvar]
    size = F.lit(1.0)
    for b in breaches:
        size = size * F.when(b > 1, F.greatest(F.lit(0.25), 1 / b)).otherwise(1.0)
    halt = breaches[0] > 2
    for b in breaches[1:]:
        halt = halt | (b > 2)
    return state.withColumns({"halt": halt, "multiplier": F.when(halt, 0.0).otherwise(size)})


def rule_regimes(trend: Column, vol: Column, vol_median: Column) -> dict[str, Column]:
    """Probabilities of bull, bear, range and stress from trend and relative volatility, which sum to one."""
    ratio = F.when(vol_median > 0, vol / vol_median).otherwise(1.0)
    raw = {"bull": F.greatest(trend * 10, F.lit(0.0)), "bear": F.greatest(-trend * 10, F.lit(0.0)), "range": F.greatest(1 - F.abs(trend) * 10, F.lit(0.1)), "stress": F.greatest(ratio - 1.2, F.lit(0.0))}
    total = sum(raw.values(), F.lit(0.0))
    return {k: v / total for k, v in raw.items()}


def hidden_markov(rows: pd.DataFrame, states: int = 3, rounds: int = 60) -> pd.DataFrame:
    """(t, state, p): a Gaussian chain fitted to one series (t, r) by expectation-maximisation; states by rising deviation."""
    x = rows.sort_values("t")["r"].to_numpy(dtype=float)
    n = len(x)
    mu, sd = np.quantile(x, (np.arange(states) + 0.5) / states), np.full(states, x.std() + 1e-6)
    move, start = np.full((states, states), 0.1 / max(states - 1, 1)), np.full(states, 1 / states)
    np.fill_diagonal(move, 0.9)
    for _ in range(rounds):
        like = np.exp(-0.5 * ((x[:, None] - mu) / sd) ** 2) / sd + 1e-300
        alpha, scale = np.zeros((n, states)), np.zeros(n)
        for t in range(n):
            alpha[t] = (start if t == 0 else alpha[t - 1] @ move) * like[t]
            scale[t] = alpha[t].sum()
            alpha[t] /= scale[t]
        beta = np.ones((n, states))
        for t in range(n - 2, -1, -1):
            beta[t] = move @ (like[t + 1] * beta[t + 1]) / scale[t + 1]
        g = alpha * beta
        g /= g.sum(axis=1, keepdims=True)
        pair = sum(np.outer(alpha[t], like[t + 1] * beta[t + 1]) * move / scale[t + 1] for t in range(n - 1)) if n > 1 else move
        start, move = g[0], pair / pair.sum(axis=1, keepdims=True)
        mass = g.sum(axis=0) + 1e-12
        mu = g.T @ x / mass
        sd = np.sqrt((g * (x[:, None] - mu) ** 2).sum(axis=0) / mass) + 1e-6
    rank = np.argsort(np.argsort(sd))
    return pd.DataFrame({"t": rows.sort_values("t")["t"].to_numpy(), "state": rank[g.argmax(axis=1)], "p": g.max(axis=1)})


def markov_regimes(returns: DataFrame, key: str) -> DataFrame:
    """(key, t, state, p) of each key's series (key, t, r), one task for each key."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = hidden_markov(rows[["t", "r"]])
        out.insert(0, key, rows[key].iloc[0])
        return out

    kind = returns.schema[key].dataType.simpleString()
    return returns.where("r is not null").groupBy(key).applyInPandas(run, f"{key} {kind}, t date, state long, p double")


# Models.


def training_rows(features: DataFrame, forward: DataFrame, names: tuple[str, ...], embargo: int, train_share: float) -> DataFrame:
    """(asset, t, idx, train, test, features, fwd): training ends ``embargo`` dates before the test begins."""
    dates = features.select("t").distinct().withColumn("idx", F.row_number().over(Window.orderBy("t")) - 1)
    last = dates.agg((F.floor(F.max("idx") * train_share)).alias("cut"))
    j = features.join(forward, ["asset", "t"]).join(F.broadcast(dates), "t").crossJoin(F.broadcast(last))
    ok = F.col("fwd").isNotNull()
    for c in names:
        ok = ok & F.col(c).isNotNull()
    return j.where(ok).select("asset", "t", "idx", (F.col("idx") < F.col("cut") - embargo).alias("train"), (F.col("idx") >= F.col("cut")).alias("test"), *names, "fwd")


def ridge(rows: DataFrame, names: tuple[str, ...], label: str = "fwd", penalty: float = 1.0) -> dict[str, float]:
    """Coefficients from the sums of products (closed form), with the intercept, not penalised, as ""."""
    cols = [F.lit(1.0), *[F.col(c) for c in names]]
    sums = rows.agg(*[F.sum(a * b).alias(f"x{i}_{k}") for i, a in enumerate(cols) for k, b in enumerate(cols)], *[F.sum(a * F.col(label)).alias(f"y{i}") for i, a in enumerate(cols)]).first()
    k = len(cols)
    a = np.array([[sums[f"x{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)]) + penalty * np.diag([0.0] + [1.0] * (k - 1))
    y = np.array([sums[f"y{i}"] or 0.0 for i in range(k)])
    w = np.linalg.lstsq(a, y, rcond=None)[0]
    return dict(zip(("", *names), map(float, w), strict=True))


def linear_score(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    return rows.withColumn("score", sum((F.col(c) * w for c, w in weights.items() if c), F.lit(weights[""])))


def in_order(rows: DataFrame, names: tuple[str, ...], n: int, each: int = 200_000) -> DataFrame:
    """``n`` rows of (asset, t) in partitions and an order that follow from the rows alone, features to ten digits: what a fit that draws rows needs to be repeatable."""
    rounded = rows.withColumns({c: F.round(c, 10) for c in names})
    return rounded.repartition(max(1, -(-n // each)), "t", "asset").sortWithinPartitions("t", "asset")


def tree_scores(rows: DataFrame, names: tuple[str, ...], model: str = "forest", seed: int = 3) -> DataFrame:
    """Test rows with the score of a forest or of boosted trees fitted on the training rows, the same in any order and partitioning of ``rows``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    v = VectorAssembler(inputCols=list(names), outputCol="__x")
    train = rows.where("train")
    make = RandomForestRegressor(featuresCol="__x", labelCol="fwd", predictionCol="score", numTrees=20, maxDepth=4, seed=seed) if model == "forest" else GBTRegressor(featuresCol="__x", labelCol="fwd", predictionCol="score", maxIter=10, maxDepth=3, seed=seed)
    return make.fit(v.transform(in_order(train, names, train.count()))).transform(v.transform(rows.where("test"))).drop("__x")


def expert_weights(ic_by_factor: DataFrame, half_life: float = 6, sharpness: float = 20.0) -> DataFrame:
    """(t, factor, weight): softmax over factors of the exponentially weighted mean of all of each factor's ICs before t."""
    span = 2 / (1 - 0.5 ** (1 / half_life)) - 1
    d = with_emas(ic_by_factor.withColumnRenamed("factor", "asset"), "ic", {"m": span})
    before = F.last("m", ignorenulls=True).over(Window.partitionBy("asset").orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("e", F.exp(F.coalesce(before, F.lit(0.0)) * sharpness))
    return d.select("t", F.col("asset").alias("factor"), (F.col("e") / F.sum("e").over(Window.partitionBy("t"))).alias("weight"))


def greedy_pool(ics: dict[str, float], correlations: dict[tuple[str, str], float], most: int, limit: float) -> list[str]:
    """Factors by falling |IC| that correlate with no chosen one above ``limit``; from small tables on the driver."""
    chosen: list[str] = []
    for f in sorted(ics, key=lambda k: (-abs(ics[k]), k)):
        if len(chosen) < most and all(abs(correlations.get((min(f, g), max(f, g)), 0.0)) <= limit for g in chosen):
            chosen.append(f)
    return chosen


def causal_market(bars: DataFrame) -> DataFrame:
    """(t, r, trend, vol): equal-weight market return with trailing trend and volatility."""
    m = bars.withColumn("r", change(F.col("close"))).groupBy("t").agg(F.avg("r").alias("r"))
    w = Window.orderBy("t").rowsBetween(-11, 0)
    return m.select("t", "r", F.avg("r").over(w).alias("trend"), F.stddev_pop("r").over(w).alias("vol"))


