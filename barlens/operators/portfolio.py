"""Weights: set-based schemes on Spark, and small dense optimisers on covariance blocks of a bounded number of assets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def score_weights(scores: DataFrame, key: str = "t") -> DataFrame:
    """(t, asset, weight): positive scores in proportion; equal where none is positive."""
    w = Window.partitionBy(key)
    s = F.greatest(F.col("score"), F.lit(0.0))
    total = F.sum(s).over(w)
    return scores.where("score is not null").select(key, "asset", F.when(total > 0, s / total).otherwise(1 / F.count(F.lit(1)).over(w)).alias("weight"))


def inverse_volatility(vols: DataFrame, floor: float = 0.01) -> DataFrame:
    """(asset, weight) from (asset, vol): missing volatility is the median's, none is below ``floor``."""
    m = vols.agg(F.percentile("vol", 0.5).alias("m"))
    inv = 1 / F.greatest(F.coalesce("vol", "m"), F.lit(floor))
    d = vols.crossJoin(F.broadcast(m)).select("asset", inv.alias("inv"))
    return d.crossJoin(F.broadcast(d.agg(F.sum("inv").alias("s")))).select("asset", (F.col("inv") / F.col("s")).alias("weight"))


def neutral_by_group(weights: DataFrame, group: str, cap: float) -> DataFrame:
    """(asset, group, weight): equal total for each group, within it in proportion, at most ``cap``, scaled to one."""
    in_group, every = Window.partitionBy(group), Window.partitionBy(F.lit(1))
    k = weights.agg(F.count_distinct(group).alias("k"))
    d = weights.crossJoin(F.broadcast(k)).withColumn("raw", F.least(F.try_divide(F.col("weight"), F.sum("weight").over(in_group)) / F.col("k"), F.lit(cap)))
    total = d.agg(F.sum("raw").alias("s"))
    return d.crossJoin(F.broadcast(total)).select("asset", group, (F.col("raw") / F.col("s")).alias("weight"))


def cap_groups(weights: DataFrame, group: str, most: float) -> DataFrame:
    """(asset, group, weight): groups above ``most`` are scaled down to it; what is freed stays cash."""
    total = F.sum("weight").over(Window.partitionBy(group))
    return weights.select("asset", group, (F.col("weight") * F.least(F.lit(1.0), most / total)).alias("weight"))


def neutral_to(weights: DataFrame, exposure: str, target: float = 0.0) -> DataFrame:
    """``weight`` moved along the exposure until its total is ``target``."""
    s = weights.agg(F.sum(F.col("weight") * F.col(exposure)).alias("wb"), F.sum(F.col(exposure) * F.col(exposure)).alias("bb"))
    return weights.crossJoin(F.broadcast(s)).select("asset", (F.col("weight") - F.try_divide(F.col("wb") - target, F.col("bb")) * F.col(exposure)).alias("weight"))


def routed(weights_by_regime: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """(asset, weight): sum over regimes of probability times the regime's weight."""
    p = F.create_map(*[F.lit(x) for kv in probabilities.items() for x in kv])
    return weights_by_regime.groupBy("asset").agg(F.sum(F.coalesce(F.try_element_at(p, F.col("regime")), F.lit(0.0)) * F.col("weight")).alias("weight"))


def concentration(weights: DataFrame, key: str) -> DataFrame:
    """(key, effective_n, largest, gross)."""
    return weights.groupBy(key).agg((1 / F.sum(F.col("weight") * F.col("weight"))).alias("effective_n"), F.max("weight").alias("largest"), F.sum(F.abs("weight")).alias("gross"))


def turnover(weights: DataFrame) -> DataFrame:
    """(t, turnover): half the sum of absolute changes from the date before, by a full outer join on shifted dates."""
    dates = weights.select("t").distinct().withColumn("k", F.row_number().over(Window.orderBy("t")))
    w = weights.join(F.broadcast(dates), "t").select("k", "asset", "weight")
    before = w.select((F.col("k") + 1).alias("k"), "asset", F.col("weight").alias("before"))
    j = w.join(before, ["k", "asset"], "full").groupBy("k").agg((F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))) / 2).alias("turnover"))
    return j.join(F.broadcast(dates), "k").select("t", "turnover")


# Dense blocks.


#: Assets of a dense block at most; :mod:`barlens.operators.structured` has no such limit.
DENSE_ASSETS = 2000


def matrix_of(covariance: DataFrame, most: int = DENSE_ASSETS) -> tuple[list, np.ndarray]:
    """Assets and the dense matrix of (a, b, cov), a <= b; raises above ``most`` assets, as it is held by the driver."""
    n = covariance.select("a").union(covariance.select("b")).distinct().count()
    if n > most:
        raise ValueError(f"{n} assets; a dense block holds at most {most}")
    rows = covariance.collect()
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    at = {a: i for i, a in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["cov"] or 0.0
    return names, m


def nearest_psd(m: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return (vectors * np.maximum(values, floor)) @ vectors.T


def onto_capped_simplex(w: np.ndarray, cap: float) -> np.ndarray:
    """The nearest weights that sum to one, each between 0 and ``cap``, by bisection on the shift."""
    cap = max(cap, 1 / len(w))
    low, high = (w - cap).min() - 1, w.max()
    for _ in range(100):
        shift = (low + high) / 2
        low, high = (shift, high) if np.clip(w - shift, 0, cap).sum() > 1 else (low, shift)
    return np.clip(w - (low + high) / 2, 0, cap)


def mean_variance(mu: np.ndarray, cov: np.ndarray, aversion: float = 5.0, cap: float = 1.0, steps: int = 2000) -> np.ndarray:
    """Maximises mu.w - aversion / 2 * w.C.w on the capped simplex by projected gradient."""
    w, rate = np.full(len(mu), 1 / len(mu)), 1 / max(aversion * np.linalg.eigvalsh(cov)[-1], 1e-12)
    for _ in range(steps):
        w = onto_capped_simplex(w + rate * (mu - aversion * cov @ w), cap)
    return w


def risk_budget(cov: np.ndarray, budget: np.ndarray | None = None, rounds: int = 500) -> np.ndarray:
    """Weights whose risk contributions are in proportion to the budget, by cyclic coordinate descent."""
    n = len(cov)
    b, x = np.full(n, 1 / n) if budget is None else budget / budget.sum(), 1 / np.sqrt(np.diag(cov))
    for _ in range(rounds):
        for i in range(n):
            rest = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-rest + np.sqrt(rest**2 + 4 * cov[i, i] * b[i])) / (2 * cov[i, i])
    return x / x.sum()


def black_litterman(prior: np.ndarray, cov: np.ndarray, views: np.ndarray, tau: float = 0.05, trust: float = 1.0) -> np.ndarray:
    """Posterior means from one absolute view on each asset; views' variances are those of the prior over ``trust``."""
    t = tau * cov
    omega = np.diag(np.diag(t) / trust)
    return prior + t @ np.linalg.solve(t + omega, views - prior)


def hierarchical_risk_parity(cov: np.ndarray) -> np.ndarray:
    """Single-linkage order of assets by correlation distance, then weights by recursive bisection."""
    sd = np.sqrt(np.diag(cov))
    d = np.sqrt(np.maximum(0, (1 - cov / np.outer(sd, sd)) / 2))
    clusters = {i: [i] for i in range(len(cov))}
    dist = {(i, j): float(np.linalg.norm(d[i] - d[j])) for i in clusters for j in clusters if i < j}
    while len(clusters) > 1:
        (i, j), _ = min(dist.items(), key=lambda kv: (kv[1], kv[0]))
        clusters[i] += clusters.pop(j)
        for k in clusters:
            if k != i:
                a, b = (min(i, k), max(i, k)), (min(j, k), max(j, k))
                dist[a] = min(dist[a], dist.pop(b))
        del dist[(i, j)]
    order, w = next(iter(clusters.values())), np.ones(len(cov))

    def variance(part: list[int]) -> float:
        own = cov[np.ix_(part, part)]
        inv = 1 / np.diag(own)
        return float((inv / inv.sum()) @ own @ (inv / inv.sum()))

    parts = [order]
    while parts:
        parts = [half for p in parts if len(p) > 1 for half in (p[: len(p) // 2], p[len(p) // 2 :])]
        for left, right in zip(parts[::2], parts[1::2], strict=True):
            share = 1 - variance(left) / (variance(left) + variance(right))
            w[left] *= share
            w[right] *= 1 - share
    return w
