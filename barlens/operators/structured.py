"""Portfolio weights under a factor structure: covariance B F B' + D, with a few factors and a variance of each asset's own.

Nothing here is quadratic in assets. A step adds up a few sums over assets in Spark (one row of K squared numbers for K factors), the driver
solves a system of that size, and weights are columns of the table of assets. Programs with bounds are solved through their duals, which have K + 1
unknowns whatever the number of assets: given these, each asset's weight follows from its own row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.operators import risk
from barlens.sources import scratch

MAX_STEPS = 60


@dataclass(frozen=True)
class Structure:
    """``assets``: (asset, a column for each of ``factors``, own), a written table; ``covariance``: of the factors."""

    assets: DataFrame
    factors: tuple[str, ...]
    covariance: np.ndarray

    def with_column(self, name: str, values: DataFrame) -> Structure:
        """The assets with a column of ``values`` (asset, ``name``), 0 where there is none."""
        joined = self.assets.drop(name).join(values.select("asset", name), "asset", "left").fillna(0.0, [name])
        return Structure(scratch.written(joined, "structure"), self.factors, self.covariance)

    def dot(self, weights: np.ndarray) -> Column:
        return sum((F.col(f) * float(w) for f, w in zip(self.factors, weights, strict=True)), F.lit(0.0))

    def cross(self, by: Column, prefix: str = "x") -> list[Column]:
        """Sums of the products of two factors, times ``by``."""
        return [F.sum(F.col(a) * F.col(b) * by).alias(f"{prefix}{i}_{j}") for i, a in enumerate(self.factors) for j, b in enumerate(self.factors) if i <= j]

    def matrix(self, row, prefix: str = "x") -> np.ndarray:
        k = len(self.factors)
        return np.array([[row[f"{prefix}{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])

    def along(self, by: Column, prefix: str) -> list[Column]:
        """Sums of the factors times ``by``."""
        return [F.sum(F.col(f) * by).alias(f"{prefix}{i}") for i, f in enumerate(self.factors)]

    def vector(self, row, prefix: str) -> np.ndarray:
        return np.array([row[f"{prefix}{i}"] or 0.0 for i in range(len(self.factors))])


def structure_of(returns: DataFrame, exposures: DataFrame, factors: tuple[str, ...], floor: float = 1e-8) -> Structure:
    """The structure of returns (asset, t, r) under fixed exposures (asset, factors) and a market that all have alike: covariance of the factors' returns
    by date, and the variance of what they leave of each asset's (``floor`` at least)."""
    names = ("market", *factors)
    ret = scratch.written(risk.factor_returns(returns, exposures, factors), "factor-returns")
    pairs = ret.select("t", F.col("factor").alias("a"), F.col("ret").alias("x")).join(ret.select("t", F.col("factor").alias("b"), F.col("ret").alias("y")), "t")
    cov = {(r["a"], r["b"]): r["c"] or 0.0 for r in pairs.groupBy("a", "b").agg(F.covar_pop("x", "y").alias("c")).collect()}
    wide = ret.groupBy("t").pivot("factor", list(names)).agg(F.first("ret"))
    wide = wide.select("t", *[F.col(n).alias(f"{n}_ret") for n in names])
    x = exposures.select("asset", F.lit(1.0).alias("market"), *factors)
    left = returns.where("r is not null").join(wide, "t").join(x, "asset")
    own = F.col("r") - sum((F.col(f"{n}_ret") * F.col(n) for n in names), F.lit(0.0))
    variances = left.groupBy("asset").agg(F.greatest(F.var_pop(own), F.lit(floor)).alias("own"))
    return Structure(scratch.written(x.join(variances, "asset"), "structure"), names, np.array([[cov.get((a, b), 0.0) for b in names] for a in names]))


def solve(s: Structure, rhs: str, own: Column | None = None, scale: float = 1.0) -> tuple[Column, np.ndarray]:
    """x with (B (scale F) B' + diagonal ``own``) x = the column ``rhs``, as a column, by Woodbury's identity; and the K numbers that it takes."""
    own = F.col("own") if own is None else own
    row = s.assets.agg(*s.cross(1 / own), *s.along(F.col(rhs) / own, "v")).first()
    f = scale * s.covariance
    z = np.linalg.solve(np.eye(len(f)) + f @ s.matrix(row), f @ s.vector(row, "v"))
    return (F.col(rhs) - s.dot(z)) / own, z


def inverse_weights(s: Structure, alpha: str = "alpha", ridge: float = 1e-6) -> DataFrame:
    """(asset, w): inverse covariance (``ridge`` added) times alpha, what is negative as 0; not yet scaled."""
    x, _ = solve(s, alpha, F.col("own") + ridge)
    return s.assets.select("asset", F.greatest(x, F.lit(0.0)).alias("w"))


def variance_of(s: Structure, weights: DataFrame, column: str = "w") -> float:
    """w' covariance w of (asset, ``column``)."""
    row = s.assets.join(weights, "asset").agg(*s.along(F.col(column), "g"), F.sum(F.col("own") * F.col(column) * F.col(column)).alias("d")).first()
    g = s.vector(row, "g")
    return float(g @ s.covariance @ g + (row["d"] or 0.0))


def ascend(point: np.ndarray, look: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], tolerance: float) -> np.ndarray:
    """The maximum of a concave function whose value, gradient and Hessian ``look`` gives, by Newton steps that are shortened until they gain.

    Each look is one Spark job. Raises where ``MAX_STEPS`` looks do not suffice."""
    value, gradient, hessian = look(point)
    damping = 0.0
    for _ in range(MAX_STEPS):
        if np.abs(gradient).max() <= tolerance:
            return point
        # A region where the function is flat in some direction (no asset within its bounds) has a singular Hessian.
        bent = -hessian + max(damping, 1e-14 * max(np.trace(-hessian), 1e-300)) * np.eye(len(point))
        step = np.linalg.solve(bent, gradient)
        found = look(point + step)
        if found[0] >= value + 1e-4 * gradient @ step - 1e-13 * abs(value) or np.abs(found[1]).max() <= tolerance:
            point, (value, gradient, hessian), damping = point + step, found, damping / 10 if damping > 1e-12 else 0.0
        else:
            damping = max(damping * 10, 1e-3 * np.abs(np.diag(hessian)).max(), 1e-8)
    raise ArithmeticError(f"no optimum within {MAX_STEPS} steps; the gradient is still {np.abs(gradient).max():.3g}")


def mean_variance(s: Structure, mu: str | None = None, aversion: float = 5.0, cap: float = 1.0, tolerance: float = 1e-9) -> DataFrame:
    """(asset, w): weights from 0 to ``cap`` that sum to one and maximise mu.w - aversion / 2 * w' covariance w; the least variance without ``mu``.

    Where n * cap < 1, all stand at 1 / n. Dual unknowns: a price for each factor's exposure and one for the sum."""
    n = s.assets.count()
    cap = max(cap, 1 / max(n, 1))
    m = F.col(mu) if mu else F.lit(0.0)
    k, a, own = len(s.factors), aversion, F.col("own")
    f = s.covariance + 1e-12 * max(np.trace(s.covariance), 1e-12) * np.eye(k)
    inverse = np.linalg.inv(f)

    def gain(point: np.ndarray) -> Column:
        return m - s.dot(point[:k]) - float(point[k])

    def weight(point: np.ndarray) -> Column:
        return F.least(F.greatest(gain(point) / (a * own), F.lit(0.0)), F.lit(cap))

    def look(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        d = s.assets.withColumns({"__w": weight(point), "__c": gain(point)})
        free = F.when((F.col("__w") > 0) & (F.col("__w") < cap), 1 / (a * own)).otherwise(0.0)
        w = F.col("__w")
        row = d.agg(F.sum(a / 2 * own * w * w - F.col("__c") * w).alias("value"), F.sum(w).alias("total"), F.sum(free).alias("free"), *s.along(w, "g"), *s.along(free, "h"), *s.cross(free)).first()
        theta = point[:k]
        value = -theta @ inverse @ theta / (2 * a) + (row["value"] or 0.0) - point[k]
        gradient = np.append(s.vector(row, "g") - inverse @ theta / a, (row["total"] or 0.0) - 1)
        h = s.vector(row, "h")
        hessian = -np.block([[inverse / a + s.matrix(row), h[:, None]], [h[None], np.array([[row["free"] or 0.0]])]])
        # Exposure prices are of the size of the covariance: scaled, all unknowns count alike.
        return value, gradient * scale, hessian * np.outer(scale, scale)

    scale = np.append(np.sqrt(np.diag(f)) * a, 1.0)
    if not n:
        return s.assets.select("asset", F.lit(0.0).alias("w"))
    first = s.assets.agg(F.avg(m).alias("m"), F.avg(own).alias("d")).first()
    start = np.append(np.zeros(k), first["m"] - a * first["d"] / n)
    best = ascend(start / scale, lambda p: look(p * scale), tolerance) * scale
    return s.assets.select("asset", weight(best).alias("w"))


def risk_budget(s: Structure, budget: str | None = None, tolerance: float = 1e-10) -> DataFrame:
    """(asset, w): positive weights of sum one whose shares of the risk are in proportion to ``budget`` (equal without it).

    Dual unknowns: a price for each factor's exposure; an asset's weight is then the root of its own quadratic."""
    k, own = len(s.factors), F.col("own")
    f = s.covariance + 1e-12 * max(np.trace(s.covariance), 1e-12) * np.eye(k)
    inverse, scale = np.linalg.inv(f), np.sqrt(np.diag(f))
    total = s.assets.agg(F.sum(F.col(budget)) if budget else F.count(F.lit(1))).first()[0] or 1
    share = (F.col(budget) if budget else F.lit(1.0)) / float(total)

    def parts(theta: np.ndarray) -> tuple[Column, Column]:
        g = s.dot(theta)
        root = F.sqrt(g * g + 4 * own * share)
        # Of the two forms of the root the one that does not cancel.
        return F.when(g > 0, 2 * share / (g + root)).otherwise((root - g) / (2 * own)), root

    def look(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        x, root = parts(theta)
        d = s.assets.withColumns({"__x": x, "__r": root, "__g": s.dot(theta), "__s": share})
        w = F.col("__x")
        row = d.agg(F.sum(own / 2 * w * w + F.col("__g") * w - F.col("__s") * F.log(w)).alias("value"), *s.along(w, "g"), *s.cross(w / F.col("__r"))).first()
        gradient = s.vector(row, "g") - inverse @ theta
        return (row["value"] or 0.0) - theta @ inverse @ theta / 2, gradient * scale, -(inverse + s.matrix(row)) * np.outer(scale, scale)

    best = ascend(np.zeros(k), lambda p: look(p * scale), tolerance) * scale
    d = s.assets.select("asset", parts(best)[0].alias("w"))
    whole = d.agg(F.sum("w").alias("s"))
    return d.crossJoin(F.broadcast(whole)).select("asset", (F.col("w") / F.col("s")).alias("w"))


def black_litterman(s: Structure, prior: str, views: str, tau: float = 0.05, trust: float = 1.0) -> DataFrame:
    """(asset, mean): posterior means from one absolute view on each asset; views' variances are those of the prior over ``trust``."""
    variance = F.col("own") + sum((F.col(a) * F.col(b) * float(s.covariance[i, j]) for i, a in enumerate(s.factors) for j, b in enumerate(s.factors)), F.lit(0.0))
    d = Structure(s.assets.withColumns({"__gap": F.col(views) - F.col(prior), "__own": tau * F.col("own") + tau * variance / trust}), s.factors, s.covariance)
    x, _ = solve(d, "__gap", F.col("__own"), tau)
    d = Structure(d.assets.withColumn("__x", x), s.factors, s.covariance)
    pulled = s.covariance @ s.vector(d.assets.agg(*d.along(F.col("__x"), "g")).first(), "g")
    return d.assets.select("asset", (F.col(prior) + tau * (d.dot(pulled) + F.col("own") * F.col("__x"))).alias("mean"))

