"""Screening of factor candidates: gates on each one alone, then an independent set chosen greedily by score.

Candidates are stacked rows (name, asset, t, score, fwd). Statistics, residuals and the correlations of all pairs are summed in Spark; the choice itself
is over the list of candidates, which does not grow with assets or dates.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.columns import guarded_corr, normal_cdf
from barlens.operators import blocks, selection
from barlens.operators.expression import tied_rank, token_similarity
from barlens.operators.selection import scored
from barlens.sources import scratch

#: Assets of a date that one task multiplies at most, on average.
BLOCK_ASSETS = 20_000
SEPARATOR = "\t"


def average_rank(c: str) -> Column:
    """Rank from 1 within a candidate and date, ties by average."""
    return tied_rank(scored(), c)


def ic_by_date(rows: DataFrame, least: int = 10) -> DataFrame:
    """(name, t, ic): rank-IC of each candidate and date with ``least`` rows; 0 where a side does not vary."""
    d = rows.select("name", "t", average_rank("score").alias("x"), average_rank("fwd").alias("y"))
    return d.groupBy("name", "t").agg(F.count(F.lit(1)).alias("n"), F.coalesce(guarded_corr(F.col("x"), F.col("y")), F.lit(0.0)).alias("ic")).where(F.col("n") >= least).drop("n")


def expected_best(n_trials: int) -> float:
    """Expected largest of ``n_trials`` standard normal draws."""
    if n_trials < 2:
        return 0.0
    ppf, g = NormalDist().inv_cdf, 0.5772156649015329
    return (1 - g) * ppf(1 - 1 / n_trials) + g * ppf(1 - 1 / (n_trials * math.e))


def deflated_ratio(ic: DataFrame, n_trials: int, least: int = 10) -> DataFrame:
    """(name, dsr): probability that a candidate's ICIR beats the best of ``n_trials`` without skill; 0 below ``least`` dates or where the IC does not vary."""
    m = ic.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"))
    z = (F.col("ic") - F.col("mean")) / F.when(F.col("sd") > 1e-12, F.col("sd"))
    d = ic.join(m, "name").groupBy("name", "n", "mean", "sd").agg(F.avg(z * z * z).alias("skew"), (F.avg(z * z * z * z) - 3).alias("excess"))
    ratio = F.col("mean") / F.col("sd")
    spread = F.greatest(1 - F.col("skew") * ratio + F.col("excess") / 4 * ratio * ratio, F.lit(1e-12))
    best = F.greatest(F.sqrt(spread / (F.col("n") - 1)) * expected_best(n_trials), F.lit(0.0))
    p = normal_cdf((ratio - best) * F.sqrt(F.col("n") - 1.0) / F.sqrt(spread))
    return d.select("name", F.when((F.col("n") >= least) & (F.col("sd") > 1e-12), p).otherwise(0.0).alias("dsr"))


def orthogonal_ic(rows: DataFrame, exposures: DataFrame, styles: tuple[str, ...], least: int = 10, in_blocks: bool = False) -> DataFrame:
    """(name, orthogonal_ic): mean rank-IC of what the exposures to styles leave of each candidate; ``in_blocks``: by :func:`blocks.stacked_sections`."""
    keyed = rows.withColumn("t", F.concat_ws(SEPARATOR, "name", F.col("t").cast("string")))
    left = selection.residual_scores(keyed, exposures, styles, keep=("name", "fwd"))
    ic = blocks.stacked_sections(left).where(F.col("n") >= least) if in_blocks else ic_by_date(left, least)
    return ic.groupBy("name").agg(F.avg("ic").alias("orthogonal_ic"))


SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def rank_products(rows: DataFrame) -> DataFrame:
    """(t, a, b, sums): for each date and two candidates, a < b, sums of their ranks within the date and of their products over rows that have both.

    A task multiplies the ranks of a bounded part of one date's assets as a matrix with a column for each candidate; sums are added over parts."""
    spark = rows.sparkSession
    n = F.count(F.lit(1)).over(scored())
    ranks = rows.select("name", "t", "asset", ((average_rank("score") - 0.5) / n - 0.5).alias("x"))
    most = rows.groupBy("name", "t").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    names = [r["name"] for r in rows.select("name").distinct().orderBy("name").collect()]
    at = {c: i for i, c in enumerate(names)}
    parts = max(1, -(-most // BLOCK_ASSETS))

    def sums(part: pd.DataFrame) -> pd.DataFrame:
        codes, _ = pd.factorize(part["asset"])
        x = np.full((codes.max() + 1, len(names)), np.nan)
        x[codes, part["name"].map(at).to_numpy()] = part["x"].to_numpy()
        has = np.isfinite(x).astype(float)
        x = np.nan_to_num(x)
        n, sx, sxx, sxy = has.T @ has, x.T @ has, (x * x).T @ has, x.T @ x
        i, j = np.triu_indices(len(names), 1)
        found = {"t": part["t"].iloc[0], "a": i, "b": j, "n": n[i, j], "sa": sx[i, j], "sb": sx[j, i], "saa": sxx[i, j], "sbb": sxx[j, i], "sab": sxy[i, j]}
        return pd.DataFrame(found)[n[i, j] > 0]

    kind = rows.schema["t"].dataType.simpleString()
    schema = f"t {kind}, a int, b int, " + ", ".join(f"{c} double" for c in SUMS)
    total = ranks.groupBy("t", F.pmod(F.xxhash64("asset"), F.lit(parts)).alias("part")).applyInPandas(sums, schema).groupBy("t", "a", "b").agg(*(F.sum(c).alias(c) for c in SUMS))
    label = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    first, second = label.select(F.col("i").alias("a"), F.col("name").alias("first")), label.select(F.col("i").alias("b"), F.col("name").alias("second"))
    return total.join(F.broadcast(first), "a").join(F.broadcast(second), "b").select("t", F.col("first").alias("a"), F.col("second").alias("b"), *SUMS)


def product_correlation() -> Column:
    """The correlation that the sums of :func:`rank_products` give; null where a side does not vary."""
    c = {k: F.col(k) for k in SUMS}
    va, vb = c["saa"] / c["n"] - (c["sa"] / c["n"]) ** 2, c["sbb"] / c["n"] - (c["sb"] / c["n"]) ** 2
    return F.when((va > 1e-12) & (vb > 1e-12), (c["sab"] / c["n"] - c["sa"] / c["n"] * c["sb"] / c["n"]) / F.sqrt(va * vb))


def value_correlations(rows: DataFrame) -> DataFrame:
    """(a, b, corr), a < b: correlation of two candidates' ranks within dates over all rows that have both; null where one does not vary."""
    total = rank_products(rows).groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in SUMS))
    return total.select("a", "b", product_correlation().alias("corr"))


def mean_correlations(rows: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, corr), a < b: mean over dates with ``least`` common rows of the correlation of two candidates' ranks."""
    return rank_products(rows).where(F.col("n") >= least).select("a", "b", product_correlation().alias("corr")).groupBy("a", "b").agg(F.avg("corr").alias("corr"))


def screened(rows: DataFrame, expressions: dict[str, str], n_trials: int, exposures: DataFrame | None = None, styles: tuple[str, ...] = (), dsr: float = 0.5, orthogonal: float = 0.01, n: int | None = None, **gates: float) -> DataFrame:
    """(name, expression, ic, icir, monotonicity, long_short, nodes, dsr, orthogonal_ic, passed, score): every candidate with what each gate looks at.

    The gate of orthogonality is open where no ``exposures`` are given. ``n``: the number of ``rows``, if it is known, for :func:`selection.candidate_stats`."""
    of = F.create_map(*[F.lit(x) for kv in expressions.items() for x in kv])
    most = rows.groupBy("name", "t").count().agg(F.max("count")).first()[0] or 0
    small = 3 * most <= blocks.CELLS
    by_date = scratch.written(blocks.stacked_sections(rows) if small else selection.ranked_by_date(rows, n=n), "ranked")
    found = selection.gated(selection.candidate_stats(rows, n=n, by_date=by_date).withColumn("expression", of[F.col("name")]), **gates)
    d = found.join(deflated_ratio(by_date.where("n >= 10").select("name", "t", "ic"), n_trials), "name", "left")
    d = d.join(orthogonal_ic(rows, exposures, styles, in_blocks=small), "name", "left") if exposures is not None else d.withColumn("orthogonal_ic", F.lit(None).cast("double"))
    passed = F.col("passed") & (F.coalesce("dsr", F.lit(0.0)) >= dsr)
    if exposures is not None:
        passed = passed & (F.abs(F.coalesce("orthogonal_ic", F.lit(0.0))) >= orthogonal)
    return d.withColumns({"passed": passed, "score": F.when(passed, F.col("score")).otherwise(0.0), "dsr": F.coalesce("dsr", F.lit(0.0))})


def independent(candidates: list[dict], correlations: dict[tuple[str, str], float], k: int, limit: float = 0.7, alike: float = 0.7) -> dict[str, tuple[int, str]]:
    """Name to (place from 1, "") of those chosen, and to (0, the chosen one that stands in its way) of those that passed and are left out.

    In order of score, ties to the name; a candidate joins if its values' correlation with every one chosen before stays below ``limit`` in size and
    their expressions' similarity is at most ``alike``. Beyond the ``k`` best nothing joins."""
    chosen: list[dict] = []
    out: dict[str, tuple[int, str]] = {}
    for c in sorted((c for c in candidates if c["passed"]), key=lambda c: (-round(c["score"], 8), c["name"])):
        near = [o["name"] for o in chosen if abs(correlations.get((min(c["name"], o["name"]), max(c["name"], o["name"]))) or 0.0) >= limit or token_similarity(c["expression"], o["expression"]) > alike]
        if near:
            out[c["name"]] = (0, near[0])
        elif len(chosen) < k:
            chosen.append(c)
            out[c["name"]] = (len(chosen), "")
    return out


def select_factors(rows: DataFrame, expressions: dict[str, str], n_trials: int, k: int = 5, limit: float = 0.7, alike: float = 0.7, **gates) -> DataFrame:
    """:func:`screened` with ``place`` (from 1; 0: not chosen) and ``blocked_by``, the chosen candidate that one is too much like."""
    spark = rows.sparkSession
    candidates = scratch.written(screened(rows, expressions, n_trials, **gates), "screened")
    listed = [r.asDict() for r in candidates.select("name", "expression", "passed", "score").collect()]
    correlations = {(r["a"], r["b"]): r["corr"] for r in value_correlations(rows).collect()}
    places = [(name, place, by) for name, (place, by) in independent(listed, correlations, k, limit, alike).items()]
    found = spark.createDataFrame(places, "name string, place int, blocked_by string")
    return candidates.join(F.broadcast(found), "name", "left").fillna(0, ["place"]).fillna("", ["blocked_by"])
