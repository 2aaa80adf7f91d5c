"""Candidate templates, win probabilities, rolling selection of assets, gates by regime, and the runs that chain them.

Rows are (asset, t, features ..., fwd). What reaches the driver is a list of retrain dates or a fitted model of a fixed size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.columns import guarded_corr
from barlens.operators import factors, portfolio, risk, selection, stats, structured
from barlens.operators.expression import cross, cross_zscore, tied_rank
from barlens.sources import scratch

# Expression templates and the lags that stand for {L}; an empty tuple for a template without one.
TEMPLATES: list[tuple[str, tuple[int, ...]]] = [
    # momentum
    ("sub(close, delay(close, {L}))", (5, 10, 20, 60)),
    ("sub(delay(close, {L}), delay(close, 60))", (20, 60)),
    ("sub(close, delay(close, {L}))", (120, 250)),
    ("sub(sub(close, delay(close, {L})), sub(delay(close, {L}), delay(close, 1)))", (10, 20)),
    # reversal
    ("sub(delay(close, {L}), close)", (5, 10, 20)),
    ("sub(delay(close, 1), close)", ()),
    ("sub(close, ts_mean(close, {L}))", (20, 60, 120)),
    # volatility
    ("ts_std(close, {L})", (10, 20, 60)),
    ("ts_std(sub(close, delay(close, 1)), {L})", (20, 60)),
    ("div(sub(high, low), close)", ()),
    ("sub(ts_std(close, {L}), delay(ts_std(close, {L}), {L}))", (20,)),
    # liquidity
    ("div(volume, delay(volume, {L}))", (5, 10, 20)),
    ("sub(amount, delay(amount, {L}))", (5, 10, 20)),
    ("div(amount, delay(amount, {L}))", (10, 20)),
    ("div(volume, ts_mean(volume, {L}))", (20, 60)),
    ("div(amount, ts_mean(amount, {L}))", (20, 60)),
    # value and quality by price and volume
    ("div(close, ts_mean(close, {L}))", (60, 120, 250)),
    ("sub(close, vwap)", ()),
    ("sub(vwap, delay(vwap, {L}))", (5, 10, 20)),
    ("mul(sub(close, delay(close, {L})), rank(volume))", (5, 10, 20)),
    ("mul(sub(close, delay(close, {L})), sub(delay(volume, {L}), volume))", (10,)),
    ("mul(sub(close, delay(close, {L})), amount)", (5, 10, 20)),
    # within the bar
    ("sub(high, low)", ()),
    ("div(abs(sub(close, delay(close, 1))), sub(high, low))", ()),
    ("div(sub(high, max(close, delay(close, 1))), close)", ()),
    ("div(sub(min(close, delay(close, 1)), low), close)", ()),
    ("sub(sub(high, low), delay(sub(high, low), {L}))", (5, 10)),
    # cross-section
    ("zscore(close)", ()),
    ("zscore(sub(close, delay(close, {L})))", (10, 20)),
    ("zscore(volume)", ()),
    ("zscore(log(amount))", ()),
    ("rank(div(close, ts_mean(close, {L})))", (60, 120)),
    ("sub(rank(close), rank(amount))", ()),
    # correlation
    ("ts_corr(close, volume, {L})", (20, 60)),
    ("ts_corr(high, low, {L})", (20,)),
    ("ts_corr(abs(sub(close, delay(close, 1))), abs(sub(close, delay(close, 1))), {L})", (10, 20)),
    ("ts_corr(close, delay(close, {L}), {L})", (10, 20)),
    # compound
    ("mul(zscore(sub(close, delay(close, {L}))), div(amount, ts_mean(amount, {L})))", (20,)),
    ("mul(sub(close, delay(close, {L})), div(1, ts_std(close, {L})))", (20, 60)),
    ("mul(sub(delay(close, {L}), close), div(volume, ts_mean(volume, {L})))", (10,)),
]


def proposals(n: int | None = None) -> dict[str, str]:
    """Name to expression of the first ``n`` candidates (all by default) of the templates, lag by lag."""
    every = [template.replace("{L}", str(lag)) for template, lags in TEMPLATES for lag in (lags or (0,))]
    return {f"p{i:02d}": e for i, e in enumerate(every[:n])}


def dated(rows: DataFrame) -> DataFrame:
    """Adds ``i``, the number of the date from 0; the window is over one row a date."""
    return rows.join(F.broadcast(rows.select("t").distinct().withColumn("i", F.row_number().over(Window.orderBy("t")) - 1)), "t")


def meta_dataset(rows: DataFrame, names: tuple[str, ...], train_end: int, embargo: int = 5, warm: int = 40, cost_bps: float = 0.0) -> DataFrame:
    """(asset, t, names ..., fwd, label, split): z-scores of each date (null: 0), label 1 if the return is above the cost of both sides.

    Dates before number ``train_end`` train, those from ``embargo`` later test, those between are left out. Rows need a return, and all
    features on the first ``warm`` dates; dates with fewer than 5 such rows, or fewer than a third of all assets, are left out."""
    split = F.when(F.col("i") < train_end, "train").when(F.col("i") >= train_end + embargo, "test")
    return meta_rows(rows, names, warm, cost_bps).withColumn("split", split).where("split is not null").drop("i")


def meta_rows(rows: DataFrame, names: tuple[str, ...], warm: int = 40, cost_bps: float = 0.0) -> DataFrame:
    """(asset, t, i, names ..., fwd, label): the rows of :func:`meta_dataset` before the split; nothing of a row depends on later dates."""
    n_assets = rows.agg(F.count_distinct("asset").alias("n_assets"))
    ok = F.col("fwd").isNotNull()
    complete = F.lit(True)
    for c in names:
        complete = complete & F.col(c).isNotNull()
    d = dated(rows).withColumn("ok", ok & ((F.col("i") >= warm) | complete))
    d = d.withColumns({f"__{c}": F.coalesce(cross_zscore(F.col(c)), F.lit(0.0)) for c in names}).withColumn("n_ok", F.count_if("ok").over(cross()))
    d = d.crossJoin(F.broadcast(n_assets)).where(F.col("ok") & (F.col("n_ok") >= F.greatest(F.lit(5), F.floor(F.col("n_assets") / 3))))
    label = (F.col("fwd") - 2 * cost_bps / 1e4 > 0).cast("int")
    return d.select("asset", "t", "i", *[F.col(f"__{c}").alias(c) for c in names], "fwd", label.alias("label"))


def win_probability(data: DataFrame, names: tuple[str, ...], trees: int = 60, depth: int = 3, step: float = 0.1, seed: int = 42) -> DataFrame:
    """The test rows of :func:`meta_dataset` with ``p``, by boosted trees fitted on the training rows; raises below 30 of these, or with one label only."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = VectorAssembler(inputCols=list(names), outputCol="__x")
    train = data.where("split = 'train'")
    n, kinds = train.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    if n < 30 or kinds < 2:
        raise ValueError(f"{n} training rows with {kinds} labels; 30 rows and both labels are needed")
    model = GBTClassifier(featuresCol="__x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed).fit(v.transform(risk.in_order(train, names, n)))
    out = model.transform(v.transform(data.where("split = 'test'")))
    return out.select("asset", "t", *names, "fwd", "label", vector_to_array("probability")[1].alias("p"))


def hit_rate(scored: DataFrame, fraction: float = 0.3) -> DataFrame:
    """One row (rate, n): share of label 1 among the ``fraction`` of rows (one at least) with the largest ``p``, to six digits.

    Thousandths of p are counted first, which finds the one that holds the last row; only values within it are ordered, a thousand at most, so no window
    grows with the rows. Rows of the last value count by their mean."""
    by = scored.groupBy(F.round(F.col("p") * 1e6).cast("long").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits")).withColumn("cell", F.floor(F.col("p") / 1000))
    total = by.agg(F.greatest(F.floor(F.sum("n") * fraction), F.lit(1)).alias("top"))
    cells = by.groupBy("cell").agg(F.sum("n").alias("in_cell"))
    # One row a thousandth, then one row a value of a single thousandth.
    before = cells.withColumn("before", F.coalesce(F.sum("in_cell").over(Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = by.join(F.broadcast(before), "cell").crossJoin(F.broadcast(total)).where(F.col("before") < F.col("top"))
    cut = F.col("before") + F.col("in_cell") > F.col("top")
    order = Window.partitionBy("cell").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)
    last = d.where(cut).withColumn("above", F.col("before") + F.coalesce(F.sum("n").over(order), F.lit(0)))
    taken = F.least(F.greatest(F.col("top") - F.col("above"), F.lit(0)), F.col("n"))
    both = d.where(~cut).select("hits", "n", F.col("n").alias("taken")).unionByName(last.select("hits", "n", taken.alias("taken")))
    return both.agg((F.sum(F.col("hits") * F.col("taken") / F.col("n")) / F.sum("taken")).alias("rate"), F.sum("taken").alias("n"))


def daily_top(scored: DataFrame, n: int = 6, least_p: float = 0.0) -> DataFrame:
    """(t, ret, bench, win): mean return of each date's ``n`` best by score (ties to the smaller asset) whose ``p`` is at least ``least_p``.

    Where none of the n is left all of them count. Rows without score or return take no part; dates with fewer than 5 rows, or fewer than a third
    of all assets, are left out. A null p does not pass."""
    n_assets = scored.agg(F.count_distinct("asset").alias("n_assets"))
    place = F.row_number().over(cross().orderBy(F.desc("score"), "asset"))
    d = scored.where("score is not null and fwd is not null").withColumn("top", place <= n)
    chosen = F.col("top") & F.coalesce(F.col("p") >= least_p, F.lit(False))
    by = d.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.when(chosen, F.col("fwd"))), F.avg(F.when(F.col("top"), F.col("fwd")))).alias("ret"), F.avg("fwd").alias("bench"))
    return by.crossJoin(F.broadcast(n_assets)).where(F.col("n") >= F.greatest(F.lit(5), F.floor(F.col("n_assets") / 3))).select("t", "ret", "bench", (F.col("ret") > 0).cast("int").alias("win"))


def rolling_scores(rows: DataFrame, names: tuple[str, ...], start: int, every: int = 20, warm: int = 40, cost_bps: float = 10.0, trees: int = 20, horizon: int = 1) -> DataFrame:
    """(asset, t, score, p, fwd) of each date from number ``start`` on, by a forest and a win classifier that are fitted anew every ``every`` dates
    on all dates whose returns over ``horizon`` dates are known when the block begins; blocks with fewer than 50 training rows are left out.

    The rows are written once. The driver loops over retrain dates, a number that does not grow with assets; each fit is a Spark job over rows in
    an order of their own, so reruns and other partitionings give the same scores."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    data = scratch.written(meta_rows(rows, names, warm, cost_bps), "rolling")
    # One row a date.
    n_by_date = {r["i"]: r["n"] for r in data.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
    v = VectorAssembler(inputCols=list(names), outputCol="__x")
    out = None
    for r in range(start, max(n_by_date, default=-1) + 1, every):
        known = r - horizon + 1
        n = sum(k for i, k in n_by_date.items() if i < known)
        if n < 50:
            continue
        train, block = data.where(F.col("i") < known), data.where(F.col("i").between(r, r + every - 1))
        forest = RandomForestRegressor(featuresCol="__x", labelCol="fwd", predictionCol="score", numTrees=trees, maxDepth=5, seed=42).fit(v.transform(risk.in_order(train, names, n)))
        both = train.withColumn("split", F.lit("train")).unionByName(block.withColumn("split", F.lit("test")))
        one = forest.transform(v.transform(win_probability(both, names, trees=trees))).select("asset", "t", "score", "p", "fwd")
        out = one if out is None else out.unionByName(one)
    kinds = dict(rows.dtypes)
    return out if out is not None else rows.sparkSession.createDataFrame([], f"asset {kinds['asset']}, t {kinds['t']}, score double, p double, fwd double")


def regime_weights(ic_by_factor: DataFrame, labels: DataFrame, affinity: dict[str, dict[str, float]], half_life: float = 6, sharpness: float = 20.0) -> DataFrame:
    """(t, factor, weight): softmax over factors of the exponential mean of each factor's ICs before t, times the affinity of the
    date's regime (``labels``: t, regime) to the factor; 1 where none is given. Logits are taken off the date's largest and cut at -30."""
    span = 2 / (1 - 0.5 ** (1 / half_life)) - 1
    d = factors.with_emas(ic_by_factor.withColumnRenamed("factor", "asset"), "ic", {"m": span})
    before = F.coalesce(F.last("m", ignorenulls=True).over(Window.partitionBy("asset").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    pairs = [F.lit(x) for regime, of in affinity.items() for factor, a in of.items() for x in (f"{regime}\t{factor}", float(a))]
    fit = F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws("\t", "regime", "asset")), F.lit(1.0)) if pairs else F.lit(1.0)
    # One row a date and factor from here on.
    d = d.withColumn("m", before).join(labels, "t", "left").withColumn("x", F.col("m") * fit * sharpness)
    e = F.exp(F.greatest(F.col("x") - F.max("x").over(cross()), F.lit(-30.0)))
    return d.withColumn("e", e).select("t", F.col("asset").alias("factor"), (F.col("e") / F.sum("e").over(cross())).alias("weight"))


def current_scores(registry: DataFrame, scores: DataFrame) -> DataFrame:
    """(factor, asset, t, score) of each factor's latest promoted version: ``registry`` (factor, version, promoted), ``scores`` (factor, version, asset, t, score)."""
    now = registry.where("promoted").groupBy("factor").agg(F.max("version").alias("version"))
    return scores.join(now, ["factor", "version"]).select("factor", "asset", "t", "score")


def sentiment_scores(items: DataFrame, half_life_hours: float = 24.0) -> DataFrame:
    """(asset, score, n) from (asset, ts, score): mean with weights that halve every so many hours before the last item of all; null scores are left out."""
    d = items.where("score is not null and ts is not null")
    end = d.agg(F.max("ts").alias("end"))
    w = F.pow(F.lit(0.5), (F.unix_timestamp("end") - F.unix_timestamp("ts")) / 3600 / half_life_hours)
    d = d.crossJoin(F.broadcast(end)).withColumn("w", w)
    # Where all weights are too small for a double, nothing is left of the score.
    return d.groupBy("asset").agg(F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("score")), F.sum("w")), F.lit(0.0)).alias("score"), F.count(F.lit(1)).alias("n"))


def covariance_weights(alpha: DataFrame, covariance: DataFrame | structured.Structure, cap: float = 0.2) -> DataFrame:
    """(asset, w) without shorts in proportion to the inverse covariance times alpha, none above ``cap``, the excess handed on.

    ``alpha`` (asset, alpha); ``covariance``: a factor structure, for any number of assets, or (a, b, cov), a <= b, whose dense block is held by the driver,
    which raises above 2,000 assets. Assets without alpha have 0; where nothing is positive, equal weights."""
    kind = alpha.schema["asset"].dataType.simpleString()
    if isinstance(covariance, structured.Structure):
        d = structured.inverse_weights(covariance.with_column("alpha", alpha)).withColumn("k", F.lit(0))
        return selection.capped(d, "k", cap).select("asset", "w")
    names, m = portfolio.matrix_of(covariance)
    of = {r["asset"]: r["alpha"] or 0.0 for r in alpha.join(F.broadcast(covariance.select(F.col("a").alias("asset")).distinct()), "asset", "left_semi").collect()}
    w = np.linalg.solve(m + 1e-6 * np.eye(len(names)), np.array([of.get(a, 0.0) for a in names])) if names else []
    d = alpha.sparkSession.createDataFrame([(0, a, max(float(x), 0.0)) for a, x in zip(names, w, strict=True)], f"k int, asset {kind}, w double")
    return selection.capped(d, "k", cap).drop("k")


def nested_targets(alpha: DataFrame, covariance: DataFrame | structured.Structure, current: DataFrame, equity: float, cap: float = 0.2, bps: float = 45.0, to_bps: float = 1000.0) -> DataFrame:
    """(asset, raw, slippage, target, change): weights before and after each alpha pays the impact of getting there.

    ``current`` (asset, w, adv): weights and daily traded values. Slippage in bps is ``bps`` times the root of the traded share of the day; assets
    without a daily value pay none."""
    raw = covariance_weights(alpha, covariance, cap)
    d = raw.withColumnRenamed("w", "raw").join(current, "asset", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    part = F.try_divide(F.abs(F.col("raw") - F.col("w")) * equity, "adv")
    d = d.withColumn("slippage", F.when(F.col("adv") > 0, bps * F.sqrt(F.least(part, F.lit(1.0)))).otherwise(0.0))
    net = d.join(alpha, "asset", "left").select("asset", (F.coalesce("alpha", F.lit(0.0)) * to_bps - F.col("slippage")).alias("alpha"))
    target = covariance_weights(net, covariance, cap).withColumnRenamed("w", "target")
    return d.join(target, "asset").select("asset", "raw", "slippage", "target", (F.col("target") - F.col("w")).alias("change"))


def research_run(rows: DataFrame, prices: DataFrame, equity: float, n_hold: int, cap: float = 0.2, lot: int = 1, n: int | None = None) -> DataFrame:
    """(asset, score, weight, shares): from stacked candidates (name, asset, t, score, fwd) and the last date's ``prices`` (name, asset, score, price)
    to orders. Candidates weigh by their ICIR; z-scores of the last date are summed by weight; the ``n_hold`` best share the equity.
    ``n``: the number of ``rows``, if it is known, for :func:`selection.candidate_stats`."""
    w = selection.candidate_stats(rows, n=n).select("name", "icir")
    w = w.crossJoin(F.broadcast(w.agg(F.sum(F.abs("icir")).alias("total")))).select("name", F.coalesce(F.try_divide("icir", "total"), F.lit(0.0)).alias("share"))
    by = Window.partitionBy("name")
    sd = F.stddev_pop("score").over(by)
    z = F.when(sd > 1e-10, (F.col("score") - F.avg("score").over(by)) / sd).otherwise(0.0)
    joined = prices.where("score is not null").withColumn("z", z).join(F.broadcast(w), "name")
    best = joined.groupBy("asset").agg(F.sum(F.col("share") * F.col("z")).alias("score"), F.max("price").alias("price")).where("price > 0")
    best = best.orderBy(F.round("score", 8).desc(), "asset").limit(n_hold)
    weight = F.least(F.lit(1.0 / n_hold), F.lit(cap))
    return best.select("asset", "score", weight.alias("weight"), (F.floor(equity * weight / F.col("price") / lot) * lot).cast("long").alias("shares"))


def anchored(values: dict[str, Column], weights: dict[str, float], price: Column, anchor: Column) -> dict[str, Column]:
    """implied, low, high, n_methods and verdict of an ``anchor`` made of several methods' values; a method without a positive value is none."""
    ok = [F.when(v > 0, v) for v in values.values()]
    implied = F.try_divide(anchor, price) - 1
    n = sum((v.isNotNull().cast("int") for v in ok), F.lit(0))
    verdict = F.when(implied.isNull(), "unknown").when(implied > 0.1, "cheap").when(implied < -0.1, "dear").otherwise("fair")
    return {"implied": implied, "low": F.least(*ok), "high": F.greatest(*ok), "n_methods": n, "verdict": verdict}


def daily_run(items: DataFrame, known: DataFrame, cash: float, least: float, most: int) -> DataFrame:
    """(asset, score, triggered, bought): a day's job. New items (asset, ts, score; those whose ``id`` is in ``known`` are left out) are scored with decay, assets of ``least``
    or more trigger, and the ``most`` strongest of these, ties to the smaller asset, share the paper cash."""
    new = items.join(known.select("id").distinct(), "id", "left_anti")
    s = sentiment_scores(new).select("asset", "score", (F.col("score") >= least).alias("triggered"))
    best = s.where("triggered").orderBy(F.round("score", 8).desc(), "asset").limit(most)
    n = best.agg(F.count(F.lit(1)).alias("n"))
    buys = best.crossJoin(F.broadcast(n)).select("asset", (F.lit(cash) / F.col("n")).alias("bought"))
    return s.join(F.broadcast(buys), "asset", "left").select("asset", "score", "triggered", F.coalesce("bought", F.lit(0.0)).alias("bought"))


def pool_greedy(wide: DataFrame, forward: DataFrame, names: tuple[str, ...], k: int = 3, least_gain: float = 0.0, least: int = 10) -> list[tuple[str, float, float]]:
    """(name, IC of the pool with it, gain) of at most ``k`` candidates: each step adds the one whose rank, summed with those of the pool, has the largest mean
    rank-IC, ties to the name, while the gain exceeds ``least_gain`` (the first one is always taken).

    One job a step for all candidates left, over ranks that are written once; rows need all scores and a return, dates ``least`` such rows."""
    ok = F.col("fwd").isNotNull()
    for c in names:
        ok = ok & F.col(c).isNotNull()
    ranked = scratch.written(wide.join(forward, ["asset", "t"]).where(ok).select("t", *[stats.average_rank(c).alias(c) for c in names], stats.average_rank("fwd").alias("y")), "ranked")
    tied = tied_rank(selection.scored(), "s")
    chosen: list[tuple[str, float, float]] = []
    before = 0.0
    while len(chosen) < min(k, len(names)):
        pool = sum((F.col(c) for c, _, _ in chosen), F.lit(0.0))
        left = [c for c in names if c not in {x for x, _, _ in chosen}]
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), (pool + F.col(c)).alias("s")) for c in left]))
        d = ranked.select("t", "y", each.alias("x")).select("t", "y", "x.*").select("name", "t", "y", tied.alias("r"))
        ic = d.groupBy("name", "t").agg(F.coalesce(guarded_corr(F.col("r"), F.col("y")), F.lit(0.0)).alias("ic"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        found = sorted((-r["ic"], r["name"]) for r in ic.groupBy("name").agg(F.avg("ic").alias("ic")).collect())
        if not found or (chosen and -found[0][0] - before <= least_gain):
            break
        chosen.append((found[0][1], -found[0][0], -found[0][0] - before))
        before = -found[0][0]
    return chosen
