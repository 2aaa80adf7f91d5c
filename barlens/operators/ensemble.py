"""Boosted trees refitted over expanding windows, beside an equal-weight baseline that takes over where the trees do not earn their place.

Rows are (asset, t, features ..., fwd). A fold is a run of dates; its trees see only rows whose returns are known when it begins, and whether its
scores are used is decided by the rank-ICs of the folds before it alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.columns import guarded_corr, quantised
from barlens.operators import research, risk, stats
from barlens.operators.expression import series
from barlens.sources import scratch

def baseline_scores(rows: DataFrame, names: tuple[str, ...], warm: int = 20) -> DataFrame:
    """``rows`` with ``baseline``: the mean over features of their z-scores against the asset's own past and present, 0 where there are fewer than ``warm`` values or no spread."""
    so_far = series().rowsBetween(Window.unboundedPreceding, 0)

    def z(c: str):
        n, m, s = F.count(c).over(so_far), F.avg(c).over(so_far), F.stddev_samp(c).over(so_far)
        return F.coalesce(F.when((n >= warm) & (s > 1e-12), (F.col(c) - m) / s), F.lit(0.0))

    return rows.withColumn("baseline", quantised(sum((z(c) for c in names), F.lit(0.0)) / len(names), 1e10))


def daily_ics(scored: DataFrame, columns: tuple[str, ...], least: int = 10) -> DataFrame:
    """(t, fold, one IC for each column, n): rank-ICs of the dates with ``least`` rows that have all columns and a return; 0 where a side does not vary."""
    ok = F.col("fwd").isNotNull()
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    d = scored.where(ok).select("t", "fold", stats.average_rank("fwd").alias("y"), *[stats.average_rank(c).alias(c) for c in columns])
    return d.groupBy("t", "fold").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(guarded_corr(F.col(c), F.col("y")), F.lit(0.0)).alias(c) for c in columns]).where(F.col("n") >= least)


def fold_summary(scored: DataFrame, edge: float, least: int = 10) -> DataFrame:
    """(fold, first, last, n_dates, ic_fitted, ic_baseline, past_fitted, past_baseline, used): a fold is scored by the trees if the mean IC of all dates of
    the folds before it is at least the baseline's and ``edge`` more; the first fold is the baseline's. A fold without trees counts for neither."""
    ic = daily_ics(scored, ("fitted", "baseline"), least)
    by = scored.groupBy("fold").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    sums = ic.groupBy("fold").agg(F.count(F.lit(1)).alias("n_dates"), F.sum("fitted").alias("f"), F.sum("baseline").alias("b"))
    # One row a fold from here on.
    past = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    d = by.join(sums, "fold", "left").fillna(0, ["n_dates"])
    mean = lambda c: F.try_divide(F.sum(c).over(past), F.sum("n_dates").over(past))
    d = d.select("fold", "first", "last", "n_dates", F.try_divide("f", "n_dates").alias("ic_fitted"), F.try_divide("b", "n_dates").alias("ic_baseline"), mean("f").alias("past_fitted"), mean("b").alias("past_baseline"))
    return d.withColumn("used", F.coalesce(quantised("past_fitted", 1e10) >= quantised(F.col("past_baseline") + edge, 1e10), F.lit(False)))


def fitted_folds(data: DataFrame, names: tuple[str, ...], start: int, every: int, horizon: int = 1, least: int = 100, trees: int = 10, depth: int = 3, seed: int = 42) -> tuple[DataFrame, list[dict]]:
    """``data``, rows with their date's number ``i``, from number ``start`` on with ``fold`` and ``fitted``, and for each fold its number, its training rows and the
    features' shares in the trees.

    The driver loops over folds, a number that grows with neither assets nor rows, and each fit is a Spark job over rows in an order of their own, so that
    shuffled partitions give equal scores. Rows with a null feature have no score; folds of fewer than ``least`` training rows none at all."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    complete = F.lit(True)
    for c in names:
        complete = complete & F.col(c).isNotNull()
    # One row a date.
    by_date = {r["i"]: r["n"] for r in data.where(complete).groupBy("i").agg(F.count("fwd").alias("n")).collect()}
    v = VectorAssembler(inputCols=list(names), outputCol="__x")
    placed = data.where(F.col("i") >= start).withColumn("fold", F.floor((F.col("i") - start) / every).cast("int"))
    blocks, folds, scored = [], [], F.lit(False)
    for fold, at in enumerate(range(start, max(by_date, default=-1) + 1, every)):
        known = at - horizon + 1
        n = sum(k for i, k in by_date.items() if i < known)
        folds.append({"fold": fold, "n_train": n, "importance": {}})
        if n < least:
            continue
        train = data.where(complete & (F.col("i") < known) & F.col("fwd").isNotNull()).select("asset", "t", *names, "fwd")
        # A fit reads its rows more than once, and would shuffle them each time.
        train = risk.in_order(train, names, n).persist()
        model = GBTRegressor(featuresCol="__x", labelCol="fwd", predictionCol="fitted", maxIter=trees, maxDepth=depth, seed=seed).fit(v.transform(train))
        train.unpersist()
        folds[-1]["importance"] = dict(zip(names, map(float, model.featureImportances.toArray()), strict=True))
        own = complete & (F.col("fold") == fold)
        block = placed.where(own).withColumns({c: F.round(c, 10) for c in names})
        blocks.append(model.transform(v.transform(block)).drop("__x"))
        scored = scored | own
    out = placed.where(~scored).withColumn("fitted", F.lit(None).cast("double"))
    for block in blocks:
        out = out.unionByName(block)
    return out, folds


def ensemble(rows: DataFrame, names: tuple[str, ...], start: int, every: int = 20, edge: float = 0.01, warm: int = 20, **fit) -> tuple[DataFrame, DataFrame]:
    """(scores, folds): (asset, t, fold, fitted, baseline, chosen, fwd) of every row from date number ``start`` on, and :func:`fold_summary` with each fold's
    training rows, the features' shares, the mean IC of what was chosen, and ``verdict``, whether the trees beat the baseline by ``edge`` over all dates."""
    spark = rows.sparkSession
    fitted, info = fitted_folds(research.dated(scratch.written(baseline_scores(rows, names, warm), "folds")), names, start, every, **fit)
    scored = scratch.written(fitted.select("asset", "t", "fold", "baseline", "fwd", "fitted"), "scored")
    summary = fold_summary(scored, edge)
    used = summary.select("fold", "used")
    chosen = F.when(F.col("used"), F.coalesce("fitted", "baseline")).otherwise(F.col("baseline"))
    scores = scored.join(F.broadcast(used), "fold").withColumn("chosen", chosen).select("asset", "t", "fold", "fitted", "baseline", "chosen", "fwd")
    after = daily_ics(scores, ("chosen",)).groupBy("fold").agg(F.avg("chosen").alias("ic_chosen"))
    known = spark.createDataFrame([(f["fold"], f["n_train"], f["importance"]) for f in info], "fold int, n_train long, importance map<string,double>")
    every_fold = Window.partitionBy()  # one row a fold
    total = lambda c: F.sum(F.col(c) * F.col("n_dates")).over(every_fold)
    beats = total("ic_fitted") - total("ic_baseline") >= edge * F.sum("n_dates").over(every_fold)
    folds = summary.join(after, "fold", "left").join(known, "fold", "left").withColumn("verdict", F.coalesce(beats & (F.sum("n_dates").over(every_fold) > 0), F.lit(False)))
    return scores, folds
