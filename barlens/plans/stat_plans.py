"""Queries of the validation statistics over the supplier panel, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.functions.columns import quantised, quantised_sql
from barlens.operators import expression, factors, stats
from barlens.plans.factor_plans import ordinal
from barlens.sources import views

_S = "OVER (PARTITION BY asset ORDER BY t)"
_BARS = "WITH " + views.SQL["supplier_bars"]
SIGNAL = "rank(sub(close, delay(close, 3)))"
#: score, forward return and market return on the supplier panel.
_PAIRS = (
    _BARS
    + f""", a AS (SELECT *, close - lag(close, 3) {_S} AS d3, lead(close) {_S} / close - 1 AS fwd, close / lag(close) {_S} - 1 AS r FROM bars
), s AS (SELECT asset, t, fwd, r, {ordinal('d3')} AS score FROM a), pairs AS (SELECT * FROM s WHERE score IS NOT NULL AND fwd IS NOT NULL)"""
)
_AVG_RANK = "(rank() OVER (PARTITION BY t ORDER BY {c}) + (count(*) OVER (PARTITION BY t, {c}) - 1) / 2.0)"
_IC = (
    _PAIRS
    + f""", ranked AS (SELECT t, {_AVG_RANK.format(c='score')} AS x, {_AVG_RANK.format(c='fwd')} AS y FROM pairs
), ic AS (SELECT t, coalesce(CASE WHEN stddev_pop(x) > 1e-10 AND stddev_pop(y) > 1e-10 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 0) AS ic, count(*) AS n FROM ranked GROUP BY t HAVING count(*) >= 10)"""
)


def quantise(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[(quantised(c).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c)) for c in df.columns if c not in keys])


def q(columns: dict[str, str]) -> str:
    return ", ".join(f"{quantised_sql(x)} AS {n}" for n, x in columns.items())


def panel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars = views.supplier_bars(spark, sf_dir)
    return expression.evaluate(bars, {"score": SIGNAL}), stats.forward_returns(bars)


def _pairs(spark, sf_dir):
    return stats.paired(*panel(spark, sf_dir))


def ic_series(spark, sf_dir):
    return quantise(stats.rank_ic(_pairs(spark, sf_dir)), "t")


def ic_ordinal(spark, sf_dir):
    return quantise(stats.rank_ic(_pairs(spark, sf_dir), ties="ordinal", least=5), "t")


def ic_summary(spark, sf_dir):
    return quantise(stats.ic_summary(stats.rank_ic(_pairs(spark, sf_dir))))


def ic_half_life(spark, sf_dir):
    return quantise(stats.half_life(stats.rank_ic(_pairs(spark, sf_dir))))


def ic_conditional(spark, sf_dir):
    market = returns(spark, sf_dir).groupBy("t").agg(F.avg("r").alias("r")).where("r is not null")
    return quantise(stats.conditional_ic(stats.rank_ic(_pairs(spark, sf_dir)), market), "regime")


def returns(spark, sf_dir) -> DataFrame:
    return views.supplier_bars(spark, sf_dir).select("asset", "t", factors.change(F.col("close")).alias("r"))


def group_low(spark, sf_dir):
    return quantise(stats.group_returns(_pairs(spark, sf_dir)), "group")


def group_top(spark, sf_dir):
    return quantise(stats.group_returns(_pairs(spark, sf_dir), top_first=True), "group")


def group_monotonicity(spark, sf_dir):
    return quantise(stats.monotonicity(stats.group_returns(_pairs(spark, sf_dir))))


def crowding(spark, sf_dir):
    """Mean absolute correlation over all pairs of brands (a fixed number)."""
    r = views.brand_bars(spark, sf_dir).select("asset", "t", factors.change(F.col("close")).alias("r"))
    return quantise(stats.pair_correlations(r, "r").agg(F.avg(F.abs("corr")).alias("crowding"), F.max("corr").alias("closest"), F.count(F.lit(1)).alias("pairs")))


def combination(spark, sf_dir):
    bars = views.supplier_bars(spark, sf_dir)
    wide = expression.evaluate(bars, {"mom": "zscore(sub(close, delay(close, 5)))", "gap": "zscore(sub(vwap, close))", "vol": "zscore(ts_std(close, 6))"})
    return quantise(stats.combine(wide, {"mom": 0.5, "gap": 0.3, "vol": -0.2}), "asset", "t")


def marginal(spark, sf_dir):
    """IC of an equal-weight combination of two factors, of one of them, and the difference."""
    bars = views.supplier_bars(spark, sf_dir)
    wide, fwd = expression.evaluate(bars, {"a": "zscore(sub(close, delay(close, 3)))", "b": "zscore(sub(vwap, close))"}), stats.forward_returns(bars)
    mean_ic = lambda w: stats.rank_ic(stats.paired(stats.combine(wide, w), fwd)).agg(F.avg("ic").alias("ic"))
    both, one = mean_ic({"a": 0.5, "b": 0.5}).withColumnRenamed("ic", "both"), mean_ic({"a": 1.0}).withColumnRenamed("ic", "one")
    return quantise(both.crossJoin(one).withColumn("gain", F.col("both") - F.col("one")))


def performance(spark, sf_dir):
    return quantise(stats.performance(returns(spark, sf_dir), periods=12), "asset", "n")


def return_moments(spark, sf_dir):
    return quantise(stats.parametric_var(stats.moments(returns(spark, sf_dir))), "asset", "n")


def tails(spark, sf_dir):
    return quantise(stats.tail_metrics(returns(spark, sf_dir)), "asset")


def ewma(spark, sf_dir):
    r = views.brand_bars(spark, sf_dir).select("asset", "t", factors.change(F.col("close")).alias("r"))
    return stats.ewma_covariance(r).select("a", "b", quantised("cov", 1e5).alias("cov"))


def attribution(spark, sf_dir):
    bars = views.supplier_bars(spark, sf_dir)
    last = bars.groupBy("asset").agg(F.max_by("close", "t").alias("c1"), F.min_by("close", "t").alias("c0"), F.max_by("volume", "t").alias("v"))
    w = last.crossJoin(F.broadcast(last.agg(F.sum("v").alias("total"))))
    held = w.join(views.supplier_industry(spark, sf_dir), "asset", "left").select("asset", "industry", (F.col("v") / F.col("total")).alias("weight"), (F.col("c1") / F.col("c0") - 1).alias("r"))
    return quantise(stats.brinson(held))


def bar_quality(spark, sf_dir):
    return stats.quality_report(views.supplier_bars(spark, sf_dir), jump=0.8)


def deflated(spark, sf_dir):
    """Probabilistic and deflated Sharpe ratio and track record length of each region's mean return: moments from Spark."""
    r = returns(spark, sf_dir).join(views.supplier_industry(spark, sf_dir), "asset").groupBy(F.col("sector").alias("asset"), "t").agg(F.avg("r").alias("r"))
    rows = stats.moments(r).collect()  # five regions
    out = []
    for m in rows:
        sharpe = m["mean"] / m["sd"] if m["sd"] else 0.0
        out.append((m["asset"], sharpe, stats.probabilistic_sharpe(sharpe, m["n"], m["skew"], m["kurt"]), stats.deflated_sharpe(sharpe, m["n"], m["skew"], m["kurt"], len(rows)), float(min(stats.minimum_track_record(sharpe, m["skew"], m["kurt"]), 1e9))))
    return spark.createDataFrame(out, "asset string, sharpe double, psr double, dsr double, track_record double")


def bootstrap(spark, sf_dir):
    return stats.bootstrap_var(returns(spark, sf_dir).groupBy("t").agg(F.avg("r").alias("r")))


_BRAND_R = "WITH " + views.SQL["brand_bars"] + f", r AS (SELECT asset, t, close / nullif(lag(close) {_S}, 0) - 1 AS r FROM bars)"
_R = _BARS + f", r AS (SELECT asset, t, close / nullif(lag(close) {_S}, 0) - 1 AS r FROM bars)"
_GUARD = "CASE WHEN stddev_pop({x}) > 1e-10 AND stddev_pop({y}) > 1e-10 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


def _z(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN CASE WHEN stddev_pop({x}) OVER (PARTITION BY t) > 1e-10 THEN (({x}) - avg({x}) OVER (PARTITION BY t)) / (stddev_pop({x}) OVER (PARTITION BY t) + 1e-10) ELSE 0.0 END END"


_GROUPS = "groups AS (SELECT g, avg(r) * 252 AS ret FROM (SELECT t, g, avg(fwd) AS r FROM placed GROUP BY ALL) GROUP BY g)"
_LOW = (
    _PAIRS
    + ", placed AS (SELECT t, fwd, CAST(least(floor((row_number() OVER (PARTITION BY t ORDER BY score, asset) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY t) - 1, 1) * 5), 4) AS INT) AS g FROM pairs QUALIFY count(*) OVER (PARTITION BY t) >= 5), "
    + _GROUPS
)


def _ic_of(score: str) -> str:
    return f"""(SELECT avg(ic) FROM (SELECT t, coalesce({_GUARD.format(x='x', y='y')}, 0) AS ic FROM (
      SELECT t, {_AVG_RANK.format(c='score')} AS x, {_AVG_RANK.format(c='fwd')} AS y FROM (SELECT t, {score} AS score, fwd FROM f WHERE ({score}) IS NOT NULL AND fwd IS NOT NULL)) GROUP BY t HAVING count(*) >= 10))"""


QUERIES = {
    "ic_series": ic_series,
    "ic_ordinal": ic_ordinal,
    "ic_summary": ic_summary,
    "ic_half_life": ic_half_life,
    "ic_conditional": ic_conditional,
    "group_returns": group_low,
    "group_returns_top": group_top,
    "group_monotonicity": group_monotonicity,
    "crowding": crowding,
    "factor_combination": combination,
    "marginal_contribution": marginal,
    "performance": performance,
    "return_moments": return_moments,
    "tail_metrics": tails,
    "ewma_covariance": ewma,
    "brinson_attribution": attribution,
    "bar_quality": bar_quality,
    "deflated_sharpe": deflated,
    "bootstrap_var": bootstrap,
}
ORACLE_SQL = {
    "ic_series": _IC + " SELECT t, " + q({"ic": "ic"}) + ", n FROM ic",
    "ic_ordinal": _PAIRS
    + """, ranked AS (SELECT t, row_number() OVER (PARTITION BY t ORDER BY score, asset)::DOUBLE AS x, row_number() OVER (PARTITION BY t ORDER BY fwd, asset)::DOUBLE AS y FROM pairs)
    SELECT t, """
    + q({"ic": f"coalesce({_GUARD.format(x='x', y='y')}, 0)"})
    + ", count(*) AS n FROM ranked GROUP BY t HAVING count(*) >= 5",
    "ic_summary": _IC + " SELECT " + q({"ic_mean": "avg(ic)", "ic_std": "stddev_samp(ic)", "icir": "avg(ic) / stddev_samp(ic)", "positive": "avg((ic > 0)::INT::DOUBLE)"}) + ", count(*) AS n_dates FROM ic",
    "ic_half_life": _IC
    + """, d AS (SELECT t, ic - (SELECT avg(ic) FROM ic) AS x FROM ic), e AS (SELECT x, lag(x) OVER (ORDER BY t) AS b FROM d), p AS (SELECT sum(x * b) / sum(b * b) AS phi FROM e)
    SELECT """
    + q({"phi": "phi", "half_life": "CASE WHEN phi > 0 AND phi < 1 THEN ln(0.5::DOUBLE) / ln(phi) ELSE 0.0 END"})
    + " FROM p",
    "ic_conditional": _IC
    + """, m AS (SELECT t, avg(r) AS r FROM s GROUP BY t HAVING avg(r) IS NOT NULL), v AS (SELECT t, stddev_pop(r) OVER (ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vol FROM m
    ), c AS (SELECT quantile_cont(vol, 1.0::DOUBLE / 3) AS lo, quantile_cont(vol, 2.0::DOUBLE / 3) AS hi FROM v)
    SELECT CASE WHEN vol <= lo THEN 'calm' WHEN vol <= hi THEN 'normal' ELSE 'stressed' END AS regime, """
    + q({"ic": "avg(ic)"})
    + ", count(*) AS n FROM ic JOIN v USING (t), c GROUP BY 1",
    "group_returns": _LOW + ' SELECT g AS "group", ' + q({"ret": "ret"}) + " FROM groups",
    "group_returns_top": _PAIRS
    + ", placed AS (SELECT t, fwd, 4 - CAST(least(floor((row_number() OVER (PARTITION BY t ORDER BY score, asset) - 1)::DOUBLE / count(*) OVER (PARTITION BY t) * 5), 4) AS INT) AS g FROM pairs), "
    + _GROUPS
    + ' SELECT g AS "group", '
    + q({"ret": "ret"})
    + " FROM groups",
    "group_monotonicity": _LOW
    + ", m AS (SELECT g, ret, (ret > lag(ret) OVER (ORDER BY g))::INT::DOUBLE AS rises FROM groups) SELECT "
    + q({"monotonicity": "coalesce(avg(rises), 0)", "spread": "arg_max(ret, g) - arg_min(ret, g)"})
    + " FROM m",
    "crowding": _BRAND_R
    + f", c AS (SELECT x.asset AS a, y.asset AS b, {_GUARD.format(x='x.r', y='y.r')} AS corr FROM r x JOIN r y ON x.t = y.t AND x.asset < y.asset AND x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY ALL HAVING count(*) >= 5) SELECT "
    + q({"crowding": "avg(abs(corr))", "closest": "max(corr)"})
    + ", count(*) AS pairs FROM c",
    "factor_combination": _BARS
    + f", a AS (SELECT *, close - lag(close, 5) {_S} AS d5, vwap - close AS gap, CASE WHEN row_number() {_S} >= 6 THEN stddev_pop(close) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) END AS sd6 FROM bars), z AS (SELECT asset, t, {_z('d5')} AS m, {_z('gap')} AS g, {_z('sd6')} AS v FROM a), w AS (SELECT *, coalesce(m * 0.5, 0) + coalesce(g * 0.3, 0) + coalesce(v * -0.2, 0) AS top, CASE WHEN m IS NOT NULL THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN g IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN v IS NOT NULL THEN -0.2::DOUBLE ELSE 0 END AS bottom FROM z) SELECT asset, t, "
    + q({"score": "CASE WHEN bottom <> 0 THEN top / bottom END"})
    + " FROM w",
    "marginal_contribution": _BARS
    + f", a AS (SELECT *, close - lag(close, 3) {_S} AS d3, vwap - close AS gap, lead(close) {_S} / close - 1 AS fwd FROM bars), z AS (SELECT t, fwd, {_z('d3')} AS a, {_z('gap')} AS b FROM a), f AS (SELECT t, fwd, a, (coalesce(a * 0.5, 0) + coalesce(b * 0.5, 0)) / ((a IS NOT NULL)::INT * 0.5::DOUBLE + 0.5) AS both_ FROM z), k AS (SELECT {_ic_of('both_')} AS b, {_ic_of('a')} AS o) SELECT "
    + q({"both": "b", "one": "o", "gain": "b - o"})
    + " FROM k",
    "performance": _R
    + """, e AS (SELECT *, product(1 + r) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING) AS equity FROM r WHERE r IS NOT NULL
    ), d AS (SELECT *, equity / greatest(max(equity) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING), 1.0) - 1 AS dd FROM e
    ), g AS (SELECT asset, pow(arg_max(equity, t), 12.0::DOUBLE / count(*)) - 1 AS ann, stddev_samp(r) AS sd, avg(r) AS m, sqrt(avg(pow(least(r, 0), 2))) AS down, min(dd) AS mdd, avg((r > 0)::INT::DOUBLE) AS hit, count(*) AS n FROM d GROUP BY asset)
    SELECT asset, n, """
    + q({"ann_return": "ann", "ann_vol": "sd * sqrt(12.0::DOUBLE)", "sharpe": "CASE WHEN sd > 1e-10 THEN m / sd * sqrt(12.0::DOUBLE) ELSE 0 END", "sortino": "CASE WHEN down > 1e-10 THEN m / down * sqrt(12.0::DOUBLE) ELSE 0 END", "max_drawdown": "mdd", "hit_rate": "hit", "calmar": "CASE WHEN mdd < -1e-10 THEN ann / -mdd ELSE 0 END"})
    + " FROM g",
    "return_moments": _R
    + """, m AS (SELECT asset, count(*) AS n, avg(r) AS mean, stddev_pop(r) AS sd FROM r WHERE r IS NOT NULL GROUP BY asset
    ), k AS (SELECT asset, n, mean, sd, coalesce(avg(pow((r - mean) / sd, 3)), 0) AS s, coalesce(avg(pow((r - mean) / sd, 4)), 3) AS k FROM r JOIN m USING (asset) WHERE r IS NOT NULL GROUP BY ALL), z AS (SELECT *, -1.6448536269514722::DOUBLE AS z FROM k)
    SELECT asset, n, """
    + q({"mean": "mean", "sd": "sd", "skew": "s", "kurt": "k", "var_normal": "-(mean + z * sd)", "var_cornish_fisher": "-(mean + (z + (z*z - 1) / 6 * s + (z*z*z - 3*z) / 24 * (k - 3) - (2*z*z*z - 5*z) / 36 * s * s) * sd)"})
    + " FROM z",
    "tail_metrics": _R
    + """, c AS (SELECT asset, quantile_cont(r, 0.05) AS p5, quantile_cont(r, 0.01) AS p1, min(r) AS worst, max(r) AS best FROM r WHERE r IS NOT NULL GROUP BY asset)
    SELECT asset, """
    + q({"var95": "-any_value(p5)", "var99": "-any_value(p1)", "cvar95": "-avg(r) FILTER (r <= p5)", "cvar99": "-avg(r) FILTER (r <= p1)", "worst": "any_value(worst)", "best": "any_value(best)"})
    + " FROM r JOIN c USING (asset) WHERE r IS NOT NULL GROUP BY asset",
    "ewma_covariance": _BRAND_R
    + """, w AS (SELECT t, pow(0.94::DOUBLE, dense_rank() OVER (ORDER BY t DESC) - 1) AS w FROM (SELECT DISTINCT t FROM r)), x AS (SELECT asset, t, w, r FROM r JOIN w USING (t) WHERE r IS NOT NULL
    ), d AS (SELECT asset, t, w, r - sum(w * r) OVER (PARTITION BY asset) / sum(w) OVER (PARTITION BY asset) AS d FROM x)
    SELECT p.asset AS a, q.asset AS b, """
    + quantised_sql("sum(p.w * p.d * q.d) / sum(p.w)", "1e5")
    + " AS cov FROM d p JOIN d q ON p.t = q.t AND p.asset <= q.asset GROUP BY ALL",
    "brinson_attribution": _BARS
    + ", "
    + views.SQL["industry"]
    + """, l AS (SELECT asset, arg_max(close, t) / arg_min(close, t) - 1 AS r, arg_max(volume, t) AS v FROM bars GROUP BY asset
    ), h AS (SELECT l.asset, industry, v / sum(v) OVER () AS w, r FROM l LEFT JOIN industry USING (asset)
    ), g AS (SELECT industry, count(*)::DOUBLE / (SELECT count(*) FROM h) AS wb, avg(r) AS rb, sum(w) AS wp, sum(w * r) / sum(w) AS rp FROM h GROUP BY industry)
    SELECT """
    + q({"allocation": "sum((wp - wb) * (rb - (SELECT sum(wb * rb) FROM g)))", "selection": "sum(wp * (rp - rb))", "coverage": "(SELECT avg((industry <> 'Unknown')::INT::DOUBLE) FROM h)"})
    + ", count(*) AS n_groups FROM g",
    "bar_quality": _R.replace("SELECT asset, t, close", "SELECT *, close")
    + " SELECT asset, count(*) AS n, count(*) FILTER (abs(r) > 0.8) AS n_jumps, count(*) FILTER (high < low) AS n_high_low, count(*) FILTER (close <= 0) AS n_bad_price, 0::BIGINT AS n_duplicates, count(*) FILTER (volume < 10) AS n_thin, min(t) AS first_t, max(t) AS last_t FROM r GROUP BY asset",
}
