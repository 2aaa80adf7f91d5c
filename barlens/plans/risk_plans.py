"""Queries of the risk model, regimes and models of returns; DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.columns import guarded_corr, quantised, quantised_sql
from barlens.operators import chains, evolution, expression, factors, risk, stats
from barlens.plans.stat_plans import _AVG_RANK, _BARS, _GUARD, _R, _S, q, quantise, returns
from barlens.sources import scratch, views

NAMES = ("mom20", "mom5", "vol20", "vol_ratio", "range")


def exposures(spark, sf_dir):
    return quantise(risk.style_exposures(views.supplier_bars(spark, sf_dir)), "asset")


def single_factor(spark, sf_dir):
    """Least-squares returns to momentum and an intercept, by date."""
    out = risk.factor_returns(returns(spark, sf_dir), risk.style_exposures(views.supplier_bars(spark, sf_dir)), ("momentum",))
    return out.select("t", "factor", quantised("ret").alias("ret"))


def factor_covariance(spark, sf_dir):
    bars = scratch.written(views.supplier_bars(spark, sf_dir), "bars")
    r = bars.select("asset", "t", factors.change(F.col("close")).alias("r"))
    # A few numbers a date, which are read several times.
    return risk.newey_west(scratch.written(risk.factor_returns(r, risk.style_exposures(bars), risk.STYLES), "factor-returns"))


def market_panel(spark, sf_dir) -> DataFrame:
    return risk.causal_market(views.supplier_bars(spark, sf_dir)).where("r is not null")


def active(spark, sf_dir):
    """Tracking error of the volume-weighted against the equal-weight portfolio."""
    r = returns(spark, sf_dir).join(views.supplier_bars(spark, sf_dir).select("asset", "t", "volume"), ["asset", "t"]).where("r is not null")
    d = r.groupBy("t").agg((F.sum(F.col("volume") * F.col("r")) / F.sum("volume")).alias("r"), F.avg("r").alias("benchmark"))
    return quantise(risk.tracking_error(d, 12))


def held_var(spark, sf_dir):
    w = views.supplier_bars(spark, sf_dir).groupBy("asset").agg(F.sum("volume").alias("v"))
    w = w.crossJoin(F.broadcast(w.agg(F.sum("v").alias("s")))).select("asset", (F.col("v") / F.col("s")).alias("weight"))
    return quantise(risk.portfolio_var(w, returns(spark, sf_dir)))


def overlays(spark, sf_dir):
    r = returns(spark, sf_dir)
    s = stats.performance(r, periods=12).join(stats.tail_metrics(r), "asset").select("asset", F.col("ann_vol").alias("vol"), F.col("max_drawdown").alias("drawdown"), F.col("cvar95").alias("cvar"))
    return quantise(risk.overlay(s, 3.0, 0.7, 0.8), "asset", "halt")


def regimes(spark, sf_dir):
    m = market_panel(spark, sf_dir)
    cut = m.agg(F.percentile("vol", 0.5).alias("median"))
    p = risk.rule_regimes(F.col("trend"), F.col("vol"), F.col("median"))
    return m.crossJoin(F.broadcast(cut)).select("t", *[quantised(c).alias(k) for k, c in p.items()])


def markov(spark, sf_dir):
    r = returns(spark, sf_dir).join(views.supplier_industry(spark, sf_dir), "asset").groupBy("sector", "t").agg(F.avg("r").alias("r"))
    return risk.markov_regimes(r, "sector")


REGIME_FEATURES = ("r", "turnover", "span")


def feature_rows(spark, sf_dir) -> DataFrame:
    """Log return, log change of volume and log span of the suppliers' bars, where all are there."""
    w = expression.series()
    b = views.supplier_bars(spark, sf_dir).select("asset", "t", F.log(F.col("close") / F.lag("close").over(w)).alias("r"), F.log(F.col("volume") / F.lag("volume").over(w)).alias("turnover"), F.log1p((F.col("high") - F.col("low")) / F.col("close")).alias("span"))
    return scratch.written(b.where("r IS NOT NULL AND turnover IS NOT NULL AND span IS NOT NULL"), "features")


def feature_regimes(spark, sf_dir):
    """States of one chain over three features that all suppliers share, at each of their bars."""
    rows = feature_rows(spark, sf_dir)
    return quantise(chains.decoded(rows, "asset", REGIME_FEATURES, chains.fit_chain(rows, "asset", REGIME_FEATURES, 3, 12)), "asset", "t", "state")


def current_regimes(spark, sf_dir):
    """Each supplier's regime of late: the state most of its last five bars were in."""
    rows = feature_rows(spark, sf_dir)
    return quantise(chains.current_regimes(chains.decoded(rows, "asset", REGIME_FEATURES, chains.fit_chain(rows, "asset", REGIME_FEATURES, 3, 12)), "asset"), "asset", "state", "n")


def _rows(spark, sf_dir) -> DataFrame:
    bars = views.supplier_bars(spark, sf_dir)
    return risk.training_rows(factors.model_features(bars), stats.forward_returns(bars), NAMES, 2, 0.7)


def _written_rows(spark, sf_dir) -> DataFrame:
    """The same for models, which read them more than once."""
    return scratch.written(_rows(spark, sf_dir), "training")


def dataset(spark, sf_dir):
    return _rows(spark, sf_dir).groupBy("train", "test").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), quantised(F.avg("fwd")).alias("fwd"))


def ridge_ic(spark, sf_dir):
    rows = _written_rows(spark, sf_dir)
    scored = risk.linear_score(rows.where("test"), risk.ridge(rows.where("train"), NAMES))
    return stats.rank_ic(scored)


def forest_ic(spark, sf_dir):
    return stats.rank_ic(risk.tree_scores(_written_rows(spark, sf_dir), NAMES))


def ics_of(spark, sf_dir) -> DataFrame:
    """(t, factor, ic) of three factors."""
    bars = views.supplier_bars(spark, sf_dir)
    fwd = stats.forward_returns(bars)
    wide = expression.evaluate(bars, {"mom": "sub(close, delay(close, 3))", "gap": "sub(vwap, close)", "vol": "volume"})
    ics = None
    for f in ("mom", "gap", "vol"):
        one = stats.rank_ic(stats.paired(wide.select("asset", "t", F.col(f).alias("score")), fwd)).select("t", F.lit(f).alias("factor"), quantised("ic").alias("ic"))
        ics = one if ics is None else ics.unionByName(one)
    return ics


def experts(spark, sf_dir):
    """Gate weights of three factors from their past ICs."""
    return quantise(risk.expert_weights(ics_of(spark, sf_dir)), "t", "factor")


def pool(spark, sf_dir):
    """Greedy pool of candidate factors by IC and correlation."""
    bars = views.supplier_bars(spark, sf_dir)
    fwd = stats.forward_returns(bars)
    exprs = {"a": "sub(close, delay(close, 1))", "b": "sub(close, delay(close, 2))", "c": "sub(vwap, close)", "d": "volume", "e": "ts_std(close, 6)"}
    wide = expression.evaluate(bars, {k: f"rank({e})" for k, e in exprs.items()})
    stacked = wide.join(fwd, ["asset", "t"]).select("t", "fwd", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("score")) for k in exprs])).alias("x")).select("t", "fwd", "x.*")
    of = lambda c: expression.tied_rank(Window.partitionBy("name", "t"), c)
    ranked = stacked.where("score is not null and fwd is not null").select("name", "t", of("score").alias("x"), of("fwd").alias("y"))
    ic = ranked.groupBy("name", "t").agg(F.coalesce(guarded_corr(F.col("x"), F.col("y")), F.lit(0.0)).alias("ic"), F.count(F.lit(1)).alias("n")).where("n >= 10")
    ics = dict(ic.groupBy("name").agg(F.avg("ic")).collect())
    pairs = [(a, b) for a in exprs for b in exprs if a < b]
    corr = wide.groupBy("t").agg(*[stats.guarded_corr(F.col(a), F.col(b)).alias(f"{a}{b}") for a, b in pairs]).agg(*[F.avg(f"{a}{b}").alias(f"{a}{b}") for a, b in pairs]).first()
    chosen = risk.greedy_pool(ics, {(a, b): corr[f"{a}{b}"] or 0.0 for a, b in pairs}, 3, 0.5)
    return spark.createDataFrame([(i, k, exprs[k], float(ics[k])) for i, k in enumerate(chosen)], "place int, name string, expression string, ic double")


def evolved(spark, sf_dir):
    bars = views.brand_bars(spark, sf_dir).cache()
    found = evolution.evolve(bars, stats.forward_returns(bars), size=10, generations=2)
    bars.unpersist()
    return spark.createDataFrame([(i, e, f) for i, (e, f) in enumerate(found[:5])], "place int, expression string, fitness double")


_X = (
    _BARS
    + f""", a AS (SELECT *, close / nullif(lag(close) {_S}, 0) - 1 AS r, close / nullif(lag(close, 20) {_S}, 0) - 1 AS mom, row_number() OVER (PARTITION BY asset ORDER BY t DESC) AS n FROM bars
), x AS (SELECT asset, max(mom) FILTER (n = 1) AS momentum, stddev_pop(r) FILTER (n <= 20) AS volatility, ln(1 + max(amount) FILTER (n = 1)) AS size, ln(1 + avg(volume) FILTER (n <= 20)) AS liquidity FROM a GROUP BY asset
), e AS (SELECT asset, {', '.join(f'coalesce(CASE WHEN stddev_pop({c}) OVER () > 1e-10 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END, 0) AS {c}' for c in risk.STYLES)} FROM x)"""
)
_MK = _R + ", m0 AS (SELECT t, avg(r) AS r FROM r GROUP BY t), m AS (SELECT * FROM (SELECT t, r, avg(r) OVER w AS trend, stddev_pop(r) OVER w AS vol FROM m0 WINDOW w AS (ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) WHERE r IS NOT NULL)"
_KEEP = repr(0.5 ** (1 / 6))


def _ic_sql(name: str, score: str) -> str:
    return f"SELECT t, '{name}' AS factor, floor(coalesce({_GUARD.format(x='x', y='y')}, 0) * 1e4 + 0.5) / 1e4 AS ic FROM (SELECT t, {_AVG_RANK.format(c='score')} AS x, {_AVG_RANK.format(c='fwd')} AS y FROM (SELECT t, {score} AS score, fwd FROM z WHERE ({score}) IS NOT NULL AND fwd IS NOT NULL)) GROUP BY t HAVING count(*) >= 10"


QUERIES = {
    "style_exposures": exposures,
    "factor_returns": single_factor,
    "factor_covariance": factor_covariance,
    "tracking_error": active,
    "portfolio_var": held_var,
    "risk_overlay": overlays,
    "rule_regimes": regimes,
    "markov_regimes": markov,
    "feature_regimes": feature_regimes,
    "current_regimes": current_regimes,
    "training_rows": dataset,
    "ridge_ic": ridge_ic,
    "forest_ic": forest_ic,
    "expert_weights": experts,
    "greedy_pool": pool,
    "evolved_factors": evolved,
}
ORACLE_SQL = {
    "style_exposures": _X + " SELECT asset, " + q({c: c for c in risk.STYLES}) + " FROM e",
    "factor_returns": _X
    + """, j AS (SELECT t, r, momentum AS x FROM a JOIN e USING (asset) WHERE r IS NOT NULL), s AS (SELECT t, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(r) AS sy, sum(x * r) AS sxy FROM j GROUP BY t
    ), b AS (SELECT t, (sxy * n - sx * sy) / (sxx * n - sx * sx) AS b, sx, sy, n FROM s) SELECT t, unnest(['market', 'momentum']) AS factor, """
    + f"unnest([{quantised_sql('(sy - b * sx) / n')}, {quantised_sql('b')}]) AS ret FROM b",
    "tracking_error": _R.replace("SELECT asset, t, close", "SELECT asset, t, volume, close")
    + ", d AS (SELECT t, sum(volume * r) / sum(volume) - avg(r) AS a FROM r WHERE r IS NOT NULL GROUP BY t) SELECT "
    + q({"tracking_error": "stddev_pop(a) * sqrt(12.0::DOUBLE)"})
    + " FROM d",
    "portfolio_var": _R
    + ", w AS (SELECT asset, sum(volume) / (SELECT sum(volume) FROM bars) AS w FROM bars GROUP BY asset), p AS (SELECT t, sum(w * r) AS r FROM r JOIN w USING (asset) WHERE r IS NOT NULL GROUP BY t), c AS (SELECT quantile_cont(r, 0.05) AS c FROM p) SELECT "
    + q({"var": "-max(c)", "cvar": "-avg(r) FILTER (r <= c)"})
    + " FROM p, c",
    "risk_overlay": _R
    + """, e AS (SELECT *, product(1 + r) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING) AS equity FROM r WHERE r IS NOT NULL
    ), d AS (SELECT *, equity / greatest(max(equity) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING), 1.0) - 1 AS dd, quantile_cont(r, 0.05) OVER (PARTITION BY asset) AS p5 FROM e
    ), g AS (SELECT asset, stddev_samp(r) * sqrt(12.0::DOUBLE) AS vol, min(dd) AS drawdown, -avg(r) FILTER (r <= p5) AS cvar FROM d GROUP BY asset
    ), b AS (SELECT *, vol / 3.0::DOUBLE AS b1, -drawdown / 0.7::DOUBLE AS b2, cvar / 0.8::DOUBLE AS b3 FROM g)
    SELECT asset, b1 > 2 OR b2 > 2 OR b3 > 2 AS halt, """
    + q({"vol": "vol", "drawdown": "drawdown", "cvar": "cvar", "multiplier": "CASE WHEN b1 > 2 OR b2 > 2 OR b3 > 2 THEN 0.0 ELSE " + " * ".join(f"CASE WHEN {b} > 1 THEN greatest(0.25, 1 / {b}) ELSE 1.0 END" for b in ("b1", "b2", "b3")) + " END"})
    + " FROM b",
    "rule_regimes": _MK
    + ", k AS (SELECT t, greatest(trend * 10, 0) AS bull, greatest(-trend * 10, 0) AS bear, greatest(1 - abs(trend) * 10, 0.1) AS rng, greatest(vol / (SELECT quantile_cont(vol, 0.5) FROM m) - 1.2::DOUBLE, 0) AS stress FROM m) SELECT t, "
    + q({"bull": "bull / (bull + bear + rng + stress)", "bear": "bear / (bull + bear + rng + stress)", '"range"': "rng / (bull + bear + rng + stress)", "stress": "stress / (bull + bear + rng + stress)"})
    + " FROM k",
    "training_rows": _BARS
    + f""", cal AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS idx FROM (SELECT DISTINCT t FROM bars)), f AS (SELECT asset, t, lead(close) {_S} / close - 1 AS fwd FROM bars), c AS (SELECT floor(max(idx) * 0.7::DOUBLE) AS cut FROM cal)
    SELECT idx < cut - 2 AS train, idx >= cut AS test, count(*) AS n, min(t) AS first, max(t) AS last, """
    + q({"fwd": "avg(fwd)"})
    + " FROM f JOIN cal USING (t), c WHERE fwd IS NOT NULL GROUP BY 1, 2",
    "expert_weights": _BARS
    + f""", z AS (SELECT asset, t, close - lag(close, 3) {_S} AS mom, vwap - close AS gap, volume AS vol, lead(close) {_S} / close - 1 AS fwd FROM bars
    ), i AS ({_ic_sql('mom', 'mom')} UNION ALL {_ic_sql('gap', 'gap')} UNION ALL {_ic_sql('vol', 'vol')}
    ), p AS (SELECT t, factor, coalesce(list(ic) OVER (PARTITION BY factor ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS past FROM i
    ), g AS (SELECT t, factor, exp(CASE WHEN len(past) > 0 THEN list_reduce(list_prepend(0.0::DOUBLE, past), lambda a, x: a * {_KEEP}::DOUBLE + x) / list_reduce(list_prepend(0.0::DOUBLE, past), lambda a, x: a * {_KEEP}::DOUBLE + 1) ELSE 0 END * 20) AS e FROM p)
    SELECT t, factor, """
    + q({"weight": "e / sum(e) OVER (PARTITION BY t)"})
    + " FROM g",
}
