"""Queries of weights and back-tests over the supplier and brand panels, with DuckDB twins where the operator is set-based."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.functions.columns import quantised, quantised_sql
from barlens.operators import backtest, expression, factors, portfolio, risk, stats, structured
from barlens.plans.risk_plans import _X
from barlens.plans.stat_plans import _BARS, _IC, _PAIRS, _R, _S, panel, q, quantise, returns
from barlens.sources import views


def _scored(spark, sf_dir) -> DataFrame:
    """(asset, t, score, r) of the suppliers: r is the return of the bar itself."""
    signal, _ = panel(spark, sf_dir)
    return signal.join(returns(spark, sf_dir), ["asset", "t"])


def _last_vols(spark, sf_dir) -> DataFrame:
    return returns(spark, sf_dir).groupBy("asset").agg(F.stddev_samp("r").alias("vol"))


def _held(spark, sf_dir) -> DataFrame:
    """(asset, industry, weight, beta) of the suppliers, weights by volume."""
    bars = views.supplier_bars(spark, sf_dir).groupBy("asset").agg(F.sum("volume").alias("v"), F.avg("close").alias("c"))
    s = bars.agg(F.sum("v").alias("s"), F.avg("c").alias("m"))
    return bars.join(views.supplier_industry(spark, sf_dir), "asset").crossJoin(F.broadcast(s)).select("asset", "industry", (F.col("v") / F.col("s")).alias("weight"), (F.col("c") / F.col("m")).alias("beta"))


def score_weighted(spark, sf_dir):
    return quantise(portfolio.score_weights(panel(spark, sf_dir)[0].withColumn("score", F.col("score") - 0.5)), "t", "asset")


def inverse_vol(spark, sf_dir):
    return portfolio.inverse_volatility(_last_vols(spark, sf_dir)).select("asset", quantised("weight", 1e6).alias("weight"))


def neutral_groups(spark, sf_dir):
    d = portfolio.neutral_by_group(_held(spark, sf_dir), "industry", 0.02)
    return d.select("asset", "industry", quantised("weight", 1e6).alias("weight"))


def capped_groups(spark, sf_dir):
    return portfolio.cap_groups(_held(spark, sf_dir), "industry", 0.04).select("asset", "industry", quantised("weight", 1e6).alias("weight"))


def beta_neutral(spark, sf_dir):
    return portfolio.neutral_to(_held(spark, sf_dir), "beta").select("asset", quantised("weight", 1e6).alias("weight"))


def regime_routed(spark, sf_dir):
    h = _held(spark, sf_dir)
    rows = h.select("asset", F.lit("bull").alias("regime"), "weight").union(h.select("asset", F.lit("bear"), F.lit(0.01))).union(h.select("asset", F.lit("range"), F.col("beta") / 100))
    return portfolio.routed(rows, {"bull": 0.5, "bear": 0.3, "range": 0.2}).select("asset", quantised("weight", 1e6).alias("weight"))


def concentrations(spark, sf_dir):
    w = portfolio.score_weights(panel(spark, sf_dir)[0].withColumn("score", F.col("score") - 0.5))
    return quantise(portfolio.concentration(w, "t").join(portfolio.turnover(w), "t"), "t")


def rebalance(spark, sf_dir):
    return backtest.rebalanced(_scored(spark, sf_dir), 10, 3, 17.0).select("t", *[quantised(c, 1e6).alias(c) for c in ("gross", "cost", "net")])


def walk_forward(spark, sf_dir):
    return quantise(backtest.walk_forward(_scored(spark, sf_dir), 24, 6, 6, 10), "window", "n")


def cpcv(spark, sf_dir):
    return quantise(backtest.combinatorial_paths(_scored(spark, sf_dir)), "combo", "n")


def long_short(spark, sf_dir):
    return quantise(backtest.long_short(stats.paired(*panel(spark, sf_dir))), "t")


def turnover_of_ranks(spark, sf_dir):
    signal, _ = panel(spark, sf_dir)
    other = expression.evaluate(views.supplier_bars(spark, sf_dir), {"score": "rank(sub(vwap, delay(vwap, 3)))"})
    return quantise(backtest.rank_turnover(signal).crossJoin(backtest.redundancy(signal, other)))


def scenario(spark, sf_dir):
    m = returns(spark, sf_dir).groupBy("t").agg(F.avg("r").alias("r"))
    return quantise(backtest.stressed(m, [("crash", -0.2, 2.0, 5), ("grind", -0.1, 1.0, 20), ("rally", 0.1, 1.5, 10)]), "scenario")


def stress_windows(spark, sf_dir):
    m = returns(spark, sf_dir).groupBy("t").agg(F.avg("r").alias("r"))
    return quantise(backtest.windows_report(m, [("first", "1995-03-01", "1995-12-01"), ("mid", "1998-01-01", "1998-12-31"), ("none", "2030-01-01", "2030-02-01")]), "window", "n")


def purged_ic(spark, sf_dir):
    """Mean rank-IC of each purged test range."""
    ic = backtest.numbered(stats.rank_ic(stats.paired(*panel(spark, sf_dir))))
    splits = backtest.purged_splits(79, 12, 2, 24, 1)
    table = spark.createDataFrame([(k, a, b) for k, (_, a, b) in enumerate(splits)], "split int, a int, b int")
    j = ic.join(F.broadcast(table), (F.col("idx") >= F.col("a")) & (F.col("idx") < F.col("b")))
    return quantise(j.groupBy("split").agg(F.avg("ic").alias("ic"), F.count(F.lit(1)).alias("n")), "split", "n")


def path_fold(spark, sf_dir):
    grid = spark.createDataFrame([("fast", 5, 1, 17.0, 0.8), ("slow", 10, 6, 17.0, 0.8), ("free", 10, 6, 0.0, 9.0)], "strategy string, n_hold int, every int, cost_bps double, limit double")
    p = _scored(spark, sf_dir)
    return backtest.path_backtest(p, grid)


def _structure(spark, sf_dir, factors_: tuple[str, ...] = ("momentum",)) -> structured.Structure:
    bars = views.supplier_bars(spark, sf_dir)
    r = bars.select("asset", "t", factors.change(F.col("close")).alias("r"))
    s = structured.structure_of(r, risk.style_exposures(bars), factors_)
    return s.with_column("alpha", r.where("r is not null").groupBy("asset").agg(F.avg("r").alias("alpha")))


def inverse_weights(spark, sf_dir):
    """All suppliers by the inverse of their covariance under market and momentum, times their mean return."""
    w = structured.inverse_weights(_structure(spark, sf_dir))
    return w.crossJoin(F.broadcast(w.agg(F.sum("w").alias("s")))).select("asset", quantised(F.try_divide("w", "s"), 1e8).alias("weight"))


def structured_weights(spark, sf_dir):
    """Weights of all suppliers by four schemes under a structure of market, momentum and volatility."""
    s = _structure(spark, sf_dir, ("momentum", "volatility"))
    s = s.with_column("posterior", structured.black_litterman(s.with_column("prior", s.assets.select("asset", F.lit(0.0).alias("prior"))), "prior", "alpha").withColumnRenamed("mean", "posterior"))
    schemes = {"mean_variance": structured.mean_variance(s, "alpha", cap=0.05), "black_litterman": structured.mean_variance(s, "posterior", cap=0.05), "min_variance": structured.mean_variance(s), "risk_budget": structured.risk_budget(s)}
    out = None
    for name, w in schemes.items():
        one = w.select(F.lit(name).alias("scheme"), "asset", quantised("w", 1e6).alias("weight"))
        out = one if out is None else out.unionByName(one)
    return out


def optimised(spark, sf_dir):
    """Weights of the 25 brands by five schemes on their covariance: a block of 25 by 25 on the driver."""
    r = views.brand_bars(spark, sf_dir).select("asset", "t", factors.change(F.col("close")).alias("r"))
    names, cov = portfolio.matrix_of(stats.ewma_covariance(r))
    cov = portfolio.nearest_psd(cov)
    mu = dict(r.groupBy("asset").agg(F.avg("r")).collect())
    m = np.array([mu[n] for n in names])
    schemes = {
        "mean_variance": portfolio.mean_variance(m, cov, cap=0.2),
        "risk_budget": portfolio.risk_budget(cov),
        "black_litterman": portfolio.mean_variance(portfolio.black_litterman(np.zeros(len(m)), cov, m), cov, cap=0.2),
        "hrp": portfolio.hierarchical_risk_parity(cov),
        "min_variance": portfolio.mean_variance(np.zeros(len(m)), cov),
    }
    return spark.createDataFrame([(s, n, float(x)) for s, w in schemes.items() for n, x in zip(names, w, strict=True)], "scheme string, asset string, weight double")


def synthetic(spark, sf_dir):
    """A random walk for each supplier on each date on which an order is placed."""
    assets = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset"))
    # A calendar of some thousand dates, whatever the size of the tables.
    calendar = views.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("t")).distinct()
    days = backtest.dealt_assets(assets, assets.count()).crossJoin(F.broadcast(calendar)).withColumn("day", F.datediff("t", F.lit("1990-01-01").cast("date")))
    return backtest.synthetic_walks(days)


_HELD = (
    _BARS
    + ", "
    + views.SQL["industry"]
    + ", b AS (SELECT asset, sum(volume) AS v, avg(close) AS c FROM bars GROUP BY asset), h AS (SELECT asset, industry, v / (SELECT sum(v) FROM b) AS w, c / (SELECT avg(c) FROM b) AS beta FROM b JOIN industry USING (asset))"
)
_SW = _PAIRS + ", u AS (SELECT t, asset, greatest(score - 0.5::DOUBLE, 0) AS s0 FROM s WHERE score IS NOT NULL), w AS (SELECT t, asset, CASE WHEN sum(s0) OVER (PARTITION BY t) > 0 THEN s0 / sum(s0) OVER (PARTITION BY t) ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY t) END AS w FROM u)"
_NUM = _PAIRS + ", cal AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS idx FROM (SELECT DISTINCT t FROM s)), p AS (SELECT s.*, idx FROM s JOIN cal USING (t))"
_M = _R + ", m AS (SELECT t, avg(r) AS r FROM r GROUP BY t HAVING avg(r) IS NOT NULL)"

_INVERSE = (
    _X
    + """, j AS (SELECT asset, t, r, momentum AS x FROM a JOIN e USING (asset) WHERE r IS NOT NULL
), b AS (SELECT t, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(r) AS sy, sum(x * r) AS sxy FROM j GROUP BY t
), f AS (SELECT t, (sxy * n - sx * sy) / (sxx * n - sx * sx) AS f1, (sy - (sxy * n - sx * sy) / (sxx * n - sx * sx) * sx) / n AS f0 FROM b
), c AS (SELECT var_pop(f0) AS c00, covar_pop(f0, f1) AS c01, var_pop(f1) AS c11 FROM f
), o AS (SELECT asset, any_value(x) AS x, greatest(var_pop(r - f0 - f1 * x), 1e-8) + 1e-6 AS d, avg(r) AS alpha FROM j JOIN f USING (t) GROUP BY asset
), s AS (SELECT sum(1 / d) AS s00, sum(x / d) AS s01, sum(x * x / d) AS s11, sum(alpha / d) AS v0, sum(x * alpha / d) AS v1 FROM o
), m AS (SELECT 1 + c00 * s00 + c01 * s01 AS m00, c00 * s01 + c01 * s11 AS m01, c01 * s00 + c11 * s01 AS m10, 1 + c01 * s01 + c11 * s11 AS m11, c00 * v0 + c01 * v1 AS u0, c01 * v0 + c11 * v1 AS u1 FROM c, s
), z AS (SELECT (u0 * m11 - m01 * u1) / (m00 * m11 - m01 * m10) AS z0, (m00 * u1 - m10 * u0) / (m00 * m11 - m01 * m10) AS z1 FROM m
), w AS (SELECT asset, greatest((alpha - z0 - z1 * x) / d, 0) AS w FROM o, z) SELECT asset, """
    + f"{quantised_sql('w / sum(w) OVER ()', '1e8')} AS weight FROM w"
)
QUERIES = {
    "score_weights": score_weighted,
    "inverse_volatility": inverse_vol,
    "group_neutral": neutral_groups,
    "group_caps": capped_groups,
    "beta_neutral": beta_neutral,
    "regime_routed": regime_routed,
    "concentration": concentrations,
    "rebalanced_backtest": rebalance,
    "walk_forward": walk_forward,
    "combinatorial_paths": cpcv,
    "long_short": long_short,
    "rank_turnover": turnover_of_ranks,
    "stress_scenarios": scenario,
    "stress_windows": stress_windows,
    "purged_ic": purged_ic,
    "path_backtest": path_fold,
    "optimised_weights": optimised,
    "inverse_weights": inverse_weights,
    "structured_weights": structured_weights,
    "synthetic_bars": synthetic,
}


def _q6(columns: dict[str, str]) -> str:
    from barlens.functions.columns import quantised_sql

    return ", ".join(f"{quantised_sql(x, '1e6')} AS {n}" for n, x in columns.items())


_SH = "CASE WHEN stddev_samp(r) > 1e-10 THEN avg(r) / stddev_samp(r) END"
ORACLE_SQL = {
    "inverse_weights": _INVERSE,
    "score_weights": _SW + " SELECT t, asset, " + q({"weight": "w"}) + " FROM w",
    "inverse_volatility": _R
    + ", v AS (SELECT asset, stddev_samp(r) AS vol FROM r GROUP BY asset), i AS (SELECT asset, 1 / greatest(coalesce(vol, (SELECT quantile_cont(vol, 0.5) FROM v)), 0.01) AS inv FROM v) SELECT asset, "
    + _q6({"weight": "inv / sum(inv) OVER ()"})
    + " FROM i",
    "group_neutral": _HELD
    + ", n AS (SELECT asset, industry, least(w / sum(w) OVER (PARTITION BY industry) / (SELECT count(DISTINCT industry) FROM h), 0.02::DOUBLE) AS raw FROM h) SELECT asset, industry, "
    + _q6({"weight": "raw / sum(raw) OVER ()"})
    + " FROM n",
    "group_caps": _HELD + " SELECT asset, industry, " + _q6({"weight": "w * least(1, 0.04::DOUBLE / sum(w) OVER (PARTITION BY industry))"}) + " FROM h",
    "beta_neutral": _HELD + " SELECT asset, " + _q6({"weight": "w - (SELECT sum(w * beta) / sum(beta * beta) FROM h) * beta"}) + " FROM h",
    "regime_routed": _HELD + " SELECT asset, " + _q6({"weight": "0.5::DOUBLE * w + 0.3::DOUBLE * 0.01::DOUBLE + 0.2::DOUBLE * (beta / 100)"}) + " FROM h",
    "concentration": _SW
    + """, cal AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM w)), x AS (SELECT k, asset, w FROM w JOIN cal USING (t)
    ), j AS (SELECT coalesce(a.k, b.k + 1) AS k, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) / 2 AS turnover FROM x a FULL JOIN x b ON a.asset = b.asset AND a.k = b.k + 1 GROUP BY 1
    ), c AS (SELECT t, 1 / sum(w * w) AS effective_n, max(w) AS largest, sum(abs(w)) AS gross FROM w GROUP BY t) SELECT t, """
    + q({x: x for x in ("effective_n", "largest", "gross", "turnover")})
    + " FROM c JOIN cal USING (t) JOIN j USING (k)",
    "rebalanced_backtest": _NUM
    + """, h AS (SELECT idx // 3 AS period, asset, 1.0::DOUBLE / count(*) OVER (PARTITION BY idx) AS w FROM (SELECT * FROM p WHERE idx % 3 = 0 AND score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY idx ORDER BY score DESC, asset) <= 10)
    ), g AS (SELECT h.period, t, idx, sum(w * coalesce(r, 0)) AS gross FROM p JOIN h ON p.asset = h.asset AND (idx - 1) // 3 = h.period WHERE idx > 0 GROUP BY ALL
    ), m AS (SELECT coalesce(a.period, b.period + 1) AS period, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) AS moved FROM h a FULL JOIN h b ON a.asset = b.asset AND a.period = b.period + 1 GROUP BY 1
    ), c AS (SELECT t, gross, CASE WHEN idx = period * 3 + 1 THEN moved * 17.0::DOUBLE / 1e4 ELSE 0 END AS cost FROM g JOIN m USING (period)) SELECT t, """
    + _q6({"gross": "gross", "cost": "cost", "net": "gross - cost"})
    + " FROM c",
    "walk_forward": _NUM
    + """, win AS (SELECT unnest(generate_series(0, (SELECT (max(idx) + 1 - 30) // 6 FROM p))) AS w), i AS (SELECT w, p.*, idx >= w * 6 + 24 AS oos FROM p JOIN win ON idx >= w * 6 AND idx < w * 6 + 30
    ), b AS (SELECT w, asset FROM (SELECT w, asset, avg(score) AS s FROM i WHERE NOT oos GROUP BY ALL HAVING avg(score) IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY w ORDER BY s DESC, asset) <= 10
    ), d AS (SELECT w, oos, idx, avg(coalesce(r, 0)) AS r FROM i JOIN b USING (w, asset) GROUP BY ALL
    ), g AS (SELECT w, oos, """
    + _SH
    + ' AS sh, count(*) AS n FROM d GROUP BY ALL) SELECT w::INT AS "window", sum(n)::BIGINT AS n, '
    + q({"is_sharpe": "max(sh) FILTER (NOT oos)", "oos_sharpe": "max(sh) FILTER (oos)"})
    + " FROM g GROUP BY w",
    "combinatorial_paths": _NUM
    + """, n AS (SELECT max(idx) + 1 AS n FROM p), k AS (SELECT unnest(generate_series(0, 5)) AS k), e AS (SELECT k, k * (n // 6) + least(k, n % 6) AS a, (k + 1) * (n // 6) + least(k + 1, n % 6) AS b FROM k, n
    ), c AS (SELECT row_number() OVER (ORDER BY x.k, y.k) - 1 AS combo, x.a AS a1, x.b AS b1, y.a AS a2, y.b AS b2 FROM e x JOIN e y ON x.k < y.k
    ), m AS (SELECT combo, p.*, (idx >= a1 AND idx < b1) OR (idx >= a2 AND idx < b2) AS test, (idx >= a1 - 1 AND idx < b1 + 1) OR (idx >= a2 - 1 AND idx < b2 + 1) AS near FROM p, c
    ), b AS (SELECT combo, asset FROM (SELECT combo, asset, avg(score) AS s FROM m WHERE NOT near GROUP BY ALL HAVING avg(score) IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY combo ORDER BY s DESC, asset) <= 10
    ), d AS (SELECT combo, idx, avg(coalesce(r, 0)) AS r FROM m JOIN b USING (combo, asset) WHERE test GROUP BY ALL) SELECT combo::INT AS combo, count(*) AS n, """
    + q({"sharpe": _SH})
    + " FROM d GROUP BY combo",
    "long_short": _PAIRS
    + ", c AS (SELECT t, quantile_cont(score, 0.8) AS hi, quantile_cont(score, 0.2) AS lo FROM pairs GROUP BY t) SELECT t, "
    + q({"r": "avg(fwd) FILTER (score >= hi) - avg(fwd) FILTER (score <= lo)"})
    + " FROM pairs JOIN c USING (t) GROUP BY t",
    "rank_turnover": _PAIRS.replace("close - lag(close, 3)", "vwap - lag(vwap, 3) " + _S + " AS v3, close - lag(close, 3)")
    + ", o AS (SELECT asset, t, CASE WHEN v3 IS NOT NULL AND count(v3) OVER (PARTITION BY t) > 1 THEN (row_number() OVER (PARTITION BY t ORDER BY v3 NULLS LAST, asset) - 1)::DOUBLE / (count(v3) OVER (PARTITION BY t) - 1) END AS other FROM a), d AS (SELECT abs(score - lag(score) OVER (PARTITION BY asset ORDER BY t)) AS d FROM s), c AS (SELECT t, CASE WHEN count(x) >= 3 AND stddev_pop(x) > 1e-10 AND stddev_pop(y) > 1e-10 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS c FROM (SELECT t, CASE WHEN other IS NOT NULL THEN score END AS x, CASE WHEN score IS NOT NULL THEN other END AS y FROM s JOIN o USING (asset, t)) GROUP BY t) SELECT "
    + q({"turnover": "(SELECT avg(d) FROM d)", "mean": "(SELECT avg(c) FROM c)", "strength": "abs((SELECT avg(c) FROM c))"}),
    "stress_scenarios": _M
    + ", sc AS (SELECT * FROM (VALUES ('crash', -0.2::DOUBLE, 2.0::DOUBLE, 5), ('grind', -0.1, 1.0, 20), ('rally', 0.1, 1.5, 10)) v(scenario, shock, mult, days)), k AS (SELECT *, row_number() OVER (ORDER BY t) AS k, avg(r) OVER () AS mean FROM m), x AS (SELECT scenario, least(greatest(shock / days + (r - mean) * mult, -0.95::DOUBLE), 1.0) AS x FROM k, sc WHERE k <= days) SELECT scenario, "
    + q({"pnl": "product(1 + x) - 1", "worst": "min(x)"})
    + " FROM x GROUP BY scenario",
    "stress_windows": _M
    + ", w AS (SELECT * FROM (VALUES ('first', DATE '1995-03-01', DATE '1995-12-01'), ('mid', DATE '1998-01-01', DATE '1998-12-31')) v(win, a, b)) SELECT win AS \"window\", count(*) AS n, "
    + q({"ret": "product(1 + r) - 1"})
    + " FROM m JOIN w ON t BETWEEN a AND b GROUP BY win",
    "purged_ic": _IC
    + ", k AS (SELECT ic, row_number() OVER (ORDER BY t) - 1 AS idx FROM ic), sp AS (SELECT unnest(generate_series(0, 4)) AS split), z AS (SELECT split, ic FROM k JOIN sp ON idx >= 27 + split * 12 AND idx < least(27 + (split + 1) * 12, 79)) SELECT split::INT AS split, count(*) AS n, "
    + q({"ic": "avg(ic)"})
    + " FROM z GROUP BY split",
}
