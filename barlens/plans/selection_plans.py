"""Queries of factor selection, residual IC, expanding ridge, capped weights and their schedule, with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlens.functions.columns import quantised
from barlens.operators import ensemble, expression, orders, refinery, research, risk, screening, selection, stats
from barlens.plans.order_plans import _HELD, MONEY, _held
from barlens.plans.risk_plans import _X
from barlens.plans.stat_plans import _AVG_RANK, _BARS, _GUARD, _R, _S, _z, panel, q, quantise
from barlens.sources import scratch, versions, views
from barlens.streaming.runtime import checkpoint_root

#: Candidates with their SQL.
CANDIDATES = {
    "amount": ("neg(amount)", "-amount"),
    "gap": ("sub(vwap, close)", "vwap - close"),
    "loud": ("volume", "volume"),
    "mom": ("sub(close, delay(close, 3))", f"close - lag(close, 3) {_S}"),
    "reach": ("sub(high, low)", "high - low"),
    "rev": ("sub(delay(close, 1), close)", f"lag(close) {_S} - close"),
}
HOLDS = [5, 10, 20]
CAP, HORIZON, IMPACT = 0.2, 5, 0.3


def _candidates(spark, sf_dir):
    bars = views.supplier_bars(spark, sf_dir)
    return selection.candidates(bars, {k: e for k, (e, _) in CANDIDATES.items()})


def _judged(rows, exprs, n=None):
    of = F.create_map(*[F.lit(x) for kv in exprs.items() for x in kv])
    return selection.gated(selection.candidate_stats(rows, n=n).withColumn("expression", of[F.col("name")]))


def _listed(spark, sf_dir, exprs):
    """Candidates of ``exprs`` from written scores, and how many rows they are at most: the scores' files know their number."""
    wide = scratch.written(selection.with_forward(views.supplier_bars(spark, sf_dir), exprs), "scores")
    return selection.each(wide, exprs), wide.count() * len(exprs)


def _gated(spark, sf_dir):
    exprs = {k: e for k, (e, _) in CANDIDATES.items()}
    rows, n = _listed(spark, sf_dir, exprs)
    return _judged(rows, exprs, n)


def gates(spark, sf_dir):
    return quantise(_gated(spark, sf_dir), "name", "expression", "nodes", "passed")


#: One that says what another says, one that the styles explain in part, and the rest.
POOL = CANDIDATES | {
    "fade": ("div(sub(delay(close, 1), close), close)", f"CASE WHEN abs(close) > 1e-10 THEN (lag(close) {_S} - close) / close WHEN lag(close) {_S} IS NOT NULL THEN 0.0 END"),
    "thin": ("neg(volume)", "-volume"),
}
N_TRIALS, LEAST_DSR, LEAST_ORTHOGONAL = 40, 0.9, 0.02


def factor_selection(spark, sf_dir):
    """The independent set of the candidates that pass all gates: deflated ICIR over forty trials and IC beyond momentum among them."""
    bars = scratch.written(views.supplier_bars(spark, sf_dir), "bars")
    rows = selection.candidates(bars, {k: e for k, (e, _) in POOL.items()})
    rows = scratch.written(rows, "candidates")
    out = screening.select_factors(rows, {k: e for k, (e, _) in POOL.items()}, N_TRIALS, 3, exposures=risk.style_exposures(bars), styles=("momentum",), dsr=LEAST_DSR, orthogonal=LEAST_ORTHOGONAL, n=rows.count())
    return quantise(out, "name", "expression", "nodes", "passed", "place", "blocked_by")


def value_correlations(spark, sf_dir):
    bars = views.supplier_bars(spark, sf_dir)
    rows = selection.candidates(bars, {k: e for k, (e, _) in POOL.items()})
    return quantise(screening.value_correlations(scratch.written(rows, "candidates")), "a", "b")


def pool(spark, sf_dir):
    """Weights of the best three candidates; those of a negative mean IC have a veto."""
    return quantise(selection.pool_weights(_gated(spark, sf_dir), F.col("ic") < 0, 3), "name", "place")


def gain(spark, sf_dir):
    bars = views.supplier_bars(spark, sf_dir)
    wide = expression.evaluate(bars, {k: CANDIDATES[k][0] for k in ("mom", "gap", "loud")})
    return quantise(selection.pool_gain(wide, stats.forward_returns(bars), ["mom", "gap"], "loud"))


def residual_ic(spark, sf_dir):
    signal, forward = panel(spark, sf_dir)
    left = selection.residual_scores(signal, risk.style_exposures(views.supplier_bars(spark, sf_dir)), ("momentum",))
    return quantise(stats.rank_ic(stats.paired(left, forward)), "t")


def ensemble_ic(spark, sf_dir):
    """IC of scores fitted on all earlier dates; a z-scored change of price stands in until there are enough rows."""
    bars = views.supplier_bars(spark, sf_dir)
    wide = expression.evaluate(bars, {"a": "zscore(sub(close, delay(close, 3)))", "b": "zscore(sub(vwap, close))"})
    rows = wide.join(stats.forward_returns(bars), ["asset", "t"]).where("a is not null and b is not null and fwd is not null")
    scored = selection.ensemble_scores(rows, ("a", "b"), F.col("a"))
    fitted = scored.groupBy("t").agg(F.bool_and("fitted").alias("fitted"))
    return quantise(stats.rank_ic(scored.withColumn("score", quantised("score", 1e8))).join(fitted, "t"), "t", "fitted")


#: First candidates of the refine loop, and what is accepted already.
SEEDS = ("sub(close, delay(close, 4))", "sub(delay(close, 2), close)", "neg(amount)", "sub(high, delay(high, 2))", "ts_mean(volume, 5)")
ACCEPTED = ("sub(vwap, close)",)
STEP_DATES, MARGIN = 10, 0.01


def refined_candidates(spark, sf_dir):
    """Candidates judged against the accepted factor and one another, and the variants of those that fail, round by round."""
    bars = scratch.written(views.supplier_bars(spark, sf_dir), "bars")
    judged = refinery.refined(bars, None, SEEDS, ACCEPTED, generations=3)
    return quantise(refinery.as_table(bars, judged), "expression", "generation", "n_dates", "alike", "passed", "reason")


def orthogonal_factors(spark, sf_dir):
    """Factors chosen one a generation by the IC of what momentum and those chosen before leave of them."""
    bars = scratch.written(views.supplier_bars(spark, sf_dir), "bars")
    found = refinery.orthogonal_search(bars, None, risk.style_exposures(bars), ("momentum",), generations=2, size=8, seeds=("sub(vwap, close)", "sub(delay(close, 1), close)", "div(vwap, close)"))
    return quantise(spark.createDataFrame(found, "generation int, expression string, ic double"), "generation", "expression")


def promotion_gate(spark, sf_dir):
    """A registry of models: every ten dates the next candidate challenges what serves, on the same dates, and is promoted beyond a margin."""
    bars = scratch.written(views.supplier_bars(spark, sf_dir), "bars")
    rows = selection.candidates(bars, {k: e for k, (e, _) in POOL.items()})
    ic = screening.ic_by_date(rows).withColumn("ic", quantised("ic", 1e8))
    dates = research.dated(bars.select("t").distinct()).withColumn("step", F.floor(F.col("i") / STEP_DATES))
    ic = scratch.written(ic.join(F.broadcast(dates), "t"), "ics")
    table = versions.VersionedTable(spark, f"{checkpoint_root(spark)}/barlens-registry-{uuid.uuid4().hex}")
    for step, name in enumerate(sorted(POOL)):
        refinery.challenged(table, ic.where(F.col("step") == step).select("name", "t", "ic"), name, MARGIN)
    return quantise(table.read(), "step", "champion", "challenger", "n_dates", "promoted", "serving")


LEARNED = {"reversal": "zscore(sub(close, delay(close, 3)))", "gap": "zscore(sub(vwap, close))", "span": "zscore(sub(high, low))"}
FOLD_START, FOLD_EVERY, EDGE = 30, 15, 0.01


def _ensemble(spark, sf_dir):
    bars = views.supplier_bars(spark, sf_dir)
    return ensemble.ensemble(selection.with_forward(bars, LEARNED), tuple(LEARNED), FOLD_START, FOLD_EVERY, EDGE)


def ensemble_folds(spark, sf_dir):
    """Boosted trees against the equal-weight baseline, fold by fold, and which of them scores each."""
    folds = _ensemble(spark, sf_dir)[1]
    shares = [quantised(F.coalesce(F.col("importance")[c], F.lit(0.0))).alias(f"share_{c}") for c in LEARNED]
    return quantise(folds.select("*", *shares).drop("importance"), "fold", "first", "last", "n_dates", "n_train", "used", "verdict")


def ensemble_chosen(spark, sf_dir):
    """Scores of both and the chosen one of every row after the first thirty dates."""
    return quantise(_ensemble(spark, sf_dir)[0], "asset", "t", "fold")


def grid(spark, sf_dir):
    out = selection.grid_results(_candidates(spark, sf_dir), HOLDS)
    return quantise(out, "name", "n_hold", "place")


def _weighted(spark, sf_dir):
    """Customers' parts with an alpha from the price paid and a variance from the part's size."""
    h = _held(spark, sf_dir).join(views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset"), "p_size", "p_retailprice"), "asset")
    h = h.withColumn("total", F.sum(F.col("value").cast(MONEY)).over(Window.partitionBy("account")).cast("double"))
    return selection.analytic_weights(h.withColumns({"price": F.col("value") / F.col("qty"), "alpha": F.col("value") / F.col("qty") / F.col("p_retailprice") - 1, "variance": (F.col("p_size") % 7 + 1) / 10}), "account", CAP)


def analytic(spark, sf_dir):
    return _weighted(spark, sf_dir).select("account", "asset", quantised("w").alias("w"))


def checks(spark, sf_dir):
    return quantise(selection.checked_weights(_weighted(spark, sf_dir), "account", CAP), "account", "n", "sums_to_one", "within_cap", "long_only")


def schedule(spark, sf_dir):
    change = F.col("w") - F.col("value") / F.col("total")
    d = _weighted(spark, sf_dir).where(F.abs(change) > 1e-9).select("account", "asset", F.when(change > 0, "buy").otherwise("sell").alias("side"), (F.abs(change) * F.col("total") / F.col("price")).alias("shares"), "variance")
    out = selection.scheduled(d, HORIZON, orders.constant_rate(F.sqrt("variance"), IMPACT, 1.0, HORIZON))
    return out.select("account", "asset", "side", F.col("period").cast("long").alias("period"), quantised("qty").alias("qty"))


def due(spark, sf_dir):
    """Runs that each user's events would start, were each the time of a run."""
    e = views.table(spark, sf_dir, "events")
    last = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("event_id", selection.may_run(F.col("ts"), last).alias("due"))


def daily_scores(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    s = F.when(F.col("event_id") % 3 == 0, -1.0).otherwise(1.0) * F.least(F.col("value") / 100, F.lit(1.0))
    return quantise(selection.window_frame(e.select(F.col("user_id").alias("asset"), "ts", s.alias("score")), 10), "asset", "day")


def offender(spark, sf_dir):
    """The worst jump or inversion of the supplier panel."""
    b = views.supplier_bars(spark, sf_dir)
    r = b.select("asset", "t", (F.try_divide("close", F.lag("close").over(expression.series())) - 1).alias("r"), (F.col("high") - F.col("low")).alias("span"))
    jump = r.where(F.abs("r") > 0.8).select("asset", "t", F.lit("jump").alias("check"), F.col("r").alias("value"))
    inverted = r.where("span < 0").select("asset", "t", F.lit("inverted").alias("check"), F.col("span").alias("value"))
    return quantise(selection.worst_offender(jump.unionByName(inverted)), "critical", "asset", "t", "check")


def baseline(spark, sf_dir):
    return quantise(selection.momentum_baseline(views.supplier_bars(spark, sf_dir)), "asset", "t")


def _stacked_sql(pool: dict[str, tuple[str, str]]) -> str:
    each = " UNION ALL ".join(f"SELECT '{k}' AS name, asset, t, s_{k} AS score, fwd FROM z WHERE s_{k} IS NOT NULL AND fwd IS NOT NULL" for k in pool)
    return f"z AS (SELECT *, lead(close) {_S} / close - 1 AS fwd, {', '.join(f'{s} AS s_{k}' for k, (_, s) in pool.items())} FROM bars), c AS ({each})"


_STACK = _BARS + ", " + _stacked_sql(CANDIDATES)
_BY_NAME = _AVG_RANK.replace("PARTITION BY t", "PARTITION BY name, t")


def _gates_sql(pool: dict[str, tuple[str, str]]) -> str:
    """Statistics and gates of the candidates in ``c``, as ``d``."""
    return f"""p AS (SELECT name, t, fwd, {_BY_NAME.format(c='score')} AS x, {_BY_NAME.format(c='fwd')} AS y, count(*) OVER (PARTITION BY name, t) AS n,
      least(floor((row_number() OVER (PARTITION BY name, t ORDER BY score, asset) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY name, t) - 1, 1) * 5), 4) AS g FROM c
    ), i AS (SELECT name, t, coalesce({_GUARD.format(x='x', y='y')}, 0) AS ic FROM p WHERE n >= 10 GROUP BY name, t
    ), m AS (SELECT name, avg(ic) AS ic, CASE WHEN stddev_samp(ic) > 1e-10 THEN avg(ic) / stddev_samp(ic) ELSE 0 END AS icir FROM i GROUP BY name
    ), g AS (SELECT name, g, avg(r) * 252 AS ret FROM (SELECT name, t, g, avg(fwd) AS r FROM p WHERE n >= 5 GROUP BY ALL) GROUP BY name, g
    ), l AS (SELECT *, ret > lag(ret) OVER (PARTITION BY name ORDER BY g) AS up FROM g
    ), s AS (SELECT name, coalesce(avg(up::INT::DOUBLE), 0) AS monotonicity, arg_max(ret, g) - arg_min(ret, g) AS long_short FROM l GROUP BY name
    ), e(name, expression) AS (VALUES {', '.join(f"('{k}', '{e}')" for k, (e, _) in pool.items())}
    ), o AS (SELECT *, len(expression) - len(replace(expression, ',', '')) + 1 AS nodes FROM m JOIN s USING (name) JOIN e USING (name)
    ), k AS (SELECT *, ic > 0.02 AND icir > 0.15 AND monotonicity > 0.4 AND (long_short > 0.1 OR abs(long_short) > 0.2) AND nodes <= 25 AS passed FROM o
    ), d AS (SELECT *, CASE WHEN passed THEN 0.4::DOUBLE * icir + 0.3::DOUBLE * monotonicity + 0.3::DOUBLE * abs(long_short) ELSE 0 END AS score FROM k)"""


_GATED = _STACK + ", " + _gates_sql(CANDIDATES)
_CDF = "CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END"
_T = "(1 / (1 + 0.2316419::DOUBLE * abs({x})))"
_TAIL = "exp(-{x} * {x} / 2) / 2.5066282746310002::DOUBLE * {t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))"


def cdf_sql(x: str) -> str:
    """The normal distribution function, as in :func:`barlens.functions.columns.normal_cdf`; ``x`` is a column."""
    return _CDF.format(x=x, tail="(" + _TAIL.format(x=x, t=_T.format(x=x)) + ")")


_VALUES = f"""v AS (SELECT name, t, asset, ({_BY_NAME.format(c='score')} - 0.5) / count(*) OVER (PARTITION BY name, t) - 0.5 AS x FROM c
    ), cc AS (SELECT l.name AS a, r.name AS b, {_GUARD.format(x='l.x', y='r.x')} AS corr FROM v l JOIN v r ON l.asset = r.asset AND l.t = r.t AND l.name < r.name GROUP BY l.name, r.name)"""
_SELECTED = (
    _X.replace("WITH ", "WITH RECURSIVE ", 1).replace("e AS (SELECT asset", "st AS (SELECT asset")
    + ", "
    + _stacked_sql(POOL)
    + ", "
    + _gates_sql(POOL)
    + f""", dm AS (SELECT name, count(*) AS n, avg(ic) AS mean, stddev_samp(ic) AS sd FROM i GROUP BY name
    ), dz AS (SELECT name, n, mean / sd AS ratio, avg(((ic - mean) / sd) ** 3) AS skew, avg(((ic - mean) / sd) ** 4) - 3 AS excess FROM i JOIN dm USING (name) WHERE n >= 10 AND sd > 1e-12 GROUP BY ALL
    ), dp AS (SELECT *, greatest(1 - skew * ratio + excess / 4 * ratio * ratio, 1e-12) AS spread FROM dz
    ), dq AS (SELECT name, (ratio - greatest(sqrt(spread / (n - 1)) * {screening.expected_best(N_TRIALS)!r}, 0)) * sqrt(n - 1) / sqrt(spread) AS q FROM dp
    ), ds AS (SELECT name, {cdf_sql('q')} AS dsr FROM dq
    ), xj AS (SELECT name, asset, t, fwd, CASE WHEN stddev_pop(score) OVER k > 1e-10 THEN (score - avg(score) OVER k) / stddev_pop(score) OVER k ELSE 0 END AS z FROM c WINDOW k AS (PARTITION BY name, t)
    ), xe AS (SELECT xj.*, momentum AS x FROM xj JOIN st USING (asset)
    ), xb AS (SELECT name, t, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(z) AS sy, sum(x * z) AS sxy FROM xe GROUP BY name, t
    ), xh AS (SELECT name, t, CASE WHEN sxx * n - sx * sx > 1e-9 * n * n THEN (sxy * n - sx * sy) / (sxx * n - sx * sx) END AS k, sx / n AS mx, sy / n AS my FROM xb
    ), xo AS (SELECT xe.*, z - (my - k * mx) - k * x AS own FROM xe JOIN xh USING (name, t)
    ), xc AS (SELECT name, t, fwd, floor(CASE WHEN stddev_pop(own) OVER k > 1e-12 THEN least(greatest(own / stddev_pop(own) OVER k, -3), 3) ELSE 0 END * 1e6 + 0.5) / 1e6 AS score FROM xo WINDOW k AS (PARTITION BY name, t)
    ), xr AS (SELECT name, t, {_BY_NAME.format(c='score')} AS x, {_BY_NAME.format(c='fwd')} AS y, count(*) OVER (PARTITION BY name, t) AS n FROM xc
    ), xi AS (SELECT name, avg(ic) AS orthogonal_ic FROM (SELECT name, t, coalesce({_GUARD.format(x='x', y='y')}, 0) AS ic FROM xr WHERE n >= 10 GROUP BY name, t) GROUP BY name
    ), f AS (SELECT name, expression, nodes, ic, icir, monotonicity, long_short, coalesce(dsr, 0) AS dsr, orthogonal_ic,
        passed AND coalesce(dsr, 0) >= {LEAST_DSR} AND abs(coalesce(orthogonal_ic, 0)) >= {LEAST_ORTHOGONAL} AS ok, score FROM d LEFT JOIN ds USING (name) LEFT JOIN xi USING (name)
    ), {_VALUES}, tk AS (SELECT name, list_distinct(regexp_extract_all(expression, '[A-Za-z_]\\w*')) AS names FROM e
    ), near AS (SELECT a, b FROM cc WHERE abs(corr) >= 0.7 UNION SELECT l.name, r.name FROM tk l JOIN tk r ON l.name < r.name WHERE len(list_intersect(l.names, r.names)) > 0.7::DOUBLE * len(list_distinct(list_concat(l.names, r.names)))
    ), around AS (SELECT name, list(other) AS others FROM (SELECT a AS name, b AS other FROM near UNION ALL SELECT b, a FROM near) GROUP BY name
    ), ordered AS (SELECT f.name, coalesce(others, []) AS others, row_number() OVER (ORDER BY round(score, 8) DESC, f.name) AS k FROM f LEFT JOIN around USING (name) WHERE ok
    ), chosen(k, names) AS (SELECT 0::BIGINT, CAST([] AS VARCHAR[]) UNION ALL SELECT o.k, CASE WHEN len(names) < 3 AND NOT list_has_any(names, others) THEN list_append(names, name) ELSE names END FROM chosen JOIN ordered o ON o.k = chosen.k + 1
    ), places AS (SELECT name, CASE WHEN list_has_any(b.names, others) THEN 0 ELSE coalesce(list_position(a.names, name), 0) END AS place,
        coalesce(list_filter(b.names, lambda x: list_contains(others, x))[1], '') AS blocked_by FROM ordered o JOIN chosen a ON a.k = o.k JOIN chosen b ON b.k = o.k - 1)
    """
)
_SUM = "sum({c}) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)"
_WEIGHTS = (
    "WITH "
    + _HELD
    + f""", a AS (SELECT h.*, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY account) AS DOUBLE) AS total, value / qty AS price, greatest((value / qty / p_retailprice - 1) / ((p_size % 7 + 1) / 10.0::DOUBLE + 1e-6), 0) AS u, (p_size % 7 + 1) / 10.0::DOUBLE AS variance
      FROM h JOIN part ON asset = p_partkey
    ), b AS (SELECT *, count(*) OVER (PARTITION BY account) AS n, sum(u) OVER (PARTITION BY account) AS s FROM a
    ), c AS (SELECT *, CASE WHEN s > 1e-12 THEN u / s ELSE 1.0::DOUBLE / n END AS w0 FROM b
    ), f AS (SELECT *, row_number() OVER o - 1 AS k, coalesce(sum(w0) OVER (PARTITION BY account ORDER BY w0 DESC, asset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WINDOW o AS (PARTITION BY account ORDER BY w0 DESC, asset)
    ), v AS (SELECT *, w0 > 1e-12 AND (1 - k * {CAP}::DOUBLE) * w0 > {CAP}::DOUBLE * (1 - before) AS over FROM f
    ), x AS (SELECT *, count(*) FILTER (over) OVER (PARTITION BY account) AS m, coalesce(sum(CASE WHEN over THEN w0 END) OVER (PARTITION BY account), 0) AS top FROM v
    ), y AS (SELECT account, asset, n, value, total, price, variance, CASE WHEN n * {CAP}::DOUBLE < 1 OR over THEN {CAP}::DOUBLE WHEN 1 - top > 1e-12 THEN w0 * (1 - m * {CAP}::DOUBLE) / (1 - top) ELSE (1 - m * {CAP}::DOUBLE) / (n - m) END AS w FROM x)"""
)

QUERIES = {
    "factor_gates": gates,
    "factor_selection": factor_selection,
    "value_correlations": value_correlations,
    "pool_weights": pool,
    "pool_gain": gain,
    "residual_ic": residual_ic,
    "ensemble_ic": ensemble_ic,
    "refined_candidates": refined_candidates,
    "orthogonal_factors": orthogonal_factors,
    "promotion_gate": promotion_gate,
    "ensemble_folds": ensemble_folds,
    "ensemble_chosen": ensemble_chosen,
    "grid_results": grid,
    "analytic_weights": analytic,
    "weight_checks": checks,
    "trade_schedule": schedule,
    "due_runs": due,
    "daily_scores": daily_scores,
    "worst_offender": offender,
    "momentum_baseline": baseline,
}
_NAMES = ", ".join(f"({k}, '{n}')" for k, n in enumerate(sorted(POOL)))
ORACLE_SQL = {
    "promotion_gate": _BARS.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", "
    + _stacked_sql(POOL)
    + f""", r AS (SELECT name, t, {_BY_NAME.format(c='score')} AS x, {_BY_NAME.format(c='fwd')} AS y, count(*) OVER (PARTITION BY name, t) AS n FROM c
    ), i AS (SELECT name, t, floor(coalesce({_GUARD.format(x='x', y='y')}, 0) * 1e8 + 0.5) / 1e8 AS ic FROM r WHERE n >= 10 GROUP BY name, t
    ), dt AS (SELECT t, (row_number() OVER (ORDER BY t) - 1) // {STEP_DATES} AS step FROM (SELECT DISTINCT t FROM bars)
    ), w AS MATERIALIZED (SELECT i.*, step FROM i JOIN dt USING (t)), names(step, name) AS (VALUES {_NAMES}
    ), duel AS MATERIALIZED (SELECT a.step, a.name AS champion, b.name AS challenger, count(*) AS n_dates, avg(a.ic) AS old_ic, avg(b.ic) AS new_ic FROM w a JOIN w b ON a.t = b.t GROUP BY ALL
    ), g(step, champion, challenger, n_dates, champion_ic, challenger_ic, promoted, serving) AS (
      SELECT -1, NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT, NULL::DOUBLE, NULL::DOUBLE, false, NULL::VARCHAR
      UNION ALL
      SELECT step, champion, challenger, coalesce(n_dates, 0), old_ic, new_ic, ok, CASE WHEN ok THEN challenger ELSE champion END FROM (
        SELECT n.step, g.serving AS champion, n.name AS challenger, d.n_dates, CASE WHEN g.serving IS NOT NULL THEN d.old_ic END AS old_ic, d.new_ic, coalesce(CASE WHEN g.serving IS NULL THEN d.new_ic > 0 ELSE d.new_ic > d.old_ic + {MARGIN}::DOUBLE END, false) AS ok
        FROM g JOIN names n ON n.step = g.step + 1 LEFT JOIN duel d ON d.step = n.step AND d.challenger = n.name AND d.champion = coalesce(g.serving, n.name))
    ) SELECT step, champion, challenger, n_dates, {q({'champion_ic': 'g.champion_ic', 'challenger_ic': 'g.challenger_ic'})}, promoted, serving FROM g WHERE step >= 0""",
    "factor_selection": _SELECTED
    + "SELECT f.name, expression, nodes, ok AS passed, coalesce(place, 0)::INT AS place, coalesce(blocked_by, '') AS blocked_by, "
    + q({c: f"f.{c}" for c in ("ic", "icir", "monotonicity", "long_short", "dsr", "orthogonal_ic")} | {"score": "CASE WHEN ok THEN f.score ELSE 0 END"})
    + " FROM f LEFT JOIN places USING (name)",
    "value_correlations": _BARS + ", " + _stacked_sql(POOL) + ", " + _VALUES + " SELECT a, b, " + q({"corr": "corr"}) + " FROM cc",
    "factor_gates": _GATED + " SELECT name, expression, nodes, passed, " + q({c: c for c in ("ic", "icir", "monotonicity", "long_short", "score")}) + " FROM d",
    "pool_weights": _GATED
    + ", r AS (SELECT *, row_number() OVER (ORDER BY ic < 0, score DESC, name) AS place FROM d), w AS (SELECT *, CASE WHEN ic >= 0 AND place <= 3 THEN abs(icir) ELSE 0 END AS w FROM r) SELECT name, place, "
    + q({"weight": "CASE WHEN sum(w) OVER () > 0 THEN w / sum(w) OVER () ELSE 0 END"})
    + " FROM w",
    "pool_gain": _STACK
    + f""", d AS (SELECT * FROM z WHERE s_mom IS NOT NULL AND s_gap IS NOT NULL AND s_loud IS NOT NULL AND fwd IS NOT NULL
    ), r AS (SELECT t, fwd, {_AVG_RANK.format(c='s_mom')} + {_AVG_RANK.format(c='s_gap')} AS b, {_AVG_RANK.format(c='s_loud')} AS l FROM d
    ), x AS (SELECT t, fwd, b, b + l AS a FROM r), y AS (SELECT t, {_AVG_RANK.format(c='a')} AS a, {_AVG_RANK.format(c='b')} AS b, {_AVG_RANK.format(c='fwd')} AS y FROM x
    ), i AS (SELECT t, coalesce({_GUARD.format(x='a', y='y')}, 0) AS a, coalesce({_GUARD.format(x='b', y='y')}, 0) AS b FROM y GROUP BY t
    ), n AS (SELECT *, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM i) SELECT """
    + q({"before": "avg(b)", "after": "avg(a)", "gain": "avg(a) - avg(b)"})
    + " FROM n WHERE i >= least(60, n // 3)",
    "residual_ic": _X
    + f""", sc AS (SELECT asset, t, close - lag(close, 3) {_S} AS d3, lead(close) {_S} / close - 1 AS fwd FROM bars
    ), rk AS (SELECT asset, t, fwd, CASE WHEN count(d3) OVER (PARTITION BY t) > 1 AND d3 IS NOT NULL THEN (row_number() OVER (PARTITION BY t ORDER BY d3 NULLS LAST, asset) - 1)::DOUBLE / (count(d3) OVER (PARTITION BY t) - 1) END AS score FROM sc
    ), zs AS (SELECT asset, t, fwd, {_z('score')} AS z FROM rk
    ), j AS (SELECT asset, t, fwd, z, momentum AS x FROM zs JOIN e USING (asset) WHERE z IS NOT NULL
    ), b AS (SELECT t, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(z) AS sy, sum(x * z) AS sxy FROM j GROUP BY t
    ), h AS (SELECT t, (sxy * n - sx * sy) / (sxx * n - sx * sx) AS k, sx / n AS mx, sy / n AS my FROM b
    ), o AS (SELECT j.*, z - (my - k * mx) - k * x AS own FROM j JOIN h USING (t)
    ), c AS (SELECT t, fwd, floor(CASE WHEN stddev_pop(own) OVER (PARTITION BY t) > 1e-12 THEN least(greatest(own / stddev_pop(own) OVER (PARTITION BY t), -3), 3) ELSE 0 END * 1e6 + 0.5) / 1e6 AS score FROM o
    ), p AS (SELECT t, {_AVG_RANK.format(c='score')} AS x, {_AVG_RANK.format(c='fwd')} AS y FROM c WHERE fwd IS NOT NULL) SELECT t, """
    + q({"ic": f"coalesce({_GUARD.format(x='x', y='y')}, 0)"})
    + ", count(*) AS n FROM p GROUP BY t HAVING count(*) >= 10",
    "ensemble_ic": _BARS
    + f""", v AS (SELECT asset, t, close - lag(close, 3) {_S} AS d3, vwap - close AS gap, lead(close) {_S} / close - 1 AS fwd FROM bars
    ), u AS (SELECT asset, t, fwd, {_z('d3')} AS a, {_z('gap')} AS b FROM v), w AS (SELECT * FROM u WHERE a IS NOT NULL AND b IS NOT NULL AND fwd IS NOT NULL
    ), s AS (SELECT t, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * fwd) AS ay, sum(b * fwd) AS by_ FROM w GROUP BY t
    ), c AS (SELECT t, {', '.join(f"{_SUM.format(c=x)} AS {x}" for x in ('n', 'aa', 'ab', 'bb', 'ay', 'by_'))} FROM s
    ), k AS (SELECT t, coalesce(n >= 100, false) AS fitted, (ay * (bb + 1) - by_ * ab) / ((aa + 1) * (bb + 1) - ab * ab) AS wa, (by_ * (aa + 1) - ay * ab) / ((aa + 1) * (bb + 1) - ab * ab) AS wb FROM c
    ), d AS (SELECT t, fwd, fitted, floor(CASE WHEN fitted THEN a * wa + b * wb ELSE a END * 1e8 + 0.5) / 1e8 AS score FROM w JOIN k USING (t)
    ), p AS (SELECT t, fitted, {_AVG_RANK.format(c='score')} AS x, {_AVG_RANK.format(c='fwd')} AS y FROM d) SELECT t, fitted, """
    + q({"ic": f"coalesce({_GUARD.format(x='x', y='y')}, 0)"})
    + ", count(*) AS n FROM p GROUP BY t, fitted HAVING count(*) >= 10",
    "grid_results": _STACK
    + f""", k AS (SELECT *, row_number() OVER (PARTITION BY name, t ORDER BY score DESC, asset) AS k FROM c), h(n_hold) AS (VALUES {', '.join(f'({h})' for h in HOLDS)}
    ), r AS (SELECT name, n_hold, t, avg(fwd) AS r FROM k JOIN h ON k <= n_hold GROUP BY ALL), s AS (SELECT name, n_hold, avg(r) AS mean, CASE WHEN stddev_samp(r) > 1e-10 THEN avg(r) / stddev_samp(r) ELSE 0 END AS sharpe FROM r GROUP BY ALL)
    SELECT name, n_hold, """
    + q({"mean": "mean", "sharpe": "sharpe"})
    + ", row_number() OVER (ORDER BY floor(s.sharpe * 1e8 + 0.5) DESC, name, n_hold) AS place FROM s",
    "analytic_weights": _WEIGHTS + " SELECT account, asset, " + q({"w": "w"}) + " FROM y",
    "weight_checks": _WEIGHTS
    + f" SELECT account, count(*) AS n, {q({'largest': 'max(w)'})}, abs(sum(w) - 1) <= 1e-6 OR count(*) * {CAP}::DOUBLE < 1 AS sums_to_one, max(w) <= {CAP}::DOUBLE + 1e-9 AS within_cap, min(w) >= 0 AS long_only FROM y GROUP BY account",
    "trade_schedule": _WEIGHTS
    + f""", g AS (SELECT account, asset, CASE WHEN w > value / total THEN 'buy' ELSE 'sell' END AS side, abs(w - value / total) * total / price AS shares, greatest(least(greatest(sqrt(variance) / (2 * {IMPACT}::DOUBLE * {HORIZON} + 1e-9), 0), 1), 1.0::DOUBLE / {HORIZON}) AS speed
      FROM y WHERE abs(w - value / total) > 1e-9), p AS (SELECT *, least(shares * speed, shares - shares * speed * period) AS qty FROM g, range({HORIZON}) r(period)) SELECT account, asset, side, period, """
    + q({"qty": "qty"})
    + " FROM p WHERE p.qty > 1e-9",
    "due_runs": """WITH e AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events)
    SELECT event_id, isodow(ts) <= 5 AND hour(ts) * 60 + minute(ts) BETWEEN 570 AND 900 AND (last IS NULL OR (last::DATE <> ts::DATE AND (date_sub('second', last, ts) >= 21600 OR ts <= last))) AS due FROM e""",
    "daily_scores": """WITH e AS (SELECT user_id AS asset, ts::DATE AS day, avg(CASE WHEN event_id % 3 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * least(value / 100, 1.0::DOUBLE)) AS score FROM events GROUP BY ALL) SELECT asset, day, """
    + q({"score": "score"})
    + " FROM e WHERE day > (SELECT max(day) FROM e) - 10",
    "worst_offender": _R.replace("SELECT asset, t, close", "SELECT asset, t, high - low AS span, close")
    + ", o AS (SELECT asset, t, 'jump' AS \"check\", r AS value FROM r WHERE abs(r) > 0.8 UNION ALL SELECT asset, t, 'inverted', span FROM r WHERE span < 0) SELECT count(*) OVER () AS critical, asset, t, \"check\", "
    + q({"value": "value"})
    + ' FROM o ORDER BY abs(o.value) DESC, asset, t, "check" LIMIT 1',
    "momentum_baseline": _BARS + f", p AS (SELECT asset, t, close, lag(close, 20) {_S} AS b FROM bars) SELECT asset, t, " + q({"score": "CASE WHEN close > 0 AND b > 0 THEN ln(close / b) ELSE 0 END"}) + " FROM p",
}
