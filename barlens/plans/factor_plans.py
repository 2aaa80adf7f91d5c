"""Queries of the expression language and the factor libraries, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.functions.columns import quantised, quantised_sql
from barlens.operators import expression, factors
from barlens.sources import views

_BARS = "WITH " + views.SQL["supplier_bars"]
_W = "OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


def over(n: int) -> str:
    return _W.format(n=n - 1)


_S = "OVER (PARTITION BY asset ORDER BY t)"
_X = "OVER (PARTITION BY t)"
_RN = f"row_number() {_S}"


def full(x: str, w: int) -> str:
    return f"CASE WHEN {_RN} >= {w} THEN {x} END"


def corr_sql(x: str, y: str, w: int, least: int = 2) -> str:
    both = f"({x}) IS NOT NULL AND ({y}) IS NOT NULL"
    a, b, o = f"CASE WHEN {both} THEN {x} END", f"CASE WHEN {both} THEN {y} END", over(w)
    return f"CASE WHEN count({a}) {o} >= {least} AND stddev_pop({a}) {o} > 1e-10 AND stddev_pop({b}) {o} > 1e-10 THEN covar_pop({a}, {b}) {o} / (stddev_pop({a}) {o} * stddev_pop({b}) {o}) END"


def pct(x: str) -> str:
    """Cross-sectional percent rank with average ties."""
    return f"CASE WHEN ({x}) IS NOT NULL THEN (rank() OVER (PARTITION BY t ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY t, {x}) - 1) / 2.0) / count({x}) {_X} END"


def ordinal(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL AND count({x}) {_X} > 1 THEN (row_number() OVER (PARTITION BY t ORDER BY {x} NULLS LAST, asset) - 1)::DOUBLE / (count({x}) {_X} - 1) END"


def _all_quantised(df: DataFrame, keys: tuple[str, ...] = ("asset", "t")) -> DataFrame:
    return df.select(*keys, *[quantised(c).alias(c) for c in df.columns if c not in keys])


def q_columns(columns: dict[str, str], keys: str = "asset, t") -> str:
    return f"SELECT {keys}, " + ", ".join(f"{quantised_sql(x)} AS {n}" for n, x in columns.items())


ELEMENTWISE = {
    "e_add": "add(open, close)",
    "e_sub": "sub(high, low)",
    "e_mul": "mul(open, const(2.5))",
    "e_div": "div(amount, sub(volume, volume))",
    "e_div2": "div(amount, volume)",
    "e_neg": "neg(close)",
    "e_abs": "abs(sub(open, close))",
    "e_sqrt": "sqrt(sub(open, close))",
    "e_log": "log(sub(open, close))",
    "e_min": "min(open, close)",
    "e_max": "max(open, close)",
}
SERIES = {
    "s_delay": "delay(close, 3)",
    "s_mean": "ts_mean(close, 5)",
    "s_std": "ts_std(close, 5)",
    "s_max": "ts_max(high, 10)",
    "s_min": "ts_min(low, 10)",
    "s_corr": "ts_corr(close, volume, 8)",
    "s_nested": "sub(ts_mean(sub(close, delay(close, 1)), 4), ts_mean(delay(close, 2), 6))",
}
SECTIONS = {"x_rank": "rank(close)", "x_zscore": "zscore(volume)", "x_nested": "rank(sub(close, delay(close, 3)))", "x_deep": "zscore(rank(ts_mean(volume, 3)))"}


def elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_quantised(expression.evaluate(views.supplier_bars(spark, sf_dir), ELEMENTWISE))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_quantised(expression.evaluate(views.supplier_bars(spark, sf_dir), SERIES))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_quantised(expression.evaluate(views.supplier_bars(spark, sf_dir), SECTIONS))


def latest_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_quantised(expression.latest(expression.evaluate(views.brand_bars(spark, sf_dir), {"score": "rank(sub(close, delay(close, 3)))", "level": "ts_mean(close, 5)"})))


def library_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression over named library series: 'lib.' names stand beside fields."""
    libraries = {"lib.ret": lambda: factors.change(F.col("close")), "lib.gap": lambda: factors.ratio(F.col("close") - F.col("vwap"), F.col("vwap"))}
    return _all_quantised(expression.evaluate(views.supplier_bars(spark, sf_dir), {"f": "mul(lib.ret, lib.gap)", "g": "ts_mean(lib.ret, 4)"}, libraries))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_quantised(factors.library_by_category(views.supplier_bars(spark, sf_dir)))


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_quantised(factors.family_factors(views.supplier_bars(spark, sf_dir)))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_quantised(factors.model_features(views.supplier_bars(spark, sf_dir)))


def vols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_quantised(factors.volatility(views.supplier_bars(spark, sf_dir)))


_LIB_SQL = (
    _BARS
    + f""", a AS (SELECT *, close / nullif(lag(close) {_S}, 0) - 1 AS r, close - lag(close) {_S} AS d1, ln(volume) - ln(lag(volume, 2) {_S}) AS d2lnv,
  (close - open) / nullif(open, 0) AS body, {pct('low')} AS rank_low, 9973.0::DOUBLE AS shares FROM bars
), b AS (SELECT *, {full('avg(close) ' + over(20), 20)} AS ma20, {full('stddev_samp(close) ' + over(20), 20)} AS sd20,
  {full('avg(greatest(d1, 0)) ' + over(14), 14)} AS up14, {full('avg(greatest(-d1, 0)) ' + over(14), 14)} AS dn14,
  {full('stddev_samp(r) ' + over(20), 20)} AS rsd20,
  {quantised_sql(full(corr_sql('d2lnv', 'body', 6), 6), '1e6')} AS c6, {quantised_sql(full(corr_sql('open', 'volume', 10), 10), '1e6')} AS c10,
  CASE WHEN {_RN} >= 9 THEN len(list_filter(list(rank_low) {over(9)}, lambda x: x <= rank_low))::DOUBLE / 9 END AS rank_low9,
  {full('avg(volume) ' + over(20), 20)} AS adv20, close - lag(close, 7) {_S} AS d7,
  {quantised_sql(f"{full('sum(open) ' + over(5), 5)} * {full('sum(r) ' + over(5), 5)}", '1e6')} AS so_sr,
  {full('min(d1) ' + over(5), 6)} AS lo5, {full('max(d1) ' + over(5), 6)} AS hi5, {full('min(d1) ' + over(4), 5)} AS lo4, {full('max(d1) ' + over(4), 5)} AS hi4 FROM a
), c AS (SELECT *, pow(CASE WHEN r < 0 THEN rsd20 ELSE close END, 2) AS signed,
  list_filter(list(abs(d7)) {over(20)}, lambda x: x IS NOT NULL) AS d7s, lag(so_sr, 10) {_S} AS so_sr_lag, {_RN} AS rn FROM b
), d AS (SELECT *, CASE WHEN rn >= 20 THEN len(list_filter(d7s, lambda x: x <= abs(d7)))::DOUBLE / len(d7s) END AS abs_d7_rank,
  list(coalesce(signed, 0)) {over(5)} AS s5, list(close) {over(250)} AS cs FROM c
), e AS (SELECT *, CASE WHEN rn >= 5 THEN list_position(s5, list_max(s5))::DOUBLE END AS argmax5,
  CASE WHEN lo5 > 0 OR hi5 < 0 THEN d1 WHEN lo5 IS NOT NULL THEN -d1 END AS a9, CASE WHEN lo4 > 0 OR hi4 < 0 THEN d1 WHEN lo4 IS NOT NULL THEN -d1 END AS a10,
  {quantised_sql('so_sr - so_sr_lag', '1e6')} AS a8 FROM d
) """
    + q_columns(
        {
            "momentum": f"close / nullif(lag(close, 20) {_S}, 0) - 1",
            "rsi": "CASE WHEN dn14 = 0 THEN 100.0 ELSE 100 - 100 / (1 + up14 / nullif(dn14, 0)) END",
            "macd": " - ".join(f"list_reduce(list_prepend(0.0::DOUBLE, cs), lambda acc, x: acc * {k} + x) / list_reduce(list_prepend(0.0::DOUBLE, cs), lambda acc, x: acc * {k} + 1.0)" for k in (f"{1 - 2 / 13!r}::DOUBLE", f"{1 - 2 / 27!r}::DOUBLE")),
            "vwm": f"{full('sum(volume * r) ' + over(20), 20)} / nullif({full('sum(volume) ' + over(20), 20)}, 0)",
            "mean_reversion": "(close - ma20) / nullif(sd20, 0)",
            "bollinger": "(close - ma20) / nullif(4 * sd20, 0)",
            "vwap_dev": "(close - vwap) / nullif(vwap, 0)",
            "vol_roc": f"volume / nullif(lag(volume, 10) {_S}, 0) - 1",
            "obv": f"sum(coalesce(sign(d1), 0) * volume) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING)",
            "illiquidity": full("avg(abs(r) / nullif(volume, 0)) " + over(20), 20),
            "turnover": full("avg(volume / shares) " + over(20), 20),
            "alpha1": f"{pct('argmax5')} - 0.5",
            "alpha2": f"-({pct('c6')})",
            "alpha3": f"-({pct('c10')})",
            "alpha4": "-rank_low9",
            "alpha5": f"(({pct('open')}) - ({pct('close')})) * ({pct('volume')})",
            "alpha6": "-c10",
            "alpha7": "CASE WHEN adv20 < volume THEN -abs_d7_rank * sign(d7) ELSE -1.0 END",
            "alpha8": f"-({pct('a8')})",
            "alpha9": "a9",
            "alpha10": pct("a10"),
        }
    )
    + " FROM e"
)

_UP, _DN = "coalesce(greatest(d, 0), 0)", "coalesce(greatest(-d, 0), 0)"
_FAMILY_SQL = (
    _BARS
    + f""", a AS (SELECT *, close / nullif(lag(close) {_S}, 0) - 1 AS r, close - lag(close) {_S} AS d, volume / nullif(lag(volume) {_S}, 0) - 1 AS vc FROM bars) """
    + q_columns(
        {
            "KMID": "(close - open) / nullif(open, 0)",
            "KLEN": "(high - low) / nullif(open, 0)",
            "KMID2": "(close - open) / (high - low + 1e-12)",
            "KUP": "(high - greatest(open, close)) / (high - low + 1e-12)",
            "KLOW": "(least(open, close) - low) / (high - low + 1e-12)",
            **{f"ROC{n}": f"close / nullif(lag(close, {n}) {_S}, 0) - 1" for n in (5, 10, 20)},
            **{f"MA{n}": f"close / nullif({full(f'avg(close) {over(n)}', n)}, 0) - 1" for n in (5, 10, 20)},
            "RSV20": f"(close - {full(f'min(low) {over(20)}', 20)}) / (max(high) {over(20)} - min(low) {over(20)} + 1e-12)",
            **{f"STD{n}": full(f"stddev_pop(r) {over(n)}", n) for n in (5, 10, 20)},
            "ATR10": f"{full(f'avg(high - low) {over(10)}', 10)} / nullif({full(f'avg(close) {over(10)}', 10)}, 0)",
            "CORR_CR": full(corr_sql("close", "vc", 10, 5), 10),
            "CORD": full(corr_sql("r", "vc", 10, 5), 10),
            **{f"RSI{n}": f"{full(f'avg({_UP}) {over(n)}', n)} / ({full(f'avg({_UP}) {over(n)}', n)} + {full(f'avg({_DN}) {over(n)}', n)} + 1e-12)" for n in (5, 14)},
            **{f"VMA{n}": f"volume / ({full(f'avg(volume) {over(n)}', n)} + 1e-12) - 1" for n in (5, 10)},
            **{f"VSTD{n}": f"{full(f'stddev_pop(volume) {over(n)}', n)} / ({full(f'avg(volume) {over(n)}', n)} + 1e-12)" for n in (5, 10)},
        }
    )
    + " FROM a"
)


def z(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN CASE WHEN stddev_pop({x}) {_X} > 1e-10 THEN (({x}) - avg({x}) {_X}) / (stddev_pop({x}) {_X} + 1e-10) ELSE 0.0 END END"


QUERIES = {
    "expr_elementwise": elementwise,
    "expr_series": series,
    "expr_sections": sections,
    "expr_latest": latest_section,
    "expr_library": library_series,
    "library_factors": library,
    "family_factors": families,
    "model_features": features,
    "volatility": vols,
}
ORACLE_SQL = {
    "expr_elementwise": _BARS
    + " "
    + q_columns(
        {
            "e_add": "open + close",
            "e_sub": "high - low",
            "e_mul": "open * 2.5::DOUBLE",
            "e_div": "0.0::DOUBLE",
            "e_div2": "CASE WHEN abs(volume) > 1e-10 THEN amount / volume ELSE 0 END",
            "e_neg": "-close",
            "e_abs": "abs(open - close)",
            "e_sqrt": "sqrt(abs(open - close))",
            "e_log": "sign(open - close) * ln(1 + abs(open - close))",
            "e_min": "least(open, close)",
            "e_max": "greatest(open, close)",
        }
    )
    + " FROM bars",
    "expr_series": _BARS
    + f", a AS (SELECT *, close - lag(close) {_S} AS d1, lag(close, 2) {_S} AS l2 FROM bars) "
    + q_columns(
        {
            "s_delay": f"lag(close, 3) {_S}",
            "s_mean": full(f"avg(close) {over(5)}", 5),
            "s_std": full(f"stddev_pop(close) {over(5)}", 5),
            "s_max": full(f"max(high) {over(10)}", 10),
            "s_min": full(f"min(low) {over(10)}", 10),
            "s_corr": full(f"coalesce({corr_sql('close', 'volume', 8)}, 0)", 8),
            "s_nested": f"{full(f'avg(d1) {over(4)}', 4)} - {full(f'avg(l2) {over(6)}', 6)}",
        }
    )
    + " FROM a",
    "expr_sections": _BARS
    + f", a AS (SELECT *, close - lag(close, 3) {_S} AS d3, {full(f'avg(volume) {over(3)}', 3)} AS m3 FROM bars), b AS (SELECT *, {ordinal('m3')} AS rm3 FROM a) "
    + q_columns({"x_rank": ordinal("close"), "x_zscore": z("volume"), "x_nested": ordinal("d3"), "x_deep": z("rm3")})
    + " FROM b",
    "expr_latest": "WITH "
    + views.SQL["brand_bars"]
    + f", a AS (SELECT *, close - lag(close, 3) {_S} AS d3, {full(f'avg(close) {over(5)}', 5)} AS m5 FROM bars), b AS (SELECT asset, t, {ordinal('d3')} AS score, m5 AS level FROM a) "
    + q_columns({"score": "score", "level": "level"})
    + " FROM b WHERE t = (SELECT max(t) FROM bars)",
    "expr_library": _BARS
    + f", a AS (SELECT *, close / nullif(lag(close) {_S}, 0) - 1 AS r, (close - vwap) / nullif(vwap, 0) AS gap FROM bars) "
    + q_columns({"f": "r * gap", "g": full(f"avg(r) {over(4)}", 4)})
    + " FROM a",
    "library_factors": _LIB_SQL,
    "family_factors": _FAMILY_SQL,
    "model_features": _BARS
    + f""", a AS (SELECT *, close / nullif(lag(close) {_S}, 0) - 1 AS r FROM bars
), b AS (SELECT *, {full(f'stddev_pop(r) {over(5)}', 6)} AS vol5, {full(f'stddev_pop(r) {over(20)}', 21)} AS vol20 FROM a
), c AS (SELECT asset, t, close / nullif(lag(close, 20) {_S}, 0) - 1 AS mom20, close / nullif(lag(close, 5) {_S}, 0) - 1 AS mom5, vol20, vol5 / nullif(vol20, 0) AS vol_ratio, (high - low) / nullif(close, 0) AS range FROM b) """
    + q_columns({n: f"coalesce({z(n)}, 0.0)" for n in ("mom20", "mom5", "vol20", "vol_ratio", "range")})
    + " FROM c",
    "volatility": _BARS
    + f", a AS (SELECT *, close / nullif(lag(close) {_S}, 0) - 1 AS r FROM bars) "
    + q_columns(
        {
            "daily_vol": full(f"stddev_samp(r) {over(20)}", 21),
            "realised_vol": f"{full(f'stddev_pop(r) {over(12)}', 13)} * sqrt(252.0::DOUBLE)",
            "causal_z": f"CASE WHEN stddev_pop(close) {over(61)} > 1e-10 THEN (close - avg(close) {over(61)}) / stddev_pop(close) {over(61)} ELSE 0.0 END",
        }
    )
    + " FROM a",
}
