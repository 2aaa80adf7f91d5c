"""Scalar building blocks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quantised(c: Column | str, steps: float = 1e4) -> Column:
    """Rounded half up to 1/steps with plain double arithmetic, which other engines repeat exactly."""
    return F.floor(col(c) * F.lit(steps) + F.lit(0.5)).cast("double") / F.lit(steps)


def quantised_sql(x: str, steps: str = "1e4") -> str:
    """The same in DuckDB."""
    return f"CAST(floor(({x}) * {steps} + 0.5) AS DOUBLE) / {steps}"


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, and 0 where |b| is at most 1e-10; null if a or b is null."""
    a, b = col(a), col(b)
    return F.when(F.abs(b) > TINY, a / b).when(a.isNotNull() & b.isNotNull(), F.lit(0.0))


def signed_log(a: Column | str) -> Column:
    return F.signum(col(a)) * F.log1p(F.abs(col(a)))


def strict_least(a: Column, b: Column) -> Column:
    """The lesser, null if either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def strict_greatest(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(low)), F.lit(high)))


def normalised_code(c: Column | str) -> Column:
    """The six digits of an exchange code with a market prefix or suffix ('SH600519', '600519.SH')."""
    digits = F.regexp_extract(F.upper(F.trim(col(c))), r"(\d{6})", 1)
    return F.when(digits != "", digits).otherwise(F.upper(F.trim(col(c))))


def price_limit_ratio(code: Column | str) -> Column:
    """Daily price limit of a board: 20 % for codes 30/68, 30 % for 8/4/92, else 10 %."""
    c = normalised_code(code)
    return F.when(c.rlike("^(30|68)"), 0.2).when(c.rlike("^(8|4|92)"), 0.3).otherwise(0.1)


def half_life_weight(age_hours: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_hours, F.lit(0.0)) / half_life)


def guarded_corr(x: Column, y: Column, over=None, least: int = 2) -> Column:
    """Pearson correlation over pairs; null if there are fewer than ``least`` or either side does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    wrap = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    n, cov = wrap(F.count(a)), wrap(F.covar_pop(a, b))
    sa, sb = wrap(F.stddev_pop(a)), wrap(F.stddev_pop(b))
    return F.when((n >= least) & (sa > TINY) & (sb > TINY), cov / (sa * sb))


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 26.2.17 (error below 7.5e-8)."""
    t = 1 / (1 + F.lit(0.2316419) * F.abs(x))
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    tail = F.exp(-x * x / 2) / F.lit(2.5066282746310002) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)
