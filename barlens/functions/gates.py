"""Gates on what a step puts out, as Columns: each gives (passed, score), the score from 0 to 1; nulls count as 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from barlens.functions.columns import clip

#: Least t-statistic and information ratio, least ICIR, monotonicity and half-life in periods, most cost in bps and share of impact, least chance and most entropy of a regime.
T_STAT, INFORMATION = 2.0, 0.3
ICIR, MONOTONICITY, HALF_LIFE = 0.3, 0.5, 42.0
COST_BPS, IMPACT_BPS, IMPACT_SHARE = 200.0, 150.0, 0.95
CHANCE, ENTROPY = 0.5, 1.0


def _known(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def _gate(passed: Column, score: Column) -> Column:
    return F.struct(passed.alias("passed"), clip(score, 0.0, 1.0).alias("score"))


def significance(t_stat: Column, excess: Column, information: Column) -> Column:
    """Of a back-test: a t-statistic above 2, an excess return above 0, and an information ratio above 0.3."""
    t, passed = _known(t_stat), (_known(t_stat) > T_STAT) & (_known(excess) > 0) & (_known(information) > INFORMATION)
    return _gate(passed, F.greatest(t / 3, F.when(passed, 0.1).otherwise(0.0)))


def hurdle(icir: Column, monotonicity: Column, half_life: Column) -> Column:
    """Of a factor."""
    i, passed = _known(icir), (_known(icir) > ICIR) & (_known(monotonicity) > MONOTONICITY) & (_known(half_life) > HALF_LIFE)
    return _gate(passed, F.greatest(i / 0.5, F.when(passed, 0.1).otherwise(0.0)))


def constraints(largest: Column, least: Column, total: Column, cap: float) -> Column:
    """Of weights: none above the cap, none below 0, and a sum of one."""
    passed = (_known(largest) <= cap + 1e-6) & (_known(least) >= -1e-9) & (F.abs(_known(total) - 1) <= 1e-6)
    return _gate(passed, F.when(passed, 1.0).otherwise(0.0))


def reasonable_cost(total_bps: Column, impact_bps: Column) -> Column:
    total, impact = _known(total_bps), _known(impact_bps)
    share = F.when(total > 1e-9, impact / total).otherwise(0.0)
    return _gate((total < COST_BPS) & (impact < IMPACT_BPS) & (share < IMPACT_SHARE), (COST_BPS - total) / COST_BPS)


def confident(chances: list[Column]) -> Column:
    """Of a regime: a largest chance above one half, and an entropy (in nats) below 1."""
    p = [_known(c) for c in chances]
    entropy = reduce(lambda a, b: a + b, [F.when(c > 0, -c * F.log(c)).otherwise(0.0) for c in p])
    return _gate((F.greatest(*p) > CHANCE) & (entropy < ENTROPY), F.greatest(*p))


def fresh(age_days: Column, most: float) -> Column:
    """Of data: an age from 0 to ``most`` days; an unknown age does not pass."""
    return _gate(F.coalesce(age_days.between(0, most), F.lit(False)), F.coalesce(1 - age_days / (2 * most), F.lit(0.0)))
