"""Candidates judged against a registry of accepted factors, refined until nothing new passes, and searched for on what the chosen ones leave.

A round ranks and correlates all its candidates, and the registry's factors, in one plan; what reaches the driver is a few numbers for each
candidate. Expressions stand for themselves: a registry is a list of them. Where ``forward`` is None it is the return to the next bar, from the same pass.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.functions.columns import quantised
from barlens.operators import evolution, expression, screening, selection
from barlens.operators.expression import Node
from barlens.sources import scratch
from barlens.sources.versions import VersionedTable


@dataclass(frozen=True)
class Gates:
    ic: float = 0.01
    t_stat: float = 1.0
    positive: float = 0.5
    correlation: float = 0.7
    dates: int = 3


@dataclass(frozen=True)
class Judged:
    """What a candidate's evaluation found; ``reason``: the first gate that it fails, or "ok"."""

    expression: str
    generation: int
    n_dates: int
    ic: float
    t_stat: float
    positive: float
    correlation: float
    alike: str
    passed: bool
    reason: str


def swapped(node: Node) -> Node | None:
    """A difference the other way round; None for anything else."""
    return Node("sub", node.children[::-1]) if node.op == "sub" else None


def variants(text: str) -> list[str]:
    """What a candidate that failed is tried as: a difference turned round, and each delay halved and doubled, one at a time."""
    tree, out = expression.parse(text), []
    if (turned := swapped(tree)) is not None:
        out.append(turned)
    for path in evolution.places(tree):
        node = evolution.at(tree, path)
        if node.op == "delay":
            for n in (max(1, int(node.children[1].value) // 2), int(node.children[1].value) * 2):
                out.append(evolution.replaced(tree, path, Node("delay", (node.children[0], Node("const", value=float(n))))))
    return [e for e in dict.fromkeys(map(str, out)) if e != str(tree)]


def stacked_values(bars: DataFrame, forward: DataFrame | None, expressions: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """Written rows (name, asset, t, score, fwd) of the expressions, and their names; equal trees are one."""
    named = {f"e{i:03d}": e for i, e in enumerate(dict.fromkeys(str(expression.parse(e)) for e in expressions))}
    return scratch.written(selection.candidates(bars, named) if forward is None else selection.stacked(expression.evaluate(bars, named), forward, named), "judged"), named


def evaluated(bars: DataFrame, forward: DataFrame | None, candidates: Iterable[str], registry: Iterable[str], gates: Gates = Gates(), generation: int = 0) -> list[Judged]:  # noqa: B008
    """The candidates in falling order of t-statistic (ties by expression), each judged by its rank-ICs and by its likeness, the mean rank correlation by
    date, to the registry's factors and to those accepted before it in this round."""
    texts, known = [str(expression.parse(e)) for e in candidates], [str(expression.parse(e)) for e in registry]
    rows, named = stacked_values(bars, forward, [*texts, *known])
    name_of = {e: n for n, e in named.items()}
    ic = screening.ic_by_date(rows).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("ic").alias("ic"), F.stddev_pop("ic").alias("sd"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"))
    found = {r["name"]: r for r in ic.collect()}
    alike = {(r["a"], r["b"]): abs(r["corr"] or 0.0) for r in screening.mean_correlations(rows).collect()}

    def stats_of(e: str) -> tuple[int, float, float, float]:
        r = found.get(name_of[e])
        if r is None:
            return 0, 0.0, 0.0, 0.0
        return r["n"], r["ic"], (r["ic"] / (r["sd"] / r["n"] ** 0.5) if r["sd"] > 1e-12 else 0.0), r["positive"]

    accepted, out = list(known), []
    for e in sorted(dict.fromkeys(texts), key=lambda e: (-round(stats_of(e)[2], 8), e)):
        n, mean, t, positive = stats_of(e)
        like = [(1.0 if o == e else alike.get((min(name_of[e], name_of[o]), max(name_of[e], name_of[o])), 0.0), o) for o in accepted]
        most, other = max(like, key=lambda x: (round(x[0], 8), x[1]), default=(0.0, ""))
        tests = (("dates", n >= gates.dates), ("ic", mean >= gates.ic), ("t_stat", t >= gates.t_stat), ("positive", positive >= gates.positive), ("correlation", most <= gates.correlation))
        reason = next((k for k, ok in tests if not ok), "ok")
        if reason == "ok":
            accepted.append(e)
        out.append(Judged(e, generation, n, mean, t, positive, most, other, reason == "ok", reason))
    return out


def refined(bars: DataFrame, forward: DataFrame | None, candidates: Iterable[str], registry: Iterable[str] = (), gates: Gates = Gates(), generations: int = 4, most: int = 64) -> list[Judged]:  # noqa: B008
    """Rounds of :func:`evaluated`: what passes joins the registry, what fails comes back as its :func:`variants`, until a round passes nothing or has nothing new.

    An expression is judged once; of the variants of a round the first ``most`` are tried, in the order of the candidates that failed."""
    pool, known, out, seen = [str(expression.parse(e)) for e in candidates], [str(expression.parse(e)) for e in registry], [], set()
    for g in range(generations):
        pool = [e for e in dict.fromkeys(pool) if e not in seen and e not in known]
        if not pool:
            break
        judged = evaluated(bars, forward, pool, known, gates, g)
        seen |= set(pool)
        out += judged
        fresh = [j.expression for j in judged if j.passed]
        known += fresh
        if g and not fresh:
            break
        pool = [v for j in judged if not j.passed for v in variants(j.expression)][:most]
    return out


def as_table(bars: DataFrame, judged: list[Judged]) -> DataFrame:
    schema = "expression string, generation int, n_dates long, ic double, t_stat double, positive double, correlation double, alike string, passed boolean, reason string"
    return bars.sparkSession.createDataFrame([tuple(asdict(j).values()) for j in judged], schema)


# What the chosen ones leave.


def _sides(regressors: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...]]:
    """(asset, t) with a constant and the regressors, and the names of these columns.

    Scaled within dates, so that sums of products of large and small regressors keep their digits; a constant one is 0."""
    x = tuple(f"__x{i}" for i in range(len(names)))
    sides = regressors.select("asset", "t", *[F.col(c).alias(k) for c, k in zip(names, x, strict=True)]).na.drop()
    spread = sides.groupBy("t").agg(F.lit(1.0).alias("__one"), *[f(k).alias(f"{p}{k}") for k in x for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = [F.when(F.col(f"s{k}") > 1e-12, (F.col(k) - F.col(f"m{k}")) / F.col(f"s{k}")).otherwise(0.0).alias(k) for k in x]
    return sides.join(F.broadcast(spread), "t").select("asset", "t", "__one", *scaled), ("__one", *x)


def residualised(rows: DataFrame, regressors: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``rows`` (name, asset, t, score, ...) with ``score`` replaced by what a least-squares fit by candidate and date on ``names`` of ``regressors`` (asset, t) and a constant leaves.

    Scores are z-scored within candidate and date first; rows without a regressor are left out."""
    sides, x = _sides(regressors, names)
    return _left_over(rows.join(sides, ["asset", "t"], "left"), x)


def residuals_of(wide: DataFrame, columns: Iterable[str], regressors: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """:func:`residualised` for the ``columns`` of ``wide`` (asset, t, columns, fwd): the regressors join once, before the candidates are stacked, so that no stacked row is shuffled."""
    sides, x = _sides(regressors, names)
    joined = scratch.written(wide.where("fwd IS NOT NULL").join(sides, ["asset", "t"], "left"), "regressed")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("score")) for n in columns]))
    rows = joined.select("asset", "t", "fwd", *x, each.alias("e")).select("e.name", "asset", "t", "e.score", "fwd", *x)
    return _left_over(rows.where("score IS NOT NULL AND NOT isnan(score)"), x)


def _left_over(rows: DataFrame, x: tuple[str, ...]) -> DataFrame:
    """What is known of a candidate and date is summed by partial sums and joined back as small tables; tasks solve a small system for each date."""
    by = rows.groupBy("name", "t").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("sd"))
    z = F.when(F.col("sd") > 1e-10, (F.col("score") - F.col("m")) / F.col("sd")).otherwise(0.0)
    d = rows.where("__one IS NOT NULL").join(F.broadcast(by), ["name", "t"]).withColumn("score", z).drop("m", "sd")
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = d.groupBy("name", "t").agg(*[F.sum(F.col(x[i]) * F.col(x[j])).alias(f"p{i}_{j}") for i, j in pairs], *[F.sum(F.col(c) * F.col("score")).alias(f"q{i}") for i, c in enumerate(x)])
    kind = rows.schema["t"].dataType.simpleString()

    def solve(parts):
        for p in parts:
            a, b = np.empty((len(p), len(x), len(x))), np.stack([p[f"q{i}"] for i in range(len(x))], axis=1) if len(p) else np.empty((0, len(x)))
            for i, j in pairs:
                a[:, i, j] = a[:, j, i] = p[f"p{i}_{j}"]
            beta = [np.linalg.lstsq(m, y, rcond=1e-10)[0] for m, y in zip(a, b, strict=True)]
            yield pd.DataFrame({"name": p["name"], "t": p["t"], "beta": [w.tolist() for w in beta]})

    beta = sums.mapInPandas(solve, f"name string, t {kind}, beta array<double>")
    fitted = sum((F.col(c) * F.col("beta")[i] for i, c in enumerate(x)), F.lit(0.0))
    return d.join(F.broadcast(beta), ["name", "t"]).withColumn("score", quantised(F.col("score") - fitted, 1e9)).drop("beta", *x)


def residual_ics(bars: DataFrame, forward: DataFrame | None, trees: dict[str, Node], regressors: DataFrame, names: tuple[str, ...]) -> tuple[dict[str, float], DataFrame]:
    """Mean rank-IC of what the regressors leave of each tree, and the written residuals (name, asset, t, score, fwd)."""
    wide = selection.with_forward(bars, trees) if forward is None else expression.evaluate(bars, trees).join(forward, ["asset", "t"])
    left = scratch.written(residuals_of(wide, trees, regressors, names).select("name", "asset", "t", "score", "fwd"), "residuals")
    ic = screening.ic_by_date(left).groupBy("name").agg(F.avg("ic").alias("ic"))
    return dict(ic.collect()), left


def orthogonal_search(bars: DataFrame, forward: DataFrame | None, exposures: DataFrame, styles: tuple[str, ...], generations: int = 3, size: int = 12, least: float = 0.02, parsimony: float = 0.001, seed: int = 1, seeds: Iterable[str] = (), breed: Callable[[list[Node], random.Random], Node] | None = None) -> list[tuple[int, str, float]]:
    """(generation, expression, residual IC) of the factors chosen: in each generation the one whose residual's |IC| less a charge for size is the largest, if the IC reaches ``least``.

    Candidates are scored on what the styles (asset) and all factors chosen before leave of them, by date; a chosen factor's residual joins the regressors, so the chosen ones
    are orthogonal in turn. The next generation is bred from the best of the last; all choices follow from ``seed``."""
    rng = random.Random(seed)
    population = [expression.parse(e) for e in seeds]
    population += [evolution.random_tree(rng, 2) for _ in range(max(0, size - len(population)))]
    regressors, names, chosen = bars.select("asset", "t").join(exposures.select("asset", *styles), "asset"), tuple(styles), []
    for g in range(generations):
        distinct = {str(t): t for t in population}
        trees = {f"f{i:03d}": t for i, t in enumerate(distinct.values())}
        ics, left = residual_ics(bars, forward, trees, regressors, names)
        worth = lambda n: abs(ics.get(n) or 0.0) - parsimony * expression.size_of(trees[n])  # noqa: B023, E731
        order = sorted(trees, key=lambda n: (-round(worth(n), 8), str(trees[n])))
        best = order[0]
        if abs(ics.get(best) or 0.0) >= least:
            chosen.append((g, str(trees[best]), ics[best]))
            column = f"chosen{g}"
            own = left.where(F.col("name") == best).select("asset", "t", F.col("score").alias(column))
            regressors, names = scratch.written(regressors.join(own, ["asset", "t"]), "regressors"), (*names, column)
        top = [trees[n] for n in order[: max(2, size // 3)]]
        make = breed or (lambda top, rng: evolution.crossover(rng.choice(top), rng.choice(top), rng) if rng.random() < 0.5 else evolution.mutated(rng.choice(top), rng))
        population = [t for t in (make(top, rng) for _ in range(size)) if expression.size_of(t) <= 25] or top
    return chosen


# Promotion.


def challenge(ic: DataFrame, champion: str | None, challenger: str, margin: float) -> dict:
    """Both names of ``ic`` (name, t, ic) on the dates that both have: their mean ICs, and whether the challenger is promoted, which
    takes ``margin`` more than the champion's (any IC above 0, if there is none)."""
    names = [c for c in (champion, challenger) if c is not None]
    d = ic.where(F.col("name").isin(names))
    common = d.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(set(names))).select("t")
    by = {r["name"]: r for r in d.join(common, "t").groupBy("name").agg(F.avg("ic").alias("ic"), F.count(F.lit(1)).alias("n")).collect()}
    new, old = (by[c]["ic"] if c in by else None for c in (challenger, champion))
    promoted = new is not None and (new > 0 if champion is None else new > old + margin)
    return {"champion": champion, "challenger": challenger, "n_dates": by[challenger]["n"] if challenger in by else 0, "champion_ic": old, "challenger_ic": new, "promoted": promoted}


REGISTRY = "step int, champion string, challenger string, n_dates long, champion_ic double, challenger_ic double, promoted boolean, serving string"


def challenged(table: VersionedTable, ic: DataFrame, challenger: str, margin: float = 0.0) -> dict:
    """One challenge against what the registry of models at ``table`` serves, written as its next version; a refused one is kept there, too.

    A write that fails, or another one in between (ConflictError), leaves the model that served before."""
    spark, now = ic.sparkSession, table.version()
    last = table.read(now).orderBy(F.desc("step")).first() if now else None
    found = challenge(ic, last["serving"] if last else None, challenger, margin)
    row = {"step": last["step"] + 1 if last else 0, **found, "serving": challenger if found["promoted"] else found["champion"]}
    table.append(spark.createDataFrame([tuple(row[c.split()[0]] for c in REGISTRY.split(", "))], REGISTRY).coalesce(1), after=now, why=f"{challenger} {'promoted' if found['promoted'] else 'refused'}")
    return row
