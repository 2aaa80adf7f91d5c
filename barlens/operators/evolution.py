"""Search for factor expressions: a population is scored in one Spark plan for each generation, the loop itself is small."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.operators import expression, stats
from barlens.operators.expression import FIELDS, Node

UNARY = ("neg", "abs", "log", "rank", "zscore")
BINARY = ("add", "sub", "mul", "div", "min", "max")
ROLLING = ("delay", "ts_mean", "ts_std", "ts_max", "ts_min")


def random_tree(rng: random.Random, depth: int) -> Node:
    if depth <= 0 or rng.random() < 0.2:
        return Node(rng.choice(FIELDS))
    kind = rng.choice((UNARY, BINARY, ROLLING))
    op = rng.choice(kind)
    children = [random_tree(rng, depth - 1) for _ in range(2 if kind is BINARY else 1)]
    if kind is ROLLING:
        children.append(Node("const", value=float(rng.choice((2, 3, 5, 10)))))
    return Node(op, tuple(children))


def places(node: Node, path: tuple[int, ...] = ()) -> list[tuple[int, ...]]:
    """Paths of the sub-trees that may be replaced: all but the windows."""
    own = [] if node.op == "const" else [path]
    return own + [p for i, c in enumerate(node.children) for p in places(c, (*path, i))]


def at(node: Node, path: tuple[int, ...]) -> Node:
    return at(node.children[path[0]], path[1:]) if path else node


def replaced(node: Node, path: tuple[int, ...], new: Node) -> Node:
    if not path:
        return new
    children = list(node.children)
    children[path[0]] = replaced(children[path[0]], path[1:], new)
    return Node(node.op, tuple(children), node.value)


def crossover(a: Node, b: Node, rng: random.Random) -> Node:
    return replaced(a, rng.choice(places(a)), at(b, rng.choice(places(b))))


def mutated(a: Node, rng: random.Random) -> Node:
    return replaced(a, rng.choice(places(a)), random_tree(rng, 2))


def fitness(bars: DataFrame, forward: DataFrame, population: dict[str, Node], parsimony: float = 0.002) -> dict[str, float]:
    """|mean rank-IC| less a charge for size, for all trees from one plan."""
    values = expression.evaluate(bars, dict(population))
    names = list(population)
    stacked = values.select("asset", "t", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("score")) for n in names])).alias("x")).select("asset", "t", "x.*")
    pairs = stacked.join(forward, ["asset", "t"]).where("score is not null and fwd is not null and not isnan(score)")

    w = Window.partitionBy("name", "t")
    ranked = pairs.select("name", "t", F.row_number().over(w.orderBy("score", "asset")).alias("x"), F.row_number().over(w.orderBy("fwd", "asset")).alias("y"))
    ic = ranked.groupBy("name", "t").agg(F.coalesce(stats.guarded_corr(F.col("x").cast("double"), F.col("y").cast("double"), least=5), F.lit(0.0)).alias("ic"))
    means = dict(ic.groupBy("name").agg(F.avg("ic")).collect())
    return {n: abs(means.get(n) or 0.0) - parsimony * expression.size_of(t) for n, t in population.items()}


def evolve(bars: DataFrame, forward: DataFrame, size: int = 16, generations: int = 3, elite: int = 4, depth: int = 3, seed: int = 1) -> list[tuple[str, float]]:
    """Distinct expressions of the last generations by falling fitness."""
    rng = random.Random(seed)
    best: dict[str, float] = {}
    population = [random_tree(rng, depth) for _ in range(size)]
    for _ in range(generations):
        trees = {str(t): t for t in population}
        named = {f"f{i}": t for i, t in enumerate(trees.values())}
        found = fitness(bars, forward, named)
        best |= {str(named[n]): f for n, f in found.items()}
        top = [expression.parse(e) for e, _ in sorted(best.items(), key=lambda kv: (-kv[1], kv[0]))[: max(elite, 2)]]
        population = [crossover(rng.choice(top), rng.choice(top), rng) if rng.random() < 0.6 else mutated(rng.choice(top), rng) for _ in range(size)]
        population = [t for t in population if expression.size_of(t) <= 30]
    return sorted(best.items(), key=lambda kv: (-kv[1], kv[0]))


