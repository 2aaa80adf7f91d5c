"""The factor-expression language: text to tree to staged windows.

Grammar: ``expr := NUMBER | FIELD | 'const' '(' NUMBER ')' | OP '(' expr {',' expr} ')'``; a name may hold dots (``lib.momentum``).
A window function cannot stand within another, so each rolling or cross-sectional node becomes a column of its own stage;
equal sub-trees share one column, and stages of one kind share an exchange and a sort.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barlens.functions.columns import TINY, guarded_corr, safe_div, signed_log, strict_greatest, strict_least

FIELDS = ("open", "high", "low", "close", "volume", "vwap", "amount")
ARITY = {
    **dict.fromkeys(("add", "sub", "mul", "div", "min", "max", "delay", "ts_mean", "ts_std", "ts_max", "ts_min"), 2),
    **dict.fromkeys(("neg", "abs", "sqrt", "log", "rank", "zscore"), 1),
    "ts_corr": 3,
}
WINDOWED = ("delay", "ts_mean", "ts_std", "ts_max", "ts_min", "ts_corr")
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|-\d+\.?\d*)|([A-Za-z_][\w.]*)|([(),]))")


class ExpressionError(ValueError):
    """The text is not an expression of the language."""


@dataclass(frozen=True)
class Node:
    op: str
    children: tuple[Node, ...] = ()
    value: float | None = None

    def __str__(self) -> str:
        if self.op == "const":
            return f"const({self.value:g})"
        return f"{self.op}({', '.join(map(str, self.children))})" if self.children else self.op


def tokenise(text: str) -> list[str]:
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected character at {at}: {text[at:at + 10]!r}")
        tokens.append(m.group().strip())
        at = m.end()
    return tokens


def parse(text: str, libraries: frozenset[str] = frozenset()) -> Node:
    """The tree of an expression. Windows and delays must be constants of at least 1 (delays: 0)."""
    tokens = tokenise(text)
    place = count()
    at = next(place)

    def take(expected: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or (expected and tokens[at] != expected):
            raise ExpressionError(f"expected {expected or 'more'} at token {at} of {text!r}")
        at += 1
        return tokens[at - 1]

    def expression() -> Node:
        token = take()
        if re.match(r"-?\d", token):
            return Node("const", value=float(token))
        if token == "const":
            take("(")
            number = take()
            take(")")
            return Node("const", value=float(number))
        if token in ARITY:
            take("(")
            children = [expression()]
            while at < len(tokens) and tokens[at] == ",":
                take(",")
                children.append(expression())
            take(")")
            if len(children) != ARITY[token]:
                raise ExpressionError(f"{token} takes {ARITY[token]} arguments, not {len(children)}")
            if token in WINDOWED and (children[-1].op != "const" or children[-1].value < (0 if token == "delay" else 1) or children[-1].value % 1):
                raise ExpressionError(f"the last argument of {token} must be a whole number, not {children[-1]}")
            return Node(token, tuple(children))
        if token in FIELDS or token in libraries:
            return Node(token)
        raise ExpressionError(f"unknown name {token!r}")

    tree = expression()
    if at != len(tokens):
        raise ExpressionError(f"more than one expression in {text!r}")
    return tree


def clamp_windows(node: Node, low: int = 2, high: int = 120) -> Node:
    """An optional rewrite: every window and delay within [low, high]."""
    children = tuple(clamp_windows(c, low, high) for c in node.children)
    if node.op in WINDOWED:
        children = (*children[:-1], Node("const", value=float(min(max(children[-1].value, low), high))))
    return Node(node.op, children, node.value)


def fields_of(node: Node) -> set[str]:
    return {node.op} - ARITY.keys() - {"const"} if not node.children else set().union(*map(fields_of, node.children))


def look_back(node: Node) -> int:
    """Bars before the current one that the expression needs."""
    inner = max(map(look_back, node.children), default=0)
    own = int(node.children[-1].value) - (node.op != "delay") if node.op in WINDOWED else 0
    return inner + own


def on_fields(node: Node) -> bool:
    """Whether a rolling node reads fields of the bars and what rolls over them, and nothing else."""

    def plain(n: Node) -> bool:
        return n.op not in ("rank", "zscore") and (bool(n.children) or n.op == "const" or n.op in FIELDS) and all(map(plain, n.children))

    return node.op in WINDOWED and plain(node)


def rolls(node: Node) -> bool:
    return node.op in WINDOWED or any(map(rolls, node.children))


def size_of(node: Node) -> int:
    return 1 + sum(map(size_of, node.children))


def token_similarity(a: str, b: str) -> float:
    """Jaccard similarity of the names in two expressions."""
    x, y = set(re.findall(r"[A-Za-z_]\w*", a)), set(re.findall(r"[A-Za-z_]\w*", b))
    return len(x & y) / len(x | y) if x | y else 0.0


SCALARS: dict[str, Callable[..., Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": safe_div,
    "neg": lambda a: -a,
    "abs": F.abs,
    "sqrt": lambda a: F.sqrt(F.abs(a)),
    "log": signed_log,
    "min": strict_least,
    "max": strict_greatest,
}


def series() -> WindowSpec:
    """One asset's bars in order."""
    return Window.partitionBy("asset").orderBy("t")


def cross() -> WindowSpec:
    """All assets of one date."""
    return Window.partitionBy("t")


def tied_rank(within: WindowSpec, *order: Column | str) -> Column:
    """Rank from 1, ties by average. Peers are counted in the same window, so that they need no shuffle of their own."""
    w = within.orderBy(*order)
    return F.rank().over(w) + (F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2


def cross_rank(a: Column) -> Column:
    """Ordinal rank of what is not null, from 0 to 1, ties by asset; null where the cross-section has one value."""
    n = F.count(a).over(cross())
    place = F.row_number().over(cross().orderBy(a.asc_nulls_last(), "asset"))
    return F.when(a.isNotNull() & (n > 1), (place - 1) / (n - 1))


def cross_zscore(a: Column) -> Column:
    """(a - mean) / (population deviation + 1e-10), 0 where the deviation is at most 1e-10."""
    mean, std = F.avg(a).over(cross()), F.stddev_pop(a).over(cross())
    return F.when(a.isNotNull(), F.when(std > TINY, (a - mean) / (std + TINY)).otherwise(0.0))


def trailing(w: int):
    return series().rowsBetween(-(w - 1), 0)


def when_full(c: Column, w: int) -> Column:
    """Null until the asset has ``w`` bars."""
    return F.when(F.row_number().over(series()) >= w, c)


def rolling(op: str, args: list[Column], w: int) -> Column:
    if op == "delay":
        return F.lag(args[0], w).over(series()) if w else args[0]
    if op == "ts_corr":
        return when_full(F.coalesce(guarded_corr(args[0], args[1], trailing(w)), F.lit(0.0)), w)
    f = {"ts_mean": F.avg, "ts_std": F.stddev_pop, "ts_max": F.max, "ts_min": F.min}[op]
    return when_full(f(args[0]).over(trailing(w)), w)


def evaluate(bars: DataFrame, expressions: dict[str, str | Node], libraries: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """(asset, t, one column for each named expression). Fails at once if ``bars`` lacks a field that is used.

    ``libraries``: named series (``lib.x``) as functions that return a Column over the bars.
    """
    libraries = libraries or {}
    trees = {name: parse(e, frozenset(libraries)) if isinstance(e, str) else e for name, e in expressions.items()}
    used = set().union(*map(fields_of, trees.values())) if trees else set()
    missing = sorted(f for f in used if f not in libraries and f not in bars.columns)
    if missing:
        raise ExpressionError(f"the bars have no {', '.join(missing)}")
    df = bars.select("asset", "t", *sorted(f for f in used if f not in libraries))
    stages: dict[str, str] = {}
    for name in sorted(used & libraries.keys()):
        stages[name] = f"__lib{len(stages)}"
    if stages:
        df = bars.select("asset", "t", *sorted(f for f in used if f not in libraries), *[libraries[n]().alias(c) for n, c in stages.items()])

    def depth(node: Node) -> int:
        inner = max(map(depth, node.children), default=0)
        return inner + (node.op in WINDOWED or node.op in ("rank", "zscore"))

    def column(node: Node) -> Column:
        key = str(node)
        if key in stages:
            return F.col(stages[key])
        if node.op == "const":
            return F.lit(node.value)
        if not node.children:
            return F.col(node.op)
        if node.op in SCALARS:
            return SCALARS[node.op](*map(column, node.children))
        if node.op == "rank":
            return cross_rank(column(node.children[0]))
        if node.op == "zscore":
            return cross_zscore(column(node.children[0]))
        return rolling(node.op, list(map(column, node.children[:-1])), int(node.children[-1].value))

    def windows(node: Node):
        for c in node.children:
            yield from windows(c)
        if node.op in WINDOWED or node.op in ("rank", "zscore"):
            yield node

    nodes = {str(n): n for tree in trees.values() for n in windows(tree)}
    # By depth, rolling nodes before cross-sectional ones, so that equal partitionings follow one another.
    for level in sorted({(depth(n), n.op in ("rank", "zscore")) for n in nodes.values()}):
        own = [n for n in nodes.values() if (depth(n), n.op in ("rank", "zscore")) == level]
        if level[1]:  # what a date ranks is shuffled as one column, not as all the columns that it is made of
            inner = {str(c): f"__a{len(stages) + i}" for i, c in enumerate(n.children[0] for n in own) if c.op in SCALARS and str(c) not in stages}
            df = df.withColumns({inner[str(c)]: column(c) for c in (n.children[0] for n in own) if str(c) in inner})
            stages.update(inner)
        made = {str(n): column(n) for n in own}
        names = {key: f"__n{len(stages) + i}" for i, key in enumerate(made)}
        df = df.withColumns({names[key]: c for key, c in made.items()})
        stages.update(names)
    return df.select("asset", "t", *[column(tree).alias(name) for name, tree in trees.items()])


def latest(values: DataFrame) -> DataFrame:
    """The rows of the last date."""
    last = values.agg(F.max("t").alias("__last"))
    return values.join(F.broadcast(last), F.col("t") == F.col("__last")).drop("__last")
