"""The engine behind one object and a command line: back-test, validate, optimise, schedule, regime, queries.

A result carries its table as a DataFrame, its headline numbers, and the gates that it passed or failed.
"""

from __future__ import annotations

import argparse
import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens import registry
from barlens.operators import backtest, execution, expression, factors, portfolio, risk, stats, structured


@dataclass
class Result:
    tool: str
    success: bool
    data: DataFrame | None = None
    metrics: dict[str, float] = field(default_factory=dict)
    gates: dict[str, bool] = field(default_factory=dict)
    caveats: list[str] = field(default_factory=list)
    seconds: float = 0.0


GATES: dict[str, dict[str, Callable[[dict], bool]]] = {
    "backtest": {"sharpe": lambda m: m.get("sharpe", 0) > 0, "drawdown": lambda m: m.get("max_drawdown", -1) > -0.5, "length": lambda m: m.get("n", 0) >= 12},
    "signal": {"icir": lambda m: abs(m.get("icir", 0)) > 0.1, "monotonicity": lambda m: m.get("monotonicity", 0) >= 0.5, "half_life": lambda m: m.get("half_life", 0) >= 0},
    "cost": {"bps": lambda m: m.get("bps", 1e9) < 100},
}


def load_config(path: str | None, defaults: dict, prefix: str = "BARLENS_") -> dict:
    """Defaults, then a JSON file, then environment variables ``PREFIX_KEY`` (JSON values); maps are merged."""

    def merged(a: dict, b: dict) -> dict:
        return {k: merged(a[k], b[k]) if isinstance(a.get(k), dict) and isinstance(b.get(k), dict) else b.get(k, a.get(k)) for k in {**a, **b}}

    out = dict(defaults)
    if path:
        with open(path) as f:
            out = merged(out, json.load(f))
    for name, raw in os.environ.items():
        if name.startswith(prefix) and name[len(prefix) :].lower() in out:
            try:
                value = json.loads(raw)
            except ValueError:
                value = raw
            out[name[len(prefix) :].lower()] = value
    return out


class Engine:
    """Tools over one panel of bars (asset, t, open ... amount)."""

    def __init__(self, bars: DataFrame, periods: int = 252):
        self.bars, self.periods = bars, periods
        self.tools: dict[str, Callable[..., Result]] = {"backtest": self.backtest, "validate": self.validate, "walk_forward": self.walk_forward, "optimise": self.optimise, "schedule": self.schedule, "regime": self.regime}
        self.history: list[tuple[str, bool, float]] = []

    def call(self, tool: str, **options) -> Result:
        """Run a tool by name; what it raises for bad input becomes a failed result."""
        began = time.time()
        try:
            result = self.tools[tool](**options)
        except (KeyError, ValueError) as e:
            result = Result(tool, False, caveats=[f"{type(e).__name__}: {e}"])
        result.seconds = time.time() - began
        self.history.append((tool, result.success, result.seconds))
        return result

    def _scored(self, signal: str) -> DataFrame:
        r = self.bars.select("asset", "t", factors.change(F.col("close")).alias("r"))
        return expression.evaluate(self.bars, {"score": signal}).join(r, ["asset", "t"])

    def _report(self, tool: str, kind: str, data: DataFrame, row) -> Result:
        metrics = {k: float(v) for k, v in row.asDict().items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
        return Result(tool, True, data, metrics, {n: bool(g(metrics)) for n, g in GATES[kind].items()})

    def backtest(self, signal: str, n_hold: int = 10, every: int = 21, cost_bps: float = 17.0) -> Result:
        days = backtest.rebalanced(self._scored(signal), n_hold, every, cost_bps)
        perf = stats.performance(days.select(F.lit("all").alias("asset"), "t", F.col("net").alias("r")), periods=self.periods).first()
        return self._report("backtest", "backtest", days, perf) if perf else Result("backtest", False, days, caveats=["no dates to hold anything"])

    def validate(self, signal: str, horizon: int = 1) -> Result:
        pairs = stats.paired(expression.evaluate(self.bars, {"score": signal}), stats.forward_returns(self.bars, horizon))
        ic = stats.rank_ic(pairs)
        row = stats.ic_summary(ic).crossJoin(stats.half_life(ic)).crossJoin(stats.monotonicity(stats.group_returns(pairs))).first()
        return self._report("validate", "signal", ic, row)

    def walk_forward(self, signal: str, train: int = 24, test: int = 6, step: int = 6, n_hold: int = 10) -> Result:
        out = backtest.walk_forward(self._scored(signal), train, test, step, n_hold)
        row = out.agg(F.avg("oos_sharpe").alias("oos_sharpe"), F.avg((F.col("oos_sharpe") < 0).cast("double")).alias("overfit")).first()
        return Result("walk_forward", True, out, {k: v for k, v in row.asDict().items() if v is not None})

    def optimise(self, method: str = "hrp", cap: float = 0.2, structure: structured.Structure | None = None) -> Result:
        """Weights by a dense covariance; of more assets than a dense block holds, or with a ``structure``, under a factor structure (of momentum and volatility
        by default). Hierarchical weights compare all pairs of assets and so keep to the dense block."""
        r = self.bars.select("asset", "t", factors.change(F.col("close")).alias("r"))
        if structure is None and method != "hrp" and r.select("asset").distinct().count() > portfolio.DENSE_ASSETS:
            structure = structured.structure_of(r, risk.style_exposures(self.bars), ("momentum", "volatility"))
        if structure is not None:
            w = {"risk_budget": lambda: structured.risk_budget(structure), "min_variance": lambda: structured.mean_variance(structure, cap=cap)}[method]()
            data = w.withColumnRenamed("w", "weight")
            return Result("optimise", True, data, {"effective_n": data.agg(1 / F.sum(F.col("weight") * F.col("weight"))).first()[0]})
        names, cov = portfolio.matrix_of(stats.ewma_covariance(r))
        cov = portfolio.nearest_psd(cov)
        w = {"hrp": lambda: portfolio.hierarchical_risk_parity(cov), "risk_budget": lambda: portfolio.risk_budget(cov), "min_variance": lambda: portfolio.mean_variance(cov[0] * 0, cov, cap=cap)}[method]()
        data = self.bars.sparkSession.createDataFrame([(n, float(x)) for n, x in zip(names, w, strict=True)], f"asset {self.bars.schema['asset'].dataType.simpleString()}, weight double")
        return Result("optimise", True, data, {"effective_n": float(1 / (w**2).sum())})

    def schedule(self, orders: DataFrame, urgency: float = 0.5) -> Result:
        return Result("schedule", True, execution.schedule(orders, execution.urgency_style(F.lit(urgency))))

    def regime(self) -> Result:
        m = risk.causal_market(self.bars).where("r is not null")
        cut = m.agg(F.percentile("vol", 0.5).alias("median"))
        p = risk.rule_regimes(F.col("trend"), F.col("vol"), F.col("median"))
        out = m.crossJoin(F.broadcast(cut)).select("t", *[c.alias(k) for k, c in p.items()])
        last = out.orderBy(F.desc("t")).first()
        return Result("regime", True, out, {k: float(last[k]) for k in p} if last else {})


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="barlens", description="Run a registered query or list them.")
    parser.add_argument("query", nargs="?", help="name of a query; without one, all names are listed")
    parser.add_argument("--data", default="/root/testdata/sf0.001")
    parser.add_argument("--rows", type=int, default=20)
    args = parser.parse_args(argv)
    if not args.query:
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    spark = SparkSession.builder.getOrCreate()
    registry.QUERIES[args.query](spark, args.data).show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
