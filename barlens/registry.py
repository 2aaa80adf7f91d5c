"""All queries of the engine by name, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "ic_series"
PLANS = ("factor_plans", "stat_plans", "relational_plans", "scalar_plans", "portfolio_plans", "risk_plans", "stream_plans", "maintenance_plans", "decision_plans", "order_plans", "selection_plans", "research_plans", "runtime_plans", "desk_plans")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _name in PLANS:
    _plan = import_module(f"barlens.plans.{_name}")
    QUERIES |= _plan.QUERIES
    ORACLE_SQL |= _plan.ORACLE_SQL
