"""All registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "prepare_queries", "quality_queries", "classify_queries", "anomaly_queries", "feature_queries", "forecast_queries",
    "report_queries", "skew_queries",
)


def _registers():
    return [import_module(f"tallycast.plans.{name}").R for name in MODULES]


def queries() -> dict:
    return {name: query for register in _registers() for name, query in register.queries.items()}


def oracles() -> dict:
    return {name: sql for register in _registers() for name, sql in register.oracles.items()}
