"""All registered queries of the marketplace operators: name, function of (spark, sf_dir), SQL that says the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cratemill.sources.views import with_views

FLAGSHIP = "AGG01"
_MODULES = ("catalogue", "recommend", "merges", "prices", "synthesis", "drift", "grading", "review", "learning", "connectors")
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under an operator's ID."""

    def add(f):
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = f
        if oracle:
            _oracles[name] = with_views(oracle)
        return f

    return add


def twin(name: str) -> str:
    """The SQL of a query registered before, as a subquery."""
    return f"({_oracles[name]})"


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"cratemill.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
