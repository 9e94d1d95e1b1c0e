"""Every query of the match analytics part, by name, with its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapter import DOMAIN_SQL, Domain

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
MODULES = ("players", "rivalry", "leagues", "ratings", "audit", "identity", "operations", "matching", "details", "warehouse", "pages", "insights", "texts", "quality", "records")


def query(name: str, sql: str | None = None, domain: bool = True):
    """Registers f(domain) as a query; sql is its DuckDB text, behind the domain's CTEs where domain is set."""

    def register(f: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        _QUERIES[name] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            text = sql.strip()
            _SQL[name] = text if not domain else f"WITH RECURSIVE {DOMAIN_SQL}, {text[5:]}" if text.startswith("WITH ") else f"WITH RECURSIVE {DOMAIN_SQL} {text}"
        return f

    return register


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
