"""Query registry and the shared SQL definitions the oracles are built from."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def _names_in(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z0-9_]*", sql))
    return [name for name in CTES if name in words]


def with_ctes(sql: str) -> str:
    """Prefix the definitions a statement uses, directly or through others."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for other in _names_in(CTES[name]):
                if other != name:
                    visit(other)
            ordered.append(name)

    for name in _names_in(sql):
        visit(name)
    parts = [f"{name} AS ({CTES[name]})" for name in ordered]
    return f"WITH {', '.join(parts)} {sql.strip()}" if parts else sql.strip()


def oracles() -> dict[str, str]:
    return {name: with_ctes(sql) for name, sql in ORACLES.items()}


def case(name: str, sql: str | None = None):
    """Register ``fn(view)`` under ``name``; ``view`` wraps (spark, folder)."""

    def register(fn):
        from workload.views import view_for

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(view_for(spark, folder))

        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
