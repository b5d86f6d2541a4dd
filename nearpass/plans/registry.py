"""Registry of catalogue queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_CTE: dict[str, tuple[tuple, str]] = {}


def cte(name: str, body: str, *deps: str) -> None:
    """Store a named common table expression for reuse by ``statement``."""
    _CTE[name] = (deps, body)


def statement(final: str, *deps: str) -> str:
    """One SELECT preceded by the WITH clauses it needs, in dependency order."""
    order: list[str] = []

    def visit(name):
        if name in order:
            return
        for d in _CTE[name][0]:
            visit(d)
        order.append(name)

    for d in deps:
        visit(d)
    if not order:
        return final
    parts = ",\n".join(f"{n} AS ({_CTE[n][1]})" for n in order)
    return f"WITH RECURSIVE {parts}\n{final}"


def query(key: str, sql: str | None = None):
    def add(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add
