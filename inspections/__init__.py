"""Registered inspections of the test tables, each with its SQL counterpart.

A query is registered under its key together with the SQL a second engine runs on
the same tables. The SQL states the expected result directly and shares no code
with the Spark side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query; without SQL only its rows are looked at."""

    def register(body):
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = body
        if sql is not None:
            ORACLES[key] = sql.strip()
        return body

    return register


def load_all() -> None:
    from inspections import (  # noqa: F401
        consistency,
        history,
        keys,
        outputs,
        registry,
        rows,
        runs,
        state,
        statistics,
    )


def violations_sql(*cases: tuple[str, str, str]) -> str:
    """One row per case of (alias, table, condition a bad row meets)."""
    return "\nUNION ALL\n".join(
        f"SELECT '{alias}' AS check_alias, count(*) FILTER (WHERE {bad}) AS violations FROM {table}"
        for alias, table, bad in cases
    )
