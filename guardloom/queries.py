"""The core's queries and, where SQL can say the same, their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its own name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from guardloom import queries_data  # noqa: E402,F401
from guardloom import queries_guard  # noqa: E402,F401
from guardloom import queries_metrics  # noqa: E402,F401
from guardloom import queries_state  # noqa: E402,F401
from guardloom import queries_ops  # noqa: E402,F401
