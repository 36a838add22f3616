"""Registered queries: name -> (Spark job, DuckDB oracle SQL or None).

Every job reads the driver tables under ``sf_dir`` (or what Spark derives from
them) and runs over whole tables. The oracle SQL computes the same result in
DuckDB over views with the same table names. Computed columns carry the same
alias on both sides; doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Job] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Job) -> Job:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    import importlib
    for mod in ("queries_messages", "queries_text", "queries_select", "queries_flow",
                "queries_stream", "queries_state"):
        try:
            importlib.import_module(f"{__package__}.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{mod}":
                raise
