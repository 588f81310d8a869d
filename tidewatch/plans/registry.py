"""Registry of named queries (Spark builder + DuckDB oracle SQL).

``register(name, oracle)`` decorates a ``(spark, sf_dir) -> DataFrame``
function.  ``oracle`` is the equivalent DuckDB SQL over the driver views, or
None for operators that SQL cannot express (those get a brute-force check in
tests instead).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from tidewatch.plans import q_code, q_findings, q_flows, q_logs, q_sources, q_text  # noqa: F401
