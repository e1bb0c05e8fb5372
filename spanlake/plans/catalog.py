"""Query catalogue: one Spark plan and (where SQL can express it) one DuckDB

Every query reads the provided tables (or frames Spark derives from them), so
its work grows with the data.  Column names and types match between the Spark
result and the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # importing the query modules fills the registries
    from spanlake.plans import queries_decode  # noqa: F401
    from spanlake.plans import queries_prep  # noqa: F401
    from spanlake.plans import queries_eval  # noqa: F401
    from spanlake.plans import queries_io  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLES)
