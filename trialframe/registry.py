"""Names of all queries, their callables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import duck, frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, tables: str, run: Callable[..., DataFrame], sql: str | None = None) -> None:
    """Registers ``run`` over the named tables or adapters, and the same in DuckDB's SQL."""
    QUERIES[name] = lambda spark, sf_dir: run(*(frame(spark, sf_dir, t) for t in tables.split()))
    if sql is not None:
        SQL[name] = duck(sql)


def _load() -> None:
    from .plans import catalog, classification, files, relational, reports, text, trajectory  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
