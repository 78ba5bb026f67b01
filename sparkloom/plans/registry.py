"""All registered queries of the engine's own operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function (spark, sf_dir) under a name, with the SQL that must return the same rows."""

    def add(f):
        _queries[name] = f
        if oracle:
            _oracles[name] = oracle
        return f

    return add


def oracle(name: str, sql: str) -> None:
    """The SQL of a query that is registered by itself."""
    _oracles[name] = sql


def _load() -> None:
    from sparkloom.plans import catalog, flagship, frames, graphs, missions, planning, records, streams, texts, work  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
