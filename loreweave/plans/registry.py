"""Collects the named queries and their SQL twins from the query modules."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its DuckDB twin."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _load() -> None:
    from loreweave.plans import catalog  # noqa: F401


def queries() -> dict:
    _load()
    return QUERIES


def oracle_sql() -> dict:
    _load()
    return ORACLES
