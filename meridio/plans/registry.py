"""All queries over the star-schema tables and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its DuckDB equivalent where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _load() -> None:
    from importlib import import_module

    for name in MODULES:
        import_module(f"{__package__}.{name}")


#: The modules whose queries are registered when this one is imported.
MODULES = ["core", "files", "graphs", "clusters", "recs", "texts", "streams", "audits"]
_load()
