"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.schema import Catalog

_FOUND: dict[str, tuple[Callable[[Catalog], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Registers a function of a catalog under its own name, with DuckDB SQL for the same rows."""

    def keep(f):
        _FOUND[f.__name__] = (f, sql)
        return f

    return keep


def _load() -> None:
    from . import associated, expressions, extended, requests  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Catalog(spark, sf_dir))) for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}
