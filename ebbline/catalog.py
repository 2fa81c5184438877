"""The engine's named queries over the standard tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under a name, with its SQL where there is one."""

    def add(function):
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = (function, sql)
        return function

    return add


def _load() -> None:
    from . import plans

    plans.load()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: function for name, (function, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
