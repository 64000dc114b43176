"""Registration of queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.catalog.derived import SQL, Tables

MODULES = ("sources", "rows", "joins", "groups", "ordering", "sets", "functions", "config", "graph", "history",
           "streaming", "compose")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register ``fn(tables)`` under a name. ``needs`` names the derived tables that ``sql`` is written over."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            _ORACLES[name] = with_derived(sql, needs)
        return fn
    return register


def with_derived(sql: str, needs: tuple[str, ...]) -> str:
    """The SQL with the derived tables it needs in front."""
    if not needs:
        return sql
    listed: list[str] = []

    def add(name: str) -> None:
        for other in SQL[name][0]:
            add(other)
        if name not in listed:
            listed.append(name)

    for name in needs:
        add(name)
    tables = ", ".join(f"{SQL[n][2] or n} AS ({SQL[n][1]})" for n in listed)
    return f"WITH RECURSIVE {tables}{',' if sql.lstrip().startswith('WITH ') else ''} {sql.lstrip().removeprefix('WITH ')}"


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"millrace.catalog.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
