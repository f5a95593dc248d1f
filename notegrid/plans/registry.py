"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(spark, sf_dir) under a name, with its DuckDB twin where SQL can express it."""

    def add(f: Callable) -> Callable:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def _load() -> None:
    import importlib
    import pkgutil

    import notegrid.plans as here

    for m in pkgutil.iter_modules(here.__path__):
        if m.name != "registry":
            importlib.import_module(f"notegrid.plans.{m.name}")


def queries() -> dict:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
