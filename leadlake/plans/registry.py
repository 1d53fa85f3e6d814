"""Registered queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.bindings import Tables, with_ctes

QUERIES: dict[str, Callable] = {}
CHECKS: dict[str, str] = {}


def query(key: str, ctes=(), sql: str | None = None, extra: dict[str, str] | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key``; ``sql`` is the DuckDB check over the same views."""

    def wrap(fn):
        if key in QUERIES:
            raise KeyError(key)
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            CHECKS[key] = with_ctes(list(ctes), sql, extra)
        return fn

    return wrap
