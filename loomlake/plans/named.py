"""A decorator that names a query and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable


def collector() -> tuple[dict, dict, Callable]:
    """(queries, oracles, query): @query(sql) enters a function under its own name."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def enter(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return enter

    return queries, oracles, query
