"""The decorator that puts a query and its oracle into a module's tables."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    queries, sql = {}, {}

    def query(oracle: str | None = None) -> Callable:
        def register(f: Callable) -> Callable:
            queries[f.__name__] = f
            if oracle:
                sql[f.__name__] = oracle
            return f

        return register

    return queries, sql, query
