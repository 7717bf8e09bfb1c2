"""How the modules of this package register their queries."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """(queries, SQL, decorator): the decorator registers a function, with the SQL given to it, if any."""
    queries, oracle = {}, {}

    def query(sql: str | None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query
