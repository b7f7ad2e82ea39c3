"""How a module names its queries and their SQL."""

from __future__ import annotations


def registered(queries: dict, sql: dict):
    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return query
