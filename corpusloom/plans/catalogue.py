"""All queries of the library, by name."""

from __future__ import annotations

from corpusloom.plans import curation, evaluation, exchange, training

_MODULES = (curation, exchange, training, evaluation)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
