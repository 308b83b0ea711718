"""The named queries, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from ..functions.registry import Registry

QUERIES = Registry("query")
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES.register(f.__name__)(f)
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


from . import audit_queries, distribution_queries, io_queries, model_queries, study_queries  # noqa: E402, F401
