"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import days, given, items, pages, runs  # noqa: F401  they register their queries
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
