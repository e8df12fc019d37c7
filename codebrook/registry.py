"""Registry of the engine's queries and of their DuckDB twins."""

from __future__ import annotations

from .catalog import analytics, learning, linear, pictures  # noqa: F401  they register their queries
from .catalog.base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
