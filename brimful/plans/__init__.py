"""Whole jobs, and the registered queries."""

from __future__ import annotations

from typing import Any


def load() -> tuple[dict[str, Any], dict[str, str]]:
    """(queries, SQL) of the library's own operators."""
    from brimful.plans import chain_queries, more_queries, name_queries, page_queries, queries  # noqa: F401 - registers its own

    return queries.QUERY, queries.SQL
