"""All queries of the core operators and the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from quern.plans import core_queries, fact_queries, record_queries, source_queries

MODULES = [core_queries, record_queries.R, fact_queries.R, source_queries.R]


def queries() -> dict[str, Callable]:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
