"""All queries of the warehouse, with their DuckDB counterparts."""

from __future__ import annotations

from lakemill.plans import checks, gold, kpi, models, movement, patterns

PARTS = (kpi, models, patterns, checks, movement, gold)


def queries() -> dict:
    return {name: query for part in PARTS for name, query in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.oracle_sql().items()}
