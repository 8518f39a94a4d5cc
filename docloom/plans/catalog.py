"""Registered queries and their DuckDB twins."""

from __future__ import annotations

from docloom.plans import outline, parsed, scalars

MODULES = (outline, scalars, parsed)


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
