"""All core queries and their SQL by name."""

from __future__ import annotations

from . import assembly, problems, records, studies, units

MODULES = [units, records, assembly, studies, problems]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
