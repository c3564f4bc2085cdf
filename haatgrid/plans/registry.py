"""All core queries and their SQL, by name."""

from __future__ import annotations

from . import analyses, extra, problems, saved

MODULES = [problems, saved, analyses, extra]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
