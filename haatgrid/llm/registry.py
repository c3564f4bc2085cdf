"""Queries of this subpackage and their SQL."""

from . import queries as _q


def queries() -> dict:
    return dict(_q.QUERIES)


def oracle_sql() -> dict:
    return dict(_q.SQL)
