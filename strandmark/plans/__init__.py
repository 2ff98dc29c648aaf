"""Registered queries over the fixture views, each with the SQL that says the same."""

from . import chunks, more
from .registry import oracle_sql
from .registry import queries as _queries

__all__ = ["chunks", "oracle_sql", "queries"]


def queries() -> dict:
    return _queries() | more.PLAIN
