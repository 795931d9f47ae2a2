"""Registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from stratacloud import oracle
from stratacloud import queries as q


def queries() -> dict:
    return {f.__name__: f for f in q.ALL}


def oracle_sql() -> dict:
    return oracle.statements()
