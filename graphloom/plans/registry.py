"""All queries of the engine and the SQL that checks them."""

from __future__ import annotations

from graphloom.plans import documents, graphs, lookups, measures, names, rules, texts  # noqa: F401
from graphloom.plans.base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
