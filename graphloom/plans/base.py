"""Where queries are written down: a function over (spark, sf_dir), and SQL for DuckDB over the same tables."""

from __future__ import annotations

from graphloom.sources.domain import load, with_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: load(spark, sf_dir, table))
        if sql:
            SQL[name] = with_tables(sql)
        return f

    return add
