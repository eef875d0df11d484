"""Comparison of a Spark result with DuckDB over the same tables."""

from __future__ import annotations

import os
from collections import Counter
from datetime import date, datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, (datetime, date)):
        return str(v)
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    return v if v is None or isinstance(v, (str, bool)) else str(v)


def _bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> tuple[list, list, int]:
    """Rows only in Spark, rows only in DuckDB, rows in Spark; column names must agree."""
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    want, got = _bag(names, res.fetchall()), _bag(df.columns, [tuple(r) for r in df.collect()])
    return list((got - want).elements()), list((want - got).elements()), sum(got.values())
