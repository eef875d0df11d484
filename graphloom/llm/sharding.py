"""Sharding by jump consistent hashing.

A key's shard needs no table of ring points: a 64-bit generator seeded by the key jumps ahead over
shard counts, and the last jump below the number of shards is the shard. When shards are appended,
a key either stays or goes to one of the new shards, a share of new/all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import parallelism, table

N_SHARDS, N_SHARDS_BEFORE = 1024, 960


def jump(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard in [0, n) of each uint64 key; all keys advance together, and those at rest drop out."""
    if n < 1:
        raise ValueError("at least one shard is needed")
    out = np.zeros(len(keys), np.int64)
    live, k, b = np.arange(len(keys)), keys.astype(np.uint64, copy=True), np.zeros(len(keys), np.int64)
    while len(live):
        out[live] = b
        k = k * np.uint64(2862933555777941757) + np.uint64(1)
        j = np.floor((b + 1).astype(np.float64) * (2147483648.0 / ((k >> np.uint64(33)) + np.uint64(1)).astype(np.float64)))
        go = j < n
        live, k, b = live[go], k[go], j[go].astype(np.int64)
    return out


def key_of(col: Column) -> Column:
    """First 64 bits of the MD5 of the key as text, as a signed number: it depends on the value alone, not on row or file."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, 16), 16, -10).cast("bigint")


def shard_of(key: Column, n: int) -> Column:
    """Shard of a key made by key_of."""

    @F.pandas_udf("int")
    def f(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), n), dtype="int32")

    return f(key)


def assign(df: DataFrame, key: str = "doc_id", n: int = N_SHARDS, before: int | None = None) -> DataFrame:
    """All columns of `df`, with shard, and with shard_before and moved where `before` is given.

    Equal keys share a shard, repeated rows included. Rows with a null key are dealt to all shards
    by what they hold in their other columns, so only those alike in all of them share one. Columns
    of the input named as the added ones are replaced. An empty table gives an empty table.
    """
    k = key_of(F.coalesce(F.col(key).cast("string"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    out = df.withColumn("shard", shard_of(k, n))
    if before is not None:
        out = out.withColumn("shard_before", shard_of(k, before)).withColumn("moved", F.col("shard") != F.col("shard_before"))
    return out


def gather(sharded: DataFrame, n: int = N_SHARDS, key: str = "doc_id") -> DataFrame:
    """The rows of each shard together and in key order, by one shuffle.

    Each task has as many whole shards as any other, consecutive ones; with as many shuffle partitions as shards, or more, it has one.
    """
    tasks = min(n, parallelism(sharded.sparkSession))
    return sharded.repartitionById(tasks, F.expr(f"cast(cast(shard as bigint) * {tasks} div {n} as int)")).sortWithinPartitions("shard", key)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return gather(assign(docs, n=N_SHARDS, before=N_SHARDS_BEFORE))


def _sql_shard(n: int, name: str) -> str:
    return f"""
  {name}(k, st, b, j) AS (
    SELECT k, k::HUGEINT, -1::BIGINT, 0::BIGINT FROM keys
    UNION ALL
    SELECT k, nx, j, CAST(floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((nx // 8589934592) + 1)::DOUBLE)) AS BIGINT)
    FROM (SELECT k, j, (st * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT AS nx FROM {name} WHERE j < {n})
  )"""


SQL = f"""
WITH RECURSIVE keys AS (
  SELECT DISTINCT ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16))::UBIGINT AS k FROM documents),
{_sql_shard(N_SHARDS, "a")},
{_sql_shard(N_SHARDS_BEFORE, "z")}
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, s.b::INT AS shard, t.b::INT AS shard_before, s.b <> t.b AS moved
FROM documents d
JOIN (SELECT k, max(b) AS b FROM a GROUP BY k) s ON s.k = ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 16))::UBIGINT
JOIN (SELECT k, max(b) AS b FROM z GROUP BY k) t ON t.k = s.k
"""
