"""Changes to symbol tables without a mutable store: anti joins and unions over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import remove_nodes


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`new` replaces the rows of `old` with its keys, its edges included where `old` is an edge table."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def remove_symbols(symbols: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges without the given nodes."""
    return symbols.join(gone.select(F.col("node").alias("name")), "name", "left_anti"), remove_nodes(edges, gone)


def changed(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose digest the cache has not under their path."""
    return files.join(cache.select("path", "digest"), ["path", "digest"], "left_anti")


def with_digest(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("digest", F.sha2(F.col(content), 256))


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, from, to): settings (key, value) that differ."""
    j = a.alias("a").join(b.alias("b"), F.col("a.key") == F.col("b.key"), "full")
    return j.where(~F.col("a.value").eqNullSafe(F.col("b.value"))).select(F.coalesce("a.key", "b.key").alias("key"), F.col("a.value").alias("from"), F.col("b.value").alias("to"))
