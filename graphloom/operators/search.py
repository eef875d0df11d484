"""Lookup and search over symbols."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.functions import scores as S


def find(symbols: DataFrame, key: str) -> DataFrame:
    """By full name, or by name where there is no full name."""
    return symbols.where(F.coalesce("fqname", "name") == key)


def matching(symbols: DataFrame, pattern: str, regex: bool = False, case_sensitive: bool = True) -> DataFrame:
    """Names or full names that hold the pattern; an empty text is in all."""
    cols = [F.col("name"), F.col("fqname")]
    if regex:
        hits = [c.rlike(pattern) for c in cols]
    elif case_sensitive:
        hits = [F.contains(c, F.lit(pattern)) for c in cols]
    else:
        hits = [F.contains(F.lower(c), F.lit(pattern.lower())) for c in cols]
    return symbols.where(F.coalesce(hits[0], F.lit(False)) | F.coalesce(hits[1], F.lit(False)))


def search(symbols: DataFrame, pattern: str, regex: bool = False, case_sensitive: bool = True, type_: str | None = None, namespace: str | None = None, file: str | None = None) -> DataFrame:
    """A pattern, then exact type, exact namespace and a regular expression on the file; rows without a file fail the last."""
    out = matching(symbols, pattern, regex, case_sensitive)
    if type_ is not None:
        out = out.where(F.col("type") == type_)
    if namespace is not None:
        out = out.where(F.col("namespace") == namespace)
    if file is not None:
        out = out.where(F.col("file").rlike(file))
    return out


def in_file(symbols: DataFrame, file: str) -> DataFrame:
    return symbols.where(F.contains("file", F.lit(file)))


def fuzzy(symbols: DataFrame, query: str, threshold: float = 0.7) -> DataFrame:
    """All columns and score, the most similar first."""
    return symbols.withColumn("score", S.rounded(S.similarity("name", query), 4)).where(F.col("score") >= threshold).orderBy(F.desc("score"), "name")


def public_only(symbols: DataFrame) -> DataFrame:
    """Without private symbols; an unknown visibility stays."""
    return symbols.where(F.coalesce(F.col("visibility") != "private", F.lit(True)))


def secondary_index(symbols: DataFrame, by: str) -> DataFrame:
    """(value, n, member): names by type, namespace or file, repeated ones kept, each with how many its value has; a value's names are never all in one row."""
    named = symbols.where(F.col(by).isNotNull()).select(F.col(by).alias("value"), F.col("name").alias("member"))
    return named.join(named.groupBy("value").agg(F.count(F.lit(1)).alias("n")), "value").select("value", "n", "member")


def references(texts: DataFrame, symbols: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, symbol, n): how often each text mentions a known symbol; candidates are what the pattern finds, met by an equi-join."""
    found = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("symbol"))
    counted = found.groupBy("doc_id", "symbol").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(symbols.select(F.col("name").alias("symbol")).distinct(), "symbol", "left_semi").select("doc_id", "symbol", "n")


def prefix_calls(calls: DataFrame, symbols: DataFrame, side: str = "src") -> DataFrame:
    """Calls whose caller (or callee) begins with a symbol's full name, by an equi-join on the components of the name."""
    p = N.parts(F.regexp_replace(F.col(side), "[#.][^#.]*$", ""))
    heads = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), N.SEP))
    return calls.withColumn("symbol", F.explode(heads)).join(symbols.select(F.col("fqname").alias("symbol")).distinct(), "symbol", "left_semi")


def escape(text: str) -> str:
    return re.escape(text)
