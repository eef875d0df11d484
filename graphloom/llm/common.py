"""Reading of tables and cutting of lineage, shared by the operators."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import discard, settle, shared_dir, tidy  # noqa: F401

# Functions sent to executors take their code along, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules["graphloom.llm"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: Column | str) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_row(df: DataFrame) -> Column:
    """All columns in one struct `__row`, so that no name in the input can clash with one made on the way."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
