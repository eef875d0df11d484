"""Errors of a run: a collector that the driver fills, and the same questions asked of tables of any size."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("critical", "error", "warning", "info")
CATEGORIES = ("parse", "encoding", "dependency", "filesystem", "memory", "output", "config", "runtime", "unknown")
SCHEMA = "n bigint, severity string, category string, message string, file string, line int"
#: Messages that a short report shows.
SHOWN = 10


class CriticalError(RuntimeError):
    """A critical error of a run that is to end with the first."""


@dataclass
class Collector:
    """At most max_errors errors, later ones are dropped; with fail_fast a critical one is raised after it was noted."""

    max_errors: int | None = None
    fail_fast: bool = False
    rows: list[tuple] = field(default_factory=list)

    def add(self, category: str, message: str, severity: str = "error", file: str | None = None, line: int | None = None) -> bool:
        """Whether the error was kept."""
        if severity not in SEVERITIES or category not in CATEGORIES:
            raise ValueError(f"unknown severity or category: {severity}, {category}")
        if self.full():
            return False
        self.rows.append((len(self.rows), severity, category, message, file, line))
        if self.fail_fast and severity == "critical":
            raise CriticalError(message)
        return True

    def full(self) -> bool:
        return self.max_errors is not None and len(self.rows) >= self.max_errors

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)


def with_retry(f: Callable, tries: int = 3, delay: float = 0.1, factor: float = 2.0, most: float = 5.0, on: tuple = (OSError,), collector: Collector | None = None, sleep: Callable = time.sleep):
    """f(), tried again after growing pauses when it fails by one of `on`; the last failure is raised, each is noted."""
    for k in range(tries + 1):
        try:
            return f()
        except on as e:
            if collector is not None:
                collector.add("filesystem", str(e), "error" if k == tries else "warning")
            if k == tries:
                raise
            sleep(min(delay * factor**k, most))


def by(errors: DataFrame, severity: str | None = None, category: str | None = None, file: str | None = None) -> DataFrame:
    """The errors of a severity, a category and a file, as far as these are given."""
    for name, value in (("severity", severity), ("category", category), ("file", file)):
        if value is not None:
            errors = errors.where(F.col(name) == value)
    return errors


def capped(errors: DataFrame, most: int) -> DataFrame:
    """The first `most` errors by n: what a collector with that cap keeps."""
    return errors.orderBy("n").limit(most)


def report(errors: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(part, n, line): the total, a line for each severity and category there is, the first `shown` critical ones and errors, and how many more there are."""
    count = F.count(F.lit(1)).cast("string")
    total = errors.agg(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("n"), F.when(F.count(F.lit(1)) == 0, "No errors.").otherwise(F.concat(F.lit("Errors: "), count)).alias("line"))
    order = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")).cast("bigint")
    severities = errors.groupBy("severity").agg(count.alias("c")).select(F.lit(1).alias("part"), order.alias("n"), F.concat("severity", F.lit(": "), "c").alias("line"))
    order = F.array_position(F.array(*[F.lit(s) for s in CATEGORIES]), F.col("category")).cast("bigint")
    categories = errors.groupBy("category").agg(count.alias("c")).select(F.lit(2).alias("part"), order.alias("n"), F.concat("category", F.lit(": "), "c").alias("line"))
    bad = errors.where(F.col("severity").isin("critical", "error"))
    place = F.when(F.col("file").isNotNull(), F.concat(F.lit(" ("), F.concat_ws(":", "file", F.col("line").cast("string")), F.lit(")"))).otherwise("")
    first = capped(bad, shown).select(F.lit(3).alias("part"), "n", F.concat(F.lit("["), "category", F.lit("] "), "message", place).alias("line"))
    more = bad.agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > shown).select(F.lit(4).alias("part"), F.lit(0).cast("bigint").alias("n"), F.concat(F.lit("... and "), (F.col("c") - shown).cast("string"), F.lit(" more")).alias("line"))
    out = total
    for part in (severities, categories, first, more):
        out = out.unionByName(part)
    return out
