"""Ordered stages of table transforms, with a registry, callbacks, and failures that are noted while the others go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from graphloom.operators.errors import Collector
from graphloom.sources.files import Settings


class Stages:
    """Named transforms of a dictionary of tables. Plans fail when they are made, so a failing stage leaves the tables as they were before it."""

    def __init__(self, settings: Settings | None = None):
        self.settings = settings or Settings()
        self.known: dict[str, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]] = {}
        self.order: list[str] = []
        self.errors = Collector(self.settings.max_errors, self.settings.fail_fast)
        self._step: list[Callable[[str], None]] = []
        self._progress: list[Callable[[int, int, str], None]] = []

    def register(self, name: str, stage: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> Stages:
        """At the end of the order, or in the place of the stage with this name."""
        if name not in self.known:
            self.order.append(name)
        self.known[name] = stage
        return self

    def with_steps(self, names: list[str]) -> Stages:
        """Only these stages, in this order."""
        unknown = [n for n in names if n not in self.known]
        if unknown:
            raise ValueError(f"unknown stages: {unknown}")
        self.order = list(names)
        return self

    def on_step(self, f: Callable[[str], None]) -> Stages:
        self._step.append(f)
        return self

    def on_progress(self, f: Callable[[int, int, str], None]) -> Stages:
        self._progress.append(f)
        return self

    def run(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        for k, name in enumerate(self.order, 1):
            for f in self._step:
                f(name)
            try:
                made = self.known[name](dict(tables))
                for df in made.values():
                    df.schema  # noqa: B018 - a plan that can't be made is found here
                tables = tables | made
            except Exception as e:  # noqa: BLE001 - one stage's failure must not stop the others
                self.errors.add("runtime", f"{name}: {e}"[:500], "critical" if self.settings.fail_fast else "error")
            for f in self._progress:
                f(k, len(self.order), name)
        return tables


def progress(df: DataFrame, current: str, total: str) -> DataFrame:
    """`df` with percent: whole percents of `total` that `current` makes, 100 where there is nothing to do."""
    from pyspark.sql import functions as F

    share = F.when(F.col(total) > 0, F.floor(F.least(F.col(current), F.col(total)) * 100 / F.col(total))).otherwise(100)
    return df.withColumn("percent", share.cast("int"))
