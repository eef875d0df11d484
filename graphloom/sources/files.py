"""Scans of source folders, cached digests, and symbol tables from JSON."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.names import DEFAULT_EXCLUDES, excluded

TABLES = ("classes", "modules", "methods", "method_calls", "mixins")


def scan(spark: SparkSession, paths: str | list[str], pattern: str = "*.rb", excludes: list[str] | None = None, since: float | None = None) -> DataFrame:
    """(path, content, digest): files under folders, or single files; excluded ones, and those not changed after `since` (seconds), are dropped before they are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(paths)
    if since is not None:
        raw = raw.where(F.col("modificationTime") > F.timestamp_micros(F.lit(int(since * 1_000_000))))
    kept = raw.where(~excluded(F.regexp_replace("path", "^file:", ""), DEFAULT_EXCLUDES if excludes is None else excludes))
    return kept.select(F.regexp_replace("path", "^file:", "").alias("path"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("digest"))


def from_code(spark: SparkSession, code: str, path: str = "<memory>") -> DataFrame:
    return spark.createDataFrame([(path, code)], "path string, content string").withColumn("digest", F.sha2("content", 256))


def adapt(spark: SparkSession, data: dict, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Tables from a dict of rows: what is missing or None is empty, and a single row counts as a list of one."""
    out = {}
    for name, schema in schemas.items():
        rows = data.get(name) or []
        rows = [rows] if isinstance(rows, dict) else rows
        out[name] = spark.createDataFrame([{k: v for k, v in r.items()} for r in rows], schema)
    return out


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Symbol rows from JSON lines; a line that doesn't parse has its text in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def expand_env(text: str) -> str:
    """${X} and $X from the environment; unknown names are empty."""
    return re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: os.environ.get(m[1] or m[2], ""), text)


def _scalar(text: str):
    text = text.strip()
    if text[:1] in ("'", '"'):
        return text[1:-1]
    named = {"true": True, "yes": True, "false": False, "no": False, "null": None, "~": None, "": None}
    if text.lower() in named:
        return named[text.lower()]
    return int(text) if re.fullmatch(r"-?\d+", text) else float(text) if re.fullmatch(r"-?\d+\.\d+", text) else text


def plain_yaml(text: str) -> dict:
    """Keys with a value, a list in brackets, or lines of "- value" each; comments and blank lines are skipped, anything else is an error."""
    out: dict = {}
    key = None
    for n, line in enumerate(text.splitlines(), 1):
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not line.strip() or line == "---":
            continue
        item, pair = re.fullmatch(r"\s*-\s+(.*)", line), re.fullmatch(r"(\w+):\s*(.*)", line)
        if item and key is not None and isinstance(out[key] or [], list):
            out[key] = (out[key] or []) + [_scalar(item[1])]
        elif pair:
            key, value = pair[1], pair[2]
            out[key] = [_scalar(v) for v in value[1:-1].split(",") if v.strip()] if value.startswith("[") and value.endswith("]") else _scalar(value)
        else:
            raise ValueError(f"line {n} isn't plain YAML: {line.strip()}")
    return out


@dataclass
class Settings:
    """Thresholds and switches; profiles change some of them."""

    excludes: list = field(default_factory=lambda: list(DEFAULT_EXCLUDES))
    complexity: int = 10
    api: int = 5
    depth: int = 4
    fan_out: int = 3
    churn: int = 10
    coverage: int = 80
    redaction: str = "standard"
    include_private: bool = True
    fail_fast: bool = False
    max_errors: int = 1000

    def __post_init__(self):
        if self.redaction not in ("minimal", "standard", "aggressive"):
            raise ValueError(f"unknown redaction level: {self.redaction}")
        for k in ("complexity", "api", "depth", "fan_out", "churn", "coverage", "max_errors"):
            if getattr(self, k) < 0:
                raise ValueError(f"{k} must not be negative")

    def merge(self, **changes) -> Settings:
        unknown = set(changes) - set(asdict(self))
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return Settings(**(asdict(self) | changes))

    def diff(self, other: Settings) -> dict:
        a, b = asdict(self), asdict(other)
        return {k: (a[k], b[k]) for k in a if a[k] != b[k]}

    @classmethod
    def profile(cls, name: str) -> Settings:
        changes = {"development": {}, "production": {"redaction": "aggressive", "include_private": False}, "ci": {"fail_fast": True}}
        return cls().merge(**changes[name])

    @classmethod
    def from_file(cls, path: str) -> Settings:
        """From JSON, or from YAML of plain keys, values and lists of values."""
        with open(path) as f:
            text = expand_env(f.read())
        return cls().merge(**(plain_yaml(text) if path.endswith((".yml", ".yaml")) else json.loads(text)))
