"""Quality rules as data, compiled to Column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ["+", "-", "*", "/", "%", "**", "==", "!=", "<", ">", "<=", ">=", "<=>", "[]", "!", "<<", "=~"]

METHOD_RULES = [
    {"id": "long_method", "metric": "line_count", "op": ">", "threshold": 20, "severity": [[30, "low"], [50, "medium"], [100, "high"]], "default": "critical", "message": "{value} lines exceed {threshold}"},
    {"id": "too_many_parameters", "metric": "parameter_count", "op": ">", "threshold": 4, "default": "medium", "message": "{value} parameters exceed {threshold}"},
    {"id": "high_complexity", "metric": "complexity", "op": ">", "threshold": 10, "severity": [[15, "low"], [20, "medium"]], "default": "high", "message": "complexity {value} exceeds {threshold}"},
    {"id": "short_method_name", "pattern": "^.{1,2}$", "exclude": OPERATORS, "default": "low", "message": "{name} is too short a name"},
    {"id": "java_style_getter", "pattern": "^get_", "default": "low", "message": "{name} needs no get_"},
    {"id": "duplicate_indicator", "pattern": "(_copy|_duplicate|_2|_old|_new|_temp|_backup)$", "default": "medium", "message": "{name} looks like a copy"},
]
CLASS_RULES = [
    {"id": "god_class", "indicators": {"loc": 500, "method_count": 30, "dependency_count": 15, "total_complexity": 50}, "least": 2, "default": "high", "message": "{name} does too much"},
    {"id": "low_cohesion", "metric": "cohesion", "op": "<", "threshold": 0.5, "default": "medium", "message": "cohesion {value} is under {threshold}"},
    {"id": "data_class", "accessors": {"least_methods": 5, "ratio": 0.7, "behaviours_under": 3}, "default": "low", "message": "{name} holds data only"},
    {"id": "feature_envy", "metric": "external_call_ratio", "op": ">", "threshold": 0.7, "default": "medium", "message": "{value} of calls go elsewhere"},
    {"id": "mixed_abstraction_levels", "patterns": ["^(process|handle|manage|coordinate)", "^(get|set|read|write|fetch)"], "ratio": 0.3, "default": "medium", "message": "{name} mixes levels"},
]
METHOD_PENALTY = {"critical": 0.4, "high": 0.25, "medium": 0.15, "low": 0.05}
CLASS_PENALTY = {"critical": 0.3, "high": 0.2, "medium": 0.1, "low": 0.05}
ISSUE = "array<struct<rule:string,severity:string,message:string>>"


def load(path: str) -> dict[str, list]:
    """A catalogue from a JSON file with `methods`, `classes` and `custom`, the last of which are method rules too."""
    with open(path) as f:
        got = json.load(f)
    return {"methods": got.get("methods", []) + got.get("custom", []), "classes": got.get("classes", [])}


def compare(value: Column, op: str, threshold) -> Column:
    t = F.lit(threshold)
    return {">": value > t, ">=": value >= t, "<": value < t, "<=": value <= t, "==": value == t}[op]


def severity(rule: dict, value: Column | None) -> Column:
    """The first range that holds the value, else the default, else medium."""
    last = F.lit(rule.get("default") or "medium")
    out = None
    for most, label in rule.get("severity", []) if value is not None else []:
        out = F.when(value <= most, label) if out is None else out.when(value <= most, label)
    return last if out is None else out.otherwise(last)


def _share(matches: Column, names: Column) -> Column:
    return F.try_divide(F.size(F.filter(names, lambda n: n.rlike(matches))), F.size(names))


def fires(rule: dict) -> tuple[Column, Column | None]:
    """Whether a rule holds, and the value it looked at. A metric that is null never does."""
    if "metric" in rule:
        v = F.col(rule["metric"])
        return compare(v, rule["op"], rule["threshold"]), v
    if "pattern" in rule:
        name = F.col("name")
        hit = name.rlike(rule["pattern"])
        return hit & ~name.isin(rule["exclude"]) if rule.get("exclude") else hit, None
    if "indicators" in rule:
        hits = sum((F.coalesce(F.col(m) > t, F.lit(False)).cast("int") for m, t in rule["indicators"].items()), F.lit(0))
        return hits >= rule["least"], hits
    names = F.coalesce(F.col("method_names"), F.array().cast("array<string>"))
    count = lambda rx: F.size(F.filter(names, lambda n: n.rlike(rx)))
    if "accessors" in rule:
        a, accessor = rule["accessors"], "^(get_|set_)|=$"
        return (F.size(names) >= a["least_methods"]) & (F.try_divide(count(accessor), F.size(names)) > a["ratio"]) & (F.size(names) - count(accessor) < a["behaviours_under"]), None
    x, y = (count(rx) for rx in rule["patterns"])
    return F.coalesce(F.try_divide(F.least(x, y), F.greatest(x, y)) > rule["ratio"], F.lit(False)), None


def issue(rule: dict) -> Column:
    hit, value = fires(rule)
    message = F.replace(F.lit(rule["message"]), F.lit("{threshold}"), F.lit(str(rule.get("threshold", ""))))
    message = F.replace(message, F.lit("{name}"), F.coalesce(F.col("name"), F.lit("")))
    if value is not None:
        message = F.replace(message, F.lit("{value}"), F.coalesce(value.cast("string"), F.lit("")))
    return F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(rule["id"]).alias("rule"), severity(rule, value).alias("severity"), message.alias("message")))


def issues(rules: list[dict]) -> Column:
    return F.filter(F.array(*[issue(r) for r in rules]), lambda i: i.isNotNull())


def penalty(found: Column, of: dict[str, float]) -> Column:
    """Thousandths, so that sums are exact."""

    def of_level(level: str) -> Column:
        return F.size(F.filter(found, lambda i: i["severity"] == level))

    return sum((of_level(k) * round(v * 1000) for k, v in of.items()), F.lit(0))


def _score(milli: Column) -> Column:
    return F.floor((F.greatest(F.least(milli, F.lit(1000)), F.lit(0)) + 5) / 10) / 100.0


def method_score(found: Column, complexity: Column) -> Column:
    extra = F.when(complexity > 5, F.least((complexity - 5) * 15, F.lit(300))).otherwise(0)
    return _score(F.lit(1000) - penalty(found, METHOD_PENALTY) - extra)


def class_score(found: Column, stability: Column | None = None) -> Column:
    own = F.lit(1000) - penalty(found, CLASS_PENALTY)
    if stability is None:
        return _score(own)
    blended = F.coalesce(own * 0.7 + F.round(stability * 1000) * 0.3, own.cast("double"))
    return _score(F.round(blended))


def cohesion(methods: Column, ivars: Column) -> Column:
    """1 for a class without methods or variables, else 0.5: a stand-in until calls on variables are known."""
    return F.when((F.coalesce(F.size(methods), F.lit(0)) <= 0) | (F.coalesce(F.size(ivars), F.lit(0)) <= 0), 1.0).otherwise(0.5)
