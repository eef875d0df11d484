"""Hotspots, design patterns, idioms and issues of classes and methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scores as S

LIMITS = {"complexity": 10, "churn": 5, "coupling": 8, "coverage": 30, "loc": 200, "dependencies": 10}
WEIGHTS = {"complexity": 0.25, "churn": 0.20, "coupling": 0.20, "coverage": 0.15, "loc": 0.10, "dependencies": 0.10, "complex_untested": 0.30}
ADVICE = {
    "complexity": "split complex methods", "churn": "find out why it keeps changing", "coupling": "loosen dependencies", "coverage": "write tests",
    "loc": "extract classes", "dependencies": "inject fewer collaborators", "complex_untested": "test before any change",
}


def ratio_severity(ratio: Column) -> Column:
    return F.when(ratio <= 1.5, "low").when(ratio <= 2, "medium").when(ratio <= 3, "high").otherwise("critical")


def _sign(kind: str, hit: Column, severity: Column) -> Column:
    value = S.severity_value(severity)
    return F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), value.alias("value"), F.lit(WEIGHTS[kind]).alias("weight")))


def _over(kind: str, value: Column) -> Column:
    return _sign(kind, value > LIMITS[kind], ratio_severity(value / LIMITS[kind]))


def class_signs() -> Column:
    """Indicators from total_complexity, churn, dependencies, coverage and loc; a null never counts."""
    low = F.lit(LIMITS["coverage"])
    signs = [
        _over("complexity", F.col("total_complexity")), _over("churn", F.col("churn")), _over("coupling", F.col("dependencies")),
        _sign("coverage", F.col("coverage") < low, ratio_severity((low - F.col("coverage")) / low)), _over("loc", F.col("loc")),
    ]
    return F.filter(F.array(*signs), lambda s: s.isNotNull())


def method_signs() -> Column:
    """Indicators from complexity, calls and test_coverage."""
    untested = (F.col("complexity") > 5) & (F.coalesce("test_coverage", F.lit(0.0)) < 50)
    signs = [_over("complexity", F.col("complexity")), _over("dependencies", F.col("calls")), _sign("complex_untested", untested, F.lit("high"))]
    return F.filter(F.array(*signs), lambda s: s.isNotNull())


def risk(signs: Column) -> Column:
    return S.weighted_risk(signs)


def advice(signs: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    return F.array_distinct(F.transform(signs, lambda s: F.element_at(table, s["kind"])))


def hotspots(df: DataFrame, signs: Column) -> DataFrame:
    """Rows with an indicator: signs (kinds, joined), risk, level and advice."""
    out = df.withColumn("__s", signs).where(F.size("__s") > 0)
    r = risk(F.col("__s"))
    level = F.when(F.col("risk") > 0.8, "critical_hotspot").when(F.col("risk") > 0.7, "high_risk_class").otherwise("hotspot")
    out = out.withColumn("signs", F.array_join(F.transform("__s", lambda s: F.concat(s["kind"], F.lit(":"), s["severity"])), ",")).withColumn("risk", r)
    return out.withColumn("level", level).withColumn("advice", F.array_join(advice(F.col("__s")), "; ")).drop("__s")


#: name: (pattern of the name, required methods, optional methods, whether new must be private)
PATTERNS = {
    "factory": ("Factory$", ["create", "build"], ["create_with_defaults", "build_with_defaults"], False),
    "singleton": ("Singleton$|Connection$", ["instance"], [], True),
    "observer": ("Observer$|Listener$", ["update"], ["notify"], False),
    "strategy": ("Strategy$|Policy$", ["execute"], ["perform", "apply"], False),
    "adapter": ("Adapter$", [], ["adapt", "convert", "translate"], False),
    "decorator": ("Decorator$", [], ["decorate", "wrap"], False),
}


def pattern_matches(df: DataFrame, name: str = "name", methods: str = "method_names", private_new: str = "private_new") -> DataFrame:
    """(name, pattern, confidence): by the name, or by all required methods with a private `new` where the pattern asks for it."""
    found = []
    have = F.coalesce(F.col(methods), F.array().cast("array<string>"))
    for key, (rx, required, optional, alone) in PATTERNS.items():
        named = F.coalesce(F.col(name).rlike(rx), F.lit(False))
        private = F.coalesce(F.col(private_new), F.lit(False))
        count = lambda ms: sum((F.array_contains(have, m).cast("int") for m in ms), F.lit(0))
        share = lambda ms: count(ms) * F.lit(0.4) / len(ms) if ms else F.lit(0.0)
        whole = (count(required) == len(required)) & (private if alone else F.lit(True)) if required else F.lit(False)
        confidence = named.cast("double") * 0.4 + share(required) + share(optional) + (private.cast("double") * 0.3 if alone else F.lit(0.0))
        found.append(F.when(named | whole, F.struct(F.lit(key).alias("pattern"), F.round(S.clamp(confidence), 2).alias("confidence"))))
    return df.select(F.col(name).alias("name"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("p")).select("name", "p.pattern", "p.confidence")


PROTOCOLS = {
    "string": ["to_s", "to_str"], "integer": ["to_i", "to_int"], "array": ["to_a", "to_ary"], "hash": ["to_h", "to_hash"], "enumerable": ["each"], "comparable": ["<=>"],
    "hash_like": ["[]", "[]="], "range": ["begin", "end", "exclude_end?"], "io": ["read", "write", "close"], "coercion": ["coerce"],
}
BUILDER = "^(define|create|build|configure|setup)_"


def method_idioms(name: Column, yields: Column) -> Column:
    """Idioms of one method: protocols it belongs to, blocks, builders, predicates and bang methods."""
    found = [F.when(name.isin(ms), F.lit(f"protocol:{k}")) for k, ms in PROTOCOLS.items()]
    found += [F.when(F.coalesce(yields, F.lit(False)), F.lit("block")), F.when(name.rlike(BUILDER), F.lit("dsl")), F.when(F.endswith(name, F.lit("?")), F.lit("predicate")), F.when(F.endswith(name, F.lit("!")), F.lit("bang"))]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def class_idioms(methods: Column, mixins: Column) -> Column:
    """Idioms of a class: complete protocols of several methods, reader and writer pairs, and the well-known mixins."""
    ms, mx = (F.coalesce(c, F.array().cast("array<string>")) for c in (methods, mixins))
    found = [F.when(F.size(F.array_intersect(ms, F.array(*[F.lit(x) for x in v]))) == len(v), F.lit(f"complete:{k}")) for k, v in PROTOCOLS.items() if len(v) > 1]
    found.append(F.when(F.exists(ms, lambda m: F.endswith(m, F.lit("=")) & F.array_contains(ms, F.regexp_replace(m, "=$", ""))), F.lit("accessor_pair")))
    found += [F.when(F.array_contains(mx, m), F.lit(f"mixin:{m.lower()}")) for m in ("Enumerable", "Comparable", "Singleton")]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def class_issues(df: DataFrame) -> DataFrame:
    """(name, issue, severity) from coverage, api_size, depth, churn and fan_out; nulls of coverage count as no coverage, others never."""
    table = [
        ("low_coverage", F.coalesce("coverage", F.lit(0.0)) < 80, S.coverage_severity("coverage")),
        ("large_api", F.col("api_size") >= 5, F.when(F.col("api_size") >= 10, "high").otherwise("medium")),
        ("deep_inheritance", F.col("depth") > 4, F.when(F.col("depth") > 6, "high").otherwise("medium")),
        ("high_churn", F.col("churn") > 10, F.when(F.col("churn") > 20, "high").otherwise("medium")),
        ("many_dependencies", F.col("fan_out") > 10, F.lit("high")),
    ]
    made = [F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(k).alias("issue"), s.alias("severity"))) for k, hit, s in table]
    return df.select("name", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("i")).select("name", "i.issue", "i.severity")


def evidence_confidence(required: Column, n_required: int, optional: Column, n_optional: int) -> Column:
    """0.7 of the required share and 0.3 of the optional one."""
    return S.rounded(0.7 * (required / n_required if n_required else F.lit(1.0)) + 0.3 * (optional / n_optional if n_optional else F.lit(0.0)))


def summary_lists(df: DataFrame) -> DataFrame:
    """(list, name, value) from complexity, coupling and cohesion: what is complex, tightly and loosely coupled, and of low cohesion."""
    lists = [("high_complexity", "complexity", F.col("complexity") > 10), ("tightly_coupled", "coupling", F.col("coupling") > 0.7), ("loosely_coupled", "coupling", F.col("coupling") < 0.3), ("low_cohesion", "cohesion", F.col("cohesion") < 0.3)]
    made = [F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(k).alias("list"), F.col(v).cast("double").alias("value"))) for k, v, hit in lists]
    return df.select("name", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("l")).select("l.list", "name", "l.value")


def symbol_issues(df: DataFrame) -> DataFrame:
    """(name, issue, severity) that a symbol's page shows, from complexity, cohesion and fan_out."""
    table = [("high_complexity", F.col("complexity") > 50, "high"), ("low_cohesion", F.col("cohesion") < 0.3, "medium"), ("many_dependencies", F.col("fan_out") > 10, "medium")]
    made = [F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(k).alias("issue"), F.lit(s).alias("severity"))) for k, hit, s in table]
    return df.select("name", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("i")).select("name", "i.issue", "i.severity")
