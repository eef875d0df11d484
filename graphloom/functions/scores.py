"""Measures and categories of methods and classes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zero(x) -> Column:
    return F.coalesce(_c(x), F.lit(0))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def rounded(x: Column, places: int = 2) -> Column:
    """Half away from zero of the double times a power of ten, as SQL's round() does; Spark's goes by the shortest decimal that stands for it, so ties may fall otherwise."""
    return F.round(x * float(10**places)) / float(10**places)


def steps(value, bounds: list[tuple[float, object]], default, inclusive=True) -> Column:
    """The first label whose bound isn't passed."""
    v, out = _c(value), None
    for b, label in bounds:
        cond = v <= b if inclusive else v < b
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def cyclomatic(branches, loops, conditionals, body_lines) -> Column:
    return F.lit(1) + zero(branches) + zero(loops) + zero(conditionals) + F.floor(zero(body_lines) / 10).cast("int")


def complexity_category(cx, for_class=False) -> Column:
    return steps(cx, [(5, "simple"), (10, "moderate")] + ([] if for_class else [(20, "complex")]), "complex" if for_class else "very_complex")


def complexity_level(cx) -> Column:
    return F.when(_c(cx) > 7, "high").when(_c(cx) > 4, "medium").otherwise("low")


def coverage_category(cov) -> Column:
    v = _c(cov)
    return F.when(v >= 80, "excellent").when(v >= 60, "good").when(v >= 30, "fair").when(v > 0, "poor").otherwise("none")


def coverage_severity(cov) -> Column:
    v = _c(cov)
    return F.when(v.isNull() | (v < 30), "high").when(v < 60, "medium").otherwise("low")


def coupling_strength(fan_in, fan_out) -> Column:
    n = zero(fan_in) + zero(fan_out)
    return steps(n, [(0, 0), (2, 1), (5, 3), (10, 5), (20, 7)], 9)


def inheritance_depth(chain, name, superclass) -> Column:
    c = _c(chain)
    return (
        F.when(F.size(c) > 0, F.size(c) - F.when(F.get(c, F.lit(0)) == _c(name), 1).otherwise(0))
        .when(_c(superclass).isNotNull(), 1).otherwise(0)
    )


def age_in_days(last_modified, as_of) -> Column:
    return F.datediff(_c(as_of) if not isinstance(as_of, str) else F.lit(as_of).cast("date"), _c(last_modified))


def churn_score(commits, age) -> Column:
    a = _c(age)
    recency = F.when(a.isNull(), 1.0).when(a < 7, 2.0).when(a < 30, 1.5).when(a < 90, 1.2).otherwise(0.5)
    return rounded(zero(commits) * recency)


def stability_simple(age, coverage, churn, doc) -> Column:
    """Mean of the factors that are known; 0.5 if none is."""
    fs = [F.least(_c(age) / 365.0, F.lit(1.0)), _c(coverage) / 100.0, F.greatest(1 - _c(churn) / 10.0, F.lit(0.0)), _c(doc) / 100.0]
    n = sum((f.isNotNull().cast("int") for f in fs), F.lit(0))
    s = sum((F.coalesce(f, F.lit(0.0)) for f in fs), F.lit(0.0))
    return rounded(F.when(n > 0, F.try_divide(s, n)).otherwise(0.5))


def stability_category(score) -> Column:
    return F.when(_c(score) >= 0.7, "stable").when(_c(score) <= 0.4, "unstable").otherwise("neutral")


def norm_age(days) -> Column:
    return clamp(F.greatest(zero(days), F.lit(0)) / 365.0)


def norm_churn(score) -> Column:
    return clamp(F.greatest(zero(score), F.lit(0)) / 100.0)


def norm_coverage(c) -> Column:
    return clamp(F.greatest(zero(c), F.lit(0)) / 100.0)


def norm_ten(x) -> Column:
    """Coupling and complexity: tenths."""
    return clamp(F.greatest(zero(x), F.lit(0)) / 10.0)


def stability_composite(age, coverage, churn, doc) -> Column:
    return rounded(0.2 * norm_age(age) + 0.3 * norm_coverage(coverage) + 0.3 * (1 - norm_churn(churn)) + 0.2 * norm_coverage(doc))


def hundredths(total: Column, n: Column) -> Column:
    """total / (100 n) for whole numbers, rounded half up to two places without passing through fractions; null where n is 0."""
    return F.floor(F.try_divide(2 * total + n, 2 * n)) / 100.0


def complexity_score(cx) -> Column:
    """A tenth, at most 1, rounded from thousandths."""
    return hundredths(F.round(norm_ten(cx) * 1000).cast("bigint"), F.lit(10).cast("bigint"))


def maintainability(stability, cx_score, coupling) -> Column:
    """Mean of stability, simplicity and looseness, each taken in thousandths."""
    milli = lambda x: F.round(x * 1000).cast("bigint")
    return hundredths(milli(_c(stability)) + 2000 - milli(_c(cx_score)) - milli(norm_ten(coupling)), F.lit(30).cast("bigint"))


QUALITY_LEVELS = [(0.9, "excellent"), (0.7, "good"), (0.5, "fair"), (0.3, "poor")]


def quality_level(score) -> Column:
    out = None
    for least, label in QUALITY_LEVELS:
        out = F.when(_c(score) >= least, label) if out is None else out.when(_c(score) >= least, label)
    return out.otherwise("needs_improvement")


def weighted_risk(pairs: Column) -> Column:
    """Severity-weighted mean of an array of (severity value, weight)."""
    num = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["value"] * p["weight"])
    den = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["weight"])
    return rounded(F.when(den > 0, F.try_divide(num, den)).otherwise(0.0))


SEVERITY_VALUE = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.3}


def severity_value(s) -> Column:
    out = F.lit(0.0)
    for k, v in SEVERITY_VALUE.items():
        out = F.when(_c(s) == k, v).otherwise(out)
    return out


def common_prefix(a, b) -> Column:
    """Length of the common beginning of two texts."""
    n = F.least(F.length(_c(a)), F.length(_c(b)))
    idx = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(idx, lambda i: F.substring(_c(a), F.lit(1), i) == F.substring(_c(b), F.lit(1), i)))


def similarity(text, query: str) -> Column:
    """Fuzzy likeness in [0, 1]: equal, contained either way, common beginning, shared letters; case doesn't count."""
    t, q = F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(query.lower())
    lt, lq = F.length(t), F.lit(len(query))
    short, long_ = F.least(lt, lq), F.greatest(lt, lq)
    idx = F.when(short > 0, F.sequence(F.lit(1), short)).otherwise(F.array().cast("array<int>"))
    p = F.size(F.filter(idx, lambda i: F.substr(t, F.lit(1), i) == F.substr(q, F.lit(1), i)))
    x, y = F.array_distinct(F.split(t, "")), F.array_distinct(F.split(q, ""))
    jac = F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))
    return (
        F.when(t == q, 1.0).when((lt == 0) | (lq == 0), 0.0)
        .when(F.contains(t, q) | F.contains(q, t), 0.9 + 0.1 * short / F.greatest(long_, F.lit(1)))
        .when(p > 0, F.least(0.7 * p / F.greatest(lq, F.lit(1)) + 0.3 * p / F.greatest(long_, F.lit(1)), F.lit(0.95))).otherwise(jac)
    )
