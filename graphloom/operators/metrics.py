"""Measures of classes from their methods, edges and history: one grouped aggregation each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.functions import scores as S


def with_complexity(methods: DataFrame) -> DataFrame:
    return methods.withColumn("complexity", S.cyclomatic("branches", "loops", "conditionals", "body_lines"))


def class_rollup(methods: DataFrame, *more) -> DataFrame:
    """(owner, methods, total_complexity, loc, avg_complexity, coverage, doc_coverage, api_size): all a class has from its methods, in one pass; `more` are further aggregates.

    Complexity averages known values; coverage counts an unknown one as 0.
    """
    m = with_complexity(methods)
    public = F.col("visibility") == "public"
    return m.groupBy("owner").agg(
        F.count(F.lit(1)).alias("methods"), F.sum("complexity").alias("total_complexity"), F.sum(S.zero("body_lines")).alias("loc"),
        S.hundredths(F.sum("complexity") * 100, F.count("complexity")).alias("avg_complexity"),
        S.hundredths(F.sum(F.round(F.coalesce("test_coverage", F.lit(0.0)) * 100).cast("bigint")), F.count(F.lit(1))).alias("coverage"),
        S.hundredths(F.sum(F.round(F.coalesce("doc_coverage", F.lit(0.0)) * 100).cast("bigint")), F.count(F.lit(1))).alias("doc_coverage"),
        F.sum(F.coalesce(public, F.col("scope") == "class").cast("int")).alias("api_size"), *more,
    )


def history(methods: DataFrame, as_of: str) -> DataFrame:
    """class_rollup() and churn() in one pass."""
    g = class_rollup(methods, F.count("changed").alias("commits"), F.max("changed").alias("last")).withColumn("age", S.age_in_days("last", as_of))
    return g.drop("last").withColumn("churn", S.churn_score("commits", "age"))


def api_surface(methods: DataFrame) -> DataFrame:
    """(owner, instance_api, class_api): public methods; an unknown visibility counts for class methods only."""
    public, is_class = F.col("visibility") == "public", F.col("scope") == "class"
    return methods.groupBy("owner").agg(
        F.sum((F.coalesce(public, F.lit(False)) & ~is_class).cast("int")).alias("instance_api"), F.sum((F.coalesce(public, F.lit(True)) & is_class).cast("int")).alias("class_api"),
    )


def fans(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out): distinct neighbours each way, from edges of any kind."""
    e = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy(F.col("x.node").alias("node")).agg(F.sum("x.i").alias("fan_in"), F.sum("x.o").alias("fan_out"))


def class_of_calls(calls: DataFrame) -> DataFrame:
    """Calls between methods as edges between their classes, those within a class left out."""
    return calls.select(N.call_class("src").alias("src"), N.call_class("dst").alias("dst")).where("src is not null and dst is not null and src <> dst").distinct()


def coupling(fan: DataFrame, least_out: int = 3, strong: int = 7) -> DataFrame:
    """Fans with strength and whether they make a hotspot."""
    s = fan.withColumn("strength", S.coupling_strength("fan_in", "fan_out"))
    return s.withColumn("hotspot", (F.col("fan_out") >= least_out) | (F.col("strength") >= strong))


def churn(methods: DataFrame, as_of: str) -> DataFrame:
    """(owner, commits, age, churn): changes of a class, days since the last, and their product with recency."""
    g = methods.groupBy("owner").agg(F.count("changed").alias("commits"), F.max("changed").alias("last"))
    g = g.withColumn("age", S.age_in_days("last", as_of))
    return g.select("owner", "commits", "age", S.churn_score("commits", "age").alias("churn"))


def distribution(df: DataFrame, category) -> DataFrame:
    return df.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def severity_counts(issues: DataFrame, levels=("critical", "high", "medium", "low")) -> DataFrame:
    """One row with a count for each severity, 0 where there is none."""
    return issues.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in levels])


def overall(scores: DataFrame) -> DataFrame:
    """Mean of all scores (hundredths are summed, so that order doesn't matter), and its level."""
    mean = S.hundredths(F.sum(F.round(F.col("score") * 100).cast("bigint")), F.count("score"))
    return scores.agg(mean.alias("quality"), F.count("score").alias("scored")).withColumn("level", S.quality_level("quality"))


def largest(df: DataFrame, measure: str, ties: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(F.desc(measure), *ties).limit(n)


def highest_up_to(df: DataFrame, measure: str, cap: int = 20) -> DataFrame:
    return df.where(F.col(measure) <= cap).agg(F.max(measure).alias("highest"))


def error_summary(errors: DataFrame) -> DataFrame:
    """(severity, category, n) with totals, nulls standing for all."""
    return errors.groupingSets([["severity", "category"], ["severity"], ["category"], []], "severity", "category").agg(F.count(F.lit(1)).alias("n"))
