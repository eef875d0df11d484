"""Queries of metrics, scores and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import scores as S
from graphloom.operators import metrics as M
from graphloom.plans.base import query
from graphloom.sources.domain import AS_OF

CX = "(1 + branches + loops + conditionals + body_lines // 10)"
CAT = "CASE WHEN {0} <= 5 THEN 'simple' WHEN {0} <= 10 THEN 'moderate' WHEN {0} <= 20 THEN 'complex' ELSE 'very_complex' END"
ROLLUP = f"""
r AS (SELECT owner, count(*) AS methods, sum({CX})::BIGINT AS total_complexity, sum(body_lines)::BIGINT AS loc, ((200 * sum({CX}) + count(*)) // (2 * count(*))) / 100.0::DOUBLE AS avg_complexity,
  ((2 * sum(round(test_coverage * 100)::BIGINT) + count(*)) // (2 * count(*))) / 100.0::DOUBLE AS coverage, ((2 * sum(round(doc_coverage * 100)::BIGINT) + count(*)) // (2 * count(*))) / 100.0::DOUBLE AS doc_coverage,
  sum(CASE WHEN visibility = 'public' THEN 1 ELSE 0 END)::BIGINT AS api_size FROM @methods GROUP BY owner)"""


@query("method_complexity", f"SELECT l_orderkey, branches, {CX}::INT AS complexity, {CAT.format(CX)} AS category, CASE WHEN {CX} > 7 THEN 'high' WHEN {CX} > 4 THEN 'medium' ELSE 'low' END AS level FROM @methods")
def _(t):
    m = M.with_complexity(t("methods"))
    return m.select("l_orderkey", "branches", "complexity", S.complexity_category("complexity").alias("category"), S.complexity_level("complexity").alias("level"))


@query("class_complexity", f"WITH {ROLLUP} SELECT * FROM r")
def _(t):
    return M.class_rollup(t("methods"))


@query("complexity_distribution", f"SELECT {CAT.format(CX)} AS category, count(*) AS n FROM @methods GROUP BY 1")
def _(t):
    return M.distribution(M.with_complexity(t("methods")), S.complexity_category("complexity"))


@query("coverage_category", """
SELECT CASE WHEN test_coverage >= 80 THEN 'excellent' WHEN test_coverage >= 60 THEN 'good' WHEN test_coverage >= 30 THEN 'fair' WHEN test_coverage > 0 THEN 'poor' ELSE 'none' END AS category,
  CASE WHEN test_coverage < 30 THEN 'high' WHEN test_coverage < 60 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM @methods GROUP BY 1, 2""")
def _(t):
    return t("methods").groupBy(S.coverage_category("test_coverage").alias("category"), S.coverage_severity("test_coverage").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("api_surface", """
SELECT owner, sum(CASE WHEN visibility = 'public' AND scope <> 'class' THEN 1 ELSE 0 END)::BIGINT AS instance_api, sum(CASE WHEN visibility = 'public' AND scope = 'class' THEN 1 ELSE 0 END)::BIGINT AS class_api FROM @methods GROUP BY owner""")
def _(t):
    return M.api_surface(t("methods"))


CHURN = f"""
c AS (SELECT owner, commits, age, round(commits * CASE WHEN age < 7 THEN 2.0 WHEN age < 30 THEN 1.5 WHEN age < 90 THEN 1.2 ELSE 0.5 END::DOUBLE, 2) AS churn FROM (
  SELECT owner, count(changed) AS commits, date_diff('day', max(changed), DATE '{AS_OF}')::INT AS age FROM @methods GROUP BY owner))"""


@query("churn_score", f"WITH {CHURN} SELECT * FROM c")
def _(t):
    return M.churn(t("methods"), AS_OF)


def history(t):
    return M.history(t("methods"), AS_OF)


@query("stability_simple", f"""
WITH {ROLLUP}, {CHURN}, s AS (SELECT owner, round((least(age / 365.0::DOUBLE, 1.0) + coverage / 100.0::DOUBLE + greatest(1 - churn / 10.0::DOUBLE, 0.0) + doc_coverage / 100.0::DOUBLE) / 4, 2) AS stability FROM r JOIN c USING (owner))
SELECT owner, stability, CASE WHEN stability >= 0.7 THEN 'stable' WHEN stability <= 0.4 THEN 'unstable' ELSE 'neutral' END AS category FROM s""")
def _(t):
    s = history(t).select("owner", S.stability_simple("age", "coverage", "churn", "doc_coverage").alias("stability"))
    return s.withColumn("category", S.stability_category("stability"))


_COMPOSITE = "round(0.2::DOUBLE * least(greatest(age, 0) / 365.0::DOUBLE, 1.0) + 0.3::DOUBLE * least(coverage / 100.0::DOUBLE, 1.0) + 0.3::DOUBLE * (1 - least(churn / 100.0::DOUBLE, 1.0)) + 0.2::DOUBLE * least(doc_coverage / 100.0::DOUBLE, 1.0), 2)"


@query("stability_composite", f"WITH {ROLLUP}, {CHURN} SELECT owner, {_COMPOSITE} AS stability FROM r JOIN c USING (owner)")
def _(t):
    return history(t).select("owner", S.stability_composite("age", "coverage", "churn", "doc_coverage").alias("stability"))


@query("maintainability", f"""
WITH {ROLLUP}, {CHURN}, x AS (SELECT owner, {_COMPOSITE} AS stability, ((2 * round(least(avg_complexity / 10.0::DOUBLE, 1.0) * 1000)::BIGINT + 10) // 20) / 100.0::DOUBLE AS cx, least(methods / 10.0::DOUBLE, 1.0) AS coupling FROM r JOIN c USING (owner))
SELECT owner, stability, cx, ((2 * (round(stability * 1000)::BIGINT + 2000 - round(cx * 1000)::BIGINT - round(coupling * 1000)::BIGINT) + 30) // 60) / 100.0::DOUBLE AS maintainability FROM x""")
def _(t):
    h = history(t).select("owner", "methods", S.stability_composite("age", "coverage", "churn", "doc_coverage").alias("stability"), S.complexity_score("avg_complexity").alias("cx"))
    return h.select("owner", "stability", "cx", S.maintainability("stability", "cx", "methods").alias("maintainability"))


@query("top5_largest", f"WITH {ROLLUP} SELECT owner, methods, loc FROM r ORDER BY methods DESC, owner LIMIT 5")
def _(t):
    return M.largest(M.class_rollup(t("methods")), "methods", ["owner"]).select("owner", "methods", "loc")


@query("top5_longest", "SELECT owner, name, body_lines, price FROM @methods ORDER BY body_lines DESC, owner, name, price LIMIT 5")
def _(t):
    return M.largest(t("methods"), "body_lines", ["owner", "name", "price"]).select("owner", "name", "body_lines", "price")


@query("max_complexity_capped", f"SELECT max({CX})::INT AS highest FROM @methods WHERE {CX} <= 20")
def _(t):
    return M.highest_up_to(M.with_complexity(t("methods")), "complexity")


@query("error_rollup", """
SELECT severity, category, count(*) AS n FROM (SELECT CASE toxic WHEN 1 THEN 'critical' ELSE 'warning' END AS severity, CASE quality WHEN 1 THEN 'parse' ELSE 'io' END AS category FROM @labels)
GROUP BY GROUPING SETS ((severity, category), (severity), (category), ())""")
def _(t):
    e = t("labels").select(F.when(F.col("toxic") == 1, "critical").otherwise("warning").alias("severity"), F.when(F.col("quality") == 1, "parse").otherwise("io").alias("category"))
    return M.error_summary(e)


@query("overview", "SELECT (SELECT count(*) FROM @classes) AS classes, (SELECT count(*) FROM @tree WHERE type = 'module') AS modules, (SELECT count(*) FROM @methods) AS methods, (SELECT count(*) FROM @depends) AS dependencies")
def _(t):
    tagged = [t("classes").select(F.lit("c").alias("k")), t("tree").where("type = 'module'").select(F.lit("m").alias("k")), t("methods").select(F.lit("x").alias("k")), t("depends").select(F.lit("d").alias("k"))]
    every = tagged[0].unionAll(tagged[1]).unionAll(tagged[2]).unionAll(tagged[3])
    return every.agg(*[F.count_if(F.col("k") == k).alias(n) for k, n in (("c", "classes"), ("m", "modules"), ("x", "methods"), ("d", "dependencies"))])


@query("framework_counts", "SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'model' WHEN 'MACHINERY' THEN 'controller' ELSE 'job' END AS kind, count(*) AS n FROM @customers GROUP BY 1")
def _(t):
    from graphloom.functions.names import rails_type

    base = F.when(F.col("c_mktsegment") == "BUILDING", "ApplicationRecord").when(F.col("c_mktsegment") == "MACHINERY", "ApplicationController").otherwise("ApplicationJob")
    return t("customers").groupBy(rails_type(base).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
