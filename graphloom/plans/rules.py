"""Queries of the rule engine, hotspots, patterns, idioms and issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import rules as R
from graphloom.functions import scores as S
from graphloom.operators import detectors as D
from graphloom.operators import metrics as M
from graphloom.plans.base import query
from graphloom.plans.measures import CHURN, CX, ROLLUP, history

_NAMES = ["go", "get_total", "item_copy", "==", "do_work", "compute", "data_old", "x"]


def _methods(t):
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("l_orderkey") % 8 + 1).cast("int"))
    m = M.with_complexity(t("methods")).withColumn("name", name)
    return m.select("l_orderkey", "branches", "name", F.col("body_lines").alias("line_count"), F.col("branches").alias("parameter_count"), "complexity")


_M = f"""
m AS (SELECT l_orderkey, branches, ([{", ".join(repr(n) for n in _NAMES)}])[l_orderkey % 8 + 1] AS name, body_lines AS line_count, branches AS parameter_count, {CX} AS complexity FROM @methods),
i AS (SELECT l_orderkey, branches, complexity,
  CASE WHEN line_count > 20 THEN 'long_method:' || CASE WHEN line_count <= 30 THEN 'low' WHEN line_count <= 50 THEN 'medium' WHEN line_count <= 100 THEN 'high' ELSE 'critical' END END AS a,
  CASE WHEN parameter_count > 4 THEN 'too_many_parameters:medium' END AS b,
  CASE WHEN complexity > 10 THEN 'high_complexity:' || CASE WHEN complexity <= 15 THEN 'low' WHEN complexity <= 20 THEN 'medium' ELSE 'high' END END AS c,
  CASE WHEN length(name) <= 2 AND name <> '==' THEN 'short_method_name:low' END AS d, CASE WHEN starts_with(name, 'get_') THEN 'java_style_getter:low' END AS e,
  CASE WHEN name IN ('item_copy', 'data_old') THEN 'duplicate_indicator:medium' END AS f FROM m),
s AS (SELECT *, array_to_string(list_filter([a, b, c, d, e, f], lambda x: x IS NOT NULL), ',') AS issues,
  coalesce(list_sum(list_transform(list_filter([a, b, c, d, e, f], lambda x: x IS NOT NULL), lambda x: CASE WHEN ends_with(x, 'critical') THEN 400 WHEN ends_with(x, 'high') THEN 250 WHEN ends_with(x, 'medium') THEN 150 ELSE 50 END)), 0) AS pen FROM i),
sc AS (SELECT l_orderkey, branches, issues, floor((greatest(least(1000 - pen - CASE WHEN complexity > 5 THEN least((complexity - 5) * 15, 300) ELSE 0 END, 1000), 0) + 5) / 10) / 100.0::DOUBLE AS score FROM s)"""


def _scored(t):
    m = _methods(t).withColumn("found", R.issues(R.METHOD_RULES))
    return m.withColumn("score", R.method_score(F.col("found"), F.col("complexity")))


def _listed():
    return F.array_join(F.transform("found", lambda i: F.concat(i["rule"], F.lit(":"), i["severity"])), ",")


@query("rule_engine_methods", f"WITH {_M} SELECT l_orderkey, branches, issues, score FROM sc")
def _(t):
    return _scored(t).select("l_orderkey", "branches", _listed().alias("issues"), "score")


@query("severity_ranges", f"WITH {_M}, x AS (SELECT unnest(string_split(issues, ',')) AS i FROM sc WHERE issues <> '') SELECT split_part(i, ':', 1) AS rule, split_part(i, ':', 2) AS severity, count(*) AS n FROM x GROUP BY 1, 2")
def _(t):
    return _scored(t).select(F.explode("found").alias("i")).groupBy(F.col("i.rule").alias("rule"), F.col("i.severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("issues_by_severity", f"""
WITH {_M}, x AS (SELECT split_part(unnest(string_split(issues, ',')), ':', 2) AS s FROM sc WHERE issues <> '')
SELECT count(*) FILTER (s = 'critical') AS critical, count(*) FILTER (s = 'high') AS high, count(*) FILTER (s = 'medium') AS medium, count(*) FILTER (s = 'low') AS low FROM x""")
def _(t):
    return M.severity_counts(_scored(t).select(F.explode("found").alias("i")).select(F.col("i.severity").alias("severity")))


@query("quality_level", f"WITH {_M} SELECT CASE WHEN score >= 0.9 THEN 'excellent' WHEN score >= 0.7 THEN 'good' WHEN score >= 0.5 THEN 'fair' WHEN score >= 0.3 THEN 'poor' ELSE 'needs_improvement' END AS level, count(*) AS n FROM sc GROUP BY 1")
def _(t):
    return M.distribution(_scored(t), S.quality_level("score")).withColumnRenamed("category", "level")


@query("overall_quality", f"""
WITH {_M}, q AS (SELECT ((2 * sum(round(score * 100)::BIGINT) + count(*)) // (2 * count(*))) / 100.0::DOUBLE AS quality, count(*) AS scored FROM sc)
SELECT quality, scored, CASE WHEN quality >= 0.9 THEN 'excellent' WHEN quality >= 0.7 THEN 'good' WHEN quality >= 0.5 THEN 'fair' WHEN quality >= 0.3 THEN 'poor' ELSE 'needs_improvement' END AS level FROM q""")
def _(t):
    return M.overall(_scored(t).select("score"))


_CLASS_NAMES = ["get_a", "b=", "c=", "d=", "run", "process_all"]
_C = f"""
{ROLLUP}, d AS (SELECT src AS owner, count(*) AS dependency_count FROM @depends GROUP BY src),
k AS (SELECT owner, methods, loc, total_complexity, dependency_count, (loc > 500)::INT + (methods > 30)::INT + (dependency_count > 15)::INT + (total_complexity > 50)::INT AS hits,
  methods % 7 AS shown FROM r JOIN d USING (owner)),
i AS (SELECT owner, shown, hits, CASE WHEN hits >= 2 THEN 'god_class:high' END AS a, CASE WHEN shown = 5 THEN 'data_class:low' END AS b,
  CASE WHEN shown = 6 THEN 'mixed_abstraction_levels:medium' END AS c FROM k)"""


def _classes(t):
    d = t("depends").groupBy(F.col("src").alias("owner")).agg(F.count(F.lit(1)).alias("dependency_count"))
    r = M.class_rollup(t("methods")).join(d, "owner")
    shown = F.slice(F.array(*[F.lit(n) for n in _CLASS_NAMES]), F.lit(1), (F.col("methods") % 7).cast("int"))
    r = r.select("owner", F.col("owner").alias("name"), "loc", F.col("methods").alias("method_count"), "dependency_count", "total_complexity", shown.alias("method_names"))
    r = r.withColumn("cohesion", R.cohesion(F.col("method_names"), F.lit(None).cast("array<string>"))).withColumn("external_call_ratio", F.lit(0.5))
    return r.withColumn("found", R.issues(R.CLASS_RULES))


@query("rule_engine_classes", f"""
WITH {_C} SELECT owner, array_to_string(list_filter([a, b, c], lambda x: x IS NOT NULL), ',') AS issues FROM i""")
def _(t):
    return _classes(t).select("owner", _listed().alias("issues"))


@query("god_class", f"WITH {_C} SELECT owner, hits FROM i WHERE hits >= 2")
def _(t):
    rule = R.CLASS_RULES[0]
    hit, hits = R.fires(rule)
    return _classes(t).where(hit).select("owner", hits.alias("hits"))


_SEV = "CASE WHEN {0} <= 1.5 THEN 'low' WHEN {0} <= 2 THEN 'medium' WHEN {0} <= 3 THEN 'high' ELSE 'critical' END"
_VAL = "CASE {0} WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5 ELSE 0.3 END::DOUBLE"
_HOT = f"""
WITH {ROLLUP}, {CHURN}, d AS (SELECT src AS owner, count(*) AS dependencies FROM @depends GROUP BY src),
x AS (SELECT owner, CASE WHEN total_complexity > 10 THEN {_SEV.format("(total_complexity / 10.0)")} END AS sa, CASE WHEN churn > 5 THEN {_SEV.format("(churn / 5.0)")} END AS sb,
  CASE WHEN dependencies > 8 THEN {_SEV.format("(dependencies / 8.0)")} END AS sc, CASE WHEN coverage < 30 THEN {_SEV.format("((30 - coverage) / 30.0)")} END AS sd, CASE WHEN loc > 200 THEN {_SEV.format("(loc / 200.0)")} END AS se
  FROM r JOIN c USING (owner) JOIN d USING (owner)),
h AS (SELECT owner, array_to_string(list_filter(['complexity:' || sa, 'churn:' || sb, 'coupling:' || sc, 'coverage:' || sd, 'loc:' || se], lambda z: z IS NOT NULL), ',') AS signs,
  coalesce({_VAL.format('sa')} * 0.25::DOUBLE * (sa IS NOT NULL)::INT, 0) + coalesce({_VAL.format('sb')} * 0.2::DOUBLE * (sb IS NOT NULL)::INT, 0) + coalesce({_VAL.format('sc')} * 0.2::DOUBLE * (sc IS NOT NULL)::INT, 0)
    + coalesce({_VAL.format('sd')} * 0.15::DOUBLE * (sd IS NOT NULL)::INT, 0) + coalesce({_VAL.format('se')} * 0.1::DOUBLE * (se IS NOT NULL)::INT, 0) AS num,
  CASE WHEN sa IS NULL THEN 0.0 ELSE 0.25 END::DOUBLE + CASE WHEN sb IS NULL THEN 0.0 ELSE 0.2 END::DOUBLE + CASE WHEN sc IS NULL THEN 0.0 ELSE 0.2 END::DOUBLE + CASE WHEN sd IS NULL THEN 0.0 ELSE 0.15 END::DOUBLE + CASE WHEN se IS NULL THEN 0.0 ELSE 0.1 END::DOUBLE AS den,
  array_to_string(list_filter([CASE WHEN sa IS NOT NULL THEN 'split complex methods' END, CASE WHEN sb IS NOT NULL THEN 'find out why it keeps changing' END, CASE WHEN sc IS NOT NULL THEN 'loosen dependencies' END,
    CASE WHEN sd IS NOT NULL THEN 'write tests' END, CASE WHEN se IS NOT NULL THEN 'extract classes' END], lambda z: z IS NOT NULL), '; ') AS advice FROM x),
q AS (SELECT owner, signs, round(num / den, 2) AS risk, advice FROM h WHERE den > 0)
"""


def _hot(t):
    d = t("depends").groupBy(F.col("src").alias("owner")).agg(F.count(F.lit(1)).alias("dependencies"))
    return D.hotspots(history(t).join(d, "owner"), D.class_signs())


@query("hotspot_risk", _HOT + "SELECT owner, signs, risk, CASE WHEN risk > 0.8 THEN 'critical_hotspot' WHEN risk > 0.7 THEN 'high_risk_class' ELSE 'hotspot' END AS level FROM q")
def _(t):
    return _hot(t).select("owner", "signs", "risk", "level")


@query("recommendations", _HOT + "SELECT owner, advice FROM q")
def _(t):
    return _hot(t).select("owner", "advice")


@query("method_hotspots", f"""
WITH x AS (SELECT l_orderkey, branches, {CX} AS cx, test_coverage FROM @methods)
SELECT l_orderkey, branches, CASE WHEN cx > 10 THEN 'complexity' || CASE WHEN cx > 5 AND test_coverage < 50 THEN ',complex_untested' ELSE '' END ELSE 'complex_untested' END AS kinds FROM x WHERE cx > 10 OR (cx > 5 AND test_coverage < 50)""")
def _(t):
    m = M.with_complexity(t("methods")).withColumn("calls", F.lit(None).cast("int")).withColumn("s", D.method_signs())
    return m.where(F.size("s") > 0).select("l_orderkey", "branches", F.array_join(F.transform("s", lambda x: x["kind"]), ",").alias("kinds"))


@query("pattern_detect", """
SELECT fqname AS name, ([ 'factory', 'observer', 'strategy', 'adapter', 'decorator', 'singleton'])[p_partkey % 6 + 1] AS pattern,
  CASE p_partkey % 6 WHEN 0 THEN 0.8 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 WHEN 3 THEN 0.53 WHEN 4 THEN 0.4 ELSE CASE WHEN size > 25 THEN 0.7 ELSE 0.4 END END::DOUBLE AS confidence FROM @classes""")
def _(t):
    ends = F.element_at(F.array(*[F.lit(x) for x in ("Factory", "Listener", "Policy", "Adapter", "Decorator", "Connection")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    ms = [["create", "build"], ["update"], ["perform"], ["adapt"], [], []]
    methods = F.element_at(F.array(*[F.array(*[F.lit(x) for x in m]).cast("array<string>") for m in ms]), (F.col("p_partkey") % 6 + 1).cast("int"))
    c = t("classes").select("fqname", F.concat("name", ends).alias("name"), methods.alias("method_names"), (F.col("size") > 25).alias("private_new"))
    named = c.select(F.concat("fqname", F.lit("|"), "name").alias("name"), "method_names", "private_new")
    return D.pattern_matches(named).select(F.substring_index("name", "|", 1).alias("name"), "pattern", "confidence")


_IDIOM_NAMES = ["to_s", "each", "build_all", "valid?", "save!", "coerce", "plain", "<=>"]
_IDIOMS = ["protocol:string", "protocol:enumerable", "dsl", "predicate", "bang", "protocol:coercion", "", "protocol:comparable"]


@query("idiom_detect", f"""
SELECT idiom, count(*) AS n FROM (SELECT ([{", ".join(repr(x) for x in _IDIOMS)}])[l_orderkey % 8 + 1] AS idiom FROM @methods UNION ALL SELECT 'block' FROM @methods WHERE loops = 4) WHERE idiom <> '' GROUP BY idiom""")
def _(t):
    name = F.element_at(F.array(*[F.lit(n) for n in _IDIOM_NAMES]), (F.col("l_orderkey") % 8 + 1).cast("int"))
    return t("methods").select(F.explode(D.method_idioms(name, F.col("loops") == 4)).alias("idiom")).groupBy("idiom").agg(F.count(F.lit(1)).alias("n"))


@query("class_issues", f"""
WITH {ROLLUP}, {CHURN}, x AS (SELECT * FROM r JOIN c USING (owner))
SELECT owner AS name, 'low_coverage' AS issue, CASE WHEN coverage < 30 THEN 'high' WHEN coverage < 60 THEN 'medium' ELSE 'low' END AS severity FROM x WHERE coverage < 80
UNION ALL SELECT owner, 'large_api', CASE WHEN api_size >= 10 THEN 'high' ELSE 'medium' END FROM x WHERE api_size >= 5
UNION ALL SELECT owner, 'high_churn', CASE WHEN churn > 20 THEN 'high' ELSE 'medium' END FROM x WHERE churn > 10
UNION ALL SELECT owner, 'many_dependencies', 'high' FROM x WHERE methods > 10""")
def _(t):
    h = history(t).select(F.col("owner").alias("name"), "coverage", "api_size", F.lit(None).cast("int").alias("depth"), "churn", F.col("methods").alias("fan_out"))
    return D.class_issues(h)
