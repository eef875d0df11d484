"""Queries of documentation pages, error reports, issues and scores of classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.functions import rules as R
from graphloom.functions import scores as S
from graphloom.operators import detectors as D
from graphloom.operators import errors as E
from graphloom.operators import metrics as M
from graphloom.operators import text as T
from graphloom.plans.base import query
from graphloom.plans.measures import ROLLUP
from graphloom.plans.rules import _C, _classes
from graphloom.sinks import pages as P
from graphloom.stages import progress


def _documented(t):
    r = M.class_rollup(t("methods")).select(F.col("owner").alias("name"), "methods", "total_complexity", "loc", "api_size")
    ms = t("methods").groupBy(F.col("owner").alias("name")).agg(F.sort_array(F.collect_set("name")).alias("method_names"))
    return t("classes").join(r, "name", "left").join(ms, "name", "left")


_PAGE = f"""
{ROLLUP}, m AS (SELECT owner, list_sort(list_distinct(list(name))) AS ms FROM @methods GROUP BY owner),
g AS (SELECT 'symbols/' || replace(fqname, '::', '/') || '.md' AS path, '# ' || fqname || chr(10) || chr(10) || '- Type: ' || coalesce(type, '') || chr(10) || '- Superclass: ' || coalesce(superclass, '') || chr(10) || '- File: ' || coalesce(file, '')
    || chr(10) || chr(10) || '## Metrics' || chr(10) || chr(10) || '- Methods: ' || coalesce(methods::VARCHAR, '') || chr(10) || '- Complexity: ' || coalesce(total_complexity::VARCHAR, '') || chr(10) || '- Lines: ' || coalesce(loc::VARCHAR, '')
    || chr(10) || '- Public: ' || coalesce(api_size::VARCHAR, '') || chr(10) || chr(10) || '## Methods' || chr(10) || chr(10) || coalesce(array_to_string(list_transform(ms, lambda x: '- `' || x || '`' || chr(10)), ''), '') AS content
  FROM @classes c LEFT JOIN r ON r.owner = c.name LEFT JOIN m ON m.owner = c.name)"""


@query("symbol_pages", f"WITH {_PAGE} SELECT path, content FROM g")
def _(t):
    return P.symbol_pages(_documented(t))


@query("page_manifest", f"WITH {_PAGE} SELECT path, strlen(content)::BIGINT AS bytes, ceil(length(content) / 4.0)::BIGINT AS tokens, sha256(content) AS sha256 FROM g")
def _(t):
    return P.manifest(P.symbol_pages(_documented(t)))


@query("overview_page", """
SELECT 'index.md' AS path, '# Overview' || chr(10) || chr(10) || '- Classes: ' || (SELECT count(*) FROM @classes) || chr(10) || '- Modules: ' || (SELECT count(*) FROM @tree WHERE type = 'module') || chr(10)
  || '- Methods: ' || (SELECT count(*) FROM @methods) || chr(10) || '- Dependencies: ' || (SELECT count(*) FROM @depends) || chr(10) AS content""")
def _(t):
    tagged = t("classes").select(F.lit("c").alias("k")).unionAll(t("tree").where("type = 'module'").select(F.lit("m"))).unionAll(t("methods").select(F.lit("x"))).unionAll(t("depends").select(F.lit("d")))
    return P.overview_page(tagged.agg(*[F.count_if(F.col("k") == k).alias(n) for k, n in (("c", "classes"), ("m", "modules"), ("x", "methods"), ("d", "dependencies"))]))


@query("index_lines", "SELECT 'index/' || replace(namespace, '::', '/') || '.md' AS path, '- [' || fqname || '](/symbols/' || replace(fqname, '::', '/') || '.md)' AS line FROM @classes")
def _(t):
    return P.index_lines(t("classes"))


@query("relationship_lines", "SELECT 'relationships/inherits.md' AS path, '- ' || src || ' -> ' || dst AS line FROM @inherits")
def _(t):
    return P.relationship_lines(t("inherits").withColumn("type", F.lit("inherits")))


_ERRORS = """
e AS (SELECT doc_id AS n, CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 0 THEN 'error' WHEN doc_id % 2 = 0 THEN 'warning' ELSE 'info' END AS severity,
  CASE doc_id % 3 WHEN 0 THEN 'parse' WHEN 1 THEN 'output' ELSE 'config' END AS category, 'm' || doc_id AS message, CASE WHEN doc_id % 5 > 0 THEN 'f' || (doc_id % 5) END AS file, (doc_id % 100)::INT AS line FROM @labels)"""


def _errors(t):
    k = F.col("doc_id")
    severity = F.when(F.col("toxic") == 1, "critical").when(F.col("quality") == 0, "error").when(k % 2 == 0, "warning").otherwise("info")
    category = F.when(k % 3 == 0, "parse").when(k % 3 == 1, "output").otherwise("config")
    file = F.when(k % 5 > 0, F.concat(F.lit("f"), (k % 5).cast("string")))
    return t("labels").select(k.alias("n"), severity.alias("severity"), category.alias("category"), F.concat(F.lit("m"), k.cast("string")).alias("message"), file.alias("file"), (k % 100).cast("int").alias("line"))


@query("errors_filtered", f"WITH {_ERRORS} SELECT n, message FROM e WHERE severity = 'error' AND category = 'output' AND file = 'f1'")
def _(t):
    return E.by(_errors(t), "error", "output", "f1").select("n", "message")


@query("errors_capped", f"WITH {_ERRORS} SELECT n, severity, message FROM e ORDER BY n LIMIT 25")
def _(t):
    return E.capped(_errors(t), 25).select("n", "severity", "message")


@query("error_report", f"""
WITH {_ERRORS}, b AS (SELECT * FROM e WHERE severity IN ('critical', 'error'))
SELECT 0::INT AS part, 0::BIGINT AS n, 'Errors: ' || count(*) AS line FROM e
UNION ALL SELECT 1, list_position(['critical', 'error', 'warning', 'info'], severity)::BIGINT, severity || ': ' || count(*) FROM e GROUP BY severity
UNION ALL SELECT 2, list_position(['parse', 'encoding', 'dependency', 'filesystem', 'memory', 'output', 'config'], category)::BIGINT, category || ': ' || count(*) FROM e GROUP BY category
UNION ALL SELECT 3, n, '[' || category || '] ' || message || coalesce(' (' || file || ':' || line || ')', '') FROM (SELECT * FROM b ORDER BY n LIMIT 10)
UNION ALL SELECT 4, 0, '... and ' || (count(*) - 10) || ' more' FROM b HAVING count(*) > 10""")
def _(t):
    return E.report(_errors(t))


@query("progress_percent", "SELECT fqname, CASE WHEN p_partkey % 50 > 0 THEN floor(least(size, p_partkey % 50) * 100.0 / (p_partkey % 50)) ELSE 100 END::INT AS percent FROM @classes")
def _(t):
    return progress(t("classes").select("fqname", "size", (F.col("p_partkey") % 50).alias("total")), "size", "total").select("fqname", "percent")


@query("class_scores", f"""
WITH {_C} SELECT owner, greatest(1000 - 200 * (a IS NOT NULL)::INT - 50 * (b IS NOT NULL)::INT - 100 * (c IS NOT NULL)::INT, 0) / 1000.0::DOUBLE AS score FROM i""")
def _(t):
    return _classes(t).select("owner", R.class_score(F.col("found")).alias("score"))


@query("issue_messages", f"""
WITH {_C} SELECT owner, CASE WHEN a IS NOT NULL THEN owner || ' does too much' END AS god, CASE WHEN b IS NOT NULL THEN owner || ' holds data only' END AS data FROM i WHERE a IS NOT NULL OR b IS NOT NULL""")
def _(t):
    of = lambda rule: F.try_element_at(F.filter("found", lambda i: i["rule"] == rule), F.lit(1))["message"]
    return _classes(t).select("owner", of("god_class").alias("god"), of("data_class").alias("data")).where("god is not null or data is not null")


@query("chain_depth", "SELECT name, CASE size % 3 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE CASE WHEN superclass IS NULL THEN 0 ELSE 1 END END::INT AS depth FROM @classes")
def _(t):
    k = F.col("size") % 3
    chain = F.when(k == 0, F.array("name", "superclass", F.lit("Object"))).when(k == 1, F.array("superclass", F.lit("Object")))
    return t("classes").select("name", S.inheritance_depth(chain, F.col("name"), F.col("superclass")).cast("int").alias("depth"))


@query("evidence", "SELECT fqname, round(0.7::DOUBLE * (size % 4) / 3.0::DOUBLE + 0.3::DOUBLE * (p_partkey % 3) / 2.0::DOUBLE, 2) AS confidence FROM @classes")
def _(t):
    return t("classes").select("fqname", D.evidence_confidence(F.col("size") % 4, 3, F.col("p_partkey") % 3, 2).alias("confidence"))


@query("summary_lists", f"""
WITH {ROLLUP}, f AS (SELECT src AS owner, count(*) AS n FROM @depends GROUP BY src),
x AS (SELECT owner, total_complexity, least(n / 10.0::DOUBLE, 1.0) AS coupling, CASE WHEN methods % 5 = 0 THEN 0.2 ELSE 0.5 END::DOUBLE AS cohesion FROM r JOIN f USING (owner))
SELECT 'high_complexity' AS list, owner AS name, total_complexity::DOUBLE AS value FROM x WHERE total_complexity > 10
UNION ALL SELECT 'tightly_coupled', owner, coupling FROM x WHERE coupling > 0.7 UNION ALL SELECT 'loosely_coupled', owner, coupling FROM x WHERE coupling < 0.3 UNION ALL SELECT 'low_cohesion', owner, cohesion FROM x WHERE cohesion < 0.3""")
def _(t):
    f = t("depends").groupBy(F.col("src").alias("owner")).agg(F.count(F.lit(1)).alias("n"))
    r = M.class_rollup(t("methods")).join(f, "owner")
    return D.summary_lists(r.select(F.col("owner").alias("name"), F.col("total_complexity").alias("complexity"), F.least(F.col("n") / 10, F.lit(1.0)).alias("coupling"), F.when(F.col("methods") % 5 == 0, 0.2).otherwise(0.5).alias("cohesion")))


@query("symbol_issues", f"""
WITH {ROLLUP} SELECT owner AS name, 'high_complexity' AS issue, 'high' AS severity FROM r WHERE total_complexity > 50
UNION ALL SELECT owner, 'low_cohesion', 'medium' FROM r WHERE methods % 5 = 0 UNION ALL SELECT owner, 'many_dependencies', 'medium' FROM r WHERE methods > 10""")
def _(t):
    r = M.class_rollup(t("methods"))
    return D.symbol_issues(r.select(F.col("owner").alias("name"), F.col("total_complexity").alias("complexity"), F.when(F.col("methods") % 5 == 0, 0.2).otherwise(0.5).alias("cohesion"), F.col("methods").alias("fan_out")))


@query("symbol_columns", """
SELECT fqname AS id, 'class' AS kind, name, fqname, namespace, file FROM @classes UNION ALL SELECT fqname, 'module', fqname, fqname, NULL, NULL FROM @tree WHERE type = 'module'
UNION ALL SELECT owner || '#' || name, 'method', name, owner || '#' || name, owner, NULL FROM @methods""")
def _(t):
    m = t("methods").select("name", F.concat("owner", F.lit("#"), "name").alias("fqname"), F.col("owner").alias("namespace"))
    return N.symbol_rows({"class": t("classes"), "module": t("tree").where("type = 'module'").select("fqname"), "method": m})


@query("paths_sanitized", """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'C:\\Users\\joe' || doc_id WHEN 1 THEN '/home/joe' || doc_id ELSE '/Users/joe' || doc_id END AS path, '[REDACTED]/x' AS clean FROM @texts""")
def _(t):
    k = F.col("doc_id")
    p = F.concat(F.when(k % 3 == 0, "C:\\Users\\joe").when(k % 3 == 1, "/home/joe").otherwise("/Users/joe"), k.cast("string"))
    return t("texts").select("doc_id", p.alias("path"), T.redact(F.concat(p, F.lit("/x")), "aggressive").alias("clean"))
