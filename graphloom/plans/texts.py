"""Queries over texts: redaction, chunks, references and deterministic output."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import search as S
from graphloom.operators import text as T
from graphloom.plans.base import query
from graphloom.sinks.documents import json_lines, redacted, yaml_lines


def _sql(level: str) -> str:
    out = "text"
    for pattern, to in T.LEVELS[level]:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')"
    return f"SELECT doc_id, {out} AS redacted FROM @texts"


@query("redact_standard", _sql("standard"))
def _(t):
    return t("texts").select("doc_id", T.redact(F.col("text"), "standard").alias("redacted"))


def _json_sql(level: str) -> str:
    inner = _sql(level).replace("SELECT doc_id, ", "").replace(" AS redacted FROM @texts", "").replace("(text,", "(x,")
    return f"SELECT doc_id, to_json({{'password': CASE WHEN lang IS NOT NULL THEN '{T.MARK}' END, 'text': {inner}}})::VARCHAR AS line FROM (SELECT doc_id, lang, 'login {{\"token\":\"a' || doc_id || '\"}} password: \"open ' || lang AS x FROM @texts)"


@query("redact_json", _json_sql("standard"))
def _(t):
    x = F.concat(F.lit('login {"token":"a'), F.col("doc_id").cast("string"), F.lit('"} password: "open '), F.col("lang"))
    d = redacted(t("texts").select("doc_id", F.col("lang").alias("password"), x.alias("text")), "standard")
    return d.select("doc_id", F.to_json(F.struct("password", "text"), {"ignoreNullFields": "false"}).alias("line"))


@query("redact_aggressive", _sql("aggressive"))
def _(t):
    return t("texts").select("doc_id", T.redact(F.col("text"), "aggressive").alias("redacted"))


_CHUNKS = """
WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM @texts), n AS (SELECT doc_id, t, unnest(range(0, greatest(ceil(length(t) / 8000.0), 1)::INT)) AS part FROM x)
SELECT doc_id, part::INT AS part, {0} FROM n"""


@query("chunk_split", _CHUNKS.format("substr(t, part * 8000 + 1, 8000) AS content, ceil(length(substr(t, part * 8000 + 1, 8000)) / 4.0)::BIGINT AS tokens"))
def _(t):
    return T.text_chunks(t("texts"))


@query("chunk_tokens", "SELECT lang, source, sum(ceil(length(coalesce(text, '')) / 4.0)::BIGINT)::BIGINT AS tokens FROM @texts GROUP BY lang, source")
def _(t):
    return t("texts").groupBy("lang", "source").agg(F.sum(F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4.0).cast("bigint")).alias("tokens"))


def _with_methods(t):
    ms = t("methods").groupBy("owner").agg(F.sort_array(F.collect_set("name")).alias("method_names"))
    return t("classes").join(ms, F.col("name") == F.col("owner"), "left").select("name", "file", "superclass", "method_names")


@query("class_chunks", """
WITH m AS (SELECT owner, len(list_distinct(list(name))) AS n, list_sort(list_distinct(list(name))) AS ms FROM @methods GROUP BY owner),
c AS (SELECT name, file, superclass, coalesce(n, 0) AS n, coalesce(ms, []) AS ms FROM @classes LEFT JOIN m ON owner = name),
h AS (SELECT *, '# ' || name || chr(10) || chr(10) || 'File: ' || coalesce(file, 'unknown') || chr(10) || 'Superclass: ' || coalesce(superclass, 'none') || chr(10) || chr(10) || '## Methods' || chr(10) AS head, ceil(n / 2.0)::INT AS half FROM c),
p AS (
  SELECT name, 0 AS part, 'whole' AS subtitle, head || array_to_string(list_transform(ms, lambda x: '- ' || x), chr(10)) AS content FROM h WHERE n <= 10
  UNION ALL SELECT name, 0, 'overview', head FROM h WHERE n > 10
  UNION ALL SELECT name, 1, 'core', '# ' || name || ' (core)' || chr(10) || array_to_string(list_transform(ms[1 : half], lambda x: '- ' || x), chr(10)) FROM h WHERE n > 10
  UNION ALL SELECT name, 2, 'helper', '# ' || name || ' (helper)' || chr(10) || array_to_string(list_transform(ms[half + 1 :], lambda x: '- ' || x), chr(10)) FROM h WHERE n > 10)
SELECT 'chunk_' || substr(md5(name || '/' || part), 1, 8) AS chunk_id, name AS symbol_id, part::INT AS part, subtitle, content, ceil(length(content) / 4.0)::BIGINT AS tokens FROM p""")
def _(t):
    return T.class_chunks(_with_methods(t))


@query("cross_links", """
WITH s AS (SELECT name FROM @classes), c AS (SELECT name AS symbol_id, 'Extends ' || coalesce(superclass, 'Object') AS content, superclass FROM @classes)
SELECT symbol_id, CASE WHEN superclass IN (SELECT name FROM s) AND superclass <> symbol_id THEN content || chr(10) || chr(10) || '## See also' || chr(10) || '- [' || superclass || '](chunk_' || substr(md5(superclass), 1, 8) || '.md)' ELSE content END AS content FROM c""")
def _(t):
    c = t("classes")
    chunks = c.select(F.col("name").alias("symbol_id"), F.concat(F.lit("Extends "), F.coalesce("superclass", F.lit("Object"))).alias("content"))
    return T.cross_links(chunks, c.select("name"), "[A-Z][A-Za-z0-9]*")


@query("text_references", """
SELECT doc_id, lang AS symbol, n FROM (SELECT doc_id, w AS lang, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM @texts) GROUP BY 1, 2)
WHERE lang IN (SELECT unnest(regexp_extract_all(name, '[A-Za-z]+')) FROM @symbols)""")
def _(t):
    known = t("symbols").select(F.explode(F.regexp_extract_all("name", F.lit("[A-Za-z]+"), F.lit(0))).alias("name"))
    return S.references(t("texts"), known, "[A-Za-z]+")


@query("deterministic_json", """
SELECT '{"file":"' || file || '","name":"' || name || '","size":' || size || ',"superclass":' || coalesce('"' || superclass || '"', 'null') || '}' AS line FROM @classes""")
def _(t):
    return json_lines(t("classes").select("name", "size", "superclass", "file"))


@query("deterministic_yaml", """
SELECT '- file: "' || file || '"' || chr(10) || '  name: "' || name || '"' || chr(10) || '  size: ' || size AS line FROM @classes""")
def _(t):
    return yaml_lines(t("classes").select("name", "size", "file"))


@query("manifest", """
SELECT count(*) AS files, sum(strlen(coalesce(text, '')))::BIGINT AS bytes, sum(ceil(length(coalesce(text, '')) / 4.0)::BIGINT)::BIGINT AS tokens FROM @texts""")
def _(t):
    content = F.coalesce("text", F.lit(""))
    return T.manifest(t("texts").select(content.alias("content"), F.ceil(F.length(content) / 4.0).cast("bigint").alias("tokens")))


@query("page_links", "SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM @pages) GROUP BY 1, 2")
def _(t):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return t("pages").select("page_id", F.explode(links).alias("link")).groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))
