"""Queries of scalar functions on names, signatures and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.plans.base import query


@query("fqname_build", "SELECT name, CASE WHEN trim(namespace) <> '' THEN trim(namespace) || '::' || name ELSE name END AS fq, namespace || '::' || name || '::new' AS built FROM @classes")
def _(t):
    return t("classes").select("name", N.fqname("name", "namespace").alias("fq"), N.build_fqname("namespace", "name", F.lit("new")).alias("built"))


@query("namespace_functions", """
SELECT fqname, array_to_string(string_split(fqname, '::')[:-2], '::') AS path, string_split(fqname, '::')[-1] AS simple,
  CASE WHEN len(string_split(fqname, '::')) > 1 THEN array_to_string(string_split(fqname, '::')[:-2], '::') END AS parent,
  contains(fqname, '::') AS qualified, starts_with(fqname, 'ASIA::') AS nested, (len(string_split(fqname, '::')) - 1)::INT AS level,
  CASE WHEN string_split(fqname, '::')[1] = 'ASIA' AND len(string_split(fqname, '::')) > 1 THEN CASE WHEN string_split(fqname, '::')[2] = 'CHINA' AND len(string_split(fqname, '::')) > 2 THEN 'ASIA::CHINA' ELSE 'ASIA' END ELSE '' END AS common
FROM @tree""")
def _(t):
    c = F.col("fqname")
    return t("tree").select(
        "fqname", F.array_join(N.namespace_path(c), "::").alias("path"), N.simple_name(c).alias("simple"), N.parent_namespace(c).alias("parent"), N.is_qualified(c).alias("qualified"),
        N.nested_in(c, F.lit("ASIA")).alias("nested"), N.namespace_level(c).alias("level"), N.common_namespace(c, F.lit("ASIA::CHINA::X")).alias("common"),
    )


_SNAKE = "lower(regexp_replace(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"


@query("snake_case", f"""
WITH x AS (SELECT p_partkey, replace(type, ' ', '') || 'HTTPPartController' AS camel FROM @classes)
SELECT p_partkey, {_SNAKE.format('camel')} AS snake, {_SNAKE.format('camel')} || 's' AS tbl, {_SNAKE.format("regexp_replace(camel, 'Controller$', '')")} AS resource FROM x""")
def _(t):
    x = t("classes").select("p_partkey", F.concat(F.replace("type", F.lit(" "), F.lit("")), F.lit("HTTPPartController")).alias("camel"))
    return x.select("p_partkey", N.snake_case("camel").alias("snake"), N.table_name("camel").alias("tbl"), N.resource_name("camel").alias("resource"))


@query("symbol_id_hash", """
SELECT fqname, 'c' || substr(sha256('class/' || fqname), 1, 16) AS class_id, 'c' || substr(sha256('module/' || fqname), 1, 16) AS module_id,
  'm' || substr(sha256(fqname || '/instance/' || size), 1, 16) AS method_id, 'chunk_' || substr(md5(fqname), 1, 8) AS chunk_id FROM @classes""")
def _(t):
    c = F.col("fqname")
    return t("classes").select("fqname", N.class_id(c).alias("class_id"), N.module_id(c).alias("module_id"), N.method_id(c, F.lit("instance"), F.col("size")).alias("method_id"), N.chunk_id(c).alias("chunk_id"))


@query("method_fqname", """
SELECT l_orderkey, owner || CASE scope WHEN 'class' THEN '.' ELSE '#' END || name AS fq, CASE WHEN scope = 'class' THEN 'class' ELSE 'instance' END AS kind,
  CASE WHEN branches = 1 THEN 'super' WHEN scope = 'class' AND branches = 2 THEN 'self' ELSE 'method_call' END AS call_type FROM @methods""")
def _(t):
    receiver = F.when((F.col("scope") == "class") & (F.col("branches") == 2), "self").otherwise("other")
    name = F.when(F.col("branches") == 1, "super").otherwise(F.col("name"))
    return t("methods").select("l_orderkey", N.method_fqname("owner", "name", "scope").alias("fq"), N.scope_of("scope").alias("kind"), N.call_type(receiver, name).alias("call_type"))


_LITERALS = ["nil", "true", "-12", "3.5", "\"x\"", ":sym", "[1, 2]", "{a: 1}", "Some::Const", "a + b", ""]
_KINDS = ["nil", "boolean", "integer", "float", "string", "symbol", "array", "hash", "constant_ref", "expression", "unknown"]


@query("constant_kind", "SELECT o_orderkey, ([" + ", ".join(f"'{k}'" for k in _KINDS) + "])[o_orderkey % 11 + 1] AS kind FROM @orders")
def _(t):
    value = F.element_at(F.array(*[F.lit(x) for x in _LITERALS]), (F.col("o_orderkey") % 11 + 1).cast("int"))
    return t("orders").select("o_orderkey", N.constant_kind(value).alias("kind"))


@query("arity", """
SELECT l_orderkey, branches, loops, conditionals,
  CASE WHEN conditionals > 0 THEN -(loops + 1) WHEN loops = 0 AND branches > 0 THEN -1 ELSE loops END AS arity, loops + conditionals AS simple,
  array_to_string(list_concat(list_concat(list_transform(range(1, loops + 1), lambda i: 'r' || i), list_transform(range(1, conditionals + 1), lambda i: 'o' || i || ' = nil')), list_transform(range(1, branches + 1), lambda i: 'k' || i || ':')), ', ') AS signature
FROM @methods""")
def _(t):
    def ps(n, kind, letter):
        seq = F.when(F.col(n) > 0, F.sequence(F.lit(1), F.col(n))).otherwise(F.array().cast("array<int>"))
        return F.transform(seq, lambda i: F.struct(F.concat(F.lit(letter), i.cast("string")).alias("name"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("default")))

    p = F.concat(ps("loops", "req", "r"), ps("conditionals", "opt", "o"), ps("branches", "key", "k"))
    m = t("methods").withColumn("p", p)
    return m.select("l_orderkey", "branches", "loops", "conditionals", N.arity("p").alias("arity"), N.arity_simple("p").alias("simple"), N.format_params("p").alias("signature"))


@query("confidence", """
WITH b AS (SELECT o_orderkey, source, CASE source WHEN 'rbs' THEN 95 WHEN 'sorbet' THEN 90 WHEN 'runtime' THEN 85 WHEN 'yard' THEN 80 WHEN 'static' THEN 75 ELSE 50 END AS c FROM @orders)
SELECT o_orderkey, source, least(100, c + CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 0 END - CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 0 END) / 100.0::DOUBLE AS confidence,
  CASE source WHEN 'inferred' THEN 1 WHEN 'yard' THEN 2 WHEN 'rbs' THEN 4 WHEN 'runtime' THEN 5 ELSE 6 END AS precedence FROM b""")
def _(t):
    name = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("n")
    return t("orders").select("o_orderkey", "source", N.confidence("source", F.col("o_orderkey") % 2 == 0, name).alias("confidence"), N.precedence("source").alias("precedence"))


@query("visibility_normalized", """
SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 3) THEN 'public' WHEN c_custkey % 4 = 1 THEN 'private' ELSE 'public' END AS vis,
  CASE WHEN c_custkey % 4 = 2 THEN 'invalid visibility: hidden' END AS err, CASE WHEN c_custkey % 2 = 0 THEN 'private' ELSE 'public' END AS inferred FROM @customers""")
def _(t):
    v = F.when(F.col("c_custkey") % 4 == 1, " Private ").when(F.col("c_custkey") % 4 == 2, "hidden").when(F.col("c_custkey") % 4 == 3, "public")
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, "_").otherwise(""), F.col("c_name"))
    return t("customers").select("c_custkey", N.visibility(v).alias("vis"), N.visibility_error(v).alias("err"), N.inferred_visibility(name, F.lit(None).cast("string")).alias("inferred"))


@query("display_helpers", """
SELECT p_partkey, CASE WHEN length(file) > 20 THEN substr(file, 1, 17) || '...' ELSE file END AS short, size || ' method' || CASE WHEN size = 1 THEN '' ELSE 's' END AS counted,
  type || ', ' || namespace || ' and ' || name AS sentence, replace(replace(file, '_', '\\_'), '#', '\\#') AS escaped, file || ':' || size AS location,
  ceil(length(file) / 4.0)::BIGINT AS tokens, regexp_replace(lower(fqname), '[^a-z0-9_.-]+', '_', 'g') AS path FROM @classes""")
def _(t):
    return t("classes").select(
        "p_partkey", N.truncate("file", 20).alias("short"), N.pluralize("size", F.lit("method")).alias("counted"), N.to_sentence(F.array("type", "namespace", "name")).alias("sentence"),
        N.escape_markdown("file").alias("escaped"), N.format_location("file", "size").alias("location"), N.estimate_tokens("file").alias("tokens"), N.sanitize_path("fqname").alias("path"),
    )


@query("framework_type", """
SELECT c_custkey, ([NULL, 'model', 'controller', 'job', 'mailer', 'channel', 'connection'])[c_custkey % 7 + 1] AS kind FROM @customers""")
def _(t):
    bases = F.array(*[F.lit(x) for x in ("Object", "ApplicationRecord", "ActionController::API", "ApplicationJob", "ActionMailer::Base", "ApplicationCable::Channel", "ActionCable::Connection::Base")])
    return t("customers").select("c_custkey", N.rails_type(F.element_at(bases, (F.col("c_custkey") % 7 + 1).cast("int"))).alias("kind"))


@query("path_excludes", """
SELECT page_id, url, regexp_matches(url, '^(.*/)?es/.*$') OR regexp_matches(url, '^[^?]*/[0-9]+[.]html$') OR regexp_matches(url, '^(.*/)?tmp/.*$') AS excluded FROM @pages""")
def _(t):
    gone = N.excluded("url", ["**/es/**", "**/tmp/**"]) | F.coalesce(F.col("url").rlike("^[^?]*/[0-9]+[.]html$"), F.lit(False))
    return t("pages").select("page_id", "url", F.when(F.col("url").isNotNull(), gone).alias("excluded"))
