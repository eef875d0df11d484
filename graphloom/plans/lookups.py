"""Queries that look up, search, validate, merge and change symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.operators import incremental as I
from graphloom.operators import merge as G
from graphloom.operators import search as S
from graphloom.plans.base import query


@query("symbol_lookup", "SELECT name, fqname, file, size AS line, type FROM @classes WHERE fqname = 'Brand#13::Part7' OR fqname = (SELECT max(fqname) FROM @classes)")
def _(t):
    c = t("classes")
    last = c.agg(F.max("fqname").alias("fqname"))
    got = S.find(c, "Brand#13::Part7").unionByName(c.join(last, "fqname", "left_semi")).distinct()
    return got.select("name", "fqname", "file", F.col("size").alias("line"), "type")


@query("search_regex", "SELECT name, fqname FROM @classes WHERE regexp_matches(name, '7[0-4]$') OR regexp_matches(fqname, '7[0-4]$')")
def _(t):
    return S.matching(t("classes"), "7[0-4]$", regex=True).select("name", "fqname")


@query("search_text", "SELECT name, fqname FROM @classes WHERE contains(name, 'Part19') OR contains(fqname, 'Part19')")
def _(t):
    return S.matching(t("classes"), "Part19").select("name", "fqname")


@query("search_ci", "SELECT fqname FROM @tree WHERE contains(lower(fqname), 'asia::nation_1')")
def _(t):
    return S.matching(t("tree").withColumn("name", N.simple_name("fqname")), "asia::Nation_1", case_sensitive=False).select("fqname")


@query("search_filtered", """
SELECT name, type, file FROM @classes WHERE (contains(name, '1') OR contains(fqname, '1')) AND namespace = (SELECT min(namespace) FROM @classes) AND regexp_matches(file, 'part_[0-9]*[05][.]rb$')""")
def _(t):
    c = t("classes")
    least = c.agg(F.min("namespace").alias("namespace"))
    return S.search(c, "1", file="part_[0-9]*[05][.]rb$").join(least, "namespace", "left_semi").select("name", "type", "file")


_SIM = """
WITH x AS (SELECT name, lower(name) AS t, 'part12' AS q, length(name) AS lt, 6 AS lq FROM @classes),
y AS (SELECT *, len(list_filter(range(1, least(lt, lq) + 1), lambda i: substr(t, 1, i) = substr(q, 1, i))) AS p,
  len(list_intersect(string_split(t, ''), string_split(q, ''))) AS same, len(list_distinct(list_concat(string_split(t, ''), string_split(q, '')))) AS every FROM x)
SELECT name, round(CASE WHEN t = q THEN 1.0 WHEN contains(t, q) OR contains(q, t) THEN 0.9 + 0.1 * least(lt, lq)::DOUBLE / greatest(lt, lq)
  WHEN p > 0 THEN least(0.7::DOUBLE * p / lq + 0.3::DOUBLE * p / greatest(lt, lq), 0.95) ELSE same::DOUBLE / every END, 4) AS score FROM y"""


@query("fuzzy_search", f"SELECT name, score FROM ({_SIM}) WHERE score >= 0.7".replace("SELECT name, score FROM (\nWITH", "WITH").replace("AS score FROM y) WHERE score >= 0.7", "AS score FROM y QUALIFY score >= 0.7 AND row_number() OVER () > 0"))
def _(t):
    return S.fuzzy(t("classes"), "part12").select("name", "score")


@query("public_symbols", "SELECT owner, count(*) AS n FROM @methods WHERE visibility <> 'private' GROUP BY owner")
def _(t):
    return S.public_only(t("methods")).groupBy("owner").agg(F.count(F.lit(1)).alias("n"))


@query("secondary_index", "SELECT namespace AS value, count(*) OVER (PARTITION BY namespace) AS n, name AS member FROM @classes")
def _(t):
    return S.secondary_index(t("classes"), "namespace")


@query("validate_reject", """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'missing name' WHEN c_custkey % 5 = 1 THEN 'empty name' WHEN c_custkey % 5 = 2 AND c_acctbal < 0 THEN 'missing owner' END AS error FROM @customers
WHERE c_custkey % 5 < 2 OR (c_custkey % 5 = 2 AND c_acctbal < 0)""")
def _(t):
    k = F.col("c_custkey") % 5
    c = t("customers").withColumn("n", F.when(k == 1, " ").when(k > 1, F.col("c_name"))).withColumn("o", F.when(~((k == 2) & (F.col("c_acctbal") < 0)), F.lit("owner")))
    _, bad = G.split_valid(c, F.coalesce(G.class_error(F.col("n")), G.method_error(F.col("n"), F.col("o"))))
    return bad.select("c_custkey", "error")


_MERGED = """
WITH m AS (SELECT owner, l_suppkey, m.name, source, visibility, body_lines, price, CASE source WHEN 'inferred' THEN 1 WHEN 'yard' THEN 2 WHEN 'rbs' THEN 4 WHEN 'runtime' THEN 5 ELSE 6 END AS p,
  CASE source WHEN 'rbs' THEN 0.95 WHEN 'runtime' THEN 0.85 WHEN 'yard' THEN 0.8 WHEN 'static' THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence
  FROM @methods m JOIN @orders o ON m.l_orderkey = o.o_orderkey)
"""


def _sourced(t):
    m = t("methods").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("owner", "l_suppkey", "name", "source", "visibility", "body_lines", "price")
    return m


@query("dedup_precedence", _MERGED + """
SELECT owner, l_suppkey, name, source, visibility, body_lines, price FROM m
QUALIFY row_number() OVER (PARTITION BY owner, l_suppkey ORDER BY p DESC, name DESC, source DESC, visibility DESC, body_lines DESC, price DESC) = 1""")
def _(t):
    return G.winners(_sourced(t), ["owner", "l_suppkey"])


@query("dedup_merge_all", _MERGED + """
SELECT owner, l_suppkey, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, max(confidence) AS confidence,
  CASE min(CASE visibility WHEN 'private' THEN 0 WHEN 'protected' THEN 1 ELSE 2 END) WHEN 0 THEN 'private' WHEN 1 THEN 'protected' ELSE 'public' END AS visibility
FROM m GROUP BY owner, l_suppkey""")
def _(t):
    m = _sourced(t).withColumn("confidence", N.confidence("source", F.lit(False), F.lit("n")))
    key = ["owner", "l_suppkey"]
    return G.merged(m, key)


@query("visibility_rank", "SELECT owner, CASE min(CASE visibility WHEN 'private' THEN 0 WHEN 'protected' THEN 1 ELSE 2 END) WHEN 0 THEN 'private' WHEN 1 THEN 'protected' ELSE 'public' END AS visibility FROM @methods GROUP BY owner")
def _(t):
    return G.most_restrictive(t("methods"), ["owner"])


@query("reliable_superclass", """
SELECT owner, arg_min(s, (-p, s)) AS superclass FROM (
  SELECT owner, CASE WHEN branches > 2 THEN 'Base' || branches END AS s, CASE source WHEN 'inferred' THEN 1 WHEN 'yard' THEN 2 WHEN 'rbs' THEN 4 WHEN 'runtime' THEN 5 ELSE 6 END AS p
  FROM @methods JOIN @orders ON l_orderkey = o_orderkey) GROUP BY owner""")
def _(t):
    m = t("methods").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    m = m.withColumn("superclass", F.when(F.col("branches") > 2, F.concat(F.lit("Base"), F.col("branches").cast("string"))))
    return G.reliable_superclass(m, ["owner"])


@query("mixin_join", """
SELECT src AS owner, dst AS module, count(name) AS methods FROM (SELECT DISTINCT src, dst FROM @depends) d
JOIN (SELECT 'Supplier' || l_suppkey AS module, name FROM @methods) m ON m.module = d.dst GROUP BY 1, 2""")
def _(t):
    own = t("methods").groupBy(F.concat(F.lit("Supplier"), F.col("l_suppkey").cast("string")).alias("module")).agg(F.count("name").alias("methods"))
    return t("depends").select(F.col("src").alias("owner"), F.col("dst").alias("module")).distinct().join(own, "module").select("owner", "module", "methods")


@query("merge_mixins", "SELECT DISTINCT owner, CASE scope WHEN 'class' THEN 'extend' ELSE 'include' END AS type, 'Supplier' || l_suppkey AS module FROM @methods")
def _(t):
    m = t("methods").select("owner", F.array(F.struct(F.when(F.col("scope") == "class", "extend").otherwise("include").alias("type"), F.concat(F.lit("Supplier"), F.col("l_suppkey").cast("string")).alias("module"))).alias("mixins"))
    return G.merge_mixins(m, ["owner"])


@query("resolve_owners", """
SELECT m.l_orderkey, m.owner, c.fqname AS owner_fqname FROM @methods m JOIN (SELECT name, min(fqname) AS fqname FROM @classes GROUP BY name) c ON c.name = m.owner""")
def _(t):
    return G.owners(t("methods"), t("classes").select("fqname", "name")).select("l_orderkey", "owner", "owner_fqname")


@query("method_availability", """
WITH RECURSIVE r(src, dst) AS (SELECT src, dst FROM @inherits UNION SELECT r.src, e.dst FROM r JOIN @inherits e ON r.dst = e.src),
d AS (SELECT DISTINCT owner, name FROM @methods)
SELECT d.owner, d.name, r.src AS available_in FROM d JOIN r ON r.dst = d.owner UNION SELECT owner, name, owner FROM d""")
def _(t):
    return G.availability(t("methods"), t("inherits"))


@query("anti_join_excludes", "SELECT p_partkey, file FROM @classes WHERE p_partkey NOT IN (SELECT replace(owner, 'Part', '')::BIGINT FROM @methods WHERE visibility = 'private' AND branches > 6 AND body_lines > 30)")
def _(t):
    gone = t("methods").where("visibility = 'private' and branches > 6 and body_lines > 30").select(F.col("owner").alias("name")).distinct()
    return t("classes").join(gone, "name", "left_anti").select("p_partkey", "file")


@query("remove_symbol", "SELECT name, fqname FROM @classes WHERE size % 10 <> 0")
def _(t):
    c = t("classes")
    return I.remove_symbols(c, t("depends"), c.where("size % 10 = 0").select(F.col("name").alias("node")))[0].select("name", "fqname")


@query("upsert_symbol", "SELECT name, CASE WHEN size > 25 THEN 'changed' ELSE file END AS file FROM @classes UNION ALL SELECT 'New' || p_partkey, 'new' FROM @classes WHERE size = 1")
def _(t):
    c = t("classes")
    new = c.where("size > 25").select("name", F.lit("changed").alias("file")).unionByName(c.where("size = 1").select(F.concat(F.lit("New"), F.col("p_partkey").cast("string")).alias("name"), F.lit("new").alias("file")))
    return I.upsert(c.select("name", "file"), new, "name")


@query("incremental_skip", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM @texts WHERE doc_id % 3 = 0 OR length(coalesce(text, '')) > 2000")
def _(t):
    now = I.with_digest(t("texts").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content")))
    before = I.with_digest(t("texts").select(F.col("doc_id").alias("path"), F.when((F.col("doc_id") % 3 == 0) | (F.length("text") > 2000), F.concat("text", F.lit("!"))).otherwise(F.coalesce("text", F.lit(""))).alias("content")))
    return I.changed(now, before).select(F.col("path").alias("doc_id"), "digest")


@query("config_diff", """
SELECT coalesce(a.namespace, b.namespace) AS key, a.v AS "from", b.v AS "to" FROM (SELECT namespace, max(size)::VARCHAR AS v FROM @classes WHERE size < 40 GROUP BY 1) a
FULL JOIN (SELECT namespace, max(size)::VARCHAR AS v FROM @classes GROUP BY 1) b ON a.namespace = b.namespace WHERE a.v IS DISTINCT FROM b.v""")
def _(t):
    c = t("classes")
    of = lambda x: x.groupBy(F.col("namespace").alias("key")).agg(F.max("size").cast("string").alias("value"))
    return I.config_diff(of(c.where("size < 40")), of(c))


@query("symbol_union", "SELECT kind, count(*) AS n FROM (SELECT 'class' AS kind FROM @classes UNION ALL SELECT 'method' FROM @methods UNION ALL SELECT 'module' FROM @tree WHERE type = 'module') GROUP BY kind")
def _(t):
    kinds = t("classes").select(F.lit("class").alias("kind")).unionByName(t("methods").select(F.lit("method").alias("kind"))).unionByName(t("tree").where("type = 'module'").select(F.lit("module").alias("kind")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("provenance", _MERGED + "SELECT owner, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, max(confidence) AS confidence FROM m GROUP BY owner")
def _(t):
    return G.provenance(_sourced(t).withColumn("confidence", N.confidence("source", F.lit(False), F.lit("n"))), ["owner"])


@query("attach_mixins", """
WITH c AS (SELECT name, fqname FROM @classes), k AS (SELECT fqname AS target, fqname FROM c UNION SELECT name, fqname FROM c),
m AS (SELECT CASE WHEN size % 2 = 0 THEN fqname ELSE name END AS target, 'include' AS type, 'Core::M' || (size % 7) AS module FROM @classes UNION ALL SELECT name, 'include', 'Other::M' || (size % 3) FROM @classes)
SELECT fqname AS target, type, min(module) AS module FROM m JOIN k USING (target) GROUP BY fqname, type, regexp_replace(module, '.*::', '')""")
def _(t):
    c, name = t("classes"), lambda p, k: F.concat(F.lit(p), (F.col("size") % k).cast("string"))
    m = c.select(F.when(F.col("size") % 2 == 0, F.col("fqname")).otherwise(F.col("name")).alias("target"), F.lit("include").alias("type"), name("Core::M", 7).alias("module"))
    return G.attach_mixins(c, m.unionByName(c.select(F.col("name").alias("target"), F.lit("include").alias("type"), name("Other::M", 3).alias("module"))))


@query("search_by_type", "SELECT name, type FROM @classes WHERE (contains(name, '1') OR contains(fqname, '1')) AND type = 'ECONOMY' AND namespace = 'Brand#5'")
def _(t):
    return S.search(t("classes"), "1", type_="ECONOMY", namespace="Brand#5").select("name", "type")


@query("in_file", "SELECT name, file FROM @classes WHERE contains(file, 'economy/part_1')")
def _(t):
    return S.in_file(t("classes"), "economy/part_1").select("name", "file")


@query("normalize_params", """
SELECT name, [{'name': 'a', 'kind': CASE size % 4 WHEN 0 THEN 'req' WHEN 1 THEN 'opt' WHEN 2 THEN 'rest' ELSE 'req' END}][1].kind AS kind, CASE size % 4 WHEN 1 THEN 'a = nil' WHEN 2 THEN '*a' ELSE 'a' END AS shown FROM @classes""")
def _(t):
    kind = F.when(F.col("size") % 4 == 0, "required").when(F.col("size") % 4 == 1, "optional").when(F.col("size") % 4 == 2, "rest")
    p = N.normalize_params(F.array(F.struct(F.lit("a").alias("name"), kind.alias("kind"), F.lit(None).cast("string").alias("type"))))
    shown = N.format_params(F.transform(p, lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), F.lit(None).cast("string").alias("default"))))
    return t("classes").select("name", p[0]["kind"].alias("kind"), shown.alias("shown"))
