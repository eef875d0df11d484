"""Queries over inheritance, dependency and call graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import metrics as M
from graphloom.plans.base import query
from graphloom.storage import settle

_REACH = """
WITH RECURSIVE r(src, dst, depth) AS (
  SELECT DISTINCT src, dst, 1 FROM {0} UNION SELECT r.src, e.dst, r.depth + 1 FROM r JOIN {0} e ON r.dst = e.src WHERE r.depth < {1})
SELECT {2} FROM r GROUP BY src, dst"""


@query("ancestors", _REACH.format("@inherits", 40, "src, dst, min(depth)::INT AS depth"))
def _(t):
    return G.closure(t("inherits"))


@query("descendants", _REACH.format("@inherits", 40, "dst AS start, src AS node, min(depth)::INT AS depth"))
def _(t):
    e = t("inherits")
    return G.descendants(e, e.select(F.col("dst").alias("node")))


def _supply(t):
    """Parts depend on suppliers, suppliers on their nation's module, and these on their region's."""
    s = t("suppliers").select(F.col("name").alias("src"), F.concat(F.lit("Nation"), F.col("nation").cast("string")).alias("dst"))
    return settle(t("depends").select("src", "dst").unionByName(s))


@query("transitive_deps", """
WITH n AS (SELECT name, 'Nation' || nation AS home FROM @suppliers)
SELECT DISTINCT src AS start, dst AS node, 1 AS depth FROM @depends UNION SELECT DISTINCT src, home, 2 FROM @depends JOIN n ON dst = name""")
def _(t):
    return G.reachable(_supply(t), t("depends").select(F.col("src").alias("node")))


@query("trace_calls", """
WITH RECURSIVE r(start, node, depth) AS (
  SELECT DISTINCT src, src, 0 FROM @calls UNION SELECT r.start, e.dst, r.depth + 1 FROM r JOIN @calls e ON r.node = e.src WHERE r.depth < 8)
SELECT start, node, min(depth)::INT AS depth FROM r GROUP BY start, node""")
def _(t):
    e = settle(t("calls"))
    return G.trace(e, e.select(F.col("src").alias("node")))


@query("cycles", """
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM @calls),
r(root, path, tip) AS (
  SELECT src, [src, dst], dst FROM e WHERE dst >= src
  UNION ALL SELECT root, list_append(path, e.dst), e.dst FROM r JOIN e ON r.tip = e.src
  WHERE r.tip <> r.root AND (e.dst = root OR (e.dst > root AND NOT list_contains(path, e.dst))))
SELECT array_to_string(path, '>') AS cycle, (len(path) - 1)::INT AS length FROM r WHERE tip = root""")
def _(t):
    return G.cycles(t("calls"))


@query("inheritance_chain", """
WITH RECURSIVE r(node, chain, tip) AS (
  SELECT src, src || '>' || dst, dst FROM @inherits UNION ALL SELECT r.node, r.chain || '>' || e.dst, e.dst FROM r JOIN @inherits e ON r.tip = e.src)
SELECT node, chain FROM r WHERE tip NOT IN (SELECT src FROM @inherits)""")
def _(t):
    return G.chain(t("inherits")).select("node", F.array_join("chain", ">").alias("chain"))


_DEPTHS = """
WITH RECURSIVE roots AS (SELECT DISTINCT dst FROM @inherits WHERE dst NOT IN (SELECT src FROM @inherits)),
r(node, depth) AS (SELECT dst, 0 FROM roots UNION SELECT e.src, r.depth + 1 FROM r JOIN @inherits e ON e.dst = r.node)
SELECT node, min(depth)::INT AS depth FROM r GROUP BY node"""


@query("inheritance_depth", _DEPTHS)
def _(t):
    return G.depths_from_roots(t("inherits"))


@query("deep_classes", f"SELECT * FROM ({_DEPTHS.strip()}) WHERE depth > 3".replace("SELECT * FROM (WITH RECURSIVE", "WITH RECURSIVE", 1).replace("GROUP BY node) WHERE depth > 3", "GROUP BY node HAVING min(depth) > 3"))
def _(t):
    return G.deep_classes(t("inherits"))


@query("traverse_breadth_first", """
WITH RECURSIVE r(node, path) AS (
  SELECT 'Part1', ['Part1'] UNION ALL SELECT e.src, list_append(path, e.src) FROM r JOIN @inherits e ON e.dst = r.node WHERE NOT list_contains(path, e.src))
SELECT node, (len(path) - 1)::INT AS depth, array_to_string(path, '>') AS path FROM r""")
def _(t):
    return G.traverse(t("inherits"), "Part1").select("node", "depth", F.array_join("path", ">").alias("path"))


@query("shortest_path", """
WITH RECURSIVE e AS (SELECT src, dst FROM @inherits UNION SELECT dst, src FROM @inherits),
r(tip, path) AS (SELECT 'Part17', ['Part17'] UNION ALL SELECT e.dst, list_append(path, e.dst) FROM r JOIN e ON r.tip = e.src WHERE r.tip <> 'Part26' AND NOT list_contains(path, e.dst)),
b AS (SELECT path FROM r WHERE tip = 'Part26' ORDER BY len(path), path LIMIT 1)
SELECT (i - 1)::INT AS step, path[i] AS node FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM b)""")
def _(t):
    e = settle(t("inherits"))
    path = G.shortest_path(e, e.where(F.lit(False)), "Part17", "Part26")
    return e.sparkSession.createDataFrame([(i, n) for i, n in enumerate(path or [])], "step int, node string")


@query("shortest_cycles", """
WITH RECURSIVE r(src, dst, depth) AS (
  SELECT DISTINCT src, dst, 1 FROM @calls UNION SELECT r.src, e.dst, r.depth + 1 FROM r JOIN @calls e ON r.dst = e.src WHERE r.depth < 20)
SELECT src AS node, min(depth)::INT AS length FROM r WHERE src = dst GROUP BY src""")
def _(t):
    return G.shortest_cycles(t("calls"))


@query("neighbours", "SELECT 'out' AS side, dst AS node FROM @calls WHERE src = 'click' UNION SELECT 'in', src FROM @calls WHERE dst = 'click'")
def _(t):
    e = settle(t("calls"))
    return G.successors(e, "click").withColumn("side", F.lit("out")).unionByName(G.predecessors(e, "click").withColumn("side", F.lit("in"))).select("side", "node")


@query("edges_of_node", """
SELECT 'in' AS side, src, dst, weight FROM @calls WHERE dst = 'click' UNION ALL SELECT 'out', src, dst, weight FROM @calls WHERE src = 'click'
UNION ALL SELECT 'between', src, dst, weight FROM @calls WHERE src = 'click' AND dst = 'view'""")
def _(t):
    e = settle(t("calls"))
    side = lambda df, n: df.select(F.lit(n).alias("side"), "src", "dst", "weight")
    return side(G.in_edges(e, "click"), "in").unionByName(side(G.out_edges(e, "click"), "out")).unionByName(side(G.edge_between(e, "click", "view"), "between"))


@query("build_edges", """
SELECT 'inheritance' AS graph, fqname AS src, superclass AS dst, 'inherits' AS type, 1 AS weight FROM @classes WHERE superclass IS NOT NULL
UNION ALL SELECT 'dependency', fqname, namespace, 'depends_on', 1 FROM @classes
UNION ALL SELECT 'mixin', fqname, 'M' || size, CASE size % 4 WHEN 0 THEN 'includes' WHEN 1 THEN 'extends' WHEN 2 THEN 'prepends' ELSE 'refine' END, 1 FROM @classes
UNION ALL SELECT 'method_call', src, dst, 'calls', coalesce(CASE WHEN weight % 2 = 0 THEN weight END, 1) FROM @calls""")
def _(t):
    kind = F.when(F.col("size") % 4 == 0, "include").when(F.col("size") % 4 == 1, "extend").when(F.col("size") % 4 == 2, "prepend").otherwise("refine")
    c = t("classes").select("name", "fqname", "superclass", F.array("namespace").alias("dependencies"), F.array(F.struct(kind.alias("type"), F.concat(F.lit("M"), F.col("size").cast("string")).alias("module"))).alias("mixins"))
    return G.build_edges(c, t("calls").select(F.col("src").alias("from"), F.col("dst").alias("to"), F.when(F.col("weight") % 2 == 0, F.col("weight")).alias("frequency")))


@query("in_out_degree", """
SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (
  SELECT src AS node, 0 AS i, 1 AS o FROM @depends UNION ALL SELECT dst, 1, 0 FROM @depends) GROUP BY node""")
def _(t):
    return G.degrees(t("depends"))


@query("fan_in_out", """
SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (
  SELECT src AS node, 0 AS i, 1 AS o FROM (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM @depends UNION ALL SELECT src, dst FROM @inherits))
  UNION ALL SELECT dst, 1, 0 FROM (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM @depends UNION ALL SELECT src, dst FROM @inherits))) GROUP BY node""")
def _(t):
    return M.fans(t("depends").select("src", "dst").unionByName(t("inherits")))


_FANS = """
WITH e AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM @depends UNION ALL SELECT src, dst FROM @inherits)),
f AS (SELECT node, sum(i) AS fan_in, sum(o) AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node),
s AS (SELECT node, fan_in::BIGINT AS fan_in, fan_out::BIGINT AS fan_out, CASE WHEN fan_in + fan_out = 0 THEN 0 WHEN fan_in + fan_out <= 2 THEN 1 WHEN fan_in + fan_out <= 5 THEN 3 WHEN fan_in + fan_out <= 10 THEN 5 WHEN fan_in + fan_out <= 20 THEN 7 ELSE 9 END AS strength FROM f)
"""


@query("coupling_strength", _FANS + "SELECT node, fan_in, fan_out, strength, fan_out >= 3 OR strength >= 7 AS hotspot FROM s")
def _(t):
    return M.coupling(M.fans(t("depends").select("src", "dst").unionByName(t("inherits"))))


@query("coupling_hotspots", _FANS + "SELECT node, strength FROM s WHERE fan_out >= 3 OR strength >= 7")
def _(t):
    return M.coupling(M.fans(t("depends").select("src", "dst").unionByName(t("inherits")))).where("hotspot").select("node", "strength")


@query("dependency_hotspots", "SELECT dst AS node, count(*) AS fan_in FROM @depends GROUP BY dst HAVING count(*) > 5")
def _(t):
    return G.dependency_hotspots(t("depends"))


@query("hot_methods", "SELECT dst AS node, sum(weight)::BIGINT AS total_weight FROM @calls GROUP BY dst HAVING sum(weight) > 10")
def _(t):
    return G.hot_methods(t("calls"))


@query("missing_refs", """
SELECT dst AS symbol, src AS referenced_by, 'inherits' AS reference_type FROM @inherits WHERE dst NOT IN (SELECT name FROM @classes WHERE size > 10)
UNION ALL SELECT dst, src, 'depends_on' FROM @depends WHERE dst NOT IN (SELECT name FROM @classes WHERE size > 10)""")
def _(t):
    e = t("inherits").withColumn("type", F.lit("inherits")).unionByName(t("depends").select("src", "dst", F.lit("depends_on").alias("type")))
    return G.missing_references(t("classes").where("size > 10"), e)


@query("call_graph_targets", "SELECT src, array_to_string(list_sort(list_distinct(list(dst))), ',') AS targets, sum(weight)::BIGINT AS calls FROM @calls GROUP BY src")
def _(t):
    return t("calls").groupBy("src").agg(F.array_join(F.sort_array(F.collect_set("dst")), ",").alias("targets"), F.sum("weight").alias("calls"))


@query("callers_of", "SELECT dst AS node, src AS caller, weight FROM @calls")
def _(t):
    return G.reverse(t("calls")).select(F.col("src").alias("node"), F.col("dst").alias("caller"), "weight")


@query("speaker_turns", "SELECT src, dst, count(*) AS weight FROM @speaks WHERE dst IS NOT NULL GROUP BY 1, 2")
def _(t):
    return t("speaks").where("dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


@query("effective_mixins", """
WITH RECURSIVE r(src, dst) AS (SELECT src, dst FROM @inherits UNION SELECT r.src, e.dst FROM r JOIN @inherits e ON r.dst = e.src),
a AS (SELECT src, dst FROM r UNION SELECT src, src FROM @depends)
SELECT DISTINCT a.src AS node, d.dst AS module FROM a JOIN @depends d ON d.src = a.dst""")
def _(t):
    return G.effective_mixins(t("inherits"), t("depends"))


@query("remove_nodes", """
SELECT src, dst, weight FROM @depends WHERE src NOT IN (SELECT name FROM @classes WHERE size % 5 = 0) AND dst NOT IN (SELECT name FROM @suppliers WHERE balance < 0)""")
def _(t):
    gone = t("classes").where("size % 5 = 0").select(F.col("name").alias("node")).unionByName(t("suppliers").where("balance < 0").select(F.col("name").alias("node")))
    return G.remove_nodes(t("depends"), gone)


@query("namespace_children", "SELECT superclass AS parent, array_to_string(list_sort(list_distinct(list(fqname))), ',') AS children FROM @tree WHERE superclass IS NOT NULL GROUP BY superclass")
def _(t):
    from graphloom.operators.merge import children

    return children(t("tree")).select("parent", F.array_join("children", ",").alias("children"))


@query("dot_edges", """
SELECT '  "' || replace(src, '"', '\\"') || '" -> "' || replace(dst, '"', '\\"') || '" [color=blue, style=solid];' AS line FROM @inherits
UNION ALL SELECT '  "' || replace(src, '"', '\\"') || '" -> "' || replace(dst, '"', '\\"') || '" [color=red, style=dashed];' FROM @depends""")
def _(t):
    from graphloom.sinks.documents import dot_lines

    return dot_lines(t("inherits"), t("depends"))


@query("class_call_edges", "SELECT DISTINCT 'Part' || l_partkey AS src, 'Supplier' || l_suppkey AS dst FROM @items")
def _(t):
    c = t("items").select(F.concat(F.lit("Part"), F.col("l_partkey").cast("string"), F.lit("#run")).alias("src"), F.concat(F.lit("Supplier"), F.col("l_suppkey").cast("string"), F.lit(".serve")).alias("dst"))
    return M.class_of_calls(c)


@query("prefix_callers", "SELECT src, dst, parent AS symbol FROM (SELECT fqname || '#run' AS src, 'x' AS dst, unnest([fqname, superclass]) AS parent FROM @tree WHERE type = 'class') WHERE parent IN (SELECT fqname FROM @tree WHERE type = 'class')")
def _(t):
    from graphloom.operators.search import prefix_calls

    c = t("tree").where("type = 'class'")
    got = prefix_calls(c.select(F.concat("fqname", F.lit("#run")).alias("src"), F.lit("x").alias("dst")), c)
    return got.select("src", "dst", "symbol")
