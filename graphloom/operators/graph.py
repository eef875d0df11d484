"""Graphs as edge tables (src, dst, and where it matters type and weight).

Closures and chains run as joins whose rounds grow with the logarithm of depth, searches from given
nodes take LEVELS steps to a round; every round is settled, so plans stay small and nothing is
collected. No depth is cut off: rounds end when nothing new is found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import discard, settle

#: Steps of a search that are one job, and rounds after which what was seen becomes one table.
LEVELS, MERGE = 4, 8
#: Nodes that get what they inherit together are 2 to this power.
BLOCK_BITS = 8


def edges_from_arrays(df: DataFrame, node: str, targets: str, kind: str) -> DataFrame:
    return df.select(F.col(node).alias("src"), F.explode(targets).alias("dst"), F.lit(kind).alias("type"), F.lit(1).cast("bigint").alias("weight"))


def build_edges(classes: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """All four graphs in one table: inheritance, dependency, method_call and mixin; a call's weight is its frequency, or 1."""
    own = F.coalesce(F.col("fqname"), F.col("name"))
    inh = classes.where(F.col("superclass").isNotNull()).select(F.lit("inheritance").alias("graph"), own.alias("src"), F.col("superclass").alias("dst"), F.lit("inherits").alias("type"), F.lit(1).cast("bigint").alias("weight"))
    out = inh
    if "dependencies" in classes.columns:
        out = out.unionByName(classes.select(F.lit("dependency").alias("graph"), own.alias("src"), F.explode("dependencies").alias("dst"), F.lit("depends_on").alias("type"), F.lit(1).cast("bigint").alias("weight")))
    if "mixins" in classes.columns:
        verb = F.when(F.col("m.type") == "include", "includes").when(F.col("m.type") == "extend", "extends").when(F.col("m.type") == "prepend", "prepends").otherwise(F.col("m.type"))
        out = out.unionByName(classes.select(own.alias("src"), F.explode("mixins").alias("m")).select(F.lit("mixin").alias("graph"), "src", F.col("m.module").alias("dst"), verb.alias("type"), F.lit(1).cast("bigint").alias("weight")))
    if calls is not None:
        out = out.unionByName(calls.select(F.lit("method_call").alias("graph"), F.col("from").alias("src"), F.col("to").alias("dst"), F.lit("calls").alias("type"), F.coalesce(F.col("frequency"), F.lit(1)).cast("bigint").alias("weight")))
    return out


def reverse(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, depth): all pairs with a path, and the least number of steps; a node reaches itself only by a cycle.

    A round that knows all pairs up to depth n joins those of depth n itself with all, which finds
    each pair up to 2 n by its first n steps and the rest: nothing known is joined again.
    """
    known = settle(edges.where("src is not null and dst is not null").select("src", "dst").distinct().withColumn("depth", F.lit(1)))
    n = 1
    while True:
        first, rest = known.where(F.col("depth") == n).alias("a"), known.alias("b")
        longer = first.join(rest, F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst", (F.lit(n) + F.col("b.depth")).alias("depth"))
        new = settle(longer.groupBy("src", "dst").agg(F.min("depth").alias("depth")).join(known.select("src", "dst"), ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return known
        known, n = known.unionByName(new), 2 * n


def _search(front: DataFrame, seen: DataFrame, e: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """`seen` and all that edges (at, to) lead to from `front`, each of (start,) node with its least depth; LEVELS steps to a job.

    `front` has keys and depth, and its nodes at the greatest depth are those from which the search goes on.
    """
    depth, parts = 0, 0
    front = front.select(*keys, "depth")
    while most is None or depth < most:
        steps, at = [], front
        for _ in range(LEVELS if most is None else min(LEVELS, most - depth)):
            depth += 1
            at = at.join(e, F.col("node") == F.col("at")).select(*[k for k in keys if k != "node"], F.col("to").alias("node")).distinct().withColumn("depth", F.lit(depth))
            steps.append(at.select(*keys, "depth"))
        found = steps[0]
        for x in steps[1:]:
            found = found.unionByName(x)
        new = settle(found.groupBy(*keys).agg(F.min("depth").alias("depth")).join(seen.select(*keys), keys, "left_anti"))
        front = new.where(F.col("depth") == depth)
        seen, parts = seen.unionByName(new), parts + 1
        if front.isEmpty():
            break
        if parts % MERGE == 0:
            seen = settle(seen)
    return seen


def reachable(edges: DataFrame, starts: DataFrame, include_start: bool = False, max_depth: int | None = None) -> DataFrame:
    """(start, node, depth) by breadth-first search from `starts` (node); a start counts as reached only on a cycle, unless included."""
    e = settle(edges.where("src is not null and dst is not null").select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct())
    front = settle(starts.select(F.col("node").alias("start"), "node").distinct().withColumn("depth", F.lit(0)))
    return _search(front, front.where(F.lit(include_start)), e, ["start", "node"], max_depth)


def ancestors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return reachable(edges, starts)


def descendants(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return reachable(reverse(edges), starts)


def trace(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """What calls lead to, the start at depth 0 included."""
    return reachable(edges, starts, include_start=True)


def depths_from_roots(edges: DataFrame) -> DataFrame:
    """(node, depth): steps from the nearest node without outgoing edge; nodes that only lead into cycles have none.

    Where no node has several parents, pointers are doubled, so the rounds are the logarithm of the depth; else the search goes down by levels.
    """
    e = settle(edges.select("src", "dst").distinct())
    roots = settle(e.select(F.col("dst").alias("node")).distinct().join(e.select(F.col("src").alias("node")), "node", "left_anti").withColumn("depth", F.lit(0)))
    if not e.groupBy("src").count().where("count > 1").isEmpty():
        return _search(roots, roots, e.select(F.col("dst").alias("at"), F.col("src").alias("to")), ["node"])
    up, most = settle(e.select(F.col("src").alias("node"), F.col("dst").alias("tip"), F.lit(1).cast("bigint").alias("steps"))), e.count()
    while True:
        j = up.join(up.select(F.col("node").alias("tip"), F.col("tip").alias("on"), F.col("steps").alias("more")), "tip", "left")
        before, up = up, settle(j.select("node", F.coalesce("on", "tip").alias("tip"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
        discard(before)
        # Who hasn't come to a root after more steps than there are edges goes round in a cycle.
        if up.join(roots.select(F.col("node").alias("tip")), "tip", "left_anti").where(F.col("steps") <= most).isEmpty():
            return roots.unionByName(up.join(roots.select(F.col("node").alias("tip")), "tip", "left_semi").select("node", F.col("steps").cast("int").alias("depth")))


def chain(edges: DataFrame) -> DataFrame:
    """(node, chain): each node followed by its single parents up to the last one known; a cycle ends where it closes.

    Chains are doubled. From where one comes back to a node it only repeats itself, so what is distinct of it, in order, is the whole chain.
    """
    up = settle(edges.groupBy("src").agg(F.min("dst").alias("dst")))
    going, done = up.select(F.col("src").alias("node"), F.array_distinct(F.array("src", "dst")).alias("chain"), (F.col("src") != F.col("dst")).alias("open")), None
    every = settle(going)
    while True:
        tail = every.select(F.col("node").alias("tip"), F.col("chain").alias("more"), F.col("open").alias("on"))
        j = every.where("open").join(tail, F.element_at("chain", -1) == F.col("tip"), "left")
        both = F.concat("chain", F.slice("more", 2, F.size("more")))
        now = j.select("node", F.when(F.col("more").isNull(), F.col("chain")).otherwise(F.array_distinct(both)).alias("chain"), F.coalesce(F.col("on") & (F.size(F.array_distinct(both)) == F.size(both)), F.lit(False)).alias("open"))
        before, every = every, settle(now.unionByName(every.where("not open")))
        discard(before)
        if every.where("open").isEmpty():
            return every.select("node", "chain")


def on_paths_between(edges: DataFrame, rounds: int = 4) -> DataFrame:
    """`edges` without some of those that can't be on a cycle: for a few rounds, ends that nothing leads to or from are taken off."""
    e = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    for _ in range(rounds):
        e = e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        e = settle(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
    return e


def cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """(cycle, length): elementary cycles, each once, from its least node round to it again; of at most `longest` nodes where that is given.

    There may be exponentially many; shortest_cycles() finds those that show each node's.
    """
    e = on_paths_between(edges)
    paths = e.where("dst >= src").select(F.col("src").alias("root"), F.array("src", "dst").alias("path"))
    found = paths.where("path[1] = root").select("path")
    paths = settle(paths.where("path[1] > root"))
    while not paths.isEmpty() and (longest is None or longest > 1):
        step = paths.join(e, F.element_at("path", -1) == F.col("src")).where((F.col("dst") == F.col("root")) | ((F.col("dst") > F.col("root")) & ~F.array_contains("path", F.col("dst"))))
        step = settle(step.select("root", F.array_append("path", F.col("dst")).alias("path"), (F.col("dst") == F.col("root")).alias("closed")))
        found = found.unionByName(step.where("closed").select("path"))
        paths = step.where("not closed").drop("closed")
        longest = None if longest is None else longest - 1
    return found.select(F.array_join("path", ">").alias("cycle"), (F.size("path") - 1).alias("length"))


def shortest_cycles(edges: DataFrame) -> DataFrame:
    """(node, length) of each node on a cycle, and the number of nodes of the shortest one through it."""
    return closure(on_paths_between(edges)).where("src = dst").select(F.col("src").alias("node"), F.col("depth").alias("length"))


def is_acyclic(edges: DataFrame) -> bool:
    return shortest_cycles(edges).isEmpty()


def shortest_path(inheritance: DataFrame, mixins: DataFrame, start: str, end: str) -> list[str] | None:
    """Inheritance both ways and mixins forward; the least path by names among the shortest; None if there is none."""
    if start == end:
        return [start]
    e = settle(inheritance.select("src", "dst").unionByName(reverse(inheritance.select("src", "dst"))).unionByName(mixins.select("src", "dst")).distinct())
    spark = e.sparkSession
    front = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    seen = front.select("node")
    while True:
        step = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        front = settle(step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        hit = front.where(F.col("node") == end).first()
        if hit:
            return list(hit["path"])
        if front.isEmpty():
            return None
        before, seen = seen, settle(seen.unionByName(front.select("node")))
        discard(before)


def traverse(edges: DataFrame, start: str, direction: str = "descendants", order: str = "bfs") -> DataFrame:
    """(node, depth, path) from one node; "descendants" follows edges backwards (to children), "ancestors" forwards.

    Breadth-first order is by depth and name; depth-first order is that of the paths.
    """
    e = settle((reverse(edges) if direction == "descendants" else edges).select("src", "dst").distinct())
    front = e.sparkSession.createDataFrame([(start, 0, [start])], "node string, depth int, path array<string>")
    seen, d = front, 0
    while not front.isEmpty():
        d += 1
        step = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        front = settle(step.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")).select("node", F.lit(d).alias("depth"), "path"))
        seen = seen.unionByName(front)
        if d % MERGE == 0:
            seen = settle(seen)
    return seen.orderBy("depth", "node") if order == "bfs" else seen.orderBy("path")


def successors(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("src") == node).select(F.col("dst").alias("node")).distinct()


def predecessors(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("dst") == node).select(F.col("src").alias("node")).distinct()


def edge_between(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.where((F.col("src") == a) & (F.col("dst") == b)).limit(1)


def in_edges(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("dst") == node)


def out_edges(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("src") == node)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree), parallel edges counted each: one pass, each edge seen from both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.node").alias("node")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def total_weight(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.sum(F.coalesce("weight", F.lit(1))).cast("bigint").alias("total_weight"))


def dependency_hotspots(edges: DataFrame, over: int = 5) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("fan_in")).where(F.col("fan_in") > over)


def hot_methods(edges: DataFrame, over: int = 10) -> DataFrame:
    return total_weight(edges).where(F.col("total_weight") > over)


def deep_classes(edges: DataFrame, over: int = 3) -> DataFrame:
    return depths_from_roots(edges).where(F.col("depth") > over)


def missing_references(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(symbol, referenced_by, reference_type): targets that are no symbol's name."""
    gone = edges.join(symbols.select(F.col("name").alias("dst")), "dst", "left_anti")
    return gone.select(F.col("dst").alias("symbol"), F.col("src").alias("referenced_by"), F.col("type").alias("reference_type"))


def remove_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the edges at either end of which a removed node is."""
    return edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")


def lineage(edges: DataFrame, more: DataFrame) -> DataFrame:
    """(node, up): every node with outgoing edges, and those of `more` (node), with itself and all nodes to which a path leads, each once.

    Where no node has several parents these are chains; else they are gathered from the closure.
    """
    e = settle(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    if e.groupBy("src").count().where("count > 1").isEmpty():
        up = chain(e).select("node", F.col("chain").alias("up"))
    else:
        up = closure(e).groupBy(F.col("src").alias("node")).agg(F.collect_set("dst").alias("up")).select("node", F.array_union(F.array("node"), "up").alias("up"))
    return up.unionByName(more.where("node is not null").select("node").distinct().join(up.select("node"), "node", "left_anti").select("node", F.array("node").alias("up")))


def inheriting(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(nodes, own) of blocks of nodes: `nodes` are lineage()'s, and `own` maps all nodes of their `up` to their items, from `own` (node, item).

    Nodes stand in the order of their ways from the root, so those of a block share most of their ancestors, and a node's items
    are sent once to each block that needs them, not to each descendant.
    """
    some = F.concat(F.collect_set("item"), F.when(F.count_if(F.col("item").isNull()) > 0, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))
    items = settle(own.where("node is not null").groupBy("node").agg(some.alias("items")))
    up = lineage(edges, items).withColumn("way", F.reverse("up"))
    n = settle(up.repartitionByRange("way").sortWithinPartitions("way").select(F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block"), "node", "up"))
    held = n.select("block", F.explode("up").alias("node")).distinct().join(items, "node").select("block", F.lit(None).cast("struct<node:string,up:array<string>>").alias("n"), F.struct("node", "items").alias("h"))
    every = n.select("block", F.struct("node", "up").alias("n"), F.lit(None).cast("struct<node:string,items:array<string>>").alias("h")).unionByName(held)
    return every.groupBy("block").agg(F.collect_list("n").alias("nodes"), F.map_from_entries(F.collect_list("h")).alias("own")).select("nodes", "own")


def effective_mixins(inheritance: DataFrame, mixins: DataFrame) -> DataFrame:
    """(node, module): a class's mixins and those of its ancestors."""
    items = lambda a: F.coalesce(F.try_element_at("own", a), F.array().cast("array<string>"))
    every = F.transform("nodes", lambda n: F.struct(n["node"].alias("node"), F.array_distinct(F.flatten(F.transform(n["up"], items))).alias("modules")))
    blocks = inheriting(inheritance, mixins.select(F.col("src").alias("node"), F.col("dst").alias("item")))
    return blocks.select(F.explode(every).alias("n")).select("n.node", F.explode("n.modules").alias("module"))


def available_modules(mixins: DataFrame, node: str) -> DataFrame:
    """(kind, modules): included and extended modules of a class; prepended ones don't count."""
    kind = F.when(F.col("type") == "includes", "included").when(F.col("type") == "extends", "extended")
    return mixins.where(F.col("src") == node).select(kind.alias("kind"), "dst").where("kind is not null").groupBy("kind").agg(F.sort_array(F.collect_set("dst")).alias("modules"))
