import duckdb
from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.functions import rules as R
from graphloom.functions import scores as S
from graphloom.operators import detectors as D
from graphloom.operators import graph as G
from graphloom.operators import incremental as I
from graphloom.operators import merge as Mg
from graphloom.operators import metrics as M
from graphloom.operators import search as Se
from graphloom.operators import text as T
from graphloom.sinks import documents as Do
from graphloom.streaming import files as St


def one(spark, *cols):
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return tuple(r)


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_names(spark):
    lit = F.lit
    assert one(spark, N.fqname(lit("A"), lit(" ")), N.fqname(lit("A"), lit("B")), N.strip_leading(lit("::A::B")), N.resolve_in(lit("A"), lit("X"))) == ("A", "B::A", "A::B", "X::A")
    assert one(spark, N.namespace_path(lit("::")), N.namespace_path(lit("A::B::")), N.namespace_path(lit(None).cast("string")), N.namespace_path(lit("A::B::C"))) == ([], ["A"], [], ["A", "B"])
    assert one(spark, N.snake_case(lit("HTTPServerError")), N.to_sentence(F.array()), N.to_sentence(F.array(lit("a"))), N.parent_namespace(lit("A"))) == ("http_server_error", "", "a", None)
    assert one(spark, N.visibility(lit(None).cast("string")), N.visibility(lit("odd")), N.confidence(lit("rbs"), lit(True), lit("x")), N.confidence(lit("?"), lit(False), lit(""))) == ("public", "public", 1.0, 0.4)


def test_scores(spark):
    lit = F.lit
    none = lit(None).cast("int")
    assert one(spark, S.cyclomatic(none, none, none, none), S.cyclomatic(lit(3), lit(2), lit(4), lit(35)), S.complexity_category(lit(21)), S.complexity_category(lit(21), True)) == (1, 13, "very_complex", "complex")
    assert one(spark, S.churn_score(lit(10), lit(3)), S.churn_score(lit(10), none), S.churn_score(none, lit(1)), S.stability_simple(none, none, none, none)) == (20.0, 10.0, 0.0, 0.5)
    assert one(spark, S.inheritance_depth(F.array(lit("A"), lit("B"), lit("C")), lit("A"), none.cast("string")), S.inheritance_depth(F.array(lit("B"), lit("C")), lit("A"), lit("B")), S.inheritance_depth(lit(None).cast("array<string>"), lit("A"), lit("B")), S.inheritance_depth(lit(None).cast("array<string>"), lit("A"), none.cast("string"))) == (2, 2, 1, 0)
    assert one(spark, S.coverage_severity(none), S.coverage_severity(lit(59.9)), S.hundredths(lit(5), lit(0)), S.hundredths(lit(1075), lit(10))) == ("high", "medium", None, 1.08)


def test_ties_are_rounded_as_in_sql(spark):
    none = F.lit(None).cast("int")
    sql = duckdb.sql("SELECT round((0::DOUBLE / 100 + 58::DOUBLE / 100) / 4, 2)").fetchall()[0]
    assert one(spark, S.stability_simple(F.lit(0), F.lit(0), F.lit(10), F.lit(58))) == sql == (0.14,)
    assert one(spark, S.rounded(F.lit(-0.125)), S.rounded(none.cast("double")), S.rounded(F.lit(0.00005), 4)) == (-0.13, None, 0.0001)


def test_fuzzy_search_ranks_the_closest_first(spark):
    s = spark.createDataFrame([("User",), ("UserGroup",), ("Order",), ("",), (None,)], "name string").withColumn("fqname", F.col("name"))
    got = [r.name for r in Se.fuzzy(s, "usr", 0.5).collect()]
    assert got[0] == "User" and "Order" not in got[:1]
    assert [r.name for r in Se.matching(s, "").collect()] == ["User", "UserGroup", "Order", ""]


CHAIN = (("AdminUser", "User"), ("User", "ApplicationRecord"), ("ApplicationRecord", "ActiveRecord::Base"), ("ActiveRecord::Base", "Object"))


def test_graph_queries(spark):
    e = edges(spark, *CHAIN)
    start = spark.createDataFrame([("AdminUser",)], "node string")
    assert [r.node for r in G.ancestors(e, start).orderBy("depth").collect()] == ["User", "ApplicationRecord", "ActiveRecord::Base", "Object"]
    assert {r.node for r in G.descendants(e, spark.createDataFrame([("User",)], "node string")).collect()} == {"AdminUser"}
    cyc = edges(spark, ("A", "B"), ("B", "C"), ("C", "A"), ("C", "D"), ("E", "E"), (None, "A"))
    assert {(r.cycle, r.length) for r in G.cycles(cyc).collect()} == {("A>B>C>A", 3), ("E>E", 1)}
    assert not G.is_acyclic(cyc) and G.is_acyclic(e)
    reach = {(r.src, r.dst): r.depth for r in G.closure(cyc).collect()}
    assert reach["A", "A"] == 3 and reach["A", "D"] == 3 and ("D", "A") not in reach
    assert {r.node: r.depth for r in G.depths_from_roots(e).collect()} == {"Object": 0, "ActiveRecord::Base": 1, "ApplicationRecord": 2, "User": 3, "AdminUser": 4}
    assert {r.node: r.chain for r in G.chain(edges(spark, ("A", "B"), ("B", "A"))).collect()} == {"A": ["A", "B"], "B": ["B", "A"]}
    none = e.limit(0)
    assert G.shortest_path(e, none, "AdminUser", "Object")[0::4] == ["AdminUser", "Object"] and G.shortest_path(e, none, "A", "A") == ["A"] and G.shortest_path(e, none, "User", "Nobody") is None
    assert G.closure(none).count() == 0 and G.cycles(none).count() == 0


def test_graphs_have_no_greatest_depth(spark):
    ring = edges(spark, *[(f"R{i}", f"R{(i + 1) % 8}") for i in range(8)], ("R0", "X"), ("Y", "R3"))
    assert [(r.cycle, r.length) for r in G.cycles(ring).collect()] == [(">".join(f"R{i % 8}" for i in range(9)), 8)]
    assert {(r.node, r.length) for r in G.shortest_cycles(ring).collect()} == {(f"R{i}", 8) for i in range(8)} and G.cycles(ring, longest=7).count() == 0
    path = edges(spark, *[(f"N{i}", f"N{i + 1}") for i in range(150)])
    assert {r.node: len(r.chain) for r in G.chain(path).collect()} == {f"N{i}": 151 - i for i in range(150)}
    depths = {r.node: r.depth for r in G.depths_from_roots(path).collect()}
    assert depths == {f"N{i}": 150 - i for i in range(151)}
    assert G.closure(path).agg({"depth": "max"}).first()[0] == 150 and G.closure(path).count() == 151 * 75
    end = path.where("src >= 'N135'")
    got = G.reachable(end, end.where("src in ('N135', 'N140')").selectExpr("src as node"))
    assert {(r.start, r.node, r.depth) for r in got.collect()} >= {(f"N{a}", f"N{b}", b - a) for a in (135, 140) for b in range(a + 1, 150)}
    assert G.reachable(path, path.where("src = 'N0'").selectExpr("src as node"), max_depth=6).count() == 6


def test_chains_into_cycles_and_orders_of_traversal(spark):
    e = edges(spark, ("A", "B"), ("B", "C"), ("C", "D"), ("D", "B"), ("S", "S"))
    assert {r.node: "".join(r.chain) for r in G.chain(e).collect()} == {"A": "ABCD", "B": "BCD", "C": "CDB", "D": "DBC", "S": "S"}
    tree = edges(spark, ("b", "a"), ("c", "a"), ("d", "b"), ("e", "b"), ("f", "c"))
    assert [r.node for r in G.traverse(tree, "a", order="dfs").collect()] == ["a", "b", "d", "e", "c", "f"]
    assert [r.node for r in G.traverse(tree, "a").collect()] == ["a", "b", "c", "d", "e", "f"]
    d = G.degrees(edges(spark, ("A", "B"), ("A", "B"), ("B", "C")))
    assert {tuple(r) for r in d.collect()} == {("A", 0, 2), ("B", 2, 1), ("C", 1, 0)}


def test_graph_of_classes(spark):
    c = spark.createDataFrame([("User", "Base", ["Log", "Mail"], [("include", "Sort")]), ("Log", None, [], [])], "fqname string, superclass string, dependencies array<string>, mixins array<struct<type:string,module:string>>").withColumn("name", F.col("fqname"))
    calls = spark.createDataFrame([("User#a", "Log.b", None), ("User#a", "Mail#c", 4)], "`from` string, `to` string, frequency int")
    e = G.build_edges(c, calls)
    assert e.groupBy("graph").count().count() == 4 and e.where("type = 'includes' and dst = 'Sort'").count() == 1
    assert {r.node: r.total_weight for r in G.total_weight(e.where("graph = 'method_call'")).collect()} == {"Log.b": 1, "Mail#c": 4}
    assert {(r.symbol, r.reference_type) for r in G.missing_references(c, e.where("graph <> 'method_call'")).collect()} == {("Base", "inherits"), ("Mail", "depends_on"), ("Sort", "includes")}
    every = e.select("src", "dst").where("instr(src, '#') = 0").unionByName(M.class_of_calls(e.where("graph = 'method_call'").select("src", "dst")))
    assert {r.node: (r.fan_in, r.fan_out) for r in M.fans(every).collect()}["User"] == (0, 4)


def test_merging(spark):
    rows = [("a", "yard", "public", None), ("a", "static", "private", None), ("a", "rbs", "public", "B"), ("b", "odd", None, None), ("b", "odd", None, None)]
    df = spark.createDataFrame(rows, "id string, source string, visibility string, superclass string")
    w = {r.id: r.source for r in Mg.winners(df, ["id"]).collect()}
    assert w == {"a": "static", "b": "odd"}
    again = Mg.winners(Mg.winners(df, ["id"]), ["id"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, Mg.winners(df, ["id"]).collect()))
    assert {r.id: r.superclass for r in Mg.reliable_superclass(df, ["id"]).collect()} == {"a": "B", "b": None}
    assert {r.id: r.visibility for r in Mg.most_restrictive(df, ["id"]).collect()} == {"a": "private", "b": "public"}
    classes = spark.createDataFrame([("A::User", "User"), ("A", "A")], "fqname string, name string")
    mixins = spark.createDataFrame([("User", "include", "X::Log"), ("A::User", "include", "Log"), ("Nobody", "include", "Log")], "target string, type string, module string")
    assert [tuple(r) for r in Mg.attach_mixins(classes, mixins).collect()] == [("A::User", "include", "Log")]
    assert [tuple(r) for r in Mg.children(classes).collect()] == [("A", ["A::User"])]
    ok, bad = Mg.split_valid(classes.withColumn("name", F.when(F.col("name") == "A", " ").otherwise(F.col("name"))), Mg.class_error(F.col("name")))
    assert ok.count() == 1 and bad.first().error == "empty name"


def test_rules_and_detectors(spark):
    m = spark.createDataFrame([("get_x", 25, 5, 12), ("ok", None, None, None), ("+", 1, 0, 1)], "name string, line_count int, parameter_count int, complexity int")
    m = m.withColumn("found", R.issues(R.METHOD_RULES)).withColumn("score", R.method_score(F.col("found"), F.col("complexity")))
    got = {r.name: r for r in m.collect()}
    assert [i.rule for i in got["get_x"].found] == ["long_method", "too_many_parameters", "high_complexity", "java_style_getter"] and got["get_x"].score == round(1 - 0.05 - 0.15 - 0.05 - 0.05 - 0.105, 2) + 0.0 or got["get_x"].score == 0.6
    assert [i.rule for i in got["ok"].found] == ["short_method_name"] and got["+"].found == []
    c = spark.createDataFrame([("WidgetFactory", ["create", "build"], None), ("Db", ["instance"], True), ("Db2", ["instance"], False), (None, None, None)], "name string, method_names array<string>, private_new boolean")
    assert {(r.name, r.pattern, r.confidence) for r in D.pattern_matches(c).collect()} == {("WidgetFactory", "factory", 0.8), ("Db", "singleton", 0.7)}
    h = spark.createDataFrame([("A", 35, 12.0, 9, 10.0, 500), ("B", 1, 0.0, 0, 90.0, 1), ("C", None, None, None, None, None)], "name string, total_complexity int, churn double, dependencies int, coverage double, loc int")
    got = D.hotspots(h, D.class_signs()).collect()
    assert [r.name for r in got] == ["A"] and got[0].signs.startswith("complexity:critical,churn:high,coupling:low") and "split complex methods" in got[0].advice
    i = spark.range(1).select(D.class_idioms(F.array(F.lit("to_s"), F.lit("to_str"), F.lit("a"), F.lit("a=")), F.array(F.lit("Comparable"))).alias("i")).first().i
    assert i == ["complete:string", "accessor_pair", "mixin:comparable"]


def test_text(spark):
    t = "password: \"x y\" and api_key=abc, /home/joe/x joe@site.org 123-45-6789"
    std, agg = one(spark, T.redact(F.lit(t)), T.redact(F.lit(t), "aggressive"))
    assert std == "password: [REDACTED] and api_key=[REDACTED] /home/joe/x joe@site.org 123-45-6789"
    assert agg == "password: [REDACTED] and api_key=[REDACTED] [REDACTED]/x [REDACTED] [REDACTED]"
    nested = spark.createDataFrame([(["token=1"], {"k": "secret: s"})], "a array<string>, m map<string,string>")
    r = nested.select(*[T.redact_nested(F.col(f.name), f.dataType).alias(f.name) for f in nested.schema.fields]).first()
    assert r.a == ["token=[REDACTED]"] and r.m == {"k": "secret: [REDACTED]"}
    c = spark.createDataFrame([("Big", "f", None, [f"m{i:02d}" for i in range(11)]), ("Small", None, "S", None)], "name string, file string, superclass string, method_names array<string>")
    chunks = T.class_chunks(c).collect()
    assert [(x.symbol_id, x.subtitle) for x in chunks] == [("Big", "overview"), ("Big", "core"), ("Big", "helper"), ("Small", "whole")] and chunks[1].content.count("- m") == 6
    texts = spark.createDataFrame([(1, "abc" * 5000), (2, None), (3, "")], "doc_id int, text string")
    parts = T.text_chunks(texts, 100).collect()
    assert "".join(p.content for p in sorted((p for p in parts if p.doc_id == 1), key=lambda p: p.part)) == "abc" * 5000 and len(parts) == 38 + 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", None), ("a", 1)], "name string, n int")
    assert sorted(r.line for r in Do.json_lines(df).collect()) == ['{"n":1,"name":"a"}', '{"n":null,"name":"b"}']
    assert Do.yaml_lines(df.where("n = 1")).first().line == '- n: 1\n  name: "a"'
    e = edges(spark, ("A", 'B"x'))
    lines = [r.line for r in Do.dot(e, e).collect()]
    assert lines[0] == "digraph symbols {" and lines[-1] == "}" and '  "A" -> "B\\"x" [color=red, style=dashed];' in lines and len(lines) == 6
    assert Do.emit_all({"t": df, "e": e}, ["json", "yaml", "dot", "parquet"], str(tmp_path)) == []
    assert spark.read.json(f"{tmp_path}/json/t").count() == 2
    try:
        Do.emit_all({"t": df}, ["odd"], str(tmp_path))
        raise AssertionError
    except ValueError:
        pass
    lines = lambda d: [r.line for r in Do.section("Classes", d, F.col("name")).orderBy("part", "line").collect()]
    assert lines(df) == ["## Classes\n", "a", "b"] and lines(df.limit(0)) == ["## Classes\n", "None."]
    chunks = T.class_chunks(spark.createDataFrame([("A", "f", None, ["m"])], "name string, file string, superclass string, method_names array<string>"))
    assert Do.write_chunks(chunks, str(tmp_path / "c")).count() == 1


def test_incremental_and_streaming(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, I.upsert(old, new, "k").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    src, table, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    for batch in (old, new):
        batch.coalesce(1).write.mode("append").json(src)
        St.apply_to_table(spark.readStream.schema("k string, v int").json(src), table, "k", check).awaitTermination()
    assert sorted(map(tuple, St.latest(spark, table).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    folder = tmp_path / "src"
    folder.mkdir()
    (folder / "a.rb").write_text("class A\nend\n")
    q = St.new_versions(St.read_files(spark, str(folder))).writeStream.format("memory").queryName("versions").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("versions").select("content").first().content == "class A\nend\n"


def test_error_summary(spark):
    e = spark.createDataFrame([("critical", "io"), ("warning", "io"), ("warning", "parse")], "severity string, category string")
    got = {(r.severity, r.category): r.n for r in M.error_summary(e).collect()}
    assert got[None, None] == 3 and got["warning", None] == 2 and got[None, "io"] == 2
    assert tuple(M.severity_counts(e).first()) == (1, 0, 0, 0) and M.overall(spark.createDataFrame([(0.55,), (0.9,), (None,)], "score double")).first().level == "good"


def _inherits(r, own):
    """What each node has of its own and of all that it leads to, by brute force."""
    reach = {(n, n) for n in own} | {(a, b) for a, b in r}
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in r if b == c}
        if more == reach:
            return {(a, i, b) for a, b in reach for i in own.get(b, ())}
        reach = more


def test_items_are_inherited_along_trees_cycles_and_several_parents(spark):
    tree = [(f"N{i}", f"N{i // 2}") for i in range(1, 600)]
    for pairs in (tree, [("A", "B"), ("B", "C"), ("C", "B"), ("S", "S")], [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "A")]):
        nodes = sorted({x for p in pairs for x in p} | {"alone"})
        own = {n: {f"m{i % 7}", f"m{i % 3}"} for i, n in enumerate(nodes) if i % 4 != 1}
        want = _inherits(pairs, own)
        rows = spark.createDataFrame([(n, m) for n, ms in own.items() for m in sorted(ms)] * 2, "src string, dst string")
        got = sorted(tuple(r) for r in G.effective_mixins(edges(spark, *pairs, *pairs), rows).collect())
        assert got == sorted({(a, i) for a, i, _ in want})
        got = sorted(tuple(r) for r in Mg.availability(rows.toDF("owner", "name"), edges(spark, *pairs, *pairs)).collect())
        assert got == sorted((b, i, a) for a, i, b in want)


def test_unknown_owners_and_items_stay(spark):
    rows, none = spark.createDataFrame([("A", None), (None, "x"), (None, None)], "owner string, name string"), edges(spark, ("B", "A"), ("C", None), (None, "A"))
    assert {tuple(r) for r in Mg.availability(rows, none).collect()} == {("A", None, "A"), ("A", None, "B"), (None, "x", None), (None, None, None)}
    assert {tuple(r) for r in G.effective_mixins(none, rows.toDF("src", "dst")).collect()} == {("A", None), ("B", None)}


def test_what_is_inherited_is_not_shuffled(spark):
    for df in (G.effective_mixins(edges(spark, ("A", "B")), edges(spark, ("B", "M"))), Mg.availability(edges(spark, ("B", "m")).toDF("owner", "name"), edges(spark, ("A", "B")))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan[: plan.index("Generate")] and "Join" not in plan[: plan.index("Generate")]


def test_mixins_are_attached_by_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(Mg, "TASK_ROWS", 100)
    classes = spark.range(300).select(F.concat(F.lit("C"), "id").alias("name"), F.concat(F.lit("A::C"), "id").alias("fqname"))
    mixins = classes.select(F.col("name").alias("target"), F.lit("include").alias("type"), F.lit("Z::Log").alias("module")).unionByName(classes.select(F.col("fqname").alias("target"), F.lit("include").alias("type"), F.lit("B::Log").alias("module")))
    got = Mg.attach_mixins(classes, mixins)
    assert got.rdd.getNumPartitions() == 13 and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {(f"A::C{i}", "include", "B::Log") for i in range(300)} and got.count() == 300
