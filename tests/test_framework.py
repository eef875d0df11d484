"""Errors, stages, templates, redaction of nested data, and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.__main__ import main
from graphloom.operators import text as T
from graphloom.operators.errors import Collector, CriticalError, report, with_retry
from graphloom.sinks.documents import json_lines
from graphloom.sinks.templates import Templates
from graphloom.sources.files import Settings, plain_yaml
from graphloom.stages import Stages
from graphloom.storage import shared_dir


def test_collector(spark):
    c = Collector(max_errors=12)
    assert all(c.add("parse", f"m{i}", "error", "a.rb", i) for i in range(12)) and not c.add("parse", "late") and c.full()
    lines = [r.line for r in report(c.table(spark)).orderBy("part", "n").collect()]
    assert lines[0] == "Errors: 12" and lines[1:4] == ["error: 12", "parse: 12", "[parse] m0 (a.rb:0)"] and lines[-1] == "... and 2 more" and len(lines) == 14
    assert [r.line for r in report(Collector().table(spark)).collect()] == ["No errors."]
    with pytest.raises(CriticalError):
        Collector(fail_fast=True).add("output", "x", "critical")
    with pytest.raises(ValueError):
        c.add("nonsense", "x")


def test_retry():
    calls, pauses, c = [], [], Collector()

    def f():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "done"

    assert with_retry(f, collector=c, sleep=pauses.append) == "done" and pauses == [0.1, 0.2] and [r[1] for r in c.rows] == ["warning"] * 2
    with pytest.raises(OSError):
        with_retry(lambda: (_ for _ in ()).throw(OSError("no")), tries=4, delay=2, sleep=pauses.append)
    assert pauses[2:] == [2, 4, 5, 5]


def test_stages(spark):
    seen = []
    s = Stages(Settings().merge(max_errors=5)).register("double", lambda t: {"x": t["x"].withColumn("y", F.col("id") * 2)}).register("bad", lambda t: {"x": t["x"].select("missing")}).register("more", lambda t: {"z": t["x"].where("y > 2")})
    out = s.on_step(seen.append).on_progress(lambda k, n, name: seen.append((k, n))).run({"x": spark.range(4)})
    assert out["z"].count() == 2 and [r[2] for r in s.errors.rows] == ["runtime"] and s.errors.rows[0][3].startswith("bad:")
    assert seen == ["double", (1, 3), "bad", (2, 3), "more", (3, 3)]
    assert "z" not in s.with_steps(["double"]).run({"x": spark.range(1)})
    with pytest.raises(CriticalError):
        Stages(Settings.profile("ci")).register("bad", lambda t: {"x": t["x"].select("missing")}).run({"x": spark.range(1)})


def test_templates(spark, tmp_path):
    (tmp_path / "class.md").write_text("{{name}}: {{#each parts}}{{> part}}{{/each}}!")
    (tmp_path / "part.md").write_text("<{{.k}}|{{ name }}>")
    df = spark.createDataFrame([("A", [("x", 1), (None, 2)]), (None, None)], "name string, parts array<struct<k:string,v:int>>")
    t = Templates(str(tmp_path))
    assert [r.s for r in df.select(t.render("class").alias("s")).collect()] == ["A: <x|A><|A>!", ": !"]
    assert "overview" in t.of
    (tmp_path / "part.md").write_text("{{> part}}")
    for bad in (lambda: Templates(str(tmp_path)).render("class"), lambda: t.render("nothing")):
        with pytest.raises((ValueError, KeyError)):
            bad()


def test_redaction_leaks_nothing(spark):
    cases = ['{"password":"abc"}', 'password: "open to the end', "api-key = 'x y'", '"private_key" : "k"', "token=raw rest", 'C:\\Users\\joe\\a', '{\\"x\\": \\"C:\\\\Users\\\\joe\\"}', "/home/joe/x", "mail joe@example.com"]
    got = [r.s for r in spark.createDataFrame([(c,) for c in cases], "c string").select(T.redact(F.col("c"), "aggressive").alias("s")).collect()]
    for secret in ("abc", "open", "x y", '"k"', "raw", "joe"):
        assert not any(secret in g for g in got), (secret, got)
    assert got[4].endswith(" rest") and got[0].startswith('{"password":')
    kept = spark.createDataFrame([('{"token": "t", "a": 1}',)], "c string").select(T.redact(F.col("c"), preserve_structure=True).alias("s")).first().s
    assert json.loads(kept) == {"token": T.MARK, "a": 1}
    df = spark.createDataFrame([("u", "p", ("t", ["password=1"]), {"k": "secret: 2"})], "name string, db_password string, deep struct<token:string,notes:array<string>>, map map<string,string>")
    line = json.loads(json_lines(df, "standard").first().line)
    assert line == {"name": "u", "db_password": T.MARK, "deep": {"token": T.MARK, "notes": [f"password={T.MARK}"]}, "map": {"k": f"secret: {T.MARK}"}}
    assert json.loads(json_lines(df).first().line)["db_password"] == "p"


def test_auto_link(spark):
    got = spark.sql("select 'User and Admin::User, not Users; [User](x)' as c").select(T.auto_link(F.col("c"), ["User", "Admin::User"]).alias("s")).first().s
    assert got.count("](chunk_") == 2 and "[Admin::User](chunk_" in got and "not Users; [User](x)" in got and got.startswith("[User](chunk_")


def test_yaml_settings(tmp_path):
    (tmp_path / "s.yml").write_text("---\napi: 7 # seven\nredaction: \"minimal\"\nexcludes:\n  - a/**\n  - 'b c'\nfail_fast: yes\n")
    s = Settings.from_file(str(tmp_path / "s.yml"))
    assert (s.api, s.redaction, s.excludes, s.fail_fast) == (7, "minimal", ["a/**", "b c"], True)
    with pytest.raises(ValueError):
        plain_yaml("a:\n  b: 1\n")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.rb").write_text("class A\n  def b\n  end\nend\n")
    out = str(tmp_path / "out")
    assert main(["status", "--out", out]) == 0 and main(["init", "--out", out]) == 0 and main(["init", "--out", out]) == 1
    kept = json.loads((tmp_path / "out/settings.json").read_text())
    (tmp_path / "out/settings.json").write_text(json.dumps(kept | {"excludes": []}))
    assert main(["map", str(tmp_path / "src"), "--out", out, "--format", "json"]) == 0
    assert main(["update", str(tmp_path / "src"), "--out", f"{out}2", "--since", "4000000000"]) == 0
    assert main(["status", "--out", out]) == 0 and main(["version"]) == 0 and main(["formats"]) == 0
    said = capsys.readouterr().out
    assert "nothing was mapped yet" in said and "/json/" in said and "parquet" in said
    assert spark.read.text(f"{out}/json/entities").count() == 2 and spark.read.parquet(f"{out}2/parquet/entities").count() == 0
    assert main(["clean", "--out", out]) == 0 and not (tmp_path / "out/json").exists()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        applicationId, master = "x", "spark://host:7077"
        getConf = lambda self: Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
