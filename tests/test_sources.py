from graphloom.functions.names import glob_regex
from graphloom.operators import frameworks as W
from graphloom.operators import metrics as M
from graphloom.sources import files, ruby

MODEL = '''require "json"
require_relative "./base"

# A shop's customer.
# @since 1.2
# @see Order
# @see Cart
class Shop::Customer < ApplicationRecord
  include Comparable
  LIMIT = 10 # at most
  @@seen = 0
  attr_accessor :name, :age
  has_many :orders, through: :carts
  belongs_to :shop
  validates :name, presence: true
  around_save :log
  default_scope -> { where(gone: false) }

  # Counts.
  # @param x [Integer] how many
  def run(x, y = 2, *rest, k:, z: 3, **opts, &blk)
    if x > 1 && y
      items.each do |i|
        i.go(1, :a, "end # if")
      end
    else
      warn("class X")
    end
    return 1 unless x
  end

  def self.make = new(1)

  private

  def hidden; end
  def late
    while true do
      break
    end
  end
  public :late
  alias_method :old, :run
end
'''
CONTROLLER = '''class CustomersController < ApplicationController
  before_action :authenticate
  def index
    @all = Customer.find(1)
  end
  def create; end
  def odd; end
end
'''


def rows_of(code):
    return ruby.extract("a.rb", code)


def test_model_file(spark):
    rows = ruby.extract_files(spark.createDataFrame([("m.rb", MODEL), ("c.rb", CONTROLLER), ("broken.rb", "class A\n  def x\n"), ("none.rb", None), ("empty.rb", "")], "path string, content string")).cache()
    c = {r.name: r for r in ruby.entities(rows, "class").collect()}
    assert c["Shop::Customer"].superclass == "ApplicationRecord" and c["Shop::Customer"].doc.startswith("A shop's customer.") and c["Shop::Customer"].line == 8
    assert '["Order","Cart"]' in str(c["Shop::Customer"].tags).replace(" ", "").replace("'", '"')
    m = {r.name: r for r in ruby.entities(rows, "method").where("path = 'm.rb'").collect()}
    assert {k: v.visibility for k, v in m.items()} == {"run": "public", "make": "public", "hidden": "private", "late": "public"}
    assert [(p.name, p.kind) for p in m["run"].parameters] == [("x", "req"), ("y", "opt"), ("rest", "rest"), ("k", "keyreq"), ("z", "key"), ("opts", "keyrest"), ("blk", "block")]
    assert m["run"].parameters[0].type_hint == "Integer" and m["make"].receiver_type == "class"
    assert (m["run"].body_lines, m["run"].branches, m["run"].conditionals, m["run"].loops) == (9, 4, 2, 1)
    assert [x.method for x in m["run"].calls][:2] == ["each", "go"] and m["run"].calls[0].has_block
    d = {r.name: r.external for r in ruby.entities(rows, "dependency").collect()}
    assert d == {"json": True, "./base": False}
    assert [r.value for r in ruby.entities(rows, "constant").collect()] == ["10"]
    assert {r.path for r in ruby.entities(rows, "error").collect()} == {"broken.rb", "none.rb"}
    assert {r.name for r in ruby.entities(rows, "attribute").collect()} == {"name", "age"} and ruby.entities(rows, "alias").first().original == "run"


def test_models_and_controllers(spark):
    rows = ruby.extract_files(spark.createDataFrame([("m.rb", MODEL), ("c.rb", CONTROLLER)], "path string, content string"))
    classes = ruby.entities(rows, "class").withColumnRenamed("name", "fqname")
    patterns = ruby.entities(rows, "pattern").withColumn("options", ruby.F.expr("to_json(arguments)"))
    got = W.model_info(patterns, classes).first()
    assert (got.associations, got.validations, got.callbacks, got.scopes, got.complexity) == (2, 1, 1, 1, 4 + 1 + 3 + 1 + 5 + 3 + 2) and got.issues == ["default_scope"]
    assert {(r.name, r.class_name) for r in W.associations(patterns).collect()} == {("orders", "Order"), ("shop", "Shop")}
    methods = M.with_complexity(ruby.entities(rows, "method"))
    c = W.controller_info(classes, methods, patterns).first()
    assert (c.actions, c.rest_actions, c.filters) == (3, 2, 1) and c.issues == ["no_strong_params", "not_restful"]
    assert {(r.action, r.verb, r.path) for r in W.action_routes(classes.where("path = 'c.rb'"), methods).collect()} == {("index", "GET", "/customers"), ("create", "POST", "/customers")}


def test_strings_comments_and_heredocs_hide_keywords():
    code = "class A\n  X = <<~TEXT\n    class B\n    end\n  TEXT\n=begin\nclass C\n=end\n  # class D\n  def a(b) # end\n    \"end\"\n  end\nend\n__END__\nclass E\n"
    assert [(r[1], r[2]) for r in rows_of(code)] == [("class", "A"), ("constant", "X"), ("method", "a")]


def test_scan_with_excludes_and_digests(spark, tmp_path):
    for p in ("a.rb", "lib/b.rb", "vendor/c.rb", "lib/d.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(f"# {p}")
    got = files.scan(spark, str(tmp_path), excludes=["**/vendor/**"]).collect()
    assert sorted(r.path.removeprefix(str(tmp_path)) for r in got) == ["/a.rb", "/lib/b.rb"] and all(len(r.digest) == 64 for r in got)
    import re

    assert [bool(re.match(glob_regex("**/vendor/*.rb"), p)) for p in ("x/vendor/a.rb", "vendor/a.rb", "x/vendor/y/a.rb")] == [True, True, False]


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("LEVEL", "aggressive")
    (tmp_path / "s.json").write_text('{"redaction": "${LEVEL}", "api": 7}')
    s = files.Settings.from_file(str(tmp_path / "s.json"))
    assert s.diff(files.Settings()) == {"redaction": ("aggressive", "standard"), "api": (7, 5)}
    for bad in ({"redaction": "none"}, {"api": -1}, {"nonsense": 1}):
        try:
            files.Settings().merge(**bad)
            raise AssertionError(bad)
        except ValueError:
            pass
    assert files.Settings.profile("ci").fail_fast and not files.Settings.profile("production").include_private


def test_adapt(spark):
    out = files.adapt(spark, {"classes": {"name": "A"}, "modules": None}, {"classes": "name string, file string", "modules": "name string"})
    assert [tuple(r) for r in out["classes"].collect()] == [("A", None)] and out["modules"].count() == 0


def test_singletons_one_line_bodies_and_parameters_over_lines():
    import json

    code = "class A; def x; foo(1) if y; end; end\nclass B\n  class << self\n    def make(a,\n             b = 2,\n             *rest)\n      run\n    end\n    private\n    def hid; end\n  end\n  def own; end\nend\n"
    got = [(r[1], r[2], r[4], json.loads(r[5])) for r in rows_of(code)]
    methods = {r[1]: (r[2], r[3]) for r in got if r[0] == "method"}
    assert not [r for r in got if r[0] == "error"] and [r[1] for r in got if r[0] == "class"] == ["A", "B"]
    assert methods["x"][1]["owner"] == "A" and methods["x"][1]["conditionals"] == 1 and [c["method"] for c in methods["x"][1]["calls"]] == ["foo"]
    assert methods["make"][1]["receiver_type"] == "class" and [p["kind"] for p in methods["make"][1]["parameters"]] == ["req", "opt", "rest"] and methods["make"][0] == 4
    assert (methods["hid"][1]["receiver_type"], methods["hid"][1]["visibility"]) == ("class", "private")
    assert (methods["own"][1]["receiver_type"], methods["own"][1]["visibility"], methods["own"][1]["owner"]) == ("instance", "public", "B")
