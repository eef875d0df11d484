"""Names, namespaces, identifiers and signatures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "::"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(c) -> Column:
    return F.when(F.trim(_c(c)) != "", F.trim(_c(c)))


def fqname(name, namespace=None) -> Column:
    """Namespace and name joined; a null or blank namespace leaves the name alone."""
    return _c(name) if namespace is None else F.concat_ws(SEP, blank_to_null(namespace), _c(name))


def build_fqname(*parts) -> Column:
    return F.concat_ws(SEP, *[blank_to_null(p) for p in parts])


def parts(name) -> Column:
    return F.split(_c(name), SEP)


def strip_leading(name) -> Column:
    """Without one leading separator."""
    return F.regexp_replace(_c(name), "^::", "")


def namespace_path(name) -> Column:
    """All but the last component. A lone separator and null have none; a leading separator gives an empty first part, which is dropped, and a trailing one is ignored."""
    kept = F.filter(parts(F.coalesce(_c(name), F.lit(""))), lambda p: p != "")
    return F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(F.array().cast("array<string>"))


def simple_name(name) -> Column:
    return F.element_at(parts(name), -1)


def parent_namespace(name) -> Column:
    p = namespace_path(name)
    return F.when(F.size(p) > 0, F.array_join(p, SEP))


def is_qualified(name) -> Column:
    return F.contains(_c(name), F.lit(SEP))


def nested_in(name, outer) -> Column:
    return F.startswith(_c(name), F.concat(_c(outer), F.lit(SEP)))


def namespace_level(name) -> Column:
    return F.size(namespace_path(name))


def resolve_in(name, namespace) -> Column:
    """A name as seen from a namespace: qualified ones are themselves."""
    return F.when(is_qualified(name), strip_leading(name)).otherwise(build_fqname(namespace, name))


def common_namespace(a, b) -> Column:
    """Longest common beginning of two namespace paths, joined."""
    x, y = namespace_path(a), namespace_path(b)
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    upto = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    return F.array_join(F.slice(x, F.lit(1), upto), SEP)


def snake_case(name) -> Column:
    once = F.regexp_replace(_c(name), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(once, "([a-z0-9])([A-Z])", "$1_$2"))


def table_name(fq) -> Column:
    return F.concat(snake_case(simple_name(fq)), F.lit("s"))


def resource_name(fq) -> Column:
    return snake_case(F.regexp_replace(simple_name(fq), "Controller$", ""))


def method_fqname(owner, name, scope) -> Column:
    return F.concat(F.coalesce(_c(owner), F.lit("")), F.when(_c(scope) == "class", ".").otherwise("#"), _c(name))


def scope_of(receiver) -> Column:
    return F.when(_c(receiver).isin("self", "singleton", "class"), "class").otherwise("instance")


def call_class(reference) -> Column:
    """The class part of a call's caller or callee; null where there is none."""
    return F.nullif(F.regexp_extract(_c(reference), "^([A-Z][A-Za-z0-9_:]*)[#.]", 1), F.lit(""))


def call_type(receiver, method) -> Column:
    return F.when(_c(method) == "super", "super").when(_c(receiver) == "self", "self").otherwise("method_call")


def symbol_id(*components) -> Column:
    """First 16 hex digits of the SHA-256 of the components joined by slashes; nulls are skipped."""
    return F.substring(F.sha2(F.concat_ws("/", *[_c(c) for c in components]), 256), 1, 16)


def class_id(fq, kind="class") -> Column:
    return F.concat(F.lit("c"), symbol_id(F.lit(kind), fq))


def module_id(fq) -> Column:
    return F.concat(F.lit("c"), symbol_id(F.lit("module"), fq))


def method_id(fq, receiver, arity) -> Column:
    return F.concat(F.lit("m"), symbol_id(fq, receiver, _c(arity).cast("string")))


def chunk_id(name) -> Column:
    return F.concat(F.lit("chunk_"), F.substring(F.md5(_c(name).cast("binary")), 1, 8))


def _kind(p: Column) -> Column:
    return F.coalesce(p["kind"], p["type"])


def arity(params) -> Column:
    """Required parameters; negative, less one, if others are optional or gathered; -1 for keywords alone. Reads kind, then type."""
    count = lambda *ks: F.coalesce(F.size(F.filter(_c(params), lambda p: _kind(p).isin(*ks))), F.lit(0))
    req = count("req", "required")
    return F.when(count("opt", "optional", "rest") > 0, -(req + 1)).when((req == 0) & (count("key", "keyreq", "keyrest") > 0), -1).otherwise(req)


def arity_simple(params) -> Column:
    count = lambda *ks: F.coalesce(F.size(F.filter(_c(params), lambda p: _kind(p).isin(*ks))), F.lit(0))
    req, opt = count("req", "required"), count("opt", "optional")
    return F.when(count("rest") > 0, -req - 1).otherwise(req + opt)


def normalize_params(params) -> Column:
    """Kinds in their short form; unknown ones stay."""
    short = {"required": "req", "optional": "opt", "keyword": "key", "keyword_required": "keyreq", "keyword_rest": "keyrest"}
    kinds = F.create_map(*[F.lit(x) for kv in short.items() for x in kv])
    return F.transform(_c(params), lambda p: F.struct(p["name"].alias("name"), F.coalesce(F.try_element_at(kinds, _kind(p)), _kind(p), F.lit("req")).alias("kind")))


def format_params(params) -> Column:
    """A signature's parameter list: x, x = d, *r, k:, **k, &b."""

    def one(p):
        k, n = p["kind"], p["name"]
        return (
            F.when(k.isin("opt", "optional"), F.concat(n, F.lit(" = "), F.coalesce(p["default"], F.lit("nil"))))
            .when(k == "rest", F.concat(F.lit("*"), n)).when(k.isin("key", "keyreq"), F.concat(n, F.lit(":")))
            .when(k == "keyrest", F.concat(F.lit("**"), n)).when(k == "block", F.concat(F.lit("&"), n)).otherwise(n)
        )

    return F.array_join(F.transform(_c(params), one), ", ")


VISIBILITIES = ("public", "protected", "private")


def visibility(v) -> Column:
    """Null, blank or unknown is public."""
    x = F.lower(F.trim(_c(v)))
    return F.when(x.isin(*VISIBILITIES), x).otherwise("public")


def visibility_error(v) -> Column:
    return F.when(_c(v).isNotNull() & ~F.lower(F.trim(_c(v))).isin(*VISIBILITIES), F.concat(F.lit("invalid visibility: "), _c(v)))


def inferred_visibility(name, explicit) -> Column:
    return F.coalesce(_c(explicit), F.when(F.startswith(_c(name), F.lit("_")), "private").otherwise("public"))


def visibility_rank(v) -> Column:
    """Smaller is more restrictive."""
    return F.when(_c(v) == "private", 0).when(_c(v) == "protected", 1).otherwise(2)


def visibility_of_rank(r) -> Column:
    return F.when(_c(r) == 0, "private").when(_c(r) == 1, "protected").otherwise("public")


PRECEDENCE = {"inferred": 1, "yard": 2, "sorbet": 3, "rbs": 4, "runtime": 5, "static": 6}
CONFIDENCE = {"rbs": 0.95, "sorbet": 0.90, "runtime": 0.85, "yard": 0.80, "static": 0.75}


def _pick(c: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def precedence(source) -> Column:
    return _pick(_c(source), PRECEDENCE, 0)


def confidence(source, has_location, name) -> Column:
    """By source, more with a location, less without a name; one at most."""
    base = _pick(_c(source), CONFIDENCE, 0.5)
    named = F.trim(F.coalesce(_c(name), F.lit(""))) != ""
    return F.round(F.least(F.lit(1.0), base + F.when(_c(has_location), 0.05).otherwise(0.0) - F.when(named, 0.0).otherwise(0.1)), 2)


def constant_kind(value) -> Column:
    """Kind of a constant from its literal's text."""
    v = F.trim(_c(value))
    rules = [
        ("nil", "^nil$"), ("boolean", "^(true|false)$"), ("float", "^-?[0-9][0-9_]*\\.[0-9]+$"), ("integer", "^-?[0-9][0-9_]*$"), ("string", "^[\"'].*[\"']$"),
        ("symbol", "^:.+"), ("array", "^\\[.*\\]$"), ("hash", "^\\{.*\\}$"), ("constant_ref", "^[A-Z][A-Za-z0-9_:]*$"),
    ]
    out = F.when(v.isNull() | (v == ""), "unknown")
    for kind, rx in rules:
        out = out.when(v.rlike(rx), kind)
    return out.otherwise("expression")


def is_external(kind, path) -> Column:
    """A plain require of a path that isn't relative."""
    return (_c(kind) == "require") & ~_c(path).rlike("^\\.\\.?/")


def truncate(text, n: int) -> Column:
    return F.when(F.length(_c(text)) > n, F.concat(F.substring(_c(text), 1, n - 3), F.lit("..."))).otherwise(_c(text))


def pluralize(count, word) -> Column:
    return F.concat(_c(count).cast("string"), F.lit(" "), _c(word), F.when(_c(count) == 1, "").otherwise("s"))


def to_sentence(items) -> Column:
    a, n = _c(items), F.size(_c(items))
    return F.when(n == 0, "").when(n == 1, F.get(a, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(a, F.lit(1), n - 1), ", "), F.lit(" and "), F.get(a, n - 1)))


def escape_markdown(text) -> Column:
    return F.regexp_replace(_c(text), "([\\\\`*_{}\\[\\]()#+!|-])", "\\\\$1")


def format_location(file, line) -> Column:
    return F.when(_c(line).isNull(), _c(file)).otherwise(F.concat(_c(file), F.lit(":"), _c(line).cast("string")))


def sanitize_path(path) -> Column:
    return F.regexp_replace(F.lower(_c(path)), "[^a-z0-9_.-]+", "_")


def estimate_tokens(text) -> Column:
    return F.ceil(F.length(_c(text)) / 4.0).cast("bigint")


def rails_type(superclass) -> Column:
    s = _c(superclass)
    return (
        F.when(s.rlike("ActiveRecord::Base|ApplicationRecord"), "model").when(s.rlike("ActionController::(Base|API)|ApplicationController"), "controller")
        .when(s.rlike("ActiveJob::Base|ApplicationJob"), "job").when(s.rlike("ActionMailer::Base|ApplicationMailer"), "mailer")
        .when(s.rlike("ActionCable::Channel|ApplicationCable::Channel"), "channel").when(s.rlike("ActionCable::Connection|ApplicationCable::Connection"), "connection")
    )


def glob_regex(pattern: str) -> str:
    """A file glob as a regular expression over whole paths: * and ? stay in a component, ** crosses them."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c) or ("\\" + c if c in ".^$+{}()|[]\\" else c)
        i += 1
    return f"^{out}$"


DEFAULT_EXCLUDES = [f"**/{d}/**" for d in ("node_modules", "vendor", "tmp", "log", ".git", "coverage", "spec", "test")]


def excluded(path, patterns=DEFAULT_EXCLUDES) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(_c(path).rlike(glob_regex(p)), F.lit(False))
    return out


def symbol_rows(tables: dict):
    """(id, kind, name, fqname, namespace, file): tables of symbols by kind in common columns; what a table lacks is null, a missing full name is the name and the other way round."""
    out = None
    for kind, df in tables.items():
        have = {c: F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("name", "fqname", "namespace", "file")}
        full = F.coalesce(have["fqname"], have["name"])
        rows = df.select(full.alias("id"), F.lit(kind).alias("kind"), F.coalesce(have["name"], have["fqname"]).alias("name"), full.alias("fqname"), have["namespace"].alias("namespace"), have["file"].alias("file"))
        out = rows if out is None else out.unionByName(rows)
    return out
