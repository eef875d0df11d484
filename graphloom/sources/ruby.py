"""Ruby source files to rows of symbols, by a line scanner: one pass over each file, files in parallel.

There is no parser here: the scanner follows the nesting of well-formed code by its keywords, after
strings, comments, heredocs and the text behind __END__ are blanked out. What it can't place becomes
an error row, never a guess. One file gives rows (kind, name, namespace, payload) with the payload
in JSON; `entities` turns a kind into a table.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, kind string, name string, namespace string, line int, payload string"
ITERATORS = set("each map collect select reject find detect reduce inject times upto downto step each_with_index each_with_object group_by partition sort_by flat_map".split())
ATTRIBUTES = {"attr_reader", "attr_writer", "attr_accessor"}
MIXINS = {"include", "extend", "prepend"}
VISIBILITIES = {"public", "private", "protected"}
DSL = set(
    "belongs_to has_one has_many has_and_belongs_to_many validates validate validates_presence_of validates_uniqueness_of scope default_scope before_action after_action around_action skip_before_action rescue_from "
    "before_save after_save around_save before_create after_create before_update after_update before_destroy after_destroy before_validation after_validation after_commit after_initialize enum delegate".split()
)
_NAME = r"[A-Z]\w*(?:::[A-Z]\w*)*"
_CLASS = re.compile(rf"^\s*class\s+(?P<name>{_NAME})(?:\s*<\s*(?P<sup>[^;#]+?))?\s*(?:;|$)")
_SINGLETON = re.compile(r"^\s*class\s*<<\s*\S+")
_MODULE = re.compile(rf"^\s*module\s+({_NAME})")
_DEF = re.compile(r"^\s*(?:(?P<vis>private|protected|public|private_class_method)\s+)?def\s+(?:(?P<recv>self|[A-Z]\w*)\.)?(?P<name>[A-Za-z_]\w*[?!=]?|\[\]=?|[-+!~]@?|[*/%<>^&|]|\*\*|<=>|===?|=~|<=|>=|<<|>>)(?P<rest>.*)$")
_CONST = re.compile(r"^\s*([A-Z]\w*)\s*=(?![=~>])\s*(.+)$")
_CVAR = re.compile(r"^\s*(@@\w+)\s*(?:\|\|)?=(?![=~])\s*(.+)$")
_ALIAS = re.compile(r"^\s*alias\s+:?(\S+)\s+:?(\S+)")
_CALL = re.compile(r"^\s*([a-z_]\w*[?!]?)\b\s*(?:\((.*)\)|(.*))$")
_TAG = re.compile(r"^@(\w+)\s+(.*)$")
_OPENERS = re.compile(r"^\s*(?:if|unless|while|until|for|case|begin)\b|=\s*(?:if|unless|case|begin|while)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*(?:;|$)")
_INVOKE = re.compile(r"((?:(?:@{0,2}[A-Za-z_]\w*|self)(?:\([^()]*\))?(?:\.|&\.|::))*)([a-z_]\w*[?!]?)(\s*\(|\s*\{|\s+do\b)?")
_WORDS = set("if unless while until for case when then else elsif end do begin rescue ensure return yield self nil true false and or not in next break redo retry super def class module alias undef defined? lambda proc puts".split())


def blank(source: str) -> tuple[list[str], dict[int, str]]:
    """Lines with the insides of strings, regular expressions and heredocs blanked, and comments (line: text) taken out."""
    out, comments, ends, block = [], {}, [], False
    for n, line in enumerate(source.split("\n"), 1):
        if line.startswith("__END__"):
            out += [""] * (source.count("\n") + 1 - len(out))
            break
        if block or line.startswith("=begin"):
            block = not line.startswith("=end")
            out.append("")
            continue
        if ends:
            if line.strip() == ends[0]:
                ends.pop(0)
            out.append("")
            continue
        text, i, quote, code = [], 0, "", ""
        while i < len(line):
            c = line[i]
            if quote:
                if c == "\\":
                    text.append("  ")
                    i += 2
                    continue
                text.append(c if c == quote else " ")
                quote = "" if c == quote else quote
            elif c in "\"'`" or (c == "/" and re.search(r"(?:^|[=(,~!&|]|\bif|\bunless|\bwhen|\breturn)\s*$", code)):
                quote = c
                text.append(c)
            elif c == "#":
                comments[n] = line[i:].rstrip()
                break
            else:
                text.append(c)
            code = "".join(text)
            i += 1
        line = "".join(text).rstrip()
        ends += [m for m in re.findall(r"<<[~-]?['\"]?([A-Z_][A-Z_0-9]*)['\"]?", line)]
        out.append(line)
    return out, comments


def split_args(text: str) -> list[str]:
    """At commas outside brackets and quotes."""
    out, depth, at, quote = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        if c == "," and not depth and not quote:
            out.append(at.strip())
            at = ""
        else:
            at += c
    return [*out, at.strip()] if at.strip() else out


def parameters(text: str, hints: dict[str, str]) -> list[dict]:
    found = []
    for p in split_args(text):
        for mark, kind in (("**", "keyrest"), ("*", "rest"), ("&", "block")):
            if p.startswith(mark):
                found.append({"name": p[len(mark) :], "kind": kind})
                break
        else:
            if m := re.match(r"^(\w+):(?!:)\s*(.*)$", p):
                found.append({"name": m[1], "kind": "key" if m[2] else "keyreq", **({"default": m[2]} if m[2] else {})})
            elif m := re.match(r"^(\w+)\s*=\s*(.+)$", p):
                found.append({"name": m[1], "kind": "opt", "default": m[2]})
            else:
                found.append({"name": p.strip("()"), "kind": "req"})
        if (hint := hints.get(found[-1]["name"])) is not None:
            found[-1]["type_hint"] = hint
    return found


def argument(text: str) -> dict:
    """A call's argument as a tagged value."""
    t = text.strip()
    if re.fullmatch(r"-?\d[\d_]*", t):
        return {"type": "integer", "value": int(t.replace("_", ""))}
    if re.fullmatch(r"-?\d[\d_]*\.\d+", t):
        return {"type": "float", "value": float(t.replace("_", ""))}
    if t in ("nil", "true", "false", "self"):
        return {"type": {"true": "boolean", "false": "boolean"}.get(t, t), "value": {"true": True, "false": False}.get(t)}
    if m := re.match(r"^(\w+[?!]?):\s+(.*)$", t) or re.match(r"^:(\w+)\s*=>\s*(.*)$", t):
        return {"type": "pair", "key": m[1], "value": argument(m[2])}
    if t.startswith(":"):
        return {"type": "symbol", "value": t[1:]}
    if t[:1] in "\"'" and t[:1]:
        return {"type": "string", "value": t[1:-1]}
    if t.startswith("["):
        return {"type": "array", "elements": [argument(x) for x in split_args(t[1:-1])]}
    if t.startswith("{"):
        return {"type": "hash", "pairs": [argument(x) for x in split_args(t[1:-1])]}
    if re.fullmatch(_NAME, t):
        return {"type": "constant", "value": t}
    if t.startswith("->") or t.startswith("lambda") or t.startswith("proc"):
        return {"type": "lambda"}
    return {"type": "expression", "value": t}


def documentation(comments: dict[int, str], lines: list[str], n: int) -> str:
    """Comment lines that end right above line n, without their marks; the first gap ends them."""
    found, at = [], n - 1
    while at in comments and not lines[at - 1].strip():
        found.append(re.sub(r"^#\s?", "", comments[at]))
        at -= 1
    return "\n".join(reversed(found))


def tags(doc: str) -> dict:
    """Tags of a documentation; one that is repeated has a list."""
    out: dict = {}
    for line in doc.split("\n"):
        if m := _TAG.match(line.strip()):
            out[m[1]] = m[2] if m[1] not in out else [*(out[m[1]] if isinstance(out[m[1]], list) else [out[m[1]]]), m[2]]
    return out


def body_metrics(lines: list[str]) -> dict:
    """Branches, conditionals, loops and calls of a method's body."""
    branches = conditionals = loops = 0
    calls = []
    for line in lines:
        for w in re.findall(r"(?<![.:\w@])(if|elsif|unless|while|until|for|case|when|else|and|or|rescue)\b(?!:)", line):
            if w == "rescue" and line.strip().startswith("rescue"):
                continue
            branches += 1
            conditionals += w in ("if", "elsif", "unless")
            loops += w in ("while", "until", "for")
        branches += len(re.findall(r"&&|\|\|(?!=)", line))
        for m in _INVOKE.finditer(line):
            receiver, name, after = m[1], m[2], (m[3] or "").strip()
            before = line[: m.start()]
            if name in _WORDS or (not receiver and not after and not re.match(r"\s+[\"':A-Z\[\d]", line[m.end() :])) or before.endswith((":", "@", "|", "def ")):
                continue
            block = after in ("{", "do") or bool(re.search(r"(\{|\bdo)\s*(\|[^|]*\|)?\s*$", line[m.end() :]))
            loops += block and name in ITERATORS
            inner = re.match(r"([^()]*)\)", line[m.end() :]) if after == "(" else None
            calls.append({"receiver": [r for r in re.split(r"&?\.|::", receiver) if r], "method": name, "arguments": [argument(a) for a in split_args(inner[1])] if inner else [], "has_block": block})
    return {"branches": branches, "conditionals": conditionals, "loops": loops, "calls": calls}


def statements(lines: list[str], raw: list[str]) -> list[tuple[int, str, str]]:
    """(line number, code, code with its strings): lines cut at semicolons, a method's parameters over several lines joined to its first."""
    out, i = [], 0
    while i < len(lines):
        n, line, whole = i + 1, lines[i], raw[i][: len(lines[i])]
        while re.match(r"^\s*(?:\w+\s+)?def\b", line) and line.count("(") > line.count(")") and i + 1 < len(lines):
            i += 1
            line, whole = f"{line} {lines[i].strip()}", f"{whole} {raw[i][: len(lines[i])].strip()}"
        at = 0
        same = len(whole) == len(line)
        for part in line.split(";"):
            if part.strip():
                out.append((n, part, whole[at : at + len(part)] if same else part))
            at += len(part) + 1
        i += 1
    return out


def extract(path: str, source: str) -> list[tuple]:
    """All rows of a file."""
    rows: list[tuple] = []
    lines, comments = blank(source)
    raw = source.split("\n")
    stack: list[dict] = []  # what is open: class, module, singleton, def, or another block

    def namespace() -> str:
        return "::".join(s["name"] for s in stack if s["kind"] in ("class", "module"))

    def add(kind: str, name: str | None, n: int, **payload) -> None:
        rows.append((path, kind, name, namespace(), n, json.dumps(payload, ensure_ascii=False, sort_keys=True)))

    def scope() -> dict | None:
        return next((s for s in reversed(stack) if s["kind"] in ("class", "module", "singleton")), None)

    every = statements(lines, raw)
    for k, (n, line, whole) in enumerate(every):
        code = line.strip()
        in_def = any(s["kind"] == "def" for s in stack)
        if _SINGLETON.match(line):
            stack.append({"kind": "singleton", "name": "", "line": n, "visibility": "public"})
        elif m := _CLASS.match(line):
            doc = documentation(comments, lines, n)
            sup = (m["sup"] or "").strip() or None
            sup = "Struct" if sup and sup.startswith("Struct.new") else sup
            add("class", m["name"], n, superclass=sup, doc=doc, tags=tags(doc), inline=comments.get(n))
            stack.append({"kind": "class", "name": m["name"], "line": n, "visibility": "public"})
        elif m := _MODULE.match(line):
            doc = documentation(comments, lines, n)
            add("module", m[1], n, doc=doc, tags=tags(doc))
            stack.append({"kind": "module", "name": m[1], "line": n, "visibility": "public"})
        elif m := _DEF.match(line):
            doc, s = documentation(comments, lines, n), scope()
            t = tags(doc)
            hints = {}
            for h in [t["param"]] if isinstance(t.get("param"), str) else t.get("param", []):
                if p := re.match(r"(\w+)\s+\[([^\]]+)\]", h):
                    hints[p[1]] = p[2]
            rest = m["rest"].strip()
            one_line = bool(re.search(r"(?:^|\))\s*=\s*\S", rest)) and not m["name"].endswith("=")
            inner = re.match(r"\(((?:[^()]|\([^()]*\))*)\)", rest)
            ps = inner[1] if inner else ("" if one_line else rest)
            visibility = m["vis"] if m["vis"] in VISIBILITIES else (s["visibility"] if s else "public")
            made = {"owner": namespace() or None, "receiver_type": "class" if m["recv"] or (s and s["kind"] == "singleton") else "instance", "visibility": visibility, "parameters": parameters(ps, hints), "doc": doc, "tags": t}
            if one_line:
                add("method", m["name"], n, **made, body_lines=0, **body_metrics([rest]))
            else:
                stack.append({"kind": "def", "name": m["name"], "line": n, "made": made, "from": k + 1})
        elif re.match(r"^end\b", code):
            if not stack:
                add("error", None, n, message="end without a beginning")
                continue
            top = stack.pop()
            if top["kind"] == "def":
                add("method", top["name"], top["line"], **top["made"], body_lines=n - top["line"], **body_metrics([t for _, t, _ in every[top["from"] : k]]))
        else:
            if not in_def:
                _statement(line, whole, n, stack, scope, add, comments)
            counted = re.sub(r"\bdo\s*$", "", line) if re.match(r"\s*(while|until|for)\b", line) else line
            opens = len(_OPENERS.findall(counted)) - len(re.findall(r"(?<=[\s;])end\b", line))
            for _ in range(max(0, opens)):
                stack.append({"kind": "block", "name": "", "line": n})
    for s in stack:
        add("error", s["name"] or None, s["line"], message=f"{s['kind']} is not closed")
    return rows


def _statement(line, whole, n, stack, scope, add, comments) -> None:
    """A line of a class body or of the top level."""
    s = scope()
    if m := _CONST.match(line):
        value = whole[m.start(2) :].strip()
        add("constant", m[1], n, value=value, inline=comments.get(n))
    elif m := _CVAR.match(line):
        add("class_variable", m[1], n, value=whole[m.start(2) :].strip())
    elif m := _ALIAS.match(line):
        add("alias", m[1], n, original=m[2])
    elif m := _CALL.match(line):
        name, at = m[1], m.start(2) if m[2] is not None else m.start(3)
        text = (whole[at : m.end(2)] if m[2] is not None else whole[at:]).strip()
        text = re.sub(r"\s+(do(\s*\|[^|]*\|)?|\{.*)$", "", text) if name not in ("scope",) else text
        args = split_args(text)
        plain = [a.strip(":'\"") for a in args if re.match(r"^[:'\"]", a)]
        if name in VISIBILITIES and s is not None:
            if not args:
                s["visibility"] = name
            else:
                for a in plain:
                    add("visibility", a, n, visibility=name)
        elif name in ATTRIBUTES:
            for a in plain:
                add("attribute", a, n, type=name.removeprefix("attr_"), visibility=s["visibility"] if s else "public")
        elif name in MIXINS:
            for a in args:
                if re.fullmatch(_NAME, a):
                    add("mixin", a, n, type=name)
        elif name in ("require", "require_relative", "load"):
            for a in plain:
                add("dependency", a, n, type=name, external=name == "require" and not re.match(r"\.\.?/", a))
        elif name == "autoload" and len(args) > 1:
            add("dependency", args[1].strip("'\""), n, type=name, constant=plain[0], external=False)
        elif name == "alias_method" and len(plain) > 1:
            add("alias", plain[0], n, original=plain[1])
        elif name in DSL and s is not None:
            add("pattern", name, n, target=plain[0] if plain else None, arguments=[argument(a) for a in args])


def extract_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Rows of all files of (path, content). A null content or a failure gives one error row; empty files give none."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    if content is None:
                        raise ValueError("no content")
                    if max_bytes is not None and len(content.encode()) > max_bytes:
                        raise ValueError("file is too large")
                    rows += extract(path, content)
                except Exception as e:  # noqa: BLE001 - an unreadable file is a row, not a failure of the job
                    rows.append((path, "error", None, "", 0, json.dumps({"message": str(e)})))
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "namespace", "line", "payload"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


PAYLOADS = {
    "class": "superclass string, doc string, inline string, tags variant",
    "module": "doc string, tags variant",
    "method": "owner string, receiver_type string, visibility string, doc string, body_lines int, branches int, conditionals int, loops int, parameters array<struct<name:string,kind:string,default:string,type_hint:string>>, calls array<struct<receiver:array<string>,method:string,has_block:boolean,arguments:variant>>",
    "constant": "value string, inline string", "class_variable": "value string", "alias": "original string", "attribute": "type string, visibility string", "mixin": "type string",
    "dependency": "type string, constant string, external boolean", "pattern": "target string, arguments variant", "visibility": "visibility string", "error": "message string",
}


def entities(rows: DataFrame, kind: str) -> DataFrame:
    """The table of one kind, with its payload's fields as columns; a method named in a later visibility call has that visibility."""
    p = rows.where(F.col("kind") == kind).withColumn("p", F.from_json("payload", PAYLOADS[kind]))
    out = p.select("path", "name", "namespace", "line", "p.*")
    if kind != "method":
        return out
    later = entities(rows, "visibility").groupBy("path", F.col("namespace").alias("owner"), "name").agg(F.max_by("visibility", "line").alias("__v"))
    return out.join(later, ["path", "owner", "name"], "left").withColumn("visibility", F.coalesce("__v", "visibility")).drop("__v")
