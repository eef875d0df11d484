"""Text templates compiled to Column expressions, with partials and a folder of the user's own.

{{name}} is a column, {{> name}} another template, {{#each name}} ... {{/each}} repeats for each
element of an array column, in which {{.}} is the element and {{.field}} a field of it. Null is empty.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULTS = {
    "method": "- `{{.}}`\n",
    "methods": "## Methods\n\n{{#each method_names}}{{> method}}{{/each}}",
    "class": "# {{fqname}}\n\n- Type: {{type}}\n- Superclass: {{superclass}}\n- File: {{file}}\n\n## Metrics\n\n- Methods: {{methods}}\n- Complexity: {{total_complexity}}\n- Lines: {{loc}}\n- Public: {{api_size}}\n\n{{> methods}}",
    "overview": "# Overview\n\n- Classes: {{classes}}\n- Modules: {{modules}}\n- Methods: {{methods}}\n- Dependencies: {{dependencies}}\n",
}
_MARK = re.compile(r"\{\{\s*(#each\s+\w+|/each|>\s*\w+|\.\w*|\w+)\s*\}\}")
_DEEPEST = 20


class Templates:
    """Templates by name: the defaults, and what is in files name.md of a folder, which win."""

    def __init__(self, folder: str | None = None):
        self.of = dict(DEFAULTS)
        for f in sorted(os.listdir(folder)) if folder else []:
            if f.endswith(".md"):
                with open(os.path.join(folder, f), encoding="utf-8") as file:
                    self.of[f[:-3]] = file.read()

    def text(self, name: str, depth: int = 0) -> str:
        """A template with its partials put in."""
        if name not in self.of:
            raise KeyError(f"no template: {name}")
        if depth > _DEEPEST:
            raise ValueError(f"template includes itself: {name}")
        return re.sub(r"\{\{\s*>\s*(\w+)\s*\}\}", lambda m: self.text(m[1], depth + 1), self.of[name])

    def render(self, name: str) -> Column:
        """The template over a table's columns."""
        return _compile(_MARK.split(self.text(name)), None)


def _shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _each(parts: list[str]):
    return lambda x: _compile(parts, x)


def _compile(parts: list[str], element: Column | None) -> Column:
    """`parts` alternate between text and marks."""
    out, i = [F.lit(parts[0])], 1
    while i < len(parts):
        mark = parts[i]
        if mark.startswith("#each"):
            depth, j = 1, i
            while depth:
                j += 2
                if j >= len(parts):
                    raise ValueError(f"{mark} is not closed")
                depth += parts[j].startswith("#each") - (parts[j] == "/each")
            inner = parts[i + 1 : j]
            array = F.coalesce(F.col(mark.split()[1]), F.array())
            out.append(F.array_join(F.transform(array, _each(inner)), ""))
            i = j
        elif mark == "/each":
            raise ValueError("/each without #each")
        elif mark.startswith("."):
            if element is None:
                raise ValueError(f"{mark} outside of #each")
            out.append(_shown(element if mark == "." else element[mark[1:]]))
        else:
            out.append(_shown(F.col(mark)))
        out.append(F.lit(parts[i + 1]))
        i += 2
    return F.concat(*out)
