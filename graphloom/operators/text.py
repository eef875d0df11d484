"""Redaction, cross links, chunks and Markdown, as string columns."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import names as N

MARK = "[REDACTED]"
_KEYS = "password|secret|api[_-]?key|token|private[_-]?key|access[_-]?key"
#: After the key a quote that ends it, as in JSON, and the sign; then a value in quotes, the rest of the line where they aren't closed, or a bare word.
_SEP = "([\"']?[ \\t]*[:=][ \\t]*)"
_VALUE = "(\"[^\"\\n]*\"|'[^'\\n]*'|[\"'][^\\n]*|[^\\s\"']+)"


def _keyed(keys: str) -> tuple[str, str]:
    return f"(?i)({keys}){_SEP}{_VALUE}", f"$1$2{MARK}"


#: (pattern, replacement with $1 for the key and its mark): all keys in one pattern, so that a text is gone through once for them.
LEVELS = {
    "minimal": [_keyed("password")],
    "standard": [_keyed(_KEYS)],
    "aggressive": [
        _keyed(f"{_KEYS}|email|username"),
        ("/home/[A-Za-z0-9_.-]+|/Users/[A-Za-z0-9_.-]+|C:\\\\+Users\\\\+[A-Za-z0-9_.-]+|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", MARK),
    ],
}


def redact(text: Column, level: str = "standard", custom: list[tuple[str, str]] | None = None, preserve_structure: bool = False) -> Column:
    """Secrets replaced by a mark, keys kept; null stays null. With preserve_structure the mark of a keyed value is in double quotes, so that JSON stays JSON."""
    for pattern, to in LEVELS[level] + (custom or []):
        text = F.regexp_replace(text, pattern, to.replace(f"$2{MARK}", f'$2"{MARK}"') if preserve_structure else to)
    return text


def secret_name(name: str) -> bool:
    """Whether a column or field of this name holds secrets as a whole."""
    return re.fullmatch(f"(?i).*({_KEYS}).*", name) is not None


def redact_nested(col: Column, kind, level: str = "standard") -> Column:
    """All strings in arrays, structs and map values of a column of Spark type `kind`."""
    name = kind.typeName()
    if name == "string":
        return redact(col, level)
    if name == "array":
        return F.transform(col, lambda x: redact_nested(x, kind.elementType, level))
    if name == "struct":
        return F.when(col.isNotNull(), F.struct(*[redact_field(col[f.name], f.name, f.dataType, level).alias(f.name) for f in kind.fields]))
    if name == "map":
        return F.transform_values(col, lambda k, v: redact_nested(v, kind.valueType, level))
    return col


def redact_field(col: Column, name: str, kind, level: str = "standard") -> Column:
    """A column or field: nothing but the mark if its name is that of a secret, else what redact_nested() makes of it."""
    if secret_name(name) and kind.typeName() == "string":
        return F.when(col.isNotNull(), F.lit(MARK))
    return redact_nested(col, kind, level)


def auto_link(content: Column, names: list[str]) -> Column:
    """Every mention of one of the names, longest first and whole words only, as a link to its chunk; what is a link already stays. The driver holds the list of names."""
    for n in sorted(names, key=lambda n: (-len(n), n)):
        link = f"[{n}](chunk_{hashlib.md5(n.encode()).hexdigest()[:8]}.md)"
        content = F.regexp_replace(content, f"(?<![A-Za-z0-9_:\\[]){re.escape(n)}(?![A-Za-z0-9_:\\]])", link.replace("\\", "\\\\").replace("$", "\\$"))
    return content


def link_section(names: Column) -> Column:
    """A Markdown list of links to chunks."""
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("- ["), n, F.lit("]("), N.chunk_id(n), F.lit(".md)"))), "\n")


def cross_links(chunks: DataFrame, symbols: DataFrame, pattern: str) -> DataFrame:
    """(symbol_id, content): the chunks that mention other symbols, with links to them put at the end."""
    m = chunks.select("symbol_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)))).alias("name"))
    m = m.join(symbols.select("name").distinct(), "name", "left_semi").where("name <> symbol_id").groupBy("symbol_id").agg(F.sort_array(F.collect_set("name")).alias("names"))
    j = chunks.join(m, "symbol_id", "left")
    return j.select("symbol_id", F.when(F.size("names") > 0, F.concat("content", F.lit("\n\n## See also\n"), link_section(F.col("names")))).otherwise(F.col("content")).alias("content"))


TARGET, MOST, SPLIT_OVER = 2000, 4000, 10


def class_content(methods: Column) -> Column:
    return F.concat(F.lit("# "), F.col("name"), F.lit("\n\nFile: "), F.coalesce("file", F.lit("unknown")), F.lit("\nSuperclass: "), F.coalesce("superclass", F.lit("none")), F.lit("\n\n## Methods\n"), F.array_join(F.transform(methods, lambda m: F.concat(F.lit("- "), m)), "\n"))


def class_chunks(classes: DataFrame) -> DataFrame:
    """(chunk_id, symbol_id, part, subtitle, content, tokens) of classes with method_names.

    A class of more than SPLIT_OVER methods or MOST tokens becomes an overview and the two halves
    of its methods; a second half without methods is left out.
    """
    ms = F.coalesce(F.col("method_names"), F.array().cast("array<string>"))
    c = classes.withColumn("__m", ms).withColumn("__c", class_content(F.col("__m"))).withColumn("__n", F.size("__m"))
    half = F.ceil(F.col("__n") / 2).cast("int")
    listed = lambda title, a: F.concat(F.lit("# "), F.col("name"), F.lit(f" ({title})\n"), F.array_join(F.transform(a, lambda m: F.concat(F.lit("- "), m)), "\n"))
    piece = lambda part, title, content: F.struct(F.lit(part).alias("part"), F.lit(title).alias("subtitle"), content.alias("content"))
    whole = F.array(piece(0, "whole", F.col("__c")))
    split = F.array(
        piece(0, "overview", class_content(F.array().cast("array<string>"))), piece(1, "core", listed("core", F.slice("__m", F.lit(1), half))),
        piece(2, "helper", listed("helper", F.slice("__m", half + 1, F.col("__n")))),
    )
    split = F.when(F.col("__n") > 1, split).otherwise(F.slice(split, 1, 2))
    long_ = (F.col("__n") > SPLIT_OVER) | (N.estimate_tokens("__c") > MOST)
    p = c.select("name", F.explode(F.when(long_, split).otherwise(whole)).alias("p"))
    return p.select(N.chunk_id(F.concat("name", F.lit("/"), F.col("p.part").cast("string"))).alias("chunk_id"), F.col("name").alias("symbol_id"), "p.part", "p.subtitle", "p.content", N.estimate_tokens("p.content").alias("tokens"))


def text_chunks(texts: DataFrame, tokens: int = TARGET) -> DataFrame:
    """(doc_id, part, content, tokens): whole texts in pieces of at most `tokens` estimated tokens; an empty text has one empty piece."""
    size = tokens * 4
    t = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    n = F.greatest(F.ceil(F.length("t") / size), F.lit(1)).cast("int")
    p = t.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    return p.select("doc_id", "part", F.substr("t", F.col("part") * size + 1, F.lit(size)).alias("content")).withColumn("tokens", N.estimate_tokens("content"))


def manifest(files: DataFrame) -> DataFrame:
    """One row for (path, content, tokens): files, bytes and tokens."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"), F.sum("tokens").cast("bigint").alias("tokens"))
