"""Documentation as tables of (path, content): an overview, an index of each namespace, and a page for each symbol; and their manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.sinks.templates import Templates


def symbol_pages(classes: DataFrame, templates: Templates | None = None) -> DataFrame:
    """(path, content) of each row, by the template "class": columns fqname, type, superclass, file, method_names and those of the rollup."""
    return classes.select(F.concat(F.lit("symbols/"), F.replace("fqname", F.lit("::"), F.lit("/")), F.lit(".md")).alias("path"), (templates or Templates()).render("class").alias("content"))


def overview_page(counts: DataFrame, templates: Templates | None = None) -> DataFrame:
    """(path, content) by the template "overview", of the one row of counts."""
    return counts.select(F.lit("index.md").alias("path"), (templates or Templates()).render("overview").alias("content"))


def index_lines(classes: DataFrame) -> DataFrame:
    """(path, line): a line with a link for each symbol, in files by namespace; no namespace is gathered in one row."""
    space = F.coalesce(N.parent_namespace(F.col("fqname")), F.lit("top"))
    path = F.concat(F.lit("index/"), F.replace(space, F.lit("::"), F.lit("/")), F.lit(".md"))
    return classes.select(path.alias("path"), F.concat(F.lit("- ["), "fqname", F.lit("](/symbols/"), F.replace("fqname", F.lit("::"), F.lit("/")), F.lit(".md)")).alias("line"))


def relationship_lines(edges: DataFrame) -> DataFrame:
    """(path, line): what each symbol depends on, in one file for each kind of edge."""
    return edges.select(F.concat(F.lit("relationships/"), "type", F.lit(".md")).alias("path"), F.concat(F.lit("- "), "src", F.lit(" -> "), "dst").alias("line"))


def manifest(pages: DataFrame) -> DataFrame:
    """(path, bytes, tokens, sha256) of pages."""
    return pages.select("path", F.octet_length("content").cast("bigint").alias("bytes"), N.estimate_tokens("content").alias("tokens"), F.sha2("content", 256).alias("sha256"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Pages and their manifest as tables; the manifest that was written."""
    pages.write.mode("overwrite").parquet(f"{folder}/pages")
    m = manifest(pages.sparkSession.read.parquet(f"{folder}/pages"))
    m.write.mode("overwrite").json(f"{folder}/manifest")
    return m
