"""Deterministic outputs: JSON, YAML, DOT, Markdown and their manifest.

Lines are made by expressions; only writing to one file gathers them, and a folder is written in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.text import redact_field


def _quoted(c) -> Column:
    return F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_lines(inherits: DataFrame, depends: DataFrame) -> DataFrame:
    """One line for each edge: inheritance solid, dependencies dashed."""
    line = lambda e, style: e.select(F.concat(F.lit("  "), _quoted("src"), F.lit(" -> "), _quoted("dst"), F.lit(f" [{style}];")).alias("line"))
    return line(inherits, "color=blue, style=solid").unionByName(line(depends, "color=red, style=dashed"))


def dot(inherits: DataFrame, depends: DataFrame) -> DataFrame:
    """(n, line): a whole digraph in order, nodes from both graphs."""
    ends = inherits.select("src", "dst").unionByName(depends.select("src", "dst"))
    nodes = ends.select(F.explode(F.array("src", "dst")).alias("x")).distinct().select(F.concat(F.lit("  "), _quoted("x"), F.lit(";")).alias("line"))
    spark = inherits.sparkSession
    ends_of = spark.createDataFrame([(0, "digraph symbols {"), (3, "}")], "n int, line string")
    return ends_of.unionByName(nodes.withColumn("n", F.lit(1))).unionByName(dot_lines(inherits, depends).withColumn("n", F.lit(2))).orderBy("n", "line")


def json_lines(df: DataFrame, level: str | None = None) -> DataFrame:
    """(line): one JSON object for each row, keys in order, nulls kept, timestamps in UTC; redacted where a level is given."""
    cols = [F.col(f"`{c}`").alias(c) for c in sorted(df.columns)]
    line = F.to_json(F.struct(*cols), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"})
    return redacted(df, level).select(line.alias("line"))


def redacted(df: DataFrame, level: str | None) -> DataFrame:
    """`df` with all strings redacted, also nested ones and whole columns that are secrets by name, before anything is made of them."""
    return df if level is None else df.select(*[redact_field(F.col(f"`{f.name}`"), f.name, f.dataType, level).alias(f.name) for f in df.schema.fields])


def yaml_lines(df: DataFrame) -> DataFrame:
    """(line): each row as an item of a YAML list, strings double-quoted as JSON has them."""
    cols = sorted(df.columns)
    parts = [F.concat(F.lit(("- " if i == 0 else "  ") + c + ": "), F.regexp_replace(F.to_json(F.array(F.col(f"`{c}`"))), "^\\[|\\]$", "")) for i, c in enumerate(cols)]
    return df.select(F.concat_ws("\n", *parts).alias("line"))


def write_lines(lines: DataFrame, folder: str, order: list[str] | None = None) -> None:
    """A folder of text files whose concatenation is in the order given: ranges are sorted in parallel."""
    by = order or ["line"]
    lines.repartitionByRange(*by).sortWithinPartitions(*by).select("line").write.mode("overwrite").text(folder)


def write_chunks(chunks: DataFrame, folder: str) -> DataFrame:
    """Chunks as Parquet by symbol, and the manifest (path, bytes, sha256) of what was written, as a table beside it."""
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    m = chunks.select(F.concat("chunk_id", F.lit(".md")).alias("path"), F.octet_length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"), "tokens")
    m.write.mode("overwrite").json(f"{folder}/manifest")
    return m


def emit_all(tables: dict[str, DataFrame], formats: list[str], folder: str, level: str | None = None) -> list[tuple[str, str, str]]:
    """Writes each table in each format, redacted where a level is given; a failure is reported as (format, table, message) and the others go on."""
    makers = {"json": json_lines, "yaml": yaml_lines}
    failed = []
    for f in formats:
        if f not in [*makers, "parquet", "dot"]:
            raise ValueError(f"unknown format: {f}")
        for name, df in tables.items():
            df = redacted(df, level)
            try:
                if f == "parquet":
                    df.write.mode("overwrite").parquet(f"{folder}/{f}/{name}")
                elif f == "dot":
                    if {"src", "dst"} <= set(df.columns):
                        write_lines(dot(df, df.limit(0)), f"{folder}/{f}/{name}", ["n", "line"])
                else:
                    write_lines(makers[f](df), f"{folder}/{f}/{name}")
            except Exception as e:  # noqa: BLE001 - one format's failure must not stop the others
                failed.append((f, name, str(e)[:500]))
    return failed


def section(title: str, items: DataFrame, line: Column) -> DataFrame:
    """(title, part, line): a Markdown section with a list, in the order of part and line; a row for each item, so that a list of any length is spread."""
    listed = items.select(F.lit(title).alias("title"), F.lit(1).alias("part"), line.alias("line"))
    none = items.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(title).alias("title"), F.lit(1).alias("part"), F.lit("None.").alias("line"))
    head = items.sparkSession.createDataFrame([(title, 0, f"## {title}\n")], "title string, part int, line string")
    return head.unionByName(listed).unionByName(none)
