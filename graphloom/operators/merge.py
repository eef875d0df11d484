"""Validation, removal of duplicates and merging of symbols that several sources describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.operators.graph import inheriting

#: Rows of a task of a join or grouping that sorts texts.
TASK_ROWS = 2**17


def winners(df: DataFrame, key: list[str], source: str = "source") -> DataFrame:
    """One row for each key: that of the source with the highest precedence, of equals the one greatest by all its columns.

    A maximum of structs combines before the shuffle, so a key of any number of rows is no burden.
    """
    rest = [c for c in df.columns if c not in key]
    best = F.max(F.struct(N.precedence(source).alias("__p"), *[F.col(c) for c in rest])).alias("m")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"m.{c}").alias(c) for c in rest])


def provenance(df: DataFrame, key: list[str], source: str = "source", confidence: str = "confidence") -> DataFrame:
    """(key, sources, confidence): distinct sources in order, and the greatest confidence."""
    return df.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"), F.max(confidence).alias("confidence"))


def merged(df: DataFrame, key: list[str], source: str = "source", confidence: str = "confidence", visibility: str = "visibility") -> DataFrame:
    """provenance() and most_restrictive() in one pass."""
    both = df.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"), F.max(confidence).alias("confidence"), F.min(N.visibility_rank(visibility)).alias("__r"))
    return both.select(*key, "sources", "confidence", N.visibility_of_rank("__r").alias(visibility))


def most_restrictive(df: DataFrame, key: list[str], visibility: str = "visibility") -> DataFrame:
    return df.groupBy(*key).agg(N.visibility_of_rank(F.min(N.visibility_rank(visibility))).alias("visibility"))


def reliable_superclass(df: DataFrame, key: list[str], superclass: str = "superclass", source: str = "source") -> DataFrame:
    """The first superclass that isn't null, by precedence; among equals the least name."""
    known = F.when(F.col(superclass).isNotNull(), F.struct(-N.precedence(source), F.col(superclass).alias("s")))
    return df.groupBy(*key).agg(F.min(known)["s"].alias("superclass"))


def merge_mixins(df: DataFrame, key: list[str], mixins: str = "mixins") -> DataFrame:
    """(key, type, module): all mixins of a key's rows, each once."""
    return df.select(*key, F.explode(mixins).alias("m")).select(*key, F.col("m.type").alias("type"), F.col("m.module").alias("module")).distinct()


def class_error(name: Column) -> Column:
    return F.when(name.isNull(), "missing name").when(F.trim(name) == "", "empty name")


def method_error(name: Column, owner: Column) -> Column:
    return F.when(name.isNull(), "missing name").when(owner.isNull(), "missing owner")


def call_error(caller: Column, callee: Column, method: Column) -> Column:
    return F.when(method.isNull() & caller.isNull() & callee.isNull(), "empty call")


def split_valid(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and rejected rows with their error."""
    marked = df.withColumn("error", error)
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def children(df: DataFrame, node: str = "fqname") -> DataFrame:
    """(parent, children): names by the namespace they are in, in order."""
    kids = df.select(N.parent_namespace(F.col(node)).alias("parent"), F.col(node).alias("child")).where("parent is not null")
    return kids.groupBy("parent").agg(F.sort_array(F.collect_set("child")).alias("children"))


def attach_mixins(classes: DataFrame, mixins: DataFrame) -> DataFrame:
    """(target, type, module): mixins whose target is known by full or simple name, once for each type and last component of the module.

    Both sides are dealt to as many tasks as they have TASK_ROWS, since the least text is found by sorting all rows of a task.
    """
    known = classes.select(F.explode(F.array_distinct(F.array("fqname", "name"))).alias("target"), "fqname")
    n = 1 + (mixins.count() + 2 * classes.count()) // TASK_ROWS
    both = mixins.repartition(n, "target").join(known.repartition(n, "target").hint("merge"), "target")
    m = both.select("fqname", "type", "module", N.simple_name("module").alias("last")).repartition(n, "fqname").groupBy("fqname", "type", "last").agg(F.min("module").alias("module"))
    return m.select(F.col("fqname").alias("target"), "type", "module")


def owners(methods: DataFrame, symbols: DataFrame) -> DataFrame:
    """Methods with the full name of their owner, found by full name or else by simple name (least full name first)."""
    full = symbols.select(F.col("fqname").alias("__k"), F.col("fqname").alias("__f")).distinct()
    simple = symbols.groupBy(F.col("name").alias("__k2")).agg(F.min("fqname").alias("__s"))
    j = methods.join(full, F.col("owner") == F.col("__k"), "left").join(simple, F.col("owner") == F.col("__k2"), "left")
    return j.withColumn("owner_fqname", F.coalesce("__f", "__s")).where("owner_fqname is not null").drop("__k", "__f", "__k2", "__s")


def availability(methods: DataFrame, inheritance: DataFrame) -> DataFrame:
    """(owner, name, available_in): where a method can be called, by edges (src, dst) from classes to their parents; the owner included.

    No row is made twice, so none of the result is shuffled.
    """
    ways = F.flatten(F.transform("nodes", lambda n: F.transform(n["up"], lambda a: F.struct(a.alias("owner"), F.try_element_at("own", a).alias("names"), n["node"].alias("available_in")))))
    blocks = inheriting(inheritance, methods.select(F.col("owner").alias("node"), F.col("name").alias("item")))
    everywhere = blocks.select(F.explode(ways).alias("w")).select("w.owner", F.explode("w.names").alias("name"), "w.available_in")
    unowned = methods.where("owner is null").select("owner", "name").distinct()
    return everywhere.unionByName(unowned.withColumn("available_in", F.col("owner")))
