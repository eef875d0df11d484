"""Each document against its nearest earlier version, whichever paragraphs an edit touches.

Pairs of versions are the exact ones of `setjoin`, over sets of paragraphs in place of n-grams: rare
paragraphs come first in its prefixes, so that those which many documents share are looked up only
where a set has few others. Differences are reconciled by the sketches of `iblt`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import settle, table, text_of
from graphloom.llm.iblt import FIRST_CELLS, reconcile
from graphloom.llm.setjoin import set_pairs

#: Jaccard similarity of the paragraphs from which a document is a version of another.
VERSION = 0.5


def _paragraph_sets(versions: DataFrame, t: float) -> DataFrame:
    """(sid, n, single, pre, docs, grams), as set_pairs wants them, for (vid, digests)."""
    each = versions.select("vid", F.explode("digests").alias("p"))
    shared = each.groupBy("p").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    grams = each.join(shared, "p").groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("c", "p"))).alias("s"))
    s = versions.select("vid", F.size("digests").cast("bigint").alias("n")).join(grams, "vid").withColumn("single", F.col("n") - F.size("s"))
    pre = F.least(F.greatest(F.col("n") - F.ceil(F.lit(t) * F.col("n") - F.lit(1e-9)) + 1 - F.col("single"), F.lit(0)), F.size("s")).cast("bigint")
    return settle(s.select(F.col("vid").alias("sid"), "n", "single", pre.alias("pre"), F.array("vid").alias("docs"), F.col("s.p").alias("grams")).where("pre > 0"))


def compare_nearest(docs: DataFrame, t: float = VERSION, cells: int = FIRST_CELLS) -> DataFrame:
    """(doc_id, base_id, n_added, n_removed, added, removed): each document against its nearest earlier version.

    Paragraphs and their digests are those of iblt.compare. Of the documents with a smaller doc_id
    (nulls come last) whose paragraphs have a Jaccard similarity of at least t, the base is the
    nearest, of equally near ones that with the smallest doc_id. A document without any is its own
    base and differs in nothing. added holds what the document has and its base has not, removed the
    reverse, as ordered numbers joined by commas. Null and empty texts have a null base_id.
    Repeated rows each give a row; other columns are ignored; an empty table gives an empty table.
    """
    lines = F.filter(F.transform(F.split(text_of("text"), "\\n+"), lambda p: F.trim(p)), lambda p: p != "")
    digests = F.array_sort(F.array_distinct(F.transform(lines, lambda p: F.conv(F.substring(F.md5(p.cast("binary")), 1, 15), 16, 10).cast("bigint"))))
    d = docs.select("doc_id", digests.alias("digests"))
    d = settle(d.select("doc_id", F.when(F.size("digests") > 0, F.xxhash64("digests")).alias("vid"), "digests"))
    some = d.where("vid is not null")
    versions = settle(some.groupBy("vid").agg(F.first("digests").alias("digests"), F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id")).alias("h")))
    p = set_pairs(_paragraph_sets(versions, t), t)
    j = (-F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("far")
    both = p.select(F.col("a").alias("vid"), F.col("b").alias("base"), j).unionByName(p.select(F.col("b").alias("vid"), F.col("a").alias("base"), j))
    head = versions.select("vid", "h")
    both = both.join(head, "vid").join(head.select(F.col("vid").alias("base"), F.col("h").alias("bh")), "base").where("bh < h")
    near = settle(both.groupBy("vid").agg(F.min(F.struct("far", "bh", "base")).alias("m")).select("vid", "m.base", "m.bh"))
    # Rows after the first of a version have that one as base, and it has the nearest.
    member = some.select("doc_id", "vid").join(head, "vid").join(near, "vid", "left")
    first = F.col("doc_id").eqNullSafe(F.col("h.doc_id")) & F.col("base").isNotNull()
    member = settle(member.select("doc_id", "vid", F.when(first, F.col("bh.doc_id")).otherwise(F.col("h.doc_id")).alias("base_id"), F.when(first, F.col("base")).otherwise(F.col("vid")).alias("base")))
    diff = reconcile(versions, member.where("vid <> base").select("vid", "base").distinct(), cells)
    out = member.join(diff, ["vid", "base"], "left").select("doc_id", "base_id", "added", "removed")
    none = d.where("vid is null").select("doc_id", F.lit(None).cast(d.schema["doc_id"].dataType).alias("base_id"), *[F.lit(None).cast("array<bigint>").alias(c) for c in ("added", "removed")])
    out = out.unionByName(none)
    n = {c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)) for c in ("added", "removed")}
    joined = {c: F.coalesce(F.array_join(F.array_sort(c).cast("array<string>"), ","), F.lit("")) for c in n}
    return out.select("doc_id", "base_id", n["added"].alias("n_added"), n["removed"].alias("n_removed"), joined["added"].alias("added"), joined["removed"].alias("removed"))


def query(spark, sf_dir):
    return compare_nearest(table(spark, sf_dir, "documents"))


SQL = f"""
WITH p AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\n+'), lambda x: trim(x)), lambda x: x <> ''),
    lambda x: ('0x' || substr(md5(x), 1, 15))::BIGINT))) AS ds FROM documents),
e AS (SELECT doc_id, len(ds) AS n, unnest(ds) AS x FROM p),
o AS (SELECT a.doc_id, b.doc_id AS base_id, count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM e a JOIN e b ON a.x = b.x AND b.doc_id < a.doc_id GROUP BY 1, 2),
b AS (SELECT doc_id, base_id FROM o WHERE j >= {VERSION} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY j DESC, base_id) = 1),
w AS (SELECT p.doc_id, p.ds, CASE WHEN len(p.ds) > 0 THEN coalesce(b.base_id, p.doc_id) END AS base_id FROM p LEFT JOIN b ON p.doc_id = b.doc_id),
d AS (
  SELECT w.doc_id, w.base_id, list_sort(list_filter(w.ds, lambda x: NOT list_contains(q.ds, x))) AS a, list_sort(list_filter(q.ds, lambda x: NOT list_contains(w.ds, x))) AS r
  FROM w LEFT JOIN p q ON w.base_id = q.doc_id)
SELECT doc_id, base_id, coalesce(len(a), 0)::INT AS n_added, coalesce(len(r), 0)::INT AS n_removed,
  coalesce(array_to_string(a, ','), '') AS added, coalesce(array_to_string(r, ','), '') AS removed FROM d
"""
