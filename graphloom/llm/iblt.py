"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A document is the set of its paragraphs' digests. Each version is sketched on its own into cells of
(count, XOR of digests, XOR of check hashes). The difference of two sketches is the sketch of the
symmetric difference, from which peeling recovers the digests if the cells are enough; the pairs
for which they weren't are sketched again with four times the cells and other hash functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import settle, table, text_of
from graphloom.llm.words import mix

HASHES, FIRST_CELLS, GROWTH = 3, 12, 4
_PIECE = 1 << 20


def _places(d: np.ndarray, m: int) -> list[np.ndarray]:
    """A digest's cell in each of HASHES equal parts of m cells."""
    return [(mix(d + np.uint64(0x9E37 * (j + 1)) + (np.uint64(m) << np.uint64(20))) % np.uint64(m // HASHES)).astype(np.int64) + j * (m // HASHES) for j in range(HASHES)]


def _check(d: np.ndarray) -> np.ndarray:
    return mix(d ^ np.uint64(0xA5A5A5A5C3C3C3C3))


def sketch(digests: np.ndarray, own: np.ndarray, rows: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest XORs and check XORs (rows x m) of the digests of each row."""
    count, key, chk = np.zeros(rows * m, np.int64), np.zeros(rows * m, np.uint64), np.zeros(rows * m, np.uint64)
    c = _check(digests)
    for p in _places(digests, m):
        at = own * m + p
        count += np.bincount(at, minlength=rows * m)
        np.bitwise_xor.at(key, at, digests)
        np.bitwise_xor.at(chk, at, c)
    return count.reshape(rows, m), key.reshape(rows, m), chk.reshape(rows, m)


def peel(count: np.ndarray, key: np.ndarray, chk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, digest, sign, done): what a difference of sketches holds; done says for each row whether that is all. The arguments are used up."""
    m = key.shape[1]
    got = []
    live = np.flatnonzero((count != 0).any(1) | (key != 0).any(1))
    for _ in range(4 * m + 8):
        r, c = np.nonzero((np.abs(count[live]) == 1) & (_check(key[live]) == chk[live]))
        if not len(r):
            break
        r = live[r]
        found = np.unique(np.stack([r.astype(np.uint64), key[r, c], (count[r, c] > 0).astype(np.uint64)]), axis=1)
        r, d, s = found[0].astype(np.int64), found[1], found[2].astype(np.int64) * 2 - 1
        got.append((r, d, s))
        x = _check(d)
        for p in _places(d, m):
            np.subtract.at(count, (r, p), s)
            np.bitwise_xor.at(key, (r, p), d)
            np.bitwise_xor.at(chk, (r, p), x)
        live = np.unique(r)
    done = ~((count != 0).any(1) | (key != 0).any(1) | (chk != 0).any(1))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), done
    r, d, s = (np.concatenate(x) for x in zip(*got))
    return r, d, s, done


def _sketches(versions: DataFrame, m: int) -> DataFrame:
    """(vid, cells) for (vid, digests): 20 bytes a cell."""

    def run(batches):
        per = max(1, _PIECE // m)
        for b in batches:
            for a in range(0, b.num_rows, per):
                part = b.slice(a, per)
                lens = np.array(part.column(1).value_lengths(), np.int64)
                d = np.array(part.column(1).flatten(), np.int64).view(np.uint64)
                count, key, chk = sketch(d, np.repeat(np.arange(len(lens)), lens), len(lens), m)
                cells = [c.astype(np.int32).tobytes() + k.tobytes() + x.tobytes() for c, k, x in zip(count, key, chk)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cells, pa.binary())], names=["vid", "cells"])

    return versions.select("vid", "digests").mapInArrow(run, "vid bigint, cells binary")


def _subtract_and_peel(pairs: DataFrame, m: int) -> DataFrame:
    """(vid, base, done, added, removed) for (vid, base, cells, base_cells)."""

    def split(col):
        raw = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, 20 * m)
        return raw[:, : 4 * m].copy().view(np.int32).astype(np.int64), raw[:, 4 * m : 12 * m].copy().view(np.uint64), raw[:, 12 * m :].copy().view(np.uint64)

    def lists(r, d, rows):
        order = np.lexsort((d, r))
        at = np.searchsorted(r[order], np.arange(rows + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(d[order].view(np.int64)))

    def run(batches):
        per = max(1, _PIECE // m)
        for b in batches:
            for a in range(0, b.num_rows, per):
                part = b.slice(a, per)
                (c1, k1, x1), (c2, k2, x2) = split(part.column(2)), split(part.column(3))
                r, d, s, done = peel(c1 - c2, k1 ^ k2, x1 ^ x2)
                ok = done[r]
                r, d, s = r[ok], d[ok], s[ok]
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(done), lists(r[s > 0], d[s > 0], rows), lists(r[s < 0], d[s < 0], rows)], names=["vid", "base", "done", "added", "removed"])

    return pairs.select("vid", "base", "cells", "base_cells").mapInArrow(run, "vid bigint, base bigint, done boolean, added array<bigint>, removed array<bigint>")


def reconcile(versions: DataFrame, pairs: DataFrame, cells: int = FIRST_CELLS) -> DataFrame:
    """(vid, base, added, removed) for each pair of distinct versions (vid, base), by sketches of a size that is raised until all are peeled."""
    waiting, found, m = pairs, None, cells
    while True:
        sides = waiting.select("vid").union(waiting.select("base")).distinct()
        s = _sketches(versions.join(sides, "vid", "left_semi"), m)
        both = waiting.join(s, "vid").join(s.select(F.col("vid").alias("base"), F.col("cells").alias("base_cells")), "base")
        tried = settle(_subtract_and_peel(both, m))
        done = tried.where("done").select("vid", "base", "added", "removed")
        found = done if found is None else found.unionByName(done)
        waiting = tried.where("not done").select("vid", "base")
        if waiting.isEmpty():
            return found
        m *= GROWTH


def compare(docs: DataFrame, cells: int = FIRST_CELLS) -> DataFrame:
    """(doc_id, base_id, n_added, n_removed, added, removed): each document against the first version of its family.

    Paragraphs are the lines of a text without outer blanks; empty ones don't count, and one that
    is repeated counts once. A digest is the first 60 bits of the MD5. Documents with the same least
    digest are a family, and the one with the smallest doc_id its first version (nulls last, ties by
    the digests). added holds what the document has and the first version has not, removed the
    reverse, as ordered numbers joined by commas. A first version differs in nothing from itself.
    Null and empty texts have no family: base_id is null and nothing differs. Repeated rows each
    give a row; other columns are ignored; an empty table gives an empty table.
    """
    lines = F.filter(F.transform(F.split(text_of("text"), "\\n+"), lambda p: F.trim(p)), lambda p: p != "")
    digests = F.array_sort(F.array_distinct(F.transform(lines, lambda p: F.conv(F.substring(F.md5(p.cast("binary")), 1, 15), 16, 10).cast("bigint"))))
    d = docs.select("doc_id", digests.alias("digests"))
    d = settle(d.select("doc_id", F.when(F.size("digests") > 0, F.xxhash64("digests")).alias("vid"), F.get("digests", F.lit(0)).alias("family"), "digests"))
    some = d.where("vid is not null")
    versions = settle(some.groupBy("vid").agg(F.first("digests").alias("digests")))
    head = some.groupBy("family").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "digests", "vid")).alias("h"))
    member = settle(some.drop("digests").join(head.select("family", F.col("h.doc_id").alias("base_id"), F.col("h.vid").alias("base")), "family").select("doc_id", "vid", "base_id", "base"))
    diff = reconcile(versions, member.where("vid <> base").select("vid", "base").distinct(), cells)
    out = member.join(diff, ["vid", "base"], "left").select("doc_id", "base_id", "added", "removed")
    none = d.where("vid is null").select("doc_id", F.lit(None).cast(d.schema["doc_id"].dataType).alias("base_id"), *[F.lit(None).cast("array<bigint>").alias(c) for c in ("added", "removed")])
    out = out.unionByName(none)
    joined = {c: F.coalesce(F.array_join(F.array_sort(c).cast("array<string>"), ","), F.lit("")) for c in ("added", "removed")}
    n = {c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)) for c in ("added", "removed")}
    return out.select("doc_id", "base_id", n["added"].alias("n_added"), n["removed"].alias("n_removed"), joined["added"].alias("added"), joined["removed"].alias("removed"))


def query(spark, sf_dir):
    return compare(table(spark, sf_dir, "documents"))


SQL = """
WITH p AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\n+'), lambda x: trim(x)), lambda x: x <> ''),
    lambda x: ('0x' || substr(md5(x), 1, 15))::BIGINT))) AS ds FROM documents),
b AS (SELECT ds[1] AS family, doc_id AS base_id, ds AS base FROM p WHERE len(ds) > 0
  QUALIFY row_number() OVER (PARTITION BY ds[1] ORDER BY doc_id NULLS LAST, ds) = 1),
j AS (
  SELECT p.doc_id, b.base_id, list_sort(list_filter(ds, lambda x: NOT list_contains(base, x))) AS a, list_sort(list_filter(base, lambda x: NOT list_contains(ds, x))) AS r
  FROM p LEFT JOIN b ON p.ds[1] = b.family)
SELECT doc_id, base_id, coalesce(len(a), 0)::INT AS n_added, coalesce(len(r), 0)::INT AS n_removed,
  coalesce(array_to_string(a, ','), '') AS added, coalesce(array_to_string(r, ','), '') AS removed FROM j
"""
