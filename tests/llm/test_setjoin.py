import itertools
import re
from collections import defaultdict

import numpy as np
import pytest

from graphloom.llm import setjoin
from graphloom.llm.setjoin import classes, keep_documents, pack, similar, unpack


def grams(text, n):
    w = re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute(rows, n, t):
    """Linked pairs of rows by their numbers, with similarity."""
    sets = [(i, grams(r[1], n)) for i, r in enumerate(rows) if grams(r[1], n)]
    return {(a, b): j for (a, x), (b, y) in itertools.combinations(sets, 2) if (j := len(x & y) / len(x | y)) >= t}


def brute_classes(rows, n, t):
    """(doc_id, class_id, links) of each row, in order; and the rows of each class by its first row's number."""
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows, n, t):
        links[a] += 1
        links[b] += 1
        parent[max(find(a), find(b))] = min(find(a), find(b))
    of = defaultdict(list)
    for i in range(len(rows)):
        of[find(i)].append(i)
    least = {c: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for c, m in of.items()}
    return [(r[0], least[find(i)], links[i]) for i, r in enumerate(rows)], of


def near(words, seed):
    """Families of copies with edits of all sizes, some sharing passages with other families."""
    r = np.random.default_rng(seed)
    rows, i = [], 0
    shared = words(60, 999)
    for f in range(12):
        base = words(int(r.integers(3, 160)), 100 + f).split()
        for _ in range(int(r.integers(1, 14))):
            w = base.copy()
            for _ in range(int(r.integers(0, 1 + len(w) // 6))):
                k = int(r.integers(0, 3))
                at = int(r.integers(0, len(w)))
                if k == 0:
                    w[at] = "changed%d" % r.integers(0, 50)
                elif k == 1 and len(w) > 2:
                    del w[at]
                else:
                    w.insert(at, "new%d" % r.integers(0, 50))
            text = " ".join(w) + (" " + shared if f % 4 == 0 else "")
            rows.append((i, text, "en", "s", len(text)))
            i += 1
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("n,t,part,block", [(3, 0.5, 4096, 1_000_000), (1, 0.8, 5, 300), (2, 0.3, 7, 2000)])
def test_all_links(spark, words, odd_rows, monkeypatch, n, t, part, block):
    monkeypatch.setattr(setjoin, "PART", part)
    monkeypatch.setattr(setjoin, "BLOCK_TOKENS", block)
    monkeypatch.setattr(setjoin, "RANGE_BYTES", 50_000)
    rows = odd_rows + [(1000 + r[0], *r[1:]) for r in near(words, n)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in classes(docs, n, t).collect()]
    want, _ = brute_classes(rows, n, t)
    assert sorted(got, key=str) == sorted(want, key=str)
    # Pairs of different sets, each as its first document.
    first = {}
    for r in rows:
        if g := grams(r[1], n):
            first[g] = min(first.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    pairs = {tuple(sorted((x[1], y[1]))): round(len(g & h) / len(g | h), 9) for (g, x), (h, y) in itertools.combinations(first.items(), 2) if not x[0] and not y[0] and len(g & h) / len(g | h) >= t}
    assert {(r.doc_a, r.doc_b): round(r.jaccard, 9) for r in similar(docs, n, t).where("doc_a is not null and doc_b is not null").collect()} == pairs


def test_one_of_each_class_stays(spark, words, clashing, odd_rows):
    rows = near(words, 5) + odd_rows
    docs = spark.createDataFrame(rows, SCHEMA)
    _, of = brute_classes(rows, 3, 0.5)
    want = [min((rows[i][:2] for i in m), key=lambda r: (r[0] is None, r[0])) for m in of.values()]
    got = [(r.doc_id, r.text) for r in keep_documents(docs).collect()]
    assert sorted(g[0] for g in got if g[0] is not None) == sorted(w[0] for w in want if w[0] is not None) and len(got) == len(want)
    assert keep_documents(clashing).dtypes == clashing.dtypes


def test_repeated_ids_null_ids_and_ids_that_are_texts(spark, words, empty):
    a, b = words(50, 1), words(50, 2)
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (0, a + " more", "en", "s", 1), (None, b, "en", "s", 1), (None, b, "en", "s", 1), (7, None, "en", "s", 1), (7, None, "en", "s", 1)]
    kept = [(r.doc_id, r.text) for r in keep_documents(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(kept, key=str) == sorted([(0, a + " more"), (1, b), (7, None), (7, None)], key=str)
    named = spark.createDataFrame([(f"doc-{r[0]}", *r[1:]) for r in rows], SCHEMA.replace("doc_id bigint", "doc_id string"))
    assert {tuple(r) for r in classes(named).collect()} == {("doc-1", "doc-0", 1), ("doc-0", "doc-0", 1), ("doc-1", "doc-1", 2), ("doc-None", "doc-1", 2), ("doc-7", "doc-7", 0)}
    assert classes(empty).count() == 0 and keep_documents(empty).count() == 0 and similar(empty).count() == 0


def test_blocks_of_any_size_lose_nothing(spark):
    """More short texts in an Arrow batch than a block's numbers have room for."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        docs = spark.range(80_000, numPartitions=1).selectExpr("id as doc_id", "concat('w', id div 2) as text")
        rows = classes(docs)
        assert rows.where("links = 1 and class_id = doc_id - doc_id % 2").count() == 80_000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_equal_rows(spark, words):
    text = words(40, 3)
    docs = spark.range(3000, numPartitions=3).selectExpr("id % 1000 as doc_id", f"'{text}' as text")
    assert [tuple(r) for r in classes(docs).distinct().orderBy("doc_id").limit(2).collect()] == [(0, 0, 2999), (1, 0, 2999)]
    assert [r.doc_id for r in keep_documents(docs).collect()] == [0]


def test_packing_of_numbers():
    r = np.random.default_rng(0)
    for v in (np.array([5], np.uint64), np.sort(r.integers(0, 2**64, 1000, dtype=np.uint64)), np.array([7, 7, 7], np.uint64)):
        assert (unpack(pack(v), len(v)) == v).all()
