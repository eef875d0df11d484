import hashlib

import numpy as np

from graphloom.llm.iblt import compare
from graphloom.llm.versions import VERSION, compare_nearest
from test_iblt import digests


def brute(rows):
    ds = [(r[0], digests(r[1])) for r in rows]
    out = []
    for i, d in ds:
        base_id, base = (i, d) if d else (None, [])
        best = None
        for k, x in ds:
            if d and x and k is not None and (i is None or k < i):
                j = len({*d} & {*x}) / len({*d} | {*x})
                if j >= VERSION and (best is None or (-j, k) < best):
                    best, base_id, base = (-j, k), k, x
        out.append((i, base_id, ",".join(str(x) for x in d if x not in base), ",".join(str(x) for x in base if x not in d)))
    return sorted(out, key=str)


def test_nearest_versions_match_brute_force(spark, odd_rows, words, clashing, empty):
    r = np.random.default_rng(11)
    rows = list(odd_rows)
    hot = "a line of a license that all share"
    for v in range(120):  # four versions of each of 30 documents; edits fall on any paragraph, the least one included
        q = np.random.default_rng(v // 4)
        paragraphs = [words(12, 5000 + 100 * (v // 4) + i) for i in range(int(q.integers(3, 30)))]
        least = min(paragraphs, key=lambda p: hashlib.md5(p.encode()).hexdigest()[:15])
        kept = [p for p in paragraphs if r.random() > 0.15 and not (p == least and v % 4)]
        rows.append((500 + v, "\n".join([hot, *kept, f"only in {v}"]), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = compare_nearest(docs, cells=3).collect()
    want = brute(rows)
    assert sorted([(g.doc_id, g.base_id, g.added, g.removed) for g in got], key=str) == want
    # What families by the least digest miss: they find fewer than 0.9 of the documents that have an earlier version.
    versions = {i for i, b, *_ in want if b is not None and b != i and i is not None and i >= 500}
    family = {g.doc_id for g in compare(docs).collect() if g.base_id != g.doc_id}
    assert len(versions & family) < 0.9 * len(versions) and versions <= {g.doc_id for g in got if g.base_id != g.doc_id}
    assert compare_nearest(clashing).count() == len(odd_rows) and compare_nearest(empty).count() == 0
