import hashlib

import numpy as np

from graphloom.llm.iblt import compare, peel, sketch


def digests(text):
    return sorted({int(hashlib.md5(p.encode()).hexdigest()[:15], 16) for p in (x.strip(" ") for x in (text or "").split("\n")) if p})


def brute(rows):
    ds = [(r[0], digests(r[1])) for r in rows]
    out = []
    for i, d in ds:
        if not d:
            out.append((i, None, "", ""))
            continue
        head = min(((j is None, j if j is not None else 0, x) for j, x in ds if x and x[0] == d[0]))
        base_id, base = None if head[0] else head[1], head[2]
        out.append((i, base_id, ",".join(str(x) for x in d if x not in base), ",".join(str(x) for x in base if x not in d)))
    return sorted(out, key=str)


def test_peeling_recovers_differences():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 2**60, 8, dtype=np.uint64), r.integers(0, 2**60, 6, dtype=np.uint64)
    common = r.integers(0, 2**60, 500, dtype=np.uint64)
    x = sketch(np.concatenate([common, a]), np.zeros(508, np.int64), 1, 96)
    y = sketch(np.concatenate([common, b]), np.zeros(506, np.int64), 1, 96)
    _, d, s, done = peel(x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2])
    assert done.all() and set(d[s > 0].tolist()) == set(a.tolist()) and set(d[s < 0].tolist()) == set(b.tolist())
    big = sketch(r.integers(0, 2**60, 400, dtype=np.uint64), np.zeros(400, np.int64), 1, 96)
    assert not peel(*[c.copy() for c in big])[3].any()


def test_versions_match_brute_force(spark, odd_rows, words, clashing, empty):
    paragraphs = [words(12, 300 + i) for i in range(900)]
    least = min(paragraphs, key=lambda p: hashlib.md5(p.encode()).hexdigest()[:15])
    r = np.random.default_rng(4)
    rows = list(odd_rows)
    for v in range(30):  # versions of one document, from few to hundreds of changes
        keep = [p for p in paragraphs if r.random() > v / 40] + [f"only in {v} {i}" for i in range(v * 3)]
        rows.append((500 + v, "\n".join([least, *keep]) + "\n\n " + least, "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = compare(docs).collect()
    assert sorted([(g.doc_id, g.base_id, g.added, g.removed) for g in got], key=str) == brute(rows)
    assert all(g.n_added == (len(g.added.split(",")) if g.added else 0) for g in got)
    assert compare(clashing).count() == len(odd_rows) and compare(empty).count() == 0
