import os

import numpy as np
import pytest

from graphloom.llm import outliers
from graphloom.llm.outliers import P, assess, fit, judge, keep_documents
from graphloom.llm.textstats import NAMES, NEAR_TRIPLES, NEAR_WORDS, robust, stats

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def near(items, back):
    last, n = {}, 0
    for i, x in enumerate(items):
        n += x in last and i - last[x] <= back
        last[x] = i
    return n


def brute_stats(text):
    import re
    from collections import Counter

    b = text.encode()
    w = [x for x in re.split(rb"[^A-Za-z0-9\x80-\xff]+", b) if x]
    t = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    marks = sum(c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in b)
    return [
        len(b), len(w), sum(65 <= c < 91 for c in b), sum(48 <= c < 58 for c in b), marks, b.count(b"\n") + (len(b) > 0), sum(map(len, w)), len(set(w)),
        max(Counter(w).values(), default=0), len(t) - len(set(t)), near(w, NEAR_WORDS), near(t, NEAR_TRIPLES),
    ]


def test_statistics(words):
    texts = ["", "a", "Ein Wort, zwei Wörter!\nZeile 2\n", words(3000, 3), "a b c a b c a b c", "123 ABC", " \n", "é" * 50] * 2
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    assert stats(raw, off).astype(int).tolist() == [brute_stats(t) for t in texts] and len(NAMES) == 12


def concentrate(x, cov, mu):
    """Concentration steps to the end, without bins: logarithm of the determinant, mean and whitening matrix."""
    last = np.inf
    w, _ = outliers._whiten(cov)
    while True:
        d = (((x - mu) @ w.T) ** 2).sum(1)
        near = x[np.argsort(d, kind="stable")[: int(np.ceil(outliers.SUPPORT * len(x)))]]
        new = near.mean(0)
        nw, logdet = outliers._whiten(np.cov(near.T, bias=True))
        if logdet >= last - 1e-9:
            return last, mu, w
        last, mu, w = logdet, new, nw


def brute_fit(x):
    """The same starts on one group in memory."""
    mid, sd = np.median(x, 0), np.maximum((np.quantile(x, 0.75, 0) - np.quantile(x, 0.25, 0)) / 1.349, outliers.FLOORS)
    z = (x - mid) / sd
    t, u = np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    sums = [np.concatenate([v.sum(0), (v.T @ v)[outliers._ROW, outliers._COL]]) for v in (t, u)]
    return min((concentrate(x, outliers.start_covariance(k, len(x), sums[k - 1], sd), mid) for k in range(3)), key=lambda r: r[0])


def mixed(seed, n=3000, bad=300):
    r = np.random.default_rng(seed)
    x = r.normal(0, 1, (n, P)) @ r.normal(0, 1, (P, P)) / 3 + 5
    x[:bad] = r.normal(0, 0.3, (bad, P)) + 11  # a close group of outliers, which pulls means and plain covariances
    return x


def test_fit_follows_the_concentration_steps(spark):
    x = mixed(0)
    df = spark.createDataFrame([("en", "s", v.tolist()) for v in x], "lang string, source string, x array<double>")
    got = judge(df.withColumn("y", df["x"]), fit(df)).toPandas()
    _, mu, w = brute_fit(x)
    want = {tuple(v): ((w @ (v - mu)) ** 2).sum() for v in x}
    ratio = np.array([g / want[tuple(v)] for v, g in zip(got.y, got.d2)])
    assert np.abs(np.log(ratio)).max() < 0.15
    assert set(map(tuple, got.y[got.d2 > outliers.chi2_quantile(1 - 1e-9, P)])) == set(map(tuple, x[:300]))


def test_no_random_start_finds_a_smaller_determinant(spark):
    x = mixed(4, 400, 80)
    df = spark.createDataFrame([("en", "s", v.tolist()) for v in x], "lang string, source string, x array<double>")
    m = fit(df).first()
    ours = -2 * np.log(np.abs(np.diag(np.array(m.w).reshape(P, P)))).sum()
    r = np.random.default_rng(1)
    others = []
    for _ in range(300):
        some = x[r.choice(len(x), P + 2, replace=False)]
        others.append(concentrate(x, np.cov(some.T, bias=True), some.mean(0))[0])
    assert ours < min(others) + 0.05  # the cut takes a whole bin of distances, so a little more than the share


def test_assess_end_to_end(spark, words):
    """Every document's distance against a version in memory, with a large pair, a small pair of a large language, and a small language."""
    rows = [(i, words(20 + i % 90, i) + "!" * (i % 3), "en", "s0", 1) for i in range(150)] + [(i, words(30 + i % 50, i), "en", "s1", 1) for i in range(150, 180)]
    rows += [(i, words(25, i), "de", "s0", 1) for i in range(180, 200)] + [(500, "###" * 300 + " a", "de", "s0", 1), (501, "###" * 300 + " a", "en", "s1", 1)]
    got = {r.doc_id: r for r in assess(spark.createDataFrame(rows, SCHEMA)).collect()}
    text = [r[1] for r in rows]
    x = robust(stats(np.frombuffer("".join(text).encode(), np.uint8), np.concatenate(([0], np.cumsum([len(t.encode()) for t in text])))))
    at = {"en s0": [k for k, r in enumerate(rows) if r[2:4] == ("en", "s0")], "en": [k for k, r in enumerate(rows) if r[2] == "en"], "all": list(range(len(rows)))}
    fits = {k: brute_fit(x[v]) for k, v in at.items()}
    for k, r in enumerate(rows):
        _, mu, w = fits["en s0" if r[2:4] == ("en", "s0") else r[2] if r[2] == "en" else "all"]
        d2 = ((w @ (x[k] - mu)) ** 2).sum()
        assert abs(np.log((got[r[0]].d2 + 0.05) / (d2 + 0.05))) < 0.35, r[0]
        if abs(np.log(d2 / outliers.chi2_quantile(1 - outliers.TAIL, P))) > 0.35:
            assert got[r[0]].keep == (d2 <= outliers.chi2_quantile(1 - outliers.TAIL, P))
    assert not got[500].keep and not got[501].keep and sum(r.keep for r in got.values()) > 190


def clean_and_junk(words):
    vocabulary = list(dict.fromkeys(a + b for a in words(400, 1).split() for b in words(60, 2).split()))

    def prose(n, seed):
        w = [vocabulary[i] for i in np.random.default_rng(seed).integers(0, len(vocabulary), n)]
        return ". ".join(" ".join(w[i : i + 9]).capitalize() for i in range(0, n, 9)) + "."

    rows = [(i, prose(30 + i % 200, i), "en", "s0", 1) for i in range(400)]
    rows += [(400, prose(3_000, 777), "en", "s0", 1)]
    junk = ["@@@ ### $$$ %%% " * 40 + "a", "same words again " * 200, "X1 " * 5 + "0123456789" * 60, "|".join("abc" for _ in range(300))]
    return rows, [(1000 + i, t, "en", "s0", 1) for i, t in enumerate(junk)]


def test_rejects_junk_and_keeps_clean(spark, words):
    clean, junk = clean_and_junk(words)
    got = {r.doc_id: r.keep for r in assess(spark.createDataFrame(clean + junk, SCHEMA)).collect()}
    assert not any(got[i] for i, *_ in junk)
    assert [i for i, *_ in clean if not got[i]] == []


def test_odd_rows(odd, odd_rows, clashing, empty):
    rows = assess(odd).collect()
    assert len(rows) == len(odd_rows)
    gone = {r.doc_id for r in rows if not r.keep}
    assert {100, 101, 102, 103} <= gone
    assert all(r.keep and r.d2 is not None for r in rows if r.doc_id in (0, 105)) and all(r.d2 is None for r in rows if r.doc_id in (100, 101, 102))
    out = keep_documents(clashing)
    assert out.dtypes == clashing.dtypes and out.count() == sum(r.keep for r in rows)
    assert assess(empty).count() == 0 and keep_documents(empty).count() == 0


@pytest.mark.parametrize("q,k,want", [(0.5, 9, 8.343), (0.999, 9, 27.877), (0.95, 4, 9.488)])
def test_chi_squared(q, k, want):
    assert abs(outliers.chi2_quantile(q, k) / want - 1) < 0.02


@pytest.mark.skipif(not os.path.exists(f"{SF}/labels.parquet"), reason="no test tables")
def test_labelled_documents(spark):
    """Most of the poor go, the good stay."""
    got = assess(spark.read.parquet(f"{SF}/documents.parquet")).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").groupBy("quality", "keep").count().collect()
    n = {(r["quality"], r["keep"]): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n[0, False] >= 0.8 * (n[0, False] + n.get((0, True), 0))
