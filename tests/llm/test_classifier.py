import numpy as np

from graphloom.llm.classifier import classify, combine, fit_logistic, keep_documents, site_posteriors

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(words, n=600):
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        text = words(20 + i % 80, i)
        if not good:
            text = " ".join(w + "!!!" for w in text.upper().split())
        rows.append((i, text, "en" if i % 2 else "de", f"s{i % 4}", 1))
        if i < n // 2:
            labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark, words):
    rows, labels = corpus(words)
    out = classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    held = [r for r in out.collect() if r.doc_id >= 300]
    assert np.mean([r.keep == (r.doc_id % 3 > 0) for r in held]) > 0.97


def test_posteriors_match_direct_computation(spark):
    r = np.random.default_rng(1)
    rows = [("l%d" % (i % 3), "h%d" % (i % 5 if i % 5 else 0), float(r.beta(1 + i % 5, 2))) for i in range(300)] + [(None, None, 0.3), ("l0", None, 0.9)]
    scored = spark.createDataFrame(rows, "lang string, source string, p double")
    got = {(g.lang, g.source, round(g.p, 12)): g["__site"] for g in combine(scored, site_posteriors(scored)).collect()}
    n, mu = len(rows), np.mean([p for *_, p in rows])
    by = lambda f: {k: [p for x in rows if f(x) == k for p in [x[2]]] for k in {f(x) for x in rows}}
    hosts, paths = by(lambda x: x[1]), by(lambda x: x[:2])

    def strength(between, sites):
        extra = (between - sites * mu * (1 - mu)) / n
        return min(max(mu * (1 - mu) / max(extra, 1e-9) - 1, 1.0), 1e6)

    kh = strength(sum(len(v) * (np.mean(v) - mu) ** 2 for v in hosts.values()), len(hosts))
    k = strength(sum(len(v) * (np.mean(v) - np.mean(hosts[key[1]])) ** 2 for key, v in paths.items()), len(paths))
    for lang, source, p in rows:
        h, v = hosts[source], paths[lang, source]
        prior = (sum(h) + kh * mu) / (len(h) + kh)
        assert abs(got[lang, source, round(p, 12)] - (sum(v) - p + k * prior) / (len(v) - 1 + k)) < 1e-9


def test_newton_finds_the_optimum():
    r = np.random.default_rng(3)
    x = np.concatenate([np.ones((500, 1)), r.normal(0, 1, (500, 3))], axis=1)
    y = (r.random(500) < 1 / (1 + np.exp(-(x @ [0.5, 2, -1, 0])))).astype(float)
    mean, sd, w = fit_logistic(x, y)
    z = (x - mean) / sd
    g = z.T @ (y - 1 / (1 + np.exp(-z @ w))) - np.array([1e-6, 1, 1, 1]) * w
    assert np.abs(g).max() < 1e-4


def test_odd_rows(spark, odd, odd_rows, clashing, empty):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, None), (3, 0, 0), (None, 1, 0), (4, None, 0), (0, 0, 1), (999, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = classify(odd, labels).collect()
    assert len(rows) == len(odd_rows)
    assert all(r.p == 0 and not r.keep for r in rows if r.doc_id in (100, 101, 102, 103))
    out = keep_documents(clashing, labels)
    assert out.dtypes == clashing.dtypes and out.count() == sum(r.keep for r in rows)
    none = classify(odd, labels.limit(0)).collect()
    assert {r.p for r in none} == {0.0, 0.5}
    assert classify(empty, labels).count() == 0 and classify(empty, labels.limit(0)).count() == 0


def test_sites_from_urls(spark, words):
    """Sparse evidence: a host's documents stand together, whatever their language and source."""
    rows, labels = corpus(words)
    docs = spark.createDataFrame([(*r, f"http://{'good' if r[0] % 3 else 'bad'}.example.com/p{r[0] % 2}/x?{r[0]}", r[0]) for r in rows], SCHEMA + ", url string, host int")
    y = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in classify(docs, y, url="url").collect()}
    assert len(got) == len(rows) and np.mean([r.keep == (k % 3 > 0) for k, r in got.items()]) > 0.97
    assert min(r.site for k, r in got.items() if k % 3) > 0.9 > 0.2 > max(r.site for k, r in got.items() if k % 3 == 0)
    out = keep_documents(docs, y, url="url")
    assert out.dtypes == docs.dtypes and out.count() == sum(r.keep for r in got.values())
