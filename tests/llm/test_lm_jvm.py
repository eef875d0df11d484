"""The kernel in Spark's JVM against the numpy functions that define the model."""

import numpy as np
import pytest

from graphloom.llm import jvm, lm

SCHEMA = "doc_id int, n_tokens bigint, nll double, perplexity double"


def texts(vocabulary):
    r = np.random.default_rng(7)
    common = r.integers(0, vocabulary, 60)
    return [np.where(r.random(n) < 0.8, common[r.integers(0, 60, n)], r.integers(0, vocabulary, n)) for n in (0, 1, 15, 16, 17, 33, 200, 1000, 0, 700)]


def coded(spark, ids, vocabulary):
    return spark.createDataFrame([(i, bytearray(t.astype(lm._width(vocabulary)).tobytes())) for i, t in enumerate(ids)], "doc_id int, ids binary").coalesce(1)


def fitted(df, vocabulary, monkeypatch, alone):
    with monkeypatch.context() as m:
        if alone:
            m.setattr(lm, "_kernel", lambda *a: None)
        return lm.fit(df, vocabulary)


@pytest.mark.parametrize("vocabulary", [300, 70_000])
def test_training_and_scores_are_numpys(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(lm, "SHARD", 50)
    monkeypatch.setattr(lm, "BATCH", 16)
    ids = texts(vocabulary)
    df = coded(spark, ids, vocabulary)
    classes, p = fitted(df, vocabulary, monkeypatch, True)
    _, got = fitted(df, vocabulary, monkeypatch, False)
    rows = lm._kernel(df, classes, p, False, SCHEMA)
    if rows is None:
        pytest.skip("no vectors of 16 numbers in this JVM")
    # Several shards of several steps: the order is numpy's permutation.
    for k in p:
        assert got[k].shape == p[k].shape and np.abs(got[k] - p[k]).mean() < 1e-4, k
    assert any(np.abs(p[k]).max() > 0.01 for k in ("word", "place"))
    rows = {r.doc_id: r for r in rows.collect()}
    assert len(rows) == len(ids)
    for i, t in enumerate(ids):
        assert rows[i].n_tokens == len(t) and (rows[i].nll is None) == (len(t) == 0)
        if len(t):
            want = -lm.log_probabilities(t, np.array([0, len(t)]), classes, p).mean()
            assert abs(rows[i].nll - want) < 1e-4 and abs(rows[i].perplexity / np.exp(rows[i].nll) - 1) < 1e-9


def test_without_vectors_numpy_does_the_same(spark, monkeypatch):
    df = coded(spark, texts(300), 300)
    monkeypatch.setattr(jvm, "_built", lambda *a: None)
    classes, p = lm.fit(df, 300)
    assert lm._kernel(df, classes, p, False, SCHEMA) is None and np.abs(p["word"]).max() > 0
