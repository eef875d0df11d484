"""What training leaves out in passes over wide rows must not change what it computes."""

import numpy as np

from graphloom.llm import lm


def test_gradients_are_divided_where_rows_are_narrow():
    r = np.random.default_rng(1)
    z = r.normal(0, 3, (50, 20))
    z[:, 4] = -np.inf
    z[7] += 90
    z[9] -= 90
    at = r.integers(5, 20, 50)
    e = np.exp(z - z.max(1, keepdims=True))
    e /= e.sum(1, keepdims=True)
    lp, got, by = lm._raw_gradient(lambda: z.copy(), at)
    assert np.abs(lp - np.log(e[np.arange(50), at])).max() < 1e-9
    e[np.arange(50), at] -= 1
    assert got.shape == z.shape and by.shape == (50, 1) and np.abs(got * by - e).max() < 1e-12


def test_distinct_inputs_are_numpys():
    x = np.random.default_rng(2).integers(0, 900, (30, 32)).astype(np.int32)
    used, at = lm._distinct(x, 1000)
    want, where = np.unique(x, return_inverse=True)
    assert np.array_equal(used, want) and np.array_equal(at, where.reshape(x.shape))


def test_training_is_adam_by_its_definition(monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 8)
    r = np.random.default_rng(3)
    classes = lm.Classes(np.arange(300), np.arange(300), 300)
    start = lm.initial() | {k: np.zeros(s, np.float32) for k, s in lm.word_shapes(300, classes.members.shape[1]).items()}
    x, y = lm._window_inputs(lm.training_windows(r.integers(0, 300, 16 * 30 + 5), np.array([0, 100, 103, 485])))
    got = lm.train(start, classes, x, y, 4)
    p = {k: v.copy() for k, v in start.items()}
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    order = np.random.default_rng(4).permutation(len(x))
    for i, a in enumerate(range(0, len(order), 8), 1):
        _, g, rows = lm.word_gradient(p, classes, x[order[a : a + 8]], y[order[a : a + 8]])
        for k, at, d in [(k, slice(None), v) for k, v in g.items()] + [(k, *v) for k, v in rows.items()]:
            m[k][at] = 0.9 * m[k][at] + 0.1 * d
            s[k][at] = 0.99 * s[k][at] + 0.01 * d * d
            p[k][at] -= lm.RATE * (m[k][at] / (1 - 0.9**i)) / (np.sqrt(s[k][at] / (1 - 0.99**i)) + 1e-8)
    assert set(got) == set(p)
    for k in p:
        assert got[k].shape == p[k].shape and np.abs(got[k] - p[k]).mean() < 1e-4, k
    assert all(np.array_equal(start[k], np.zeros_like(v)) for k, v in start.items() if k in ("sub", "place", "word"))
