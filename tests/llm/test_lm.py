import os

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import lm
from graphloom.llm.subwords import TOKENIZER, Subwords

needs_file = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")


def naive(p, ids, classes):
    """Log probabilities one subword at a time, by the definition."""
    c = [int(classes.of[i]) for i in ids]
    inputs, out = [lm.BOS, *c], []
    for t in range(len(ids)):
        begin = max(0, (t // lm.STRIDE - 1) * lm.STRIDE)
        emb = p["emb"][inputs[begin : t + 1]]
        q = emb[-1] @ p["q"] / np.sqrt(lm.DIM)
        s = (emb @ p["k"]) @ q + p["rel"][t - np.arange(begin, t + 1)]
        a = np.exp(s - s.max())
        h = emb[-1] + (a / a.sum()) @ (emb @ p["v"]) @ p["o"]
        h = h + np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"]
        z = h @ p["out"] + p["bias"]
        out.append(z[c[t]] - np.log(np.exp(z).sum()) + classes.log_share[ids[t]])
    return out


def model(seed=1):
    r = np.random.default_rng(seed)
    return {k: r.normal(0, 0.3, s).astype(np.float32) for k, s in lm.SHAPES.items()}


def test_each_token_is_scored_once_in_its_window():
    r = np.random.default_rng(2)
    classes = lm.Classes(np.arange(500), r.integers(1, 1000, 500), 500)
    texts = [r.integers(0, 500, n) for n in (1, 15, 16, 17, 33, 100, 0, 5)]
    ids, first = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = lm.log_probabilities(ids, first, classes, model())
    want = np.concatenate([naive(model(), t, classes) for t in texts])
    assert len(got) == len(ids) and np.abs(got - want).max() < 1e-3


def test_probabilities_sum_to_one():
    classes = lm.Classes(np.arange(100), np.arange(100), 300)
    x = np.zeros((1, 2 * lm.STRIDE), np.int16)
    p = model(3)
    by_class = np.array([lm.forward(p, x, np.full((1, lm.STRIDE), c))[0, -1] for c in range(lm.CLASSES)])
    assert abs(np.exp(by_class).sum() - 1) < 1e-4
    used = np.unique(classes.of)
    assert abs(np.exp(classes.log_share).sum() - len(used)) < 1e-3


def test_gradient():
    r = np.random.default_rng(5)
    x = r.integers(0, lm.CLASSES, (3, 2 * lm.STRIDE))
    x[0, :20] = lm.PAD
    y = r.integers(0, lm.CLASSES, (3, lm.STRIDE))
    y[1, 10:] = lm.PAD
    p = {k: v.astype(np.float64) for k, v in model(6).items()}
    _, g = lm.gradient(p, x, y)
    for k in lm.SHAPES:
        i = tuple(r.integers(0, n) for n in lm.SHAPES[k])
        up, down = ({n: v.copy() for n, v in p.items()} for _ in range(2))
        up[k][i] += 1e-4
        down[k][i] -= 1e-4
        slope = (lm.gradient(up, x, y)[0] - lm.gradient(down, x, y)[0]) / 2e-4
        assert abs(slope - g[k][i]) < 1e-3 * max(1, abs(slope)), k


@needs_file
def test_subwords_match_the_tokenizer(words):
    tok = Subwords()
    texts = [None, "", "  ", "Plain words, with punctuation!", "naïve café 123 déjà-vu don't", words(2000, 9), "a\n\nb\tc", "漢字 и кириллица 🙂"]
    ids, first = tok.ids(pa.array(texts))
    for t, a, z in zip(texts, first[:-1], first[1:]):
        assert ids[a:z].tolist() == [i for w in (t or "").split() for i in tok.encode(" " + w)]


@needs_file
def test_scores(spark, words, clashing, empty, odd_rows):
    rows = {r.doc_id: r for r in lm.score(clashing).collect()}
    assert lm.score(clashing).count() == len(odd_rows)
    assert all(rows[i].n_tokens == 0 and rows[i].nll is None for i in (100, 101, 102))
    assert rows[104].n_tokens > 60_000 and abs(rows[104].perplexity - np.exp(rows[104].nll)) < 1e-6 * rows[104].perplexity
    assert lm.score(empty).count() == 0
    docs = [(i, " ".join(f"{a} follows {b}" for a, b in zip(words(30, i).split(), words(30, i).split())), "en", "s", 1) for i in range(300)]
    docs.append((999, " ".join(reversed(docs[0][1].split())) + " zq qz" * 20, "en", "s", 1))
    got = {r.doc_id: r.nll for r in lm.score(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    assert got[999] > np.mean([v for k, v in got.items() if k != 999])


def word_model(classes, vocabulary, seed):
    r = np.random.default_rng(seed)
    return model(seed) | {k: r.normal(0, 0.3, s).astype(np.float32) for k, s in lm.word_shapes(vocabulary, classes.members.shape[1]).items()}


def test_every_subword_depends_on_the_context():
    classes = lm.Classes(np.arange(400), np.arange(400), 400)
    p = word_model(classes, 400, 8)
    # Given the context, the probabilities of all ids sum to one.
    h = np.random.default_rng(9).normal(0, 1, (1, lm.DIM)).astype(np.float32)
    every = np.exp(lm.class_log(p, np.repeat(h, 400, 0), classes.of) + lm.within(p, classes, np.repeat(h, 400, 0), np.arange(400)))
    unused = [k for k in range(lm.CLASSES) if k not in classes.of]
    none = sum(np.exp(lm.class_log(p, h, np.array([k])))[0] for k in unused)
    assert abs(every.sum() + none - 1) < 1e-3
    # Two ids of one class differ as inputs and, between themselves, as outputs.
    a, b = np.flatnonzero(classes.of == classes.of[int(np.flatnonzero(classes.leaf >= 0)[0])])[:2]
    left, right = (lm.log_probabilities(np.array([i, a, b]), np.array([0, 1, 3]), classes, p) for i in (a, b))
    lone = [lm.log_probabilities(np.array([i, a]), np.array([0, 2]), classes, p)[1] for i in (a, b)]
    assert abs(lone[0] - lone[1]) > 1e-4 and len(left) == len(right) == 3
    ratio = [np.subtract(*(lm.log_probabilities(np.array([i, t]), np.array([0, 2]), classes, p)[1] for t in (a, b))) for i in (1, 2)]
    assert abs(ratio[0] - ratio[1]) > 1e-4


def test_word_gradient():
    r = np.random.default_rng(5)
    classes = lm.Classes(np.arange(200), np.arange(200), 200)
    p = {k: v.astype(np.float64) for k, v in word_model(classes, 200, 6).items()}
    ids = r.integers(0, 200, (3, 2 * lm.STRIDE + 1))
    ids[0, :20], ids[1, 30:] = -1, -1
    x, y = lm._window_inputs(ids)
    _, g, rows = lm.word_gradient(p, classes, x, y)
    full = dict(g)
    for k, (at, d) in rows.items():
        full[k] = np.zeros(p[k].shape)
        full[k][at] = d
    for k in p:
        i = np.unravel_index(np.abs(full[k]).argmax(), full[k].shape)
        up, down = ({n: v.copy() for n, v in p.items()} for _ in range(2))
        up[k][i] += 1e-4
        down[k][i] -= 1e-4
        slope = (lm.word_gradient(up, classes, x, y)[0] - lm.word_gradient(down, classes, x, y)[0]) / 2e-4
        assert abs(slope - full[k][i]) < 1e-3 * max(1, abs(slope)), k


@needs_file
def test_training_windows_cover_every_subword(words):
    texts = [words(5000, 21), words(3, 22), None, words(40, 23), words(700, 24)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], names=["doc_id", "text"])
    coded = list(lm._tokenize(TOKENIZER)(iter([batch])))
    ids, first = Subwords().ids(pa.array(texts))
    got = list(lm._texts(iter(coded), Subwords().size))
    assert np.array_equal(np.concatenate([g[2] for g in got]), ids) and sum(len(g[3]) - 1 for g in got) == 5
    w = lm.training_windows(ids, first)
    assert np.array_equal(np.sort(w[:, -lm.STRIDE :][w[:, -lm.STRIDE :] >= 0]), np.sort(ids))
    x, y = lm._window_inputs(w)
    wx, wy = lm.windows(ids + lm.FIRST, first)
    assert np.array_equal(x, wx) and np.array_equal(np.where(y >= 0, y + lm.FIRST, lm.PAD), wy)


def text_ids(r, n, vocabulary=300):
    """Subwords that follow from the last two, with noise: what two subwords say together, neither says alone."""
    out = [int(r.integers(vocabulary))]
    out.append(int(r.integers(vocabulary)))
    for _ in range(n - 2):
        out.append((3 * out[-1] + 7 * out[-2]) % 40 if r.random() < 0.85 else int(r.integers(vocabulary)))
    return out


def coded(spark, texts):
    return spark.createDataFrame([(i, bytearray(np.array(t, np.uint16).tobytes())) for i, t in enumerate(texts)], "doc_id int, ids binary")


def test_fit_is_the_mean_of_its_shards(spark, monkeypatch):
    """Against the same training done by hand."""
    monkeypatch.setattr(lm, "SHARD", 40)
    r = np.random.default_rng(3)
    texts = [text_ids(r, 100) for _ in range(12)]
    classes, p = lm.fit(coded(spark, texts).coalesce(1), 300)
    ids, first = np.concatenate(texts), np.arange(0, 1201, 100)
    w = lm.training_windows(ids, first)
    start = lm.initial() | {k: np.zeros(s, np.float32) for k, s in lm.word_shapes(300, classes.members.shape[1]).items()}
    parts = [w[a : a + 40] for a in range(0, len(w), 40)]
    got = [lm.train(start, classes, *lm._window_inputs(x), 0) for x in parts]
    for k in p:
        if k != "word":
            assert np.abs(p[k] - sum(g[k] * len(x) for g, x in zip(got, parts)) / len(w)).max() < 1e-4, k
    has = [np.isin(np.arange(300), x) for x in parts]
    n = sum(h * len(x) for h, x in zip(has, parts))
    want = sum(g["word"] * (h * len(x))[:, None] for g, h, x in zip(got, has, parts)) / np.maximum(n, 1)[:, None]
    assert np.abs(p["word"] - want).max() < 1e-4


def test_held_out_texts_are_predicted_better_than_by_bigrams():
    r = np.random.default_rng(11)
    make = lambda n: ([t := [text_ids(r, 200) for _ in range(n)], np.concatenate(t)][1], np.arange(0, 200 * n + 1, 200))
    (ids, first), (other, begin) = make(1500), make(60)
    u, c = np.unique(ids, return_counts=True)
    classes = lm.Classes(u, c, 300)
    p = lm.initial() | {k: np.zeros(s, np.float32) for k, s in lm.word_shapes(300, classes.members.shape[1]).items()}
    for k in range(3):
        p = lm.train(p, classes, *lm._window_inputs(lm.training_windows(ids, first)), k)
    ours = -lm.log_probabilities(other, begin, classes, p).mean()
    one = np.bincount(ids, minlength=300) / len(ids)
    two = np.zeros((300, 300))
    np.add.at(two, (ids[:-1], ids[1:]), 1)
    bigram = 0.9 * two / np.maximum(two.sum(1, keepdims=True), 1) + 0.1 * (0.9 * one + 0.1 / 300)
    assert ours < -np.log(bigram[other[:-1], other[1:]]).mean() - 0.02
