"""Language-model scoring with a causal self-attention model on subword ids, defined in numpy; lm.java does the same in Spark's JVM, where it can.

Inputs are subword ids, each with its own vector beside that of its class. A subword's probability is
that of its class given what precedes, times its leaf's in the class, times that of its place in the leaf, all
three by softmax of the same context vector; the last two start from counts over the whole corpus.
The commonest subwords are classes of their own. Places have vectors that all leaves share: a softmax
over them is two dense products, where vectors of its own for each subword would be gathered and scattered.
Targets are scored in blocks of STRIDE; a block's window holds its inputs and the STRIDE before, so
windows overlap, every subword is scored once, and each sees STRIDE + 1 to 2 STRIDE inputs but for
a text's beginning.

Training windows are all blocks of all documents. They are taken in shards of one size, shards train
by themselves from common weights, and the weights are averaged, for ROUNDS times: what is gathered
and trained on grows with the corpus, what the driver holds does not. Texts are tokenized once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import jvm
from graphloom.llm.common import settle, table
from graphloom.llm.subwords import TOKENIZER, Subwords
from graphloom.llm.words import buffers, mix, pieces

STRIDE, DIM, HIDDEN, CLASSES, OWN = 16, 16, 32, 64, 47
#: Leaves of each class that holds several subwords.
LEAVES = 128
#: Inputs are BOS, PAD, or FIRST + a subword's id.
BOS, PAD, FIRST = 0, CLASSES, CLASSES + 1
SHARD, BATCH, ROUNDS, RATE = 131072, 256, 1, 0.02
SHAPES = {
    "emb": (CLASSES, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "o": (DIM, DIM), "rel": (2 * STRIDE,),
    "w1": (DIM, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, DIM), "out": (DIM, CLASSES), "bias": (CLASSES,),
}
_REL = np.arange(STRIDE)[:, None] + STRIDE - np.arange(2 * STRIDE)[None, :]
_CAUSAL = _REL >= 0


def initial(seed: int = 0) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    return {k: (r.normal(0, 1 / np.sqrt(s[0]) if len(s) > 1 else 0, s)).astype(np.float32) for k, s in SHAPES.items()}


def word_shapes(vocabulary: int, places: int) -> dict[str, tuple]:
    """Vectors of leaves and places as outputs, and of subwords as inputs."""
    return {"sub": (CLASSES - 1 - OWN, LEAVES, DIM), "place": (places, DIM), "word": (vocabulary, DIM)}


def flat(p: dict, shapes: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in shapes])


def unflat(x: np.ndarray, shapes: dict) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes.items():
        n = int(np.prod(s))
        out[k] = np.asarray(x[at : at + n], np.float32).reshape(s)
        at += n
    return out


class Classes:
    """Class of each subword id, and the logarithm of its share in the class, from counts over the corpus."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, vocabulary: int):
        c = np.ones(vocabulary)
        c[ids] += counts
        order = np.lexsort((np.arange(vocabulary), -c))
        rest = CLASSES - 1 - OWN
        self.of = (1 + OWN + mix(np.arange(vocabulary, dtype=np.uint64)) % np.uint64(rest)).astype(np.int16)
        self.of[order[:OWN]] = 1 + np.arange(min(OWN, vocabulary))
        self.log_share = np.log(c / np.bincount(self.of, weights=c, minlength=CLASSES)[self.of]).astype(np.float32)
        # Leaves of the classes of several: -1 for a subword that is a class of its own.
        at = mix(np.arange(vocabulary, dtype=np.uint64) + np.uint64(0x1EAF)) % np.uint64(LEAVES)
        self.leaf = np.where(self.of > OWN, (self.of.astype(np.int64) - 1 - OWN) * LEAVES + at.astype(np.int64), -1)
        ids = np.flatnonzero(self.leaf >= 0)
        ids = ids[np.argsort(self.leaf[ids], kind="stable")]
        sizes = np.bincount(self.leaf[ids], minlength=rest * LEAVES)
        weight = np.bincount(self.leaf[ids], weights=c[ids], minlength=rest * LEAVES)
        self.place = np.zeros(vocabulary, np.int64)
        self.place[ids] = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # Members of each leaf, and logarithms of their shares in it; `vocabulary` where there is none.
        self.members = np.full((rest * LEAVES, max(int(sizes.max()), 1)), vocabulary)
        self.members[self.leaf[ids], self.place[ids]] = ids
        self.log_in = np.full(self.members.shape, -np.inf, np.float32)
        self.log_in[self.leaf[ids], self.place[ids]] = np.log(c[ids] / weight[self.leaf[ids]])
        with np.errstate(divide="ignore"):
            self.log_sub = np.log(weight.reshape(rest, LEAVES) / np.maximum(weight.reshape(rest, LEAVES).sum(1, keepdims=True), 1e-30)).astype(np.float32)


def _inputs(p: dict) -> np.ndarray:
    """Vectors of the inputs that aren't subwords' ids: classes and PAD."""
    return np.vstack([p["emb"], np.zeros((1, DIM), np.float32)])


def _vectors(p: dict, of: np.ndarray, inputs: np.ndarray) -> np.ndarray:
    """Vectors of inputs: a subword's is its class's and its own."""
    i = np.maximum(inputs - FIRST, 0)
    word = inputs >= FIRST
    return _inputs(p)[np.where(word, of[i], np.minimum(inputs, PAD))] + np.where(word[:, None], p["word"][i], np.float32(0))


def _tables(p: dict, emb: np.ndarray):
    return emb, emb @ p["q"] / np.float32(np.sqrt(DIM)), emb @ p["k"], emb @ p["v"]


def _weights(p: dict, q: np.ndarray, k: np.ndarray, none: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention of the last STRIDE positions of windows to all before them, and the inverse of its sums, by which it isn't multiplied yet; `none` marks PAD."""
    mask = np.where(_CAUSAL, p["rel"][np.clip(_REL, 0, None)], np.float32(-1e9))
    some = np.flatnonzero(none.any(1))

    def scores():
        s = q @ k.transpose(0, 2, 1)
        s += mask
        if len(some):
            s[some] += np.where(none[some], np.float32(-1e9), np.float32(0))[:, None, :]
        return s

    s, total, _ = _exps(scores)
    return s, (1 / total).reshape(-1, 1)


def hidden(p: dict, tables, x: np.ndarray) -> np.ndarray:
    """Context vectors (n STRIDE, DIM) after each of the last STRIDE inputs."""
    emb, q, k, v = tables
    a, by = _weights(p, q[x[:, STRIDE:]], k[x], x == PAD)
    ctx = (a @ v[x]).reshape(-1, DIM)
    ctx *= by
    h = emb[x[:, STRIDE:]].reshape(-1, DIM)
    h += ctx @ p["o"]
    u = h @ p["w1"]
    u += p["b1"]
    h += np.maximum(u, 0, out=u) @ p["w2"]
    return h


def forward(p: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log probability of the class y (n, STRIDE) after each of the last STRIDE inputs of x (n, 2 STRIDE), which are classes."""
    return class_log(p, hidden(p, _tables(p, _inputs(p)), x), y)


def class_log(p: dict, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _log(lambda: _and_one(h) @ np.vstack([p["out"], p["bias"]]), y.ravel()).reshape(y.shape)


def _and_one(h: np.ndarray) -> np.ndarray:
    """Rows with a 1 at the end, which takes what is added to all of them into their product."""
    out = np.empty((len(h), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h
    out[:, -1] = 1
    return out


def _exps(make) -> tuple[np.ndarray, np.ndarray, np.ndarray | np.float32]:
    """Exponentials of the rows that make() gives, their sums, and what was taken off first: nothing where they fit into numbers as they are."""
    z = make()
    off = np.float32(0)
    if z.size and z.max() > 60:
        off = z.max(-1)
        z -= off[..., None]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[-1], z.dtype)
    if total.size and not total.min() > 1e-25:
        z = make()
        off = z.max(-1)
        z -= off[..., None]
        np.exp(z, out=z)
        total = z @ np.ones(z.shape[-1], z.dtype)
    return z, total, off


def _raw_gradient(make, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probabilities at `at` of the rows that make() gives, the gradient of their negative sum for these rows, and the numbers its rows are still to be multiplied by: what comes of them is narrower."""
    z, total, _ = _exps(make)
    n = np.arange(len(z))
    lp = np.log(np.maximum(z[n, at] / total, 1e-30))
    z[n, at] -= total
    return lp, z, (1 / total)[:, None]


def _log(make, at) -> np.ndarray:
    """Log probabilities at `at` of the rows that make() gives."""
    z, total, _ = _exps(make)
    return np.log(np.maximum(z[np.arange(len(z)), at], 1e-30) / total)


def within(p: dict, classes: Classes, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Log probability of each id within its class, given the context vectors h."""
    out = np.zeros(len(ids), np.float32)
    rows, leaf, edges = _by_class(classes, ids)
    sub = _leaves(p, classes)
    place = classes.place[ids[rows]]
    for k, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        for a in range(a, z, 2048):
            at = slice(a, min(a + 2048, z))
            x = _and_one(h[rows[at]])
            out[rows[at]] = _log(lambda: x @ sub[k], leaf[at] - k * LEAVES) + _log(lambda: _places(p, classes, x[:, :-1], leaf[at]), place[at])
    return out


def _by_class(classes: Classes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of subwords of classes of several, class by class, their leaves, and where each class's begin, and the end."""
    leaf = classes.leaf[ids]
    rows = np.flatnonzero(leaf >= 0)
    order = np.argsort((leaf[rows] // LEAVES).astype(np.uint8), kind="stable")
    rows = rows[order]
    leaf = leaf[rows]
    return rows, leaf, np.searchsorted(leaf // LEAVES, np.arange(CLASSES - OWN))


def _leaves(p: dict, classes: Classes) -> np.ndarray:
    """For each class of several what rows with a 1 at their end are multiplied by (DIM + 1, LEAVES)."""
    return np.concatenate([p["sub"], classes.log_sub[:, :, None]], axis=2, dtype=p["sub"].dtype).transpose(0, 2, 1)


def _places(p: dict, classes: Classes, x: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    z = x @ p["place"].T
    z += classes.log_in[leaf]
    return z


def _within_gradient(p: dict, classes: Classes, h: np.ndarray, ids: np.ndarray):
    """Of within(): its value, and what the gradient of its negative sum is, for h, leaves and places."""
    out, dh = np.zeros(len(ids), h.dtype), np.zeros_like(h)
    dsub = np.zeros(p["sub"].shape, h.dtype)
    rows, leaf, edges = _by_class(classes, ids)
    sub = _leaves(p, classes)
    x = _and_one(h[rows])
    at = leaf % LEAVES
    lp, e, by = _raw_gradient(lambda: _places(p, classes, x[:, :-1], leaf), classes.place[ids[rows]])
    d = e @ p["place"]
    d *= by
    dplace = e.T @ (x[:, :-1] * by)
    for k, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if z > a:
            mine = x[a:z]
            more, e, by = _raw_gradient(lambda: mine @ sub[k], at[a:z])
            lp[a:z] += more
            dsub[k] = e.T @ (mine[:, :-1] * by)
            d[a:z] += (e @ p["sub"][k]) * by
    out[rows], dh[rows] = lp, d
    return out, dh, dsub, dplace


def _sums(at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of d with the same number, and the numbers."""
    # Numbers of 16 bits are sorted digit by digit.
    order = np.argsort(at.astype(np.uint16) if len(at) and at.max() < 1 << 16 else at, kind="stable")
    a = at[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(len(a), 1), bool), a[1:] != a[:-1])))
    return a[starts], np.add.reduceat(d[order], starts) if len(a) else d[:0]


def gradient(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean loss over targets that aren't PAD, and its gradient; inputs and targets are classes."""
    loss, g, demb = _gradient(p, _inputs(p), x, x == PAD, y)
    return loss, g | {"emb": demb[:CLASSES]}


def word_gradient(p: dict, classes: Classes, x: np.ndarray, ids: np.ndarray) -> tuple[float, dict, dict]:
    """Mean loss over ids (n, STRIDE; -1 for none) after inputs x, its gradient, and that of subwords' vectors as (numbers, rows)."""
    used, at = _distinct(x, FIRST + len(p["word"]))
    y = np.where(ids >= 0, classes.of[np.maximum(ids, 0)], PAD)
    loss, g, demb = _gradient(p, _vectors(p, classes.of, used), at, x == PAD, y, classes, ids)
    word = used >= FIRST
    g["emb"] = np.zeros((CLASSES, DIM), demb.dtype)
    rows, sums = _sums(np.where(word, classes.of[np.maximum(used - FIRST, 0)], used)[used != PAD], demb[used != PAD])
    g["emb"][rows] = sums
    return loss, g, {"word": (used[word] - FIRST, demb[word])}


def _distinct(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers in x, all under `most`, in order, and which of them each is."""
    where = np.zeros(most, np.int32)
    where[x] = 1
    used = np.flatnonzero(where)
    where[used] = np.arange(len(used))
    return used, where[x]


def _gradient(p: dict, table: np.ndarray, x: np.ndarray, none: np.ndarray, y: np.ndarray, classes: Classes | None = None, ids: np.ndarray | None = None):
    n, scale = len(x), np.float32(1 / np.sqrt(DIM))
    emb = table[x]
    every, last = emb.reshape(-1, DIM), emb[:, STRIDE:].reshape(-1, DIM)
    kv = np.hstack([p["k"], p["v"]])
    q, both = (last @ (p["q"] * scale)).reshape(n, STRIDE, DIM), (every @ kv).reshape(n, 2 * STRIDE, 2 * DIM)
    k, v = both[:, :, :DIM], both[:, :, DIM:]
    a, by = _weights(p, q, k, none)
    ctx = (a @ v).reshape(-1, DIM)
    ctx *= by
    h0 = ctx @ p["o"]
    h0 += last
    r = h0 @ p["w1"]
    r += p["b1"]
    np.maximum(r, 0, out=r)
    h = np.empty((len(h0), DIM + 1), h0.dtype)
    h[:, :-1] = r @ p["w2"]
    h[:, :-1] += h0
    h[:, -1] = 1
    t = y.ravel()
    on = t != PAD
    t = np.where(on, t, 0)
    m = max(int(on.sum()), 1)
    out = np.vstack([p["out"], p["bias"]])
    lp, e, share = _raw_gradient(lambda: h @ out, t)
    share *= (on / m)[:, None].astype(np.float32)
    loss = -lp[on].sum() / m
    dout = (h * share).T @ e
    g = {"out": dout[:-1], "bias": dout[-1]}
    dh = e @ p["out"].T
    dh *= share
    if classes is not None:
        rows = slice(None) if on.all() else np.flatnonzero(on)
        lp, more, g["sub"], g["place"] = _within_gradient(p, classes, h[rows, :-1], ids.ravel()[rows])
        loss -= lp.sum() / m
        more /= np.float32(m)
        dh[rows] += more
        g["sub"] /= np.float32(m)
        g["place"] /= np.float32(m)
    dr = dh @ p["w2"].T
    dr *= r > 0
    ones = np.ones(len(dr), dr.dtype)
    g |= {"w2": r.T @ dh, "w1": h0.T @ dr, "b1": ones @ dr}
    dh += dr @ p["w1"].T
    g["o"] = ctx.T @ dh
    dctx = dh @ p["o"].T
    dctx *= by
    dot = np.einsum("ij,ij->i", dctx, ctx).reshape(n, STRIDE, 1)
    dctx = dctx.reshape(n, STRIDE, DIM)
    da = dctx @ v.transpose(0, 2, 1)
    da -= dot
    da *= a
    g["rel"] = np.bincount(np.clip(_REL, 0, None)[_CAUSAL], weights=da.sum(0)[_CAUSAL], minlength=2 * STRIDE)
    dq = (da @ k).reshape(-1, DIM)
    dq *= scale
    dboth = np.empty_like(both)
    np.matmul(da.transpose(0, 2, 1), q, out=dboth[:, :, :DIM])
    np.matmul(a.transpose(0, 2, 1), dctx, out=dboth[:, :, DIM:])
    dboth = dboth.reshape(-1, 2 * DIM)
    dkv = every.T @ dboth
    g |= {"q": last.T @ dq, "k": dkv[:, :DIM], "v": dkv[:, DIM:]}
    d = (dboth @ kv.T).reshape(emb.shape)
    dh += dq @ p["q"].T
    d[:, STRIDE:] += dh.reshape(n, STRIDE, DIM)
    demb = np.zeros_like(table)
    rows, sums = _sums(x.ravel(), d.reshape(-1, DIM))
    demb[rows] = sums
    return float(loss), g, demb


def train(p: dict, classes: Classes, x: np.ndarray, ids: np.ndarray, seed: int, rate: float = RATE) -> dict:
    """One pass over the windows, by Adam; vectors of subwords move when they are met."""
    order = np.random.default_rng(seed).permutation(len(x))
    shapes = {k: v.shape for k, v in p.items() if k != "word"}
    dense = np.zeros((3, sum(int(np.prod(s)) for s in shapes.values())), np.float32)
    dense[0] = flat(p, shapes)
    # Weights, means and squares side by side: what is met is gathered once.
    words = np.zeros((len(p["word"]), 3, DIM), np.float32)
    words[:, 0] = p["word"]
    p = unflat(dense[0], shapes) | {"word": words[:, 0]}
    for i, at in enumerate(range(0, len(order), BATCH), 1):
        b = order[at : at + BATCH]
        _, g, rows = word_gradient(p, classes, x[b], ids[b])
        step, lift = np.float32(rate / (1 - 0.9**i)), np.float32(1 / (1 - 0.99**i))
        _adam(*dense, flat(g, shapes).astype(np.float32, copy=False), step, lift)
        r, d = rows["word"]
        met = words[r]
        _adam(met[:, 0], met[:, 1], met[:, 2], d, step, lift)
        words[r] = met
    return p | {"word": words[:, 0].copy()}


def _adam(p: np.ndarray, mean: np.ndarray, square: np.ndarray, d: np.ndarray, step: np.float32, lift: np.float32) -> None:
    mean *= np.float32(0.9)
    mean += np.float32(0.1) * d
    square *= np.float32(0.99)
    d = d * d
    d *= np.float32(0.01)
    square += d
    d = square * lift
    np.sqrt(d, out=d)
    d += np.float32(1e-8)
    np.divide(mean, d, out=d)
    d *= step
    p -= d


def layout(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts that begin at `first`: where ids go among padded targets, the number of blocks of each text, and the block each text begins with, its inputs having one more in front."""
    n = np.diff(first)
    blocks = -(-n // STRIDE)
    begin = np.concatenate(([0], np.cumsum(blocks)))
    return np.arange(first[-1]) + np.repeat(begin[:-1] * STRIDE - first[:-1], n), blocks, begin


def windows(inputs: np.ndarray, first: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (blocks, 2 STRIDE) and targets (blocks, STRIDE) of all blocks of all texts, or of those chosen; PAD where there is nothing."""
    place, blocks, begin = layout(first)
    y = np.full(begin[-1] * STRIDE, PAD, inputs.dtype)
    y[place] = inputs
    now = np.empty_like(y)
    now[1:] = y[:-1]
    starts = begin[:-1][blocks > 0]
    now[starts * STRIDE] = BOS
    now, y = now.reshape(-1, STRIDE), y.reshape(-1, STRIDE)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[starts] = PAD
    x = np.concatenate([before, now], axis=1)
    return (x, y) if chosen is None else (x[chosen], y[chosen])


def _tokenize(path: str):
    """(doc_id, ids) of all texts: subword ids as two or four bytes each."""

    def run(batches):
        tok = Subwords(path)
        for b in batches:
            _, off = buffers(b.column(1))
            for a, z in pieces(off, 1 << 20):
                ids, first = tok.ids(b.column(1).slice(a, z - a))
                raw = ids.astype(_width(tok.size)).tobytes()
                w = _width(tok.size)().itemsize
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array([raw[i * w : j * w] for i, j in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary())], names=["doc_id", "ids"])

    return run


def _width(vocabulary: int):
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def _texts(batches, vocabulary: int, column: str = "ids"):
    """Runs of rows of about half a million subwords: their batch, the first one's number, and ids and where each text's begin."""
    w = _width(vocabulary)().itemsize
    for b in batches:
        raw = b.column(b.schema.get_field_index(column)).cast(pa.large_binary())
        off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = raw.buffers()[2]
        ids = np.frombuffer(data, _width(vocabulary))[off[0] // w : off[-1] // w] if data is not None else np.zeros(0, _width(vocabulary))
        first = (off - off[0]) // w
        for a, z in pieces(first, 1 << 19):
            yield b, a, ids[first[a] : first[z]].astype(np.int64), first[a : z + 1] - first[a]


def _count(vocabulary: int):
    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for _, _, ids, _ in _texts(batches, vocabulary):
            total += np.bincount(ids, minlength=vocabulary)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(total[i])], names=["id", "n"])

    return run


def training_windows(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All blocks of all texts as ids (blocks, 2 STRIDE + 1), from STRIDE + 1 before a block's targets to their end; -1 where there is none."""
    _, blocks, begin = layout(first)
    own = np.repeat(np.arange(len(blocks)), blocks)
    at = (np.arange(begin[-1]) - begin[:-1][own])[:, None] * STRIDE + np.arange(-STRIDE - 1, STRIDE)[None, :]
    ok = (at >= 0) & (at < np.diff(first)[own][:, None])
    return np.where(ok, ids[np.clip(at + first[:-1][own][:, None], 0, len(ids) - 1)], -1).astype(np.int32)


def _window_inputs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets' ids from ids (n, 2 STRIDE + 1) of training windows."""
    x, y = np.where(ids >= 0, ids + FIRST, PAD)[:, :-1], ids[:, -STRIDE:]
    none = ids[:, :-1] < 0
    # The input before a text's first subword is its beginning.
    first = none & np.concatenate([~none[:, 1:], (ids[:, -1:] >= 0)], axis=1)
    first &= np.cumsum(~none, axis=1) == 0
    x[first] = BOS
    return x, y


def _train_shards(p: dict, classes: Classes, shapes: dict, seed: int):
    """All windows of a task, in shards of SHARD, to the number of windows and the sum over these of the weights, in millionths: sums of whole numbers don't depend on order. Vectors of subwords are given only where a window has the subword."""
    vocabulary = len(p["word"])

    def run(batches):
        total, n, met, held = {k: np.zeros(s, np.int64) for k, s in shapes.items()}, 0, np.zeros(vocabulary, np.int64), []

        def shard(w):
            nonlocal n
            got = train(p, classes, *_window_inputs(w), seed)
            here = np.unique(w[w >= 0])
            for k in shapes:
                at = here if k == "word" else slice(None)
                total[k][at] += np.rint(got[k][at].astype(np.float64) * 1e6).astype(np.int64) * len(w)
            n += len(w)
            met[here] += len(w)

        for _, _, ids, first in _texts(batches, vocabulary):
            if len(ids):
                held.append(training_windows(ids, first))
            while sum(map(len, held)) >= SHARD:
                every = np.concatenate(held)
                shard(every[:SHARD])
                held = [every[SHARD:]]
        if sum(map(len, held)):
            shard(np.concatenate(held))
        if n:
            sums = flat(total, shapes).astype(np.int64)
            weight = np.concatenate([np.repeat(met, DIM) if k == "word" else np.full(total[k].size, n) for k in shapes])
            i = np.flatnonzero(weight)
            rows = lambda a, t: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, t))
            yield pa.RecordBatch.from_arrays([rows(i, pa.int32()), rows(weight[i], pa.int64()), rows(sums[i], pa.int64())], names=["i", "n", "v"])

    return run


def _kernel(df: DataFrame, classes: Classes, p: dict, training: bool, schema: str, seed: int = 0) -> DataFrame | None:
    """Training or scoring of df's rows by lm.java, which does what _train_shards or log_probabilities does; None where it can't run."""
    if (STRIDE, DIM, HIDDEN) != (16, 16, 32) or CLASSES % 16:
        return None
    constants = {"CLASSES": CLASSES, "OWN": OWN, "LEAVES": LEAVES}
    (vocabulary, _), (places, _), wide = p["word"].shape, p["place"].shape, classes.log_in.shape[1]
    dense = flat(p, [*SHAPES, "sub", "place"])
    sizes = [vocabulary, places, wide, SHARD, BATCH, np.dtype(_width(vocabulary)).itemsize, len(dense), 0]
    model = jvm.packed(seed, RATE, sizes, [dense, p["word"]], [classes.of, classes.leaf, classes.place], [classes.log_sub, classes.log_in])
    return jvm.kernel(df, constants, model, training, schema)


def fit(coded: DataFrame, vocabulary: int, rounds: int = ROUNDS) -> tuple[Classes, dict]:
    """The model of settled (doc_id, ids). What comes back to the driver is one number for each weight."""
    counts = coded.select("ids").mapInArrow(_count(vocabulary), "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    classes = Classes(np.array(counts["id"], np.int64), np.array(counts["n"], np.int64), vocabulary)
    words = word_shapes(vocabulary, classes.members.shape[1])
    shapes = SHAPES | words
    p = initial() | {k: np.zeros(s, np.float32) for k, s in words.items()}
    for r in range(rounds):
        got = _kernel(coded.select("ids"), classes, p, True, "i int, n bigint, v bigint", r)
        if got is None:
            got = coded.select("ids").mapInArrow(_train_shards(p, classes, shapes, r), "i array<int>, n array<bigint>, v array<bigint>").select(F.inline(F.arrays_zip("i", "n", "v")))
        mean = got.groupBy("i").agg((F.sum(F.col("v").cast("decimal(38,0)")) / F.sum("n")).cast("double").alias("v")).toArrow()
        if not mean.num_rows:
            break
        x = flat(p, shapes).astype(float)
        x[np.array(mean["i"])] = np.array(mean["v"], float) / 1e6
        p = unflat(x, shapes)
    return classes, p


def log_probabilities(ids: np.ndarray, first: np.ndarray, classes: Classes, p: dict) -> np.ndarray:
    """Of every subword, given those before it in its text."""
    place, *_ = layout(first)
    if "word" not in p:  # a model of classes alone: shares in them are those of the corpus
        x, y = windows(classes.of[ids], first)
        out = np.empty(y.shape, np.float32)
        for a in range(0, len(x), 512):
            t = y[a : a + 512]
            out[a : a + 512] = forward(p, x[a : a + 512], np.where(t == PAD, 0, t))
        return out.ravel()[place] + classes.log_share[ids]
    x, y = windows((ids + FIRST).astype(np.int32), first)
    tables = _tables(p, _vectors(p, classes.of, np.arange(FIRST + len(p["word"]))))
    out = np.empty(y.size, np.float32)
    for a in range(0, len(x), 16384):
        h = np.empty((y[a : a + 16384].size, DIM), np.float32)
        t = np.maximum(y[a : a + 16384].ravel() - FIRST, 0)
        for b in range(0, len(h), 512 * STRIDE):
            part = slice(b, b + 512 * STRIDE)
            at = a + b // STRIDE
            h[part] = hidden(p, tables, x[at : min(at + 512, a + 16384)])
            out[a * STRIDE + b : a * STRIDE + b + len(h[part])] = class_log(p, h[part], classes.of[t[part]])
        out[a * STRIDE : a * STRIDE + len(h)] += within(p, classes, h, t)
    return out[place]


def score(docs: DataFrame, path: str = TOKENIZER, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, nll, perplexity): mean negative log probability of each document's subwords.

    The model is trained on the same documents. `path` is a tokenizer's file that all machines have.
    A null or blank text has no subwords: n_tokens is 0 and the others are null. Repeated rows are
    trained on and scored each time. Other columns are ignored; an empty table gives an empty table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = settle(docs.select("doc_id", "text").mapInArrow(_tokenize(path), f"doc_id {kind}, ids binary"))
    vocabulary = Subwords(path).size
    classes, p = fit(coded, vocabulary, rounds)
    schema = f"doc_id {kind}, n_tokens bigint, nll double, perplexity double"
    got = _kernel(coded, classes, p, False, schema)
    if got is not None:
        return got

    def run(batches):
        for b, a, ids, first in _texts(batches, vocabulary):
            n = np.diff(first)
            lp = np.concatenate(([0.0], np.cumsum(log_probabilities(ids, first, classes, p), dtype=np.float64))) if len(ids) else np.zeros(1)
            nll = -(lp[first[1:]] - lp[first[:-1]]) / np.maximum(n, 1)
            none = n == 0
            yield pa.RecordBatch.from_arrays([b.column(0).slice(a, len(n)), pa.array(n), pa.array(nll, mask=none), pa.array(np.exp(nll), mask=none)], names=["doc_id", "n_tokens", "nll", "perplexity"])

    return coded.mapInArrow(run, schema)


def query(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
