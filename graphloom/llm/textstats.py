"""Counts over whole texts, many texts at a time, straight from Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.llm.words import buffers, mix, pieces, word_hashes

NAMES = ["bytes", "words", "upper", "digits", "marks", "lines", "word_bytes", "distinct", "top", "repeats", "near_words", "near_triples"]
#: Words back in which a word, and a word triple, is looked for again: what is counted so doesn't depend on a text's length.
NEAR_WORDS, NEAR_TRIPLES = 64, 1024
_PIECE = 1 << 18
_CLASSES = np.zeros((256, 5), bool)
_CLASSES[65:91, 0] = True
_CLASSES[48:58, 1] = True
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _CLASSES[_c, 2] = True
_CLASSES[10, 3] = True
_CLASSES[128:, 4] = True
_CLASSES[48:58, 4] = _CLASSES[65:91, 4] = _CLASSES[97:123, 4] = True


def _sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    got = np.add.reduceat(np.append(mask, False), np.minimum(off[:-1], len(mask)), dtype=np.int64)
    return np.where(off[1:] > off[:-1], got, 0)


def _again(h: np.ndarray, at: np.ndarray, doc: np.ndarray, docs: int, near: int) -> tuple[np.ndarray, ...]:
    """For each text, of the hashes h at positions `at`: how many differ, how often the commonest occurs, and how many occur up to `near` positions before."""
    if not len(at):
        return (np.zeros(docs, np.int64),) * 3
    # One sort of (text and hash, position): the positions of equal ones follow each other.
    bits = np.uint64(int(at[-1]).bit_length())
    key = mix(h[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> bits << bits | at.astype(np.uint64)
    key.sort()
    pos = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    key >>= bits
    same = key[1:] == key[:-1]
    edges = np.flatnonzero(np.concatenate(([True], ~same, [True])))
    of = doc[pos[edges[:-1]]]
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, of, np.diff(edges))
    hit = pos[1:][same & (pos[1:] - pos[:-1] <= near)]
    return np.bincount(of, minlength=docs), top, np.bincount(doc[hit], minlength=docs)


def stats(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text: a mark is ASCII punctuation, top the count of the commonest word, repeats the word triples that came before in the text, near the words and triples that came shortly before."""
    out = np.zeros((len(off) - 1, len(NAMES)))
    for a, z in pieces(off, _PIECE):
        r, o = raw[off[a] : off[z]], off[a : z + 1] - off[a]
        part = out[a:z]
        part[:, 0] = np.diff(o)
        for to, c in ((2, 0), (3, 1), (4, 2), (5, 3), (6, 4)):
            part[:, to] = _sums(_CLASSES[:, c][r], o)
        part[:, 5] += part[:, 0] > 0
        w, first = word_hashes(r, o)
        n = np.diff(first)
        part[:, 1] = n
        doc = np.repeat(np.arange(z - a), n)
        part[:, 7], part[:, 8], part[:, 10] = _again(w, np.arange(len(w)), doc, z - a, NEAR_WORDS)
        t = mix(w[:-2] + w[1:-1] * np.uint64(3) + w[2:] * np.uint64(7)) if len(w) > 2 else w[:0]
        whole = np.flatnonzero(doc[2:] == doc[:-2])
        different, _, part[:, 11] = _again(t, whole, doc, z - a, NEAR_TRIPLES)
        part[:, 9] = np.maximum(n - 2, 0) - different
    return out


#: Bytes and words of an ordinary text that are added to each, so that a few words can't make an extreme share.
PRIOR_BYTES, PRIOR_WORDS = 200, 40
VECTOR = ["log words", "log bytes a word", "upper", "digits", "marks", "log distinct", "log bytes a line", "top", "repeats"]


def _share(k: np.ndarray, n: np.ndarray, usual: float, prior: float) -> np.ndarray:
    return np.arcsin(np.sqrt(np.clip((k + usual * prior) / (n + prior), 0, 1)))


def vectors(s: np.ndarray) -> np.ndarray:
    """Statistics made about normal: logarithms of sizes, arcsines of the roots of shares."""
    b, w = s[:, 0], s[:, 1]
    return np.stack([
        np.log(w + 10), np.log((s[:, 6] + 5.5 * PRIOR_WORDS) / (w + PRIOR_WORDS)), _share(s[:, 2], b, 0.02, PRIOR_BYTES), _share(s[:, 3], b, 0.001, PRIOR_BYTES), _share(s[:, 4], b, 0.02, PRIOR_BYTES),
        np.log(s[:, 7] + 10), np.log((b + PRIOR_BYTES) / (s[:, 5] + 1)), _share(s[:, 8], w, 0.05, PRIOR_WORDS), _share(s[:, 9], w, 0, PRIOR_WORDS),
    ], axis=1)


#: Statistics in which a text's size makes no difference.
ROBUST = ["log bytes a word", "upper", "digits", "marks", "near words", "line ends", "top", "near triples"]


def robust(s: np.ndarray) -> np.ndarray:
    b, w = s[:, 0], s[:, 1]
    return np.stack([
        np.log((s[:, 6] + 5.5 * PRIOR_WORDS) / (w + PRIOR_WORDS)), _share(s[:, 2], b, 0.02, PRIOR_BYTES), _share(s[:, 3], b, 0.001, PRIOR_BYTES), _share(s[:, 4], b, 0.02, PRIOR_BYTES),
        _share(s[:, 10], w, 0.05, PRIOR_WORDS), _share(np.maximum(s[:, 5] - 1, 0), b, 0.002, PRIOR_BYTES), _share(s[:, 8], w, 0.05, PRIOR_WORDS), _share(s[:, 11], w, 0, PRIOR_WORDS),
    ], axis=1)


def vector_of(text: Column) -> Column:
    """The vector of a text; null where it has no word."""

    @F.arrow_udf("array<double>")
    def f(t: pa.Array) -> pa.Array:
        s = stats(*buffers(t))
        v = robust(s)
        mask = s[:, 1] == 0
        at = np.concatenate(([0], np.cumsum(np.where(mask, 0, v.shape[1])))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(v[~mask].ravel()), mask=pa.array(mask))

    return f(text)
