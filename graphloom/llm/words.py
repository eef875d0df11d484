"""Vectorised word splitting and hashing of whole Arrow text columns.

A word is a longest run of ASCII letters, ASCII digits and non-ASCII characters; every other byte
separates words. Hashes are 64 bits wide. Nothing here loops over words or characters in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[128:] = True
for _lo, _hi in ((48, 57), (65, 90), (97, 122)):
    _WORD_BYTE[_lo : _hi + 1] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer with full avalanche (the public splitmix64 constants)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 2 * len(_POWERS), 64), _BASE, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, most: int):
    """Row ranges of at most about `most` bytes, of one row at least: bounds the memory of what follows."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and for each text the number of its first word (one more at the end)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = _WORD_BYTE[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cuts = off[(off > 0) & (off < n)]
    opens[cuts] = inside[cuts]
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    first = np.searchsorted(at, starts)
    lens = np.diff(np.append(first, len(at)))
    pos = np.arange(len(at)) - np.repeat(first, lens)
    h = np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * _powers(int(lens.max()))[pos], first)
    return mix(h + lens.astype(np.uint64)), np.searchsorted(starts, off).astype(np.int64)


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 13, 32]] = True


def token_counts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text the number of its runs of anything but blanks, tabs and line ends."""
    out = np.zeros(len(off) - 1, np.int64)
    for a, z in pieces(off, 1 << 20):
        o = off[a : z + 1] - off[a]
        inside = ~_BLANK[raw[off[a] : off[z]]]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        cuts = o[(o > 0) & (o < len(inside))]
        opens[cuts] = inside[cuts]
        at = np.searchsorted(np.flatnonzero(opens), o)
        out[a:z] = np.diff(at)
    return out


def shingle_sets(raw: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams; a text of 1 to n-1 words has one, of all its words."""
    w, first = word_hashes(raw, off)
    mul = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    if len(w) >= n:
        g = np.zeros(len(w) - n + 1, np.uint64)
        for i in range(n):
            g += w[i : len(w) - n + 1 + i] * mul[i]
        g = mix(g)
    else:
        g = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            s = np.sort(g[a : b - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mix((w[a:b] * mul[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
