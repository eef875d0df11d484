"""Best-fit packing with swap-based local search.

Texts become pieces of at most a bin's capacity. Pieces are dealt at random into groups of about
`BINS` bins each, so that groups are alike at every size of the corpus; a group is packed best-fit
in decreasing order, and then bins with room exchange pieces one for one, two for one and one for
two, or take pieces over, always so that the sum of squared fills rises: the emptier bins give to
the fuller ones until none can or they are empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import settle, table, text_of
from graphloom.llm.mixing import words_in

CAPACITY, BINS = 2048, 1024


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece, pieces being given in decreasing order: each goes where it leaves the least room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, out, n = 0, np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        fits = open_ >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ &= ~(1 << r)
        else:
            r, b, n = capacity, n, n + 1
        out[i] = b
        if r > s:
            room[r - s].append(b)
            open_ |= 1 << (r - s)
    return out


def _pairs(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions with the same bin."""
    order = np.argsort(bins, kind="stable")
    s = bins[order]
    first, second, k = [], [], 1
    while True:
        m = np.flatnonzero(s[k:] == s[:-k]) if k < len(s) else np.zeros(0, np.int64)
        if not len(m):
            break
        first.append(order[m])
        second.append(order[m + k])
        k += 1
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, np.int64),) * 2


def local_search(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Bins after all improving moves that a sweep over the bins, emptiest first, finds; sweeps end when one finds none."""
    bins = bins.copy()
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    while True:
        moved = False
        part = np.flatnonzero(fill[bins] < capacity)  # pieces of bins with room
        if not len(part):
            return bins
        size, at = sizes[part], bins[part]
        p, q = _pairs(at)
        both = size[p] + size[q]
        for a in np.argsort(fill, kind="stable").tolist():
            if not 0 < fill[a] < capacity:
                continue
            while True:
                mine = np.flatnonzero(at == a)
                if not len(mine):
                    break
                room = capacity - fill
                # A bin as full as this one, or fuller, may take: what it gains then raises the sum of squares.
                takes = (fill >= fill[a]) & (room > 0)
                takes[a] = False
                ok, gap = takes[at], room[at]
                ok2 = takes[at[p]] & (at[p] == at[q])
                best, move = 0, None
                into = np.flatnonzero(takes)
                i2, j2 = np.triu_indices(len(mine), 1)
                gives = [(size[x], (x,)) for x in mine.tolist()] + [(size[mine[i]] + size[mine[j]], (int(mine[i]), int(mine[j]))) for i, j in zip(i2, j2)]
                for s, xs in gives:
                    if len(xs) == 1 and len(into):
                        # Moving a piece: the fullest bin that has room for it.
                        can = into[room[into] >= s]
                        if len(can):
                            b = can[np.argmax(fill[can])]
                            if (gain := (s + fill[b] - fill[a]) * s) > best:
                                best, move = gain, (xs, (), b)
                    d = s - size
                    g = np.where(ok & (d > 0) & (d <= gap), d * (d + fill[at] - fill[a]), 0)
                    y = int(np.argmax(g))
                    if g[y] > best:
                        best, move = g[y], (xs, (y,), at[y])
                    if len(xs) == 1 and len(p):
                        d = s - both
                        g = np.where(ok2 & (d > 0) & (d <= gap[p]), d * (d + fill[at[p]] - fill[a]), 0)
                        y = int(np.argmax(g))
                        if g[y] > best:
                            best, move = g[y], (xs, (int(p[y]), int(q[y])), at[p[y]])
                if move is None:
                    break
                xs, ys, b = move
                d = sum(size[x] for x in xs) - sum(size[y] for y in ys)
                at[list(xs)] = b
                at[list(ys)] = a
                fill[b] += d
                fill[a] -= d
                moved = True
        bins[part] = at
        if not moved:
            return bins


def _pack_group(capacity: int):
    def run(g: pa.Table) -> pa.Table:
        n = np.array(g["length"], np.int64)
        order = np.array(g.select(["length", "doc_key", "start"]).append_column("row", pa.array(np.arange(len(n)))).sort_by([("length", "descending"), ("doc_key", "ascending"), ("start", "ascending")])["row"])
        g, n = g.take(pa.array(order)), n[order]
        bins = local_search(n, best_fit(n, capacity), capacity)
        _, bins = np.unique(bins, return_inverse=True)
        fill = np.bincount(bins, weights=n).astype(np.int64)
        by = np.lexsort((np.arange(len(n)), bins))
        slot = np.empty(len(n), np.int64)
        starts = np.searchsorted(bins[by], bins[by])
        slot[by] = np.arange(len(n)) - starts
        return pa.table({"pack": g["pack"], "bin": pa.array(bins.astype(np.int64)), "slot": pa.array(slot), "doc_id": g["doc_id"], "start": g["start"], "length": g["length"], "bin_fill": pa.array(fill[bins])})

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, bins: int = BINS) -> DataFrame:
    """(pack, bin, slot, doc_id, start, length, bin_fill): where each piece of each text goes.

    A piece is `length` tokens of the text from token `start`; a text longer than a bin gives full
    pieces and a rest. No bin of a pack holds more than `capacity` tokens, and every token is in one
    bin. Null, empty and blank texts have no piece. Repeated rows, and rows with null ids, are packed
    each by itself. Ties in size are packed by the hash of document and text. Other columns are ignored; an empty
    table gives an empty table.
    """
    n = words_in(text_of("text"))
    key = F.xxhash64(F.col("doc_id"), F.md5(text_of("text").cast("binary")))
    d = settle(docs.select("doc_id", key.alias("doc_key"), n.alias("n")).where("n > 0"))
    total = d.agg(F.greatest(F.ceil(F.sum("n") / (capacity * bins)), F.lit(1)).cast("int").alias("packs"))
    d = d.crossJoin(F.broadcast(total)).withColumn("pack", F.pmod(F.xxhash64("doc_key", "n"), F.col("packs")).cast("int"))
    p = d.withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(capacity).cast("bigint"))))
    p = p.select("pack", "doc_id", "doc_key", "start", F.least(F.col("n") - F.col("start"), F.lit(capacity)).cast("bigint").alias("length"))
    out = f"pack int, bin bigint, slot bigint, doc_id {d.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, bin_fill bigint"
    return p.groupBy("pack").applyInArrow(_pack_group(capacity), out)


def query(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
