"""N-gram Jaccard join with set-relation skipping.

Texts whose sets of word n-grams have a Jaccard similarity of at least a threshold, exactly
(n-grams are compared as 64-bit hashes, sets by 128 bits).

1. Each input split hashes its texts block by block. For every hash range a block sends its
   distinct n-grams, sorted and delta-coded; n-grams of several of its sets go there as a number
   only, and their lists of sets straight to the block's own reducer, so that an n-gram costs a range at most
   one entry for each block however common it is. A range's reducer sees every n-gram there is,
   so frequencies are exact and n-grams that occur in one set only, most of them, end there.
2. N-grams ordered from rare to common, a set of size n can only match where one of its first
   n - ceil(t n) + 1 n-grams (its prefix) matches. Those of one set only come first in this order,
   so sets with enough of them need no index at all.
3. Index skipping: an n-gram's list of sets is held in blocks of one set size, by position of the
   n-gram. Sizes out of proportion skip whole blocks, and within a block the position from which
   too few n-grams are left ends it. Lists of more than PART sets are split, and each pair of parts
   compared in a task of its own.
4. Answer skipping: sets that share prefixes gather at a common pivot. There the overlap of two
   sets follows from how each differs from a highly similar base set, without reading what they
   share: |y & z| = |x| - |x-y| - |x-z| + |(x-y) & (x-z)| + |(y-x) & (z-x)|. Sets with equal n-grams
   are one set, which has the same answers. Lists all of whose sets are at one pivot are skipped;
   pairs from different pivots are checked one by one.

Rows are carried as 128-bit hashes of id and text, so ids may have any type that can be ordered.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, settle, table, text_of, tidy, whole_row
from graphloom.llm.words import buffers, mix, pieces, shingle_sets

NGRAM, THRESHOLD = 3, 0.5
#: A block's n-grams and texts (a text's number has 16 bits), and bytes and texts that are hashed at once.
BLOCK_TOKENS, BLOCK_TEXTS, _PIECE, _PIECE_TEXTS = 500_000, 60_000, 1 << 18, 4096
#: Bytes of text to a range of hashes; from LARGE bytes on, ranges and blocks both grow with the root of the size.
RANGE_BYTES, LARGE = 4 << 20, 16 << 30
#: Postings to a range of lists.
RANGE_POSTINGS = 200_000
#: Sets of a pivot or list that are compared in one task; more are split, and each pair of parts compared.
PART = 4096
#: N-grams of such sets; longer sets make more parts.
PART_GRAMS = 1 << 20
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64()), ("na", pa.int64()), ("nb", pa.int64())])
_PAIRS_SQL = "a bigint, b bigint, both bigint, na bigint, nb bigint"
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.int64())])
_LINKS_SQL = "a bigint, b bigint, w bigint"
_DOCS, _COMMON, _SINGLE, _COUNTS = 0, 1, 2, 3


def pack(v: np.ndarray) -> bytes:
    """Sorted uint64 numbers as the first one and differences, byte plane by byte plane, without the planes that are all zero."""
    d = np.diff(v, prepend=v[:1])
    k = (int(d.max()).bit_length() + 7) // 8
    return v[:1].tobytes() + bytes([k]) + d.view(np.uint8).reshape(-1, 8).T[:k].tobytes()


def unpack(b: bytes, n: int) -> np.ndarray:
    d, k = np.zeros((n, 8), np.uint8), b[8]
    d[:, :k] = np.frombuffer(b, np.uint8, k * n, 9).reshape(k, n).T
    return np.frombuffer(b, np.uint64, 1)[0] + np.cumsum(d.view(np.uint64).ravel(), dtype=np.uint64)


def _prefix(n: int, t: float) -> int:
    return n - math.ceil(t * n - 1e-9) + 1


def _edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1], [True])))


def _table(rows: list, schema: pa.Schema) -> list:
    cols = list(zip(*rows)) or [()] * len(schema)
    return [pa.array(list(c), f.type) for c, f in zip(cols, schema)]


_SENT = pa.schema([("rng", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("size", pa.int64()), ("payload", pa.binary()), ("extra", pa.binary())])
_SENT_SQL = "rng int, block bigint, kind int, size bigint, payload binary, extra binary"


def _block_rows(block: int, ranges: int, keys: np.ndarray, sets: list[np.ndarray]):
    """A block's rows of _SENT: its documents; n-grams of several of its sets, with their lists; for each range the n-grams of one set, and the others' counts."""
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum(sizes)))
    sums = np.zeros((2, len(sets)), np.uint64)
    for k in (0, 1):
        m = np.concatenate(([np.uint64(0)], np.cumsum(mix(every + np.uint64(0x51ED27 + 77 * k)), dtype=np.uint64)))
        sums[k] = m[at[1:]] - m[at[:-1]]
    _, first, slot = np.unique(np.stack([sums[0], sums[1], sizes.astype(np.uint64)], axis=1), axis=0, return_index=True, return_inverse=True)
    slot = slot.ravel()
    yield block % ranges, block, _DOCS, len(sets), np.stack([*keys.view(np.uint64), sizes.astype(np.uint64), *sums, slot.astype(np.uint64)]).tobytes(), b""
    lead = np.zeros(len(sets), bool)
    lead[first] = True
    use = np.repeat(lead, sizes)
    v, own = every[use], np.repeat(slot, sizes)[use].astype(np.uint16)
    order = np.argsort(v, kind="stable")
    v, own = v[order], own[order]
    edges = _edges(v)
    token, count = v[edges[:-1]], np.diff(edges)
    some = count > 1
    if some.any():
        yield block % ranges, block, _COMMON, int(some.sum()), pack(token[some]), count[some].astype(np.uint32).tobytes() + own[np.repeat(some, count)].tobytes()
    cuts = np.searchsorted(token, np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64))
    starts = edges[:-1]
    for r, (a, z) in enumerate(zip(np.append(0, cuts).tolist(), np.append(cuts, len(token)).tolist())):
        one = ~some[a:z]
        if one.any():
            yield r, block, _SINGLE, int(one.sum()), pack(token[a:z][one]), own[starts[a:z][one]].tobytes()
        if not one.all():
            yield r, block, _COUNTS, int((~one).sum()), pack(token[a:z][~one]), np.minimum(count[a:z][~one], 255).astype(np.uint8).tobytes()


def _send(ranges: int, most: int, n: int):
    """Texts (h1, h2, text) to the rows of their blocks."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        number = task.partitionId() << 32 if task else 0
        keys, sets, held = [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays(_table(list(_block_rows(number, ranges, np.concatenate(keys, axis=1), sets)), _SENT), schema=_SENT)

        for batch in batches:
            raw, off = buffers(batch.column(2))
            h = np.stack([np.array(batch.column(c), np.int64) for c in (0, 1)])
            for a, z in pieces(off, _PIECE):
                for b in range(a, z, _PIECE_TEXTS):
                    e = min(b + _PIECE_TEXTS, z)
                    got = shingle_sets(raw[off[b] : off[e]], off[b : e + 1] - off[b], n)
                    has = np.array([len(s) > 0 for s in got])
                    if not has.any():
                        continue
                    keys.append(h[:, b:e][:, has])
                    sets += [s for s in got if len(s)]
                    held += sum(map(len, got))
                    if held >= most or len(sets) >= BLOCK_TEXTS:
                        yield flush()
                        number, keys, sets, held = number + 1, [], [], 0
        if sets:
            yield flush()

    return run


_BACK = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("rng", pa.int32()), ("size", pa.int64()), ("payload", pa.binary()), ("extra", pa.binary()), ("df", pa.binary())])
_BACK_SQL = "block bigint, kind int, rng int, size bigint, payload binary, extra binary, df binary"


def _count(part: pa.Table) -> pa.Table:
    """A range: to each block the frequencies of what it counted, and those of its single n-grams that others have too (255 stands for all above)."""
    rng, block, kind, size, payload, extra = (part[c].to_pylist() for c in _SENT.names)
    rows = [(b, k, r, s, p, x, b"") for r, b, k, s, p, x in zip(rng, block, kind, size, payload, extra) if k in (_DOCS, _COMMON)]
    asked = [i for i, k in enumerate(kind) if k in (_SINGLE, _COUNTS)]
    if asked:
        tokens = [unpack(payload[i], size[i]) for i in asked]
        token = np.concatenate(tokens)
        number = np.concatenate([np.ones(size[i], np.int64) if kind[i] == _SINGLE else np.frombuffer(extra[i], np.uint8).astype(np.int64) for i in asked])
        order = np.argsort(token, kind="stable")
        edges = _edges(token[order])
        df = np.empty(len(token), np.int64)
        df[order] = np.repeat(np.add.reduceat(number[order], edges[:-1]), np.diff(edges))
        df = np.minimum(df, 255)
        at = 0
        for i, v in zip(asked, tokens):
            d = df[at : at + len(v)]
            at += len(v)
            if kind[i] == _COUNTS:
                rows.append((block[i], _COUNTS, rng[i], len(v), b"", b"", d.astype(np.uint8).tobytes()))
            elif (m := d > 1).any():
                rows.append((block[i], _SINGLE, rng[i], int(m.sum()), pack(v[m]), np.frombuffer(extra[i], np.uint16)[m].tobytes(), d[m].astype(np.uint8).tobytes()))
    return pa.Table.from_arrays(_table(rows, _BACK), schema=_BACK)


_SETS = pa.schema([("sid", pa.int64()), ("check", pa.int64()), ("n", pa.int64()), ("single", pa.int64()), ("pre", pa.int64()), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64())), ("grams", pa.list_(pa.int64()))])
_SETS_SQL = "sid bigint, check bigint, n bigint, single bigint, pre bigint, h1 array<bigint>, h2 array<bigint>, grams array<bigint>"


def _sets_of_block(t: float):
    def run(part: pa.Table) -> pa.Table:
        """A block's sets that can match another: their rows, their n-grams that others have too, rare ones first, and how many of those are in the prefix."""
        rng, kind, size, payload, extra, df = (part[c].to_pylist() for c in ("rng", "kind", "size", "payload", "extra", "df"))
        where = {k: sorted((i for i, x in enumerate(kind) if x == k), key=lambda i: rng[i]) for k in range(4)}
        i = where[_DOCS][0]
        h1, h2, n, s1, s2, slot = np.frombuffer(payload[i], np.uint64).reshape(6, size[i])
        token, own, f = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.uint8)]
        for i in where[_COMMON]:
            count = np.frombuffer(extra[i], np.uint32, size[i])
            token.append(np.repeat(unpack(payload[i], size[i]), count))
            own.append(np.frombuffer(extra[i], np.uint16, int(count.sum()), 4 * size[i]))
            # Ranges are in the order of n-grams, so their frequencies one after another are those of the sorted n-grams.
            f.append(np.repeat(np.frombuffer(b"".join(df[j] for j in where[_COUNTS]), np.uint8), count))
        for i in where[_SINGLE]:
            token.append(unpack(payload[i], size[i]))
            own.append(np.frombuffer(extra[i], np.uint16))
            f.append(np.frombuffer(df[i], np.uint8))
        token, own, f = (np.concatenate(x) for x in (token, own, f))
        order = np.lexsort((token, f, own))
        own, token = own[order], token[order].view(np.int64)
        by = np.argsort(slot, kind="stable")
        edges = _edges(slot[by])
        rows = []
        bounds = np.searchsorted(own, np.arange(len(edges)))
        for k, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            at, lo, hi = by[a], int(bounds[k]), int(bounds[k + 1])
            single = int(n[at]) - (hi - lo)
            pre = min(max(0, _prefix(int(n[at]), t) - single), hi - lo)
            if pre or z - a > 1:
                rows.append((int(s1[at].view(np.int64)), int(s2[at].view(np.int64)), int(n[at]), single, pre, h1[by[a:z]].view(np.int64), h2[by[a:z]].view(np.int64), token[lo:hi]))
        return pa.Table.from_arrays(_table(rows, _SETS), schema=_SETS)

    return run


def row_key(id_: Column, text: Column) -> tuple[Column, Column]:
    """128 bits of a row's id and text: rows alike in both are one."""
    return F.xxhash64(F.lit(1), id_, text).alias("h1"), F.xxhash64(F.lit(2), id_, text).alias("h2")


def distinct_sets(docs: DataFrame, n: int, t: float, text_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(sid, n, single, pre, k, grams) of the distinct sets that have a copy or may have a partner, k being the number of their rows; and (h1, h2, sid) of each of their rows.

    `docs` has h1, h2 and text; text_bytes, which partitions are sized by, need not be exact.
    """
    grown = max(1.0, math.sqrt(text_bytes / LARGE))
    ranges = max(1, math.ceil(text_bytes / (RANGE_BYTES * grown)))
    texts = docs.select("h1", "h2", F.lower("text").alias("text")).where("text is not null")
    sent = texts.mapInArrow(_send(ranges, int(BLOCK_TOKENS * min(grown, 16.0)), n), _SENT_SQL)
    # What was sent is twice the input at times: it is let go before what was counted is shuffled.
    counted = settle(sent.groupBy("rng").applyInArrow(_count, _BACK_SQL))
    del texts, sent
    tidy(docs.sparkSession)
    sets = counted.groupBy("block").applyInArrow(_sets_of_block(t), _SETS_SQL)
    # A row for the set, and one for its rows in this block: a set's rows are never all in one place.
    none = F.lit(None)
    part = F.array(
        F.struct(none.cast("bigint").alias("of"), F.size("h1").cast("bigint").alias("k"), none.cast("array<bigint>").alias("h1"), none.cast("array<bigint>").alias("h2"), F.col("grams").alias("grams")),
        F.struct(F.xxhash64("h1", "h2").alias("of"), F.lit(0).cast("bigint").alias("k"), F.col("h1").alias("h1"), F.col("h2").alias("h2"), none.cast("array<bigint>").alias("grams")),
    )
    both = sets.select("sid", "check", "n", "single", "pre", F.explode(part).alias("p")).select("sid", "check", "n", "single", "pre", "p.*")
    one = both.groupBy("sid", "check", "n", "of").agg(F.first("single").alias("single"), F.first("pre").alias("pre"), F.sum("k").alias("k"), F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.first("grams").alias("grams"))
    one = settle(one.drop("check"))
    discard(counted)
    members = one.where("of is not null").select("sid", F.explode(F.arrays_zip("h1", "h2")).alias("h")).select("h.h1", "h.h2", "sid").distinct()
    return one.where("of is null").select("sid", "n", "single", "pre", "k", "grams"), members


def _postings(sets: DataFrame) -> DataFrame:
    p = sets.where("pre > 0").select("sid", "n", "single", *(["pivot"] if "pivot" in sets.columns else []), F.posexplode(F.slice("grams", F.lit(1), F.col("pre").cast("int"))).alias("j", "gram"))
    return p.withColumn("pos", F.col("single") + F.col("j")).drop("single", "j")


def with_pivots(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`sets` that share a prefix n-gram, with pivot: of the first sets of the lists a set is in, the one it meets most often; and (gram, head, c) of the lists."""
    lists = settle(_postings(sets).groupBy("gram").agg(F.min("sid").alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1"))
    met = _postings(sets).select("sid", "gram").join(lists.select("gram", "head"), "gram").groupBy("sid", "head").agg(F.count(F.lit(1)).alias("c"))
    pivot = met.groupBy("sid").agg(F.min(F.struct(-F.col("c"), F.col("head"))).alias("m")).select("sid", F.col("m.head").alias("pivot"))
    return settle(sets.join(pivot, "sid").select("sid", "n", "single", "pre", "k", "grams", "pivot")), lists


def _need(a, b, t: float):
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


def _cross_pairs(t: float):
    def run(part: pa.Table) -> pa.Table:
        """Lists of n-grams, or two parts of one, to pairs of sets at different pivots, by blocks of one size in order of position."""
        gram, sid, n, pos, pivot, side = (np.array(part[c]) for c in ("gram", "sid", "n", "pos", "pivot", "part"))
        two = part["i"][0].as_py() != part["j"][0].as_py()
        order = np.lexsort((pos, n, gram))
        gram, sid, n, pos, pivot, side = (x[order] for x in (gram, sid, n, pos, pivot, side))
        got, held = [], 0
        edges = _edges(gram).tolist()
        for a, z in zip(edges[:-1], edges[1:]):
            if z - a < 2 or (pivot[a:z] == pivot[a]).all():
                continue
            sizes = (a + _edges(n[a:z])).tolist()
            for i in range(len(sizes) - 1):  # sets of the larger size x look for partners in blocks of sizes up to theirs
                nx, least = n[sizes[i]], math.ceil(t * n[sizes[i]] - 1e-9)
                for j in range(i, -1, -1):
                    ny = n[sizes[j]]
                    if ny < least:
                        break
                    need = _need(nx, ny, t)
                    last_x = int(np.searchsorted(pos[sizes[i] : sizes[i + 1]], nx - need, side="right"))  # 1 + what is left after the position >= need
                    last_y = int(np.searchsorted(pos[sizes[j] : sizes[j + 1]], ny - need, side="right"))
                    if not (last_x and last_y):
                        continue
                    step = max(1, (1 << 20) // last_y)
                    for s in range(0, last_x, step):
                        x, y = np.arange(sizes[i] + s, sizes[i] + min(s + step, last_x)), np.arange(sizes[j], sizes[j] + last_y)
                        x, y = np.repeat(x, len(y)), np.tile(y, len(x))
                        m = (pivot[x] != pivot[y]) & ((x > y) if i == j else True) & ((side[x] != side[y]) if two else True)
                        got.append(np.stack([np.minimum(sid[x[m]], sid[y[m]]), np.maximum(sid[x[m]], sid[y[m]])]))
                        held += len(got[-1][0])
                        if len(got) > 256 or held > 1 << 22:
                            got = [np.unique(np.concatenate(got, axis=1), axis=1)]
                            held = 0
        p = np.unique(np.concatenate(got, axis=1), axis=1) if got else np.zeros((2, 0), np.int64)
        return pa.table([pa.array(p[0]), pa.array(p[1])], names=["a", "b"])

    return run


class _Lists:
    """Lists of members by token number, for counting how often each member is met."""

    def __init__(self, token: np.ndarray, who: np.ndarray, tokens: int, members: int):
        order = np.argsort(token, kind="stable")
        self.who, self.at, self.members = who[order], np.searchsorted(token[order], np.arange(tokens + 1)), members

    def met(self, tokens: np.ndarray) -> np.ndarray:
        lens = self.at[tokens + 1] - self.at[tokens]
        ends = np.cumsum(lens)
        if not len(ends) or not ends[-1]:
            return np.zeros(self.members, np.int64)
        where = np.arange(ends[-1]) + np.repeat(self.at[tokens] - (ends - lens), lens)
        return np.bincount(self.who[where], minlength=self.members)


def _answers(t: float, part: pa.Table):
    """For each set of one part, or of two parts, of a pivot in turn: its number, those of its partners with which it wasn't met before, and the overlaps.

    The base x is the set whose n-grams are commonest here. Sets near it are indexed by what they
    lack of it and have besides it, the others by all they have.
    """
    sid, n, side = (np.array(part[c]) for c in ("sid", "n", "part"))
    two = part["i"][0].as_py() != part["j"][0].as_py()
    lens = np.array(part["grams"].combine_chunks().value_lengths(), np.int64)
    uniq, tok = np.unique(np.array(part["grams"].combine_chunks().flatten()), return_inverse=True)
    k, u = len(sid), len(uniq)
    off = np.concatenate(([0], np.cumsum(lens)))
    own = np.repeat(np.arange(k), lens)
    x = int(np.argmax(np.bincount(own, weights=np.bincount(tok, minlength=u)[tok], minlength=k) / np.maximum(lens, 1)))
    in_base = np.zeros(u, bool)
    in_base[tok[off[x] : off[x + 1]]] = True
    base = np.flatnonzero(in_base)
    common = np.bincount(own[in_base[tok]], minlength=k)
    near = 2 * common > np.maximum(lens, len(base))
    lacks = []
    for i in np.flatnonzero(near):
        present = in_base.copy()
        present[tok[off[i] : off[i + 1]]] = False
        lacks.append(np.flatnonzero(present))
    lack = dict(zip(np.flatnonzero(near).tolist(), lacks))
    nl = np.array([len(lack[i]) if i in lack else 0 for i in range(k)])
    extra = near[own] & ~in_base[tok]
    lacking = _Lists(np.concatenate([np.zeros(0, np.int64), *lacks]), np.repeat(np.arange(k), nl), u, k)
    besides = _Lists(tok[extra], own[extra], u, k)
    whole = _Lists(tok[~near[own]], own[~near[own]], u, k)
    order = np.lexsort((sid, n))
    rank = np.empty(k, np.int64)
    rank[order] = np.arange(k)
    ns = n[order]
    for i in range(k):
        # Partners of sizes in proportion, each pair once: from the set later in order of size.
        cand = order[int(np.searchsorted(ns, math.ceil(t * n[i] - 1e-9))) : rank[i]]
        if two:
            cand = cand[side[cand] != side[i]]
        if not len(cand):
            continue
        mine = tok[off[i] : off[i + 1]]
        if near[i]:
            both = len(base) - nl[i] - nl + lacking.met(lack[i]) + besides.met(mine[~in_base[mine]])
        else:
            both = common[i] - lacking.met(mine[in_base[mine]]) + besides.met(mine[~in_base[mine]])
        both = np.where(near, both, whole.met(mine))[cand]
        m = both / (n[i] + n[cand] - both) >= t
        if m.any():
            yield i, cand[m], both[m]


def _pairs_at_pivot(t: float):
    def run(part: pa.Table) -> pa.Table:
        sid, n = (np.array(part[c]) for c in ("sid", "n"))
        out = [np.stack([np.full(len(c), sid[i]), sid[c], both, np.full(len(c), n[i]), n[c]]) for i, c, both in _answers(t, part)]
        p = np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)
        return pa.Table.from_arrays([pa.array(c.astype(np.int64)) for c in p], schema=_PAIRS)

    return run


def _links_at_pivot(t: float):
    def run(part: pa.Table) -> pa.Table:
        """(a, null, w): a has w rows as partners here; (a, b, null): enough pairs to connect what all pairs connect."""
        sid, rows = (np.array(part[c]) for c in ("sid", "k"))
        total, label, edges = np.zeros(len(sid), np.int64), np.arange(len(sid)), []
        for i, c, _ in _answers(t, part):
            total[i] += rows[c].sum()
            total[c] += rows[i]
            labels, first = np.unique(label[c], return_index=True)
            new = labels != label[i]
            if new.any():
                edges += [(int(sid[i]), int(sid[c[f]]), None) for f in first[new]]
                hit = np.zeros(len(sid), bool)
                hit[labels] = True
                label[hit[label]] = label[i]
        return pa.Table.from_arrays(_table([(int(sid[i]), None, int(total[i])) for i in np.flatnonzero(total)] + edges, _LINKS), schema=_LINKS)

    return run


def _check_pairs(t: float):
    def run(batches):
        for b in batches:
            n = [np.array(b.column(c)) for c in ("na", "nb")]
            both = np.array([len(np.intersect1d(np.array(x.values), np.array(y.values), assume_unique=True)) for x, y in zip(b.column("ga"), b.column("gb"))], np.int64)
            m = both / np.maximum(n[0] + n[1] - both, 1) >= t
            yield pa.RecordBatch.from_arrays([*[b.column(c).filter(pa.array(m)) for c in ("a", "b", "na", "nb", "ka", "kb")], pa.array(both[m])], names=["a", "b", "na", "nb", "ka", "kb", "both"])

    return run


def _parted(df: DataFrame, rows: str) -> DataFrame:
    """Rows of a group of `rows` rows as members of each pair (i, j) of parts that they are in."""
    parts = F.ceil(F.col(rows) / PART).cast("int")
    m = df.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return m.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("parts", "other")


def _compared(sets: DataFrame, t: float, links: bool) -> DataFrame:
    if "k" not in sets.columns:
        sets = sets.withColumn("k", F.lit(1).cast("bigint"))
    p, lists = with_pivots(sets)
    postings = lists.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    ranges = max(1, math.ceil(postings / RANGE_POSTINGS))
    long_ = settle(lists.where(F.col("c") > PART).select("gram", "c"))
    each = _postings(p).join(long_, "gram", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    each = _parted(each, "c").withColumn("rng", F.when(F.col("c") > 1, F.col("gram")).otherwise(F.pmod("gram", F.lit(ranges))))
    found = each.select("rng", (F.col("c") > 1).alias("long"), "i", "j", "gram", "sid", "n", "pos", "pivot", "part").groupBy("rng", "long", "i", "j").applyInArrow(_cross_pairs(t), "a bigint, b bigint").distinct()
    side = lambda x: p.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("k").alias(f"k{x}"), F.col("grams").alias(f"g{x}"))
    cross = found.join(side("a"), "a").join(side("b"), "b").mapInArrow(_check_pairs(t), "a bigint, b bigint, na bigint, nb bigint, ka bigint, kb bigint, both bigint")
    heavy = F.ceil(F.sum(F.size("grams")) * (PART / PART_GRAMS))
    many = p.groupBy("pivot").agg(F.count(F.lit(1)).alias("c"), heavy.alias("g")).where("c > 1").select("pivot", F.greatest("c", "g").alias("m"))
    m = _parted(p.select("sid", "n", "k", "grams", "pivot").join(many, "pivot"), "m").drop("m").groupBy("pivot", "i", "j")
    if not links:
        return m.applyInArrow(_pairs_at_pivot(t), _PAIRS_SQL).unionByName(cross.select(*_PAIRS.names))
    none = F.lit(None).cast("bigint")
    three = F.array(F.struct("a", "b", none.alias("w")), F.struct("a", none.alias("b"), F.col("kb").alias("w")), F.struct(F.col("b").alias("a"), none.alias("b"), F.col("ka").alias("w")))
    return m.applyInArrow(_links_at_pivot(t), _LINKS_SQL).unionByName(cross.select(F.inline(three).alias("a", "b", "w")))


def set_pairs(sets: DataFrame, t: float) -> DataFrame:
    """(a, b, both, na, nb): pairs of distinct sets that reach the threshold, each once."""
    return _compared(sets, t, links=False)


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Texts by row key, (h1, h2, doc_id) of all rows, and the bytes of all texts."""
    h1, h2 = row_key(F.col("doc_id"), F.col("text"))
    narrow = settle(docs.select(h1, h2, "doc_id", F.octet_length(text_of("text")).cast("bigint").alias("bytes")))
    return docs.select(h1, h2, "text"), narrow.select("h1", "h2", "doc_id"), narrow.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]


def _first_of(id_: str = "doc_id") -> Column:
    """By which the first of several rows is found: the smallest id, nulls last."""
    return F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("doc_id"), "h1", "h2")


def similar(docs: DataFrame, n: int = NGRAM, t: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, jaccard): pairs of different sets of n-grams at or above the threshold, each as the first documents that have them.

    Words, sets, nulls and ids are as in classes(). Documents with equal sets are one here, that with the smallest id.
    """
    texts, narrow, size = _keyed(docs)
    sets, members = distinct_sets(texts, n, t, size)
    pairs = set_pairs(sets, t)
    first = settle(members.join(narrow, ["h1", "h2"]).groupBy("sid").agg(F.min(_first_of()).alias("f")).select("sid", "f.doc_id"))
    x = pairs.join(first.select(F.col("sid").alias("a"), F.col("doc_id").alias("x")), "a").join(first.select(F.col("sid").alias("b"), F.col("doc_id").alias("y")), "b")
    return x.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def _grouped(docs: DataFrame, n: int, t: float) -> DataFrame:
    """(h1, h2, doc_id, g, links) of all rows: a number for each class of rows that links connect, null for a row without a link, and its links."""
    texts, narrow, size = _keyed(docs)
    sets, members = distinct_sets(texts, n, t, size)
    tidy(docs.sparkSession)
    found = settle(_compared(sets, t, links=True))
    tidy(docs.sparkSession)
    label = _components(settle(found.where("b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()))
    count = found.where("w is not null").groupBy(F.col("a").alias("sid")).agg(F.sum("w").alias("w"))
    of = sets.select("sid", "k").join(label, F.col("sid") == F.col("u"), "left").join(count, "sid", "left")
    of = of.select("sid", F.coalesce("v", "sid").alias("g"), (F.coalesce("w", F.lit(0)) + F.col("k") - 1).alias("links")).where("links > 0")
    rows = members.join(of, "sid").drop("sid")
    return settle(narrow.join(rows, ["h1", "h2"], "left").select("h1", "h2", "doc_id", "g", F.coalesce("links", F.lit(0)).cast("bigint").alias("links")))


def classes(docs: DataFrame, n: int = NGRAM, t: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links) for each row: how many other rows have a set of n-grams that is similar to its own, and the smallest doc_id of its class, which is what links connect.

    Words are runs of ASCII letters, digits and non-ASCII characters of the text in lower case. A
    text of fewer than n words has one n-gram, of all its words. Equal sets are linked, ties at the
    threshold count. Null, empty and wordless texts have no links. A row without links is its own
    class, with its own id. Rows with equal ids, null ids and repeated rows are rows of their own and
    count each; a class's null ids come last, and if all are null so is class_id. Ids may have any
    type that can be ordered. Other columns are ignored; an empty table gives an empty table.

    The result has a row for each input row whatever the groups of copies are: their pairs are counted, not listed.
    """
    r = _grouped(docs, n, t)
    least = r.where("g is not null").groupBy("g").agg(F.min("doc_id").alias("class_id"))
    linked = r.where("g is not null").join(least, "g").select("doc_id", "class_id", "links")
    return linked.unionByName(r.where("g is null").select("doc_id", F.col("doc_id").alias("class_id"), "links"))


def _components(edges: DataFrame) -> DataFrame:
    """(u, v): each node but the least of its component, and that least node, by alternating large and small stars."""
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A hub's edges are never all in one place: least neighbours are aggregated and joined back.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = settle(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        was, edges = edges, settle(small)
        discard(was, large)
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).collect()[0]
        if now == before:
            return edges
        before = now


def keep_documents(docs: DataFrame, n: int = NGRAM, t: float = THRESHOLD) -> DataFrame:
    """Of each class (see classes()) the row with the smallest doc_id, nulls last, and all rows without links; columns as in `docs`.

    What goes is decided by row: of rows with one id and different texts only those with a partner
    go, and rows with null ids go like others. Of rows alike in id and text one stays.
    """
    r = _grouped(docs, n, t).where("g is not null")
    first = r.groupBy("g").agg(F.min(_first_of()).alias("f")).select("g", F.col("f.h1").alias("k1"), F.col("f.h2").alias("k2"))
    rows = r.select("g", "h1", "h2").join(first, "g").groupBy("h1", "h2").agg(F.max((F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).alias("stays"), F.count(F.lit(1)).alias("c"))
    rows = settle(rows.where("not stays or c > 1"))
    h1, h2 = row_key(F.col("doc_id"), F.col("text"))
    whole = docs.select(whole_row(docs), h1, h2)
    # Texts are shuffled once; only for rows that are alike, mostly few, they are gone through again.
    once = whole.join(rows.select("h1", "h2"), ["h1", "h2"], "left_anti").select("__row.*")
    again = settle(rows.where("stays").select("h1", "h2"))
    tidy(docs.sparkSession)
    if again.isEmpty():
        return once
    return once.unionByName(whole.join(again, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select("__row.*"))


def query(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
w AS (SELECT r, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM d WHERE text IS NOT NULL),
g AS (
  SELECT r, list_distinct(CASE WHEN len(ws) < {NGRAM} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {NGRAM} + 2), lambda i: array_to_string(ws[i : i + {NGRAM} - 1], ' ')) END) AS gs
  FROM w WHERE len(ws) > 0),
e AS (SELECT r, len(gs) AS n, unnest(gs) AS gram FROM g),
c AS (
  SELECT a.r AS x, b.r AS y, count(*) AS o, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.gram = b.gram AND a.r < b.r GROUP BY 1, 2),
p AS (SELECT x, y FROM c WHERE o::DOUBLE / (na + nb - o) >= {THRESHOLD}),
s AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
q(r, m) AS (SELECT x, y FROM s UNION SELECT q.r, s.y FROM q JOIN s ON q.m = s.x),
k AS (SELECT q.r, min(d.doc_id) AS class_id FROM q JOIN d ON d.r = q.m GROUP BY q.r),
l AS (SELECT x AS r, count(*) AS links FROM s GROUP BY x)
SELECT d.doc_id, CASE WHEN l.r IS NULL THEN d.doc_id ELSE k.class_id END AS class_id, coalesce(l.links, 0)::BIGINT AS links
FROM d LEFT JOIN l ON l.r = d.r LEFT JOIN k ON k.r = d.r
"""
