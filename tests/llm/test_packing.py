import itertools
from collections import defaultdict

import numpy as np

from graphloom.llm.packing import best_fit, local_search, pack


def naive_best_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        fits = [r for r in room if r >= s]
        if fits:
            b = max(i for i, r in enumerate(room) if r == min(fits))
            room[b] -= s
        else:
            b = len(room)
            room.append(capacity - s)
        out.append(b)
    return room, out


def test_best_fit_leaves_the_same_room():
    r = np.random.default_rng(0)
    sizes = np.sort(r.integers(1, 101, 500))[::-1]
    room, _ = naive_best_fit(sizes.tolist(), 100)
    bins = best_fit(sizes, 100)
    assert sorted((100 - np.bincount(bins, weights=sizes)).astype(int).tolist()) == sorted(room)


def improves(sizes, bins, capacity):
    """Whether any move, or exchange of one for one, two for one or one for two, raises the sum of squared fills."""
    fill = np.bincount(bins, weights=sizes)
    inside = [[i for i in range(len(sizes)) if bins[i] == b] for b in range(len(fill))]
    groups = [[(x,) for x in m] + list(itertools.combinations(m, 2)) for m in inside]

    def better(a, b, d):  # d goes from bin a to bin b
        return d > 0 and fill[b] + d <= capacity and fill[a] < capacity and fill[b] < capacity and (fill[b] + d) ** 2 + (fill[a] - d) ** 2 > fill[a] ** 2 + fill[b] ** 2 and fill[b] >= fill[a]

    for a, b in itertools.permutations(range(len(fill)), 2):
        if not inside[a] or not inside[b]:
            continue
        for xs in groups[a]:
            given = sum(sizes[x] for x in xs)
            if len(xs) == 1 and better(a, b, given):
                return True
            for ys in groups[b]:
                if len(xs) + len(ys) < 4 and better(a, b, given - sum(sizes[y] for y in ys)):
                    return True
    return False


def test_local_search_ends_at_a_local_optimum():
    r = np.random.default_rng(1)
    for k in range(6):
        sizes = np.sort(r.integers(20, 70, 40))[::-1]
        first = best_fit(sizes, 100)
        bins = local_search(sizes, first, 100)
        fill, before = np.bincount(bins, weights=sizes), np.bincount(first, weights=sizes)
        assert fill.max() <= 100 and (fill**2).sum() >= (before**2).sum() and (fill > 0).sum() <= (before > 0).sum()
        assert not improves(sizes, bins, 100), k


def test_every_token_is_in_one_bin(odd, odd_rows, clashing, empty):
    got = pack(odd, 64, 4).collect()
    tokens = defaultdict(int)
    fill = defaultdict(int)
    for r in got:
        tokens[r.doc_id] += r.length
        fill[r.pack, r.bin] += r.length
    want = defaultdict(int)
    for i, t, *_ in odd_rows:
        if t and t.split():
            want[i] += len(t.split())
    assert tokens == want
    assert all(fill[r.pack, r.bin] == r.bin_fill <= 64 for r in got)
    assert len({(r.pack, r.bin, r.slot) for r in got}) == len(got)
    pieces = sorted((r.start, r.length) for r in got if r.doc_id == 104)
    assert [s for s, _ in pieces] == list(range(0, 60_000, 64))
    assert pack(clashing, 64, 4).count() == len(got) and pack(empty).count() == 0
