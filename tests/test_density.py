"""HDBSCAN against the definition on all pairs, with blocks and tiles of many sizes."""

import numpy as np
import pytest

from tessella.operators import density
from tessella.scratch import Scratch


def brute(xy, least, k, single=False):
    """Clusters (as sets of indexes) by cutting the whole mutual-reachability graph at falling weights."""
    n = len(xy)
    if n < least:
        return set()
    d = np.sqrt(((xy[:, None] - xy) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(k, n - 1)]
    m = np.maximum(np.maximum(d, core[:, None]), core)
    np.fill_diagonal(m, np.inf)
    lam = lambda w: 1 / max(w, density.LEAST_WEIGHT)

    def parts(s, below):
        left, out = set(s), []
        while left:
            todo = [left.pop()]
            comp = set(todo)
            while todo:
                i = todo.pop()
                near = {j for j in left if m[i, j] < below}
                left -= near
                comp |= near
                todo += near
            out.append(comp)
        return out

    def widest(s):
        """The largest edge of the set's minimum tree."""
        s = sorted(s)
        best, seen, top = {j: m[s[0], j] for j in s[1:]}, s[0], 0.0
        while best:
            seen = min(best, key=best.get)
            top = max(top, best.pop(seen))
            for j in best:
                best[j] = min(best[j], m[seen, j])
        return top

    def grow(s, birth, root):
        """(best stability, its clusters) of a cluster's members."""
        whole, mass, now = frozenset(s), 0.0, set(s)
        while True:
            w = widest(now)
            comps = parts(now, w)
            large = [c for c in comps if len(c) >= least]
            mass += (len(now) - sum(map(len, large))) * (lam(w) - birth)
            if len(large) == 1:
                now = large[0]
                continue
            mass += sum(map(len, large)) * (lam(w) - birth)
            inner = [grow(c, lam(w), False) for c in large]
            below = sum(i[0] for i in inner)
            if (not large or mass >= below - 1e-12 * abs(below)) and (single or not root):
                return mass, {whole}
            return below, set().union(*[i[1] for i in inner])

    return grow(range(n), 0.0, True)[1]


def blobs(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(0, 100, (5, 2))
    parts = [rng.normal(c, rng.uniform(0.5, 4), (n // 6, 2)) for c in centres] + [rng.uniform(-20, 120, (n - 5 * (n // 6), 2))]
    return np.concatenate(parts)


def clusters(spark, xy, least, k, group=None, **how):
    names = ["id", "x", "y", "slide", "_x"]
    rows = [(i * 3 + 1, float(a), float(b), f"s{group[i]}" if group is not None else "s", "own") for i, (a, b) in enumerate(xy)]
    df = spark.createDataFrame(rows, "id long, x double, y double, slide string, _x string")
    assert df.columns == names
    out = density.hdbscan(df, "id", "x", "y", ["slide"] if group is not None else (), least, k, **how)
    assert out.columns == [*names, "cluster"]
    found = out.collect()
    assert len(found) == len(rows)
    sets = {}
    for r in found:
        if r.cluster >= 0:
            sets.setdefault((r.slide, r.cluster), set()).add((r.id - 1) // 3)
    assert all(sorted(c for s, c in sets if s == g) == list(range(sum(s == g for s, _ in sets))) for g in {s for s, _ in sets})
    return {frozenset(s) for s in sets.values()}


@pytest.mark.parametrize(("n", "how"), [(500, {}), (260, {"most": 60, "most_edges": 60})])
def test_equals_the_definition(spark, n, how):
    xy = blobs(1, n)
    want = brute(xy, 15, 5)
    assert len(want) >= 2 and clusters(spark, xy, 15, 5, **how) == want


def test_ties_groups_and_repeats(spark):
    rng = np.random.default_rng(2)
    a = np.concatenate([rng.integers(0, 12, (150, 2)), rng.integers(30, 36, (80, 2)), np.tile([60.0, 60.0], (30, 1))]).astype(float)  # a lattice: ties everywhere, a third repeated
    b = blobs(3, 150)
    xy, group = np.concatenate([a, b, [[5.0, 5.0]]]), np.array([0] * len(a) + [1] * len(b) + [2])
    want = brute(a, 12, 4) | {frozenset(i + len(a) for i in s) for s in brute(b, 12, 4)}
    assert clusters(spark, xy, 12, 4, group, most=50, most_edges=20) == want and len(want) >= 4


def test_few_or_odd_rows(spark):
    assert clusters(spark, np.zeros((0, 2)), 5, 3) == set()
    assert clusters(spark, np.zeros((3, 2)), 5, 3) == set()
    assert clusters(spark, np.array([[0.0, 0.0], [1.0, 0.0], [np.nan, 0.0]]), 2, 5) == set()
    one = np.random.default_rng(4).normal(0, 1, (40, 2))
    assert clusters(spark, one, 30, 3) == set() == brute(one, 30, 3)
    assert clusters(spark, one, 30, 3, single=True) == brute(one, 30, 3, True) == {frozenset(range(40))}


def test_core_distances(spark):
    xy = blobs(5, 300)
    xy[-1] = (5000, 5000)
    df = spark.createDataFrame([(i, 0, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, g int, _x double, _y double")
    got = {r.id: r._core for r in density.core_distances(df, 7, "id", ["g"], Scratch(spark, "core"), 64).collect()}
    want = np.sort(np.sqrt(((xy[:, None] - xy) ** 2).sum(-1)), axis=1)[:, 7]
    assert len(got) == 300 and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_the_tree_is_minimal_and_spans(spark):
    xy = blobs(6, 150)
    df = spark.createDataFrame([(i, 0, float(a), float(b), 0.5 * (i % 3)) for i, (a, b) in enumerate(xy)], "id long, g int, _x double, _y double, _core double")
    found = [density.reachability_tree(df, "id", ["g"], Scratch(spark, "tree"), most, edges).collect() for most, edges in ((2048, 1 << 20), (40, 60))]
    trees = [{(min(r.a, r.b), max(r.a, r.b)) for r in rows} for rows in found]
    assert trees[0] == trees[1] and len(trees[0]) == 149
    core = np.array([0.5 * (i % 3) for i in range(150)])
    m = np.maximum(np.maximum(np.sqrt(((xy[:, None] - xy) ** 2).sum(-1)), core[:, None]), core)
    best, total = dict(enumerate(m[0][1:], 1)), 0.0
    while best:
        i = min(best, key=best.get)
        total += best.pop(i)
        best = {j: min(v, m[i, j]) for j, v in best.items()}
    assert abs(sum(m[a, b] for a, b in trees[0]) - total) < 1e-9


def test_tiles_give_a_minimal_tree(spark, monkeypatch):
    """Without the shortcut of small groups: tiles contract what is sure, and only the rest is left to a group's task."""
    for name, value in (("MEET", 0), ("WIDE", 6.0), ("FILL", 20)):
        monkeypatch.setattr(density, name, value)
    xy = np.concatenate([np.random.default_rng(7).uniform(0, 40, (200, 2)), np.tile([20.0, 20.0], (30, 1))])
    core = np.r_[0.5 * (np.arange(200) % 3), np.full(30, 0.25)]
    df = spark.createDataFrame([(i, 0, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(xy, core))], "id long, g int, _x double, _y double, _core double")
    found = density.reachability_tree(df, "id", ["g"], Scratch(spark, "tree")).collect()
    m = np.maximum(np.maximum(np.sqrt(((xy[:, None] - xy) ** 2).sum(-1)), core[:, None]), core)
    best, want = dict(enumerate(m[0][1:], 1)), []
    while best:
        i = min(best, key=best.get)
        want.append(best.pop(i))
        best = {j: min(v, m[i, j]) for j, v in best.items()}
    assert len({(r.a, r.b) for r in found}) == len(found) == 229 and np.allclose(sorted(r.w for r in found), sorted(want))
    assert all(abs(r.w - m[r.a, r.b]) < 1e-9 for r in found)


def test_tiles_leave_few_edges_open():
    """A tile's own edges are settled in it; before, every tile's whole forest went on to the group's task."""
    xy = np.random.default_rng(9).uniform(0, 100, (4000, 2))
    n, x, y = len(xy), *xy.T
    mine, core = np.flatnonzero((x > 10) & (x < 90) & (y > 10) & (y < 90)), np.full(len(xy), 1.0)
    i, j, w = density._tile_forest(x, y, core, np.arange(n), mine, np.arange(n), 4.0)
    order = np.lexsort((j, i, w))
    i, j = i[order], j[order]
    whole = np.zeros(n, bool)
    whole[mine] = True
    sure = density._boruvka(np.arange(len(i)), i, j, np.arange(n), whole)
    assert len(i) - (whole[i[sure]] & whole[j[sure]]).sum() < len(i) / 3


def test_best_distances_with_repeated_places():
    rng = np.random.default_rng(10)
    xy = np.concatenate([rng.integers(0, 9, (200, 2)), rng.uniform(0, 300, (100, 2))]).astype(float)
    d = np.sort(np.sqrt(((xy[:, None] - xy) ** 2).sum(-1)), axis=1)[:, :6]
    got = density._best(*xy.T, *xy.T, 6, 25.0)
    reach = d[:, -1] <= 25.0
    assert np.array_equal(got[reach], d[reach]) and not np.isfinite(got[~reach, -1]).any() and 0 < reach.sum() < 300
