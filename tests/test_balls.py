"""Balls of dense tiles: results against all pairs, and how many pairs are measured."""

import numpy as np
import pandas as pd
import pytest

from tessella.operators import balls
from tessella.operators.placement import marker_features
from tessella.operators.spatial import Ask, nearest, neighbourhood


def scene(n, seed, size=1000, decimals=0):
    rng = np.random.default_rng(seed)
    return np.round(rng.uniform(0, size, n), decimals), np.round(rng.uniform(0, size, n), decimals), rng.integers(0, 40, n).astype(float)


@pytest.mark.parametrize("decimals", [-1, 0, 3])
def test_sums_and_order_statistics(decimals):
    (qx, qy, _), (px, py, v) = scene(300, 1, 1100, decimals), scene(4000, 2, 900, decimals)
    near = (qx[:, None] - px) ** 2 + (qy[:, None] - py) ** 2 <= 120.0**2
    n, total = balls.ball_sums(qx, qy, px, py, [None, v], 120.0)
    assert (n == near.sum(1)).all() and (total == near @ v).all()
    some = np.flatnonzero(n)
    k = (n[some] // 2 + 1).astype(int)
    assert (balls.ball_kth(qx[some], qy[some], k, px, py, v, 120.0) == [np.sort(v[near[q]])[j - 1] for q, j in zip(some, k)]).all()


@pytest.mark.parametrize("strict", [True, False])
def test_nearest_with_ties(strict):
    (qx, qy, _), (px, py, _) = scene(500, 3, 1500, -1), scene(2000, 4, 900, -1)
    which, d2 = balls.ball_nearest(qx, qy, px, py, 50.0, strict)
    all_d2 = (qx[:, None] - px) ** 2 + (qy[:, None] - py) ** 2
    first, least = all_d2.argmin(1), all_d2.min(1)
    hit = least < 2500 if strict else least <= 2500
    assert (which == np.where(hit, first, -1)).all() and (d2[hit] == least[hit]).all()


def measured(monkeypatch, run, n):
    """Pairs that a run over n points in the same square measures."""
    seen, spans = [0], balls._spans

    def counted(lo, hi):
        seen[0] += int((hi - lo).sum())
        return spans(lo, hi)

    monkeypatch.setattr(balls, "_spans", counted)
    x, y, _ = scene(n, 5, 1000, 3)
    run(x, y)
    monkeypatch.setattr(balls, "_spans", spans)
    return seen[0]


@pytest.mark.parametrize("run,power", [(lambda x, y: balls.ball_sums(x, y, x, y, [None], 300.0), 1.6), (lambda x, y: balls.ball_nearest(x, y, x + 0.1, y, 300.0, True), 1.1)], ids=["sums", "nearest"])
def test_pairs_grow_slower_than_density(monkeypatch, run, power):
    small, large = (measured(monkeypatch, run, n) for n in (4000, 16000))
    assert large <= small * 4**power and large < 16000**2 * 0.28 / 4  # a ball holds over a quarter of the square's points


def test_two_tables(spark):
    (qx, qy, _), (px, py, v) = scene(200, 6), scene(3000, 7)
    a, b = pd.DataFrame({"nid": np.arange(200), "x": qx, "y": qy}), pd.DataFrame({"mid": np.arange(3000) + (1 << 60), "x": px, "y": py, "v": v})
    d2 = (qx[:, None] - px) ** 2 + (qy[:, None] - py) ** 2
    near = d2 <= 100
    left, right = spark.createDataFrame(a), spark.createDataFrame(b)
    got = neighbourhood(left, [Ask("n", "total", 10.0), Ask("s", "sum", 10.0, "v")], "nid", [], of=right, most=500).toPandas().set_index("nid").loc[a.nid]
    assert (got.n == near.sum(1)).all() and (got.s == near @ v).all()
    found = marker_features(left, right, "nid", "mid", "v", [], 5.0, 10.0, 20).toPandas().set_index("nid").loc[a.nid]
    assert (found.positives == near @ (v > 20).astype(int)).all() and np.allclose(found.local_density, near.sum(1) / (np.pi * 100))
    assert (found.intensity == np.where(d2.min(1) < 25, v[d2.argmin(1)], 0)).all()
    ids = nearest(left, right, "nid", "mid", [], 5.0).collect()  # ids beyond 2**53 stay whole beside misses
    assert {r.nid: r.mid for r in ids} == {i: int(b.mid[d2[i].argmin()]) if d2[i].min() < 25 else None for i in range(200)}


def test_dense_lattices_are_convolved(monkeypatch):
    """On dense whole places sums and medians measure no pairs, whatever the blocks; places between whole numbers still do."""
    monkeypatch.setattr(balls, "BLOCK", 160)
    (qx, qy, _), (px, py, v) = scene(6000, 8, 230), scene(20000, 9, 250)
    near = (qx[:, None] - px) ** 2 + (qy[:, None] - py) ** 2 <= 30.5**2
    spans = balls._spans
    monkeypatch.setattr(balls, "SITE", 0)
    monkeypatch.setattr(balls, "_spans", None)
    n, total, wave = balls.ball_sums(qx - 77, qy - 77, px - 77, py - 77, [None, v, np.cos(v)], 30.5)
    assert (n == near.sum(1)).all() and (total == near @ v).all() and np.allclose(wave, near @ np.cos(v), rtol=0, atol=1e-9)
    k = (n // 2 + 1).astype(int)
    assert (balls.ball_kth(qx, qy, k, px, py, v, 30.5) == [np.sort(v[near[q]])[j - 1] for q, j in enumerate(k)]).all()
    monkeypatch.setattr(balls, "_spans", spans)
    assert (balls.ball_sums(qx + 0.5, qy, px + 0.5, py, [None], 30.5)[0] == n).all()
