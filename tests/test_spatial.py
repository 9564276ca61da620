"""Neighbourhoods, joins and de-duplication against numpy restatements."""

import numpy as np
import pandas as pd
import pytest

from tessella.operators import dedup
from tessella.operators.dedup import nms_dedup, pair_dedup
from tessella.operators.spatial import Ask, nearest, neighbourhood, radius_join
from tessella.scratch import Scratch

R = 200.0


def points(n, seed, clustered=False):
    rng = np.random.default_rng(seed)
    xy = rng.integers(0, 3000, (n, 2)) if not clustered else np.vstack([rng.integers(1000, 1400, (n - 10, 2)), rng.integers(0, 3000, (10, 2))])
    return pd.DataFrame({"nid": np.arange(n), "slide": rng.integers(0, 2, n), "x": xy[:, 0], "y": xy[:, 1], "v": rng.integers(0, 50, n).astype(float), "orientation": rng.uniform(-np.pi, np.pi, n), "area": rng.integers(20, 60, n)})


def balls(p, r):
    d2 = (p.x.to_numpy()[:, None] - p.x.to_numpy()) ** 2 + (p.y.to_numpy()[:, None] - p.y.to_numpy()) ** 2
    return (d2 <= r * r) & (p.slide.to_numpy()[:, None] == p.slide.to_numpy())


@pytest.mark.parametrize("clustered,most", [(False, 20_000), (True, 50)])
def test_neighbourhood(spark, clustered, most):
    p = points(400, 1, clustered)
    asks = [Ask("n", "count", R), Ask("small", "count", R / 2), Ask("mean", "mean", R, "v"), Ask("var", "var", R, "v"), Ask("cv", "cv", R, "v"), Ask("med", "median", R, "v"), Ask("coh", "coherency", R, "orientation"), Ask("circ", "circular", R, "orientation")]
    got = neighbourhood(spark.createDataFrame(p), asks, "nid", ["slide"], most=most).toPandas().set_index("nid").loc[p.nid]
    b, v, o = balls(p, R), p.v.to_numpy(), p.orientation.to_numpy()
    assert len(got) == len(p) and (got.n == b.sum(1) - 1).all() and (got.small == balls(p, R / 2).sum(1) - 1).all()
    assert np.allclose(got["mean"], [v[m].mean() for m in b]) and np.allclose(got["var"], [v[m].var() for m in b])
    assert np.allclose(got.med, [np.median(v[m]) for m in b])
    assert np.allclose(got.cv, [v[m].std() / v[m].mean() if v[m].mean() > 1e-10 else 0 for m in b])
    coh = []
    for m in b:  # by the structure tensor's eigenvalues
        c, s = np.cos(o[m]), np.sin(o[m])
        t = np.linalg.eigvalsh([[(c * c).mean(), (c * s).mean()], [(c * s).mean(), (s * s).mean()]])
        coh.append((t[1] - t[0]) / t.sum() if m.sum() >= 3 else 0)
    assert np.allclose(got.coh, coh)
    assert np.allclose(got.circ, [np.arctan2(np.sin(o[m]).mean(), np.cos(o[m]).mean()) if m.sum() > 3 else o[i] for i, m in enumerate(b)])
    assert ((got.coh >= 0) & (got.coh <= 1 + 1e-12)).all() and int(got.n.sum()) % 2 == 0


def test_coherency_of_known_fields(spark):
    def mean(angles, seed):
        rng = np.random.default_rng(seed)
        p = pd.DataFrame({"nid": range(100), "slide": 0, "x": rng.uniform(0, 1000, 100), "y": rng.uniform(0, 1000, 100), "orientation": angles(rng)})
        return neighbourhood(spark.createDataFrame(p), [Ask("c", "coherency", 200, "orientation")], "nid", ["slide"]).toPandas().c

    assert mean(lambda g: 0.7 + g.normal(0, 0.05, 100), 42).mean() > 0.95
    assert mean(lambda g: g.uniform(-np.pi, np.pi, 100), 43).mean() < 0.4


def test_radius_join_and_nearest(spark):
    a, b = points(150, 2), points(120, 3).rename(columns={"nid": "mid"})
    got = radius_join(spark.createDataFrame(a), spark.createDataFrame(b), R, ["slide"]).count()
    d2 = (a.x.to_numpy()[:, None] - b.x.to_numpy()) ** 2 + (a.y.to_numpy()[:, None] - b.y.to_numpy()) ** 2.0
    d2[a.slide.to_numpy()[:, None] != b.slide.to_numpy()] = np.inf
    assert got == (d2 <= R * R).sum()
    for bounded in (True, False):
        near = nearest(spark.createDataFrame(a), spark.createDataFrame(b), "nid", "mid", ["slide"], 50, bounded=bounded).toPandas().set_index("nid")
        for i in range(len(a)):
            best = d2[i].min()
            if bounded and best >= 2500:
                assert pd.isna(near.loc[i, "mid"])
            else:
                assert near.loc[i, "mid"] == d2[i].argmin() and near.loc[i, "d2"] == best


#: Tile and border widths and the most points of a tile: one tile, many that decide, many that leave points open.
TILES = pytest.mark.parametrize("tiles", [(24, 6, 100_000, 20_000), (3, 2, 100_000, 0), (3, 2, 25, 0)])


def set_tiles(monkeypatch, tiles):
    for name, value in zip(("TILE", "BORDER", "MOST", "FILL"), tiles):
        monkeypatch.setattr(dedup, name, value)


@TILES
def test_nms(spark, monkeypatch, tiles):
    set_tiles(monkeypatch, tiles)
    p = points(300, 4)
    b = balls(p, R)
    kept = []
    for i in sorted(range(len(p)), key=lambda i: (-p.area[i], i)):
        if not any(b[i, k] for k in kept):
            kept.append(i)
    got = nms_dedup(spark.createDataFrame(p), R, "nid", "area", ["slide"], Scratch(spark, "t")).toPandas()
    assert set(got.nid) == set(kept)
    again = nms_dedup(spark.createDataFrame(got), R, "nid", "area", ["slide"], Scratch(spark, "t")).count()
    assert again == len(kept)


def test_nms_of_odd_rows(spark):
    rows = [(1, 0.0, 0.0, None), (2, 1.0, 0.0, None), (3, 0.0, 1.0, float("nan")), (4, 50.0, 0.0, 2.0), (5, 51.0, 0.0, 2.0), (6, None, 0.0, 9.0), (7, 50.5, 0.0, None)]
    df = spark.createDataFrame(rows, "id long, x double, y double, p double")
    kept = lambda d: sorted(r.id for r in nms_dedup(d, 2.0, "id", "p", [], Scratch(spark, "t")).collect())
    assert kept(df) == [3, 4, 6] and kept(df.limit(0)) == [] and kept(df.where("id = 6")) == [6]


@TILES
def test_pair_dedup(spark, monkeypatch, tiles):
    set_tiles(monkeypatch, tiles)
    p = points(300, 5)
    area = p.area.to_numpy()
    d2 = (p.x.to_numpy()[:, None] - p.x.to_numpy()) ** 2 + (p.y.to_numpy()[:, None] - p.y.to_numpy()) ** 2
    removed = set()
    for i in range(len(p)):  # a point that stands when its turn begins acts for its whole turn
        if i in removed:
            continue
        for j in range(i + 1, len(p)):
            if j not in removed and p.slide[i] == p.slide[j] and d2[i, j] < R * R and min(area[i], area[j]) / max(area[i], area[j]) > 0.8:
                removed.add(i if area[j] > area[i] else j)
    got = pair_dedup(spark.createDataFrame(p), R, 0.8, "nid", "area", ["slide"], Scratch(spark, "t")).toPandas()
    assert set(got.nid) == set(range(len(p))) - removed
