"""Suppression in dense tiles: no pairs are kept, and results are the greedy rule's."""

import numpy as np
import pandas as pd

from tessella.operators import dedup
from tessella.operators.dedup import nms_dedup
from tessella.scratch import Scratch


def greedy(x, y, order, r):
    up = []
    for i in order:
        if not up or ((x[up] - x[i]) ** 2 + (y[up] - y[i]) ** 2 > r * r).all():
            up.append(i)
    return set(up)


def test_cells_settle_a_tile_without_pairs():
    rng = np.random.default_rng(1)
    x, y = np.round(rng.uniform(0, 1000, (2, 50_000)))
    rank = rng.permutation(50_000)
    state = dedup._settled(x, y, rank, np.ones(50_000, bool), 100.0)
    assert set(np.flatnonzero(state == 1)) == greedy(x, y, np.argsort(rank), 100.0) and (state != 0).all()


def test_dense_tiles_leave_no_edges(spark, monkeypatch):
    """Points that more tiles than one hold, with more pairs than may be kept: none goes on as an edge."""
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"nid": np.arange(12_000), "x": rng.integers(0, 3000, 12_000), "y": rng.integers(0, 3000, 12_000), "area": rng.integers(20, 60, 12_000)})
    for name, value in {"TILE": 6, "BORDER": 4, "MOST": 1000, "KEPT": 1000, "FILL": 0}.items():
        monkeypatch.setattr(dedup, name, value)
    monkeypatch.setattr(dedup, "dominated", lambda *_: (_ for _ in ()).throw(AssertionError("edges were made")))
    got = nms_dedup(spark.createDataFrame(p), 200.0, "nid", "area", [], Scratch(spark, "t")).toPandas()
    assert set(got.nid) == greedy(p.x.to_numpy(), p.y.to_numpy(), np.lexsort((p.nid, -p.area)), 200.0)


def visited(x, y, a, r, share):
    """The pairwise rule, point by point."""
    up = np.ones(len(x), bool)
    for i in range(len(x)):
        if not up[i]:
            continue
        j = np.flatnonzero(up & (np.arange(len(x)) > i))
        j = j[((x[j] - x[i]) ** 2 + (y[j] - y[i]) ** 2 < r * r) & (np.minimum(a[i], a[j]) / np.maximum(a[i], a[j]) > share)]
        up[j[a[j] <= a[i]]] = False
        up[i] = not (a[j] > a[i]).any()
    return set(np.flatnonzero(up))


def test_dense_pairs_leave_no_edges(spark, monkeypatch):
    """Pair de-duplication of points that more tiles than one hold makes no pairs in Spark and no edges."""
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"nid": np.arange(8_000), "x": rng.integers(0, 3000, 8_000), "y": rng.integers(0, 3000, 8_000), "area": rng.integers(1, 420, 8_000)})
    for name, value in {"TILE": 6, "BORDER": 4, "MOST": 1000, "KEPT": 1000, "FILL": 0}.items():
        monkeypatch.setattr(dedup, name, value)
    for name in ("dominated", "radius_join"):
        monkeypatch.setattr(dedup, name, lambda *_: (_ for _ in ()).throw(AssertionError("pairs were made")))
    got = dedup.pair_dedup(spark.createDataFrame(p), 200.0, 0.8, "nid", "area", [], Scratch(spark, "t")).toPandas()
    assert set(got.nid) == visited(p.x.to_numpy(), p.y.to_numpy(), p.area.to_numpy(), 200.0, 0.8)


def test_areas_that_are_like_none(spark):
    """Zero, negative, missing and infinite areas go through the levels."""
    area = [0.0, 0.0, -3.0, -3.0, -4.0, None, None, float("inf"), float("inf"), 1e-300, 1e-300, 1e300, 5.0, 5.5, 4.5]
    p = spark.createDataFrame([(k, 0.0, 0.0, a) for k, a in enumerate(area)], "nid long, x double, y double, area double")
    got = {r.nid for r in dedup.pair_dedup(p, 1.0, 0.8, "nid", "area", [], Scratch(spark, "t")).collect()}
    with np.errstate(divide="ignore", invalid="ignore"):
        assert got == visited(*np.zeros((2, len(area))), np.array(area, float), 1.0, 0.8)


def test_pairs_by_edges(spark, monkeypatch):
    """Where no tile decides, edges give the same points."""
    rng = np.random.default_rng(4)
    p = pd.DataFrame({"nid": np.arange(120), "x": rng.integers(0, 160, 120), "y": rng.integers(0, 160, 120), "area": rng.integers(1, 60, 120)})
    monkeypatch.setattr(dedup, "BY_CELLS", 0)
    monkeypatch.setattr(dedup, "WIDER", 0)
    got = dedup.pair_dedup(spark.createDataFrame(p), 40.0, 0.8, "nid", "area", [], Scratch(spark, "t")).toPandas()
    assert set(got.nid) == visited(p.x.to_numpy(), p.y.to_numpy(), p.area.to_numpy(), 40.0, 0.8)


def test_few_that_stand_are_joined_without_a_shuffle(spark):
    """The points with all their columns aren't shuffled for the last join, and a row without a place or key stays."""
    from tessella.operators.dedup import nms_dedup
    from tessella.scratch import Scratch

    df = spark.range(400).selectExpr("nullif(id, 7) id", "0 g", "cast(if(id = 7, null, id % 20) as double) x", "cast(id div 20 as double) y", "id % 13 area")
    out = nms_dedup(df, 100.0, "id", "area", ["g"], Scratch(spark, "few"))
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id is None, r.area) for r in out.collect()) == [(False, 12), (True, 7)]
