"""Raster operators against direct array code."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import raster
from tessella.scratch import Scratch


def frame(spark, a, v="v"):
    y, x = np.indices(a.shape)
    return spark.createDataFrame(pd.DataFrame({"px": x.ravel(), "py": y.ravel(), v: a.ravel()}))


def array(df, shape, v="v"):
    p, out = df.toPandas(), np.zeros(shape, int)
    out[p.py, p.px] = p[v]
    return out


@pytest.mark.parametrize("k", [3, 4, 5])
def test_morphology(spark, k):
    a = (np.random.default_rng(k).random((12, 15)) > 0.6).astype(int)
    low, high = -(k // 2), k - 1 - k // 2
    want = np.array([[a[max(0, y + low) : y + high + 1, max(0, x + low) : x + high + 1].max() for x in range(15)] for y in range(12)])
    assert (array(raster.dilate(frame(spark, a), "v", k, []), a.shape) == want).all()
    closed = array(raster.close(frame(spark, a), "v", k, []), a.shape)
    assert (closed >= a).all() or k % 2 == 0


def test_window_sums(spark):
    a = np.random.default_rng(1).integers(0, 9, (10, 14))
    at = pd.DataFrame({"nid": range(40), "cx": np.random.default_rng(2).integers(0, 14, 40), "cy": np.random.default_rng(3).integers(0, 10, 40)})
    got = raster.window_sums(spark.createDataFrame(at), raster.integral(frame(spark, a), "v", []), 3, 14, 10, "nid", []).toPandas().set_index("nid")
    for r in at.itertuples():
        part = a[max(0, r.cy - 3) : r.cy + 3, max(0, r.cx - 3) : r.cx + 3]
        assert got.loc[r.nid, "total"] == part.sum() and got.loc[r.nid, "cells"] == part.size


def test_components(spark):
    a = (np.random.default_rng(5).random((20, 25)) > 0.62).astype(int)
    seen, sizes = np.zeros_like(a), []
    for y, x in zip(*np.nonzero(a)):
        if seen[y, x]:
            continue
        stack, n = [(y, x)], 0
        seen[y, x] = 1
        while stack:
            cy, cx = stack.pop()
            n += 1
            for ny in range(max(0, cy - 1), min(20, cy + 2)):
                for nx in range(max(0, cx - 1), min(25, cx + 2)):
                    if a[ny, nx] and not seen[ny, nx]:
                        seen[ny, nx] = 1
                        stack.append((ny, nx))
        sizes.append(n)
    got = raster.component_table(raster.components(frame(spark, a), "v", [], Scratch(spark, "t")), []).toPandas()
    assert sorted(got.area) == sorted(sizes)


def test_shapes(spark):
    square = np.zeros((20, 20), int)
    square[3:13, 4:14] = 1
    px = frame(spark, square, "label").selectExpr("*", "px r", "py g", "0 b")
    row = raster.region_props(px, []).first()
    assert row.area_px == 100 and row.cx == 8.5 and row.cy == 7.5 and row.eccentricity == pytest.approx(0, abs=1e-6) and row.r == 8.5
    line = raster.outlines(px, []).first()
    assert line.perimeter_px == 36 and line.solidity == 1.0
    bar = np.zeros((20, 20), int)
    bar[5:8, 2:18] = 1
    thin = raster.thin(bar)
    assert thin.sum() >= 10 and thin.sum(axis=0).max() == 1
    topo = raster.topology(frame(spark, thin.astype(int)).where("v > 0").select("px", "py"), []).first()
    assert topo.endpoints == 2 and topo.branches == 0


def test_tiles_and_orientation(spark):
    grid = raster.tile_grid(spark.createDataFrame([(1, 3000, 1024), (2, 1000, 5000)], "s int, width int, height int")).toPandas()
    assert sorted(grid[grid.s == 1].x) == [0, 896, 1792] and not len(grid[grid.s == 2])
    a = np.random.default_rng(7).random((16, 16))
    best = raster.best_orientation(frame(spark, a), frame(spark, a[:, ::-1]), "v", 16, 16).toPandas()
    assert best.loc[best.score.idxmax(), "name"] == "flip_h" and best.score.max() == pytest.approx(1)


def test_tissue_kernels_grow_with_the_level(spark):
    """A gap of 20 pixels stays at level 0 and closes at level 2; small pieces go, and levels beyond the last are as it."""
    rows = [("s", x, y, int(80 <= x < 100 or 120 <= x < 140)) for x in range(220) for y in range(40)] + [("t", x, y, int(x < 5 and y < 5)) for x in range(220) for y in range(40)]
    df = spark.createDataFrame(rows, "image string, px int, py int, v int").cache()
    got = {}
    for level in (0, 2, 7):
        out = raster.tissue_mask(df, "v", level, 220, 40, ["image"], Scratch(spark, "t"), floor=500)
        got[level] = {(r.image, r.y): r.n for r in out.where("v = 1").groupBy("image", F.col("py").alias("y")).agg(F.count("*").alias("n")).collect()}
        assert out.count() == len(rows) and {k[0] for k in got[level]} == {"s"}
    assert set(got[0].values()) == {40} and set(got[2].values()) == {60} and got[2] == got[7]
