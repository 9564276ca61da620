"""Registration against known maps, and its derivatives against differences."""

import numpy as np
import pandas as pd
import pytest

from tessella.operators import registration as R
from tessella.scratch import Scratch

W, H = 150, 120
SMALL = R.Settings(tile=64, reach=6)


def _scene(x, y):
    """A smooth image, whose values at any position are known."""
    rng = np.random.default_rng(5)
    out = np.zeros_like(x, dtype=float)
    for _ in range(45):
        cx, cy, s, a = rng.uniform(5, W - 5), rng.uniform(5, H - 5), rng.uniform(4, 9), rng.uniform(0.3, 1)
        out += a * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * s * s))
    return out


def _pixels(spark, f):
    y, x = np.mgrid[0:H, 0:W]
    return spark.createDataFrame(pd.DataFrame({"px": x.ravel(), "py": y.ravel(), "v": f(x.ravel().astype(float), y.ravel().astype(float))}))


def _probe():
    y, x = np.mgrid[15 : H - 15 : 7, 15 : W - 15 : 7].astype(float)
    return x.ravel(), y.ravel()


def _warp(x, y):
    return x + 2.5 * np.sin(y / 25), y + 2.0 * np.cos(x / 30)


AFFINE = np.array([[1.02, 0.05, -1.0], [-0.06, 0.98, 5.0]])


def test_affine_is_found_across_stains(spark):
    """The fixed image is the scene read through a known map, with values turned upside down."""
    moving = _pixels(spark, _scene)
    fixed = _pixels(spark, lambda x, y: 1 / (1 + _scene(*(AFFINE @ np.stack([x, y, np.ones_like(x)])))))
    start = R.identity(W, H)
    t = R.register_affine(fixed, moving, "v", W, H, SMALL, start)
    x, y = _probe()
    want = AFFINE @ np.stack([x, y, np.ones_like(x)])
    assert np.abs(np.stack(t(x, y)) - want).max() < 0.5


def test_warp_is_found_and_resampled(spark):
    moving, fixed = _pixels(spark, _scene), _pixels(spark, lambda x, y: _scene(*_warp(x, y)))
    t = R.register_warp(fixed, moving, "v", R.identity(W, H), SMALL)
    x, y = _probe()
    far = np.hypot(*(np.stack(t(x, y)) - np.stack(_warp(x, y))))
    assert np.median(far) < 0.5 and np.mean(far < 0.5) > 0.9
    out = R.resample(fixed, moving, "v", t, SMALL).toPandas()
    assert len(out) == W * H
    inner = out[out["px"].between(15, W - 15) & out["py"].between(15, H - 15)]
    want = _scene(*_warp(inner["px"].to_numpy(float), inner["py"].to_numpy(float)))
    assert np.corrcoef(want, inner["v"])[0, 1] > 0.99


@pytest.mark.parametrize("tile", [32, 256])
def test_slopes_are_those_of_the_measure(spark, tile):
    """Derivatives equal differences of the mutual information, whatever the tiles."""
    s = R.Settings(tile=tile, reach=4, mesh=3)
    moving, fixed = _pixels(spark, _scene), _pixels(spark, lambda x, y: _scene(x + 1.3, y - 0.7)).where(f"px between 5 and {W - 6} and py between 5 and {H - 6}")
    bins = R._Bins(s.bins, R._bounds(fixed, "v"), R._bounds(moving, "v"))
    level = R._Level(fixed, moving, "v", 1, s, Scratch(spark, "slopes"), "one")
    t = R.identity(W, H)
    t.matrix[:, 2] = 0.37, 0.42  # between pixels: a linear reading has kinks at them
    h = R._histogram(level, t, bins, True)
    value, logs, total = R._information(h[0], s.bins)
    got = h[1:] @ logs / total

    def at(m, grid=None):
        return R._information(R._histogram(level, R.Transform(W, H, m, grid), bins, False)[0], s.bins)[0]

    for k in (0, 2, 5):
        d = np.zeros(6)
        d[k] = 0.05
        assert abs(got[k]) > 2e-3
        assert got[k] == pytest.approx((at(t.matrix + d.reshape(2, 3)) - at(t.matrix - d.reshape(2, 3))) / 0.1, rel=0.15, abs=2e-3)
    grid = np.zeros((6, 6, 2))
    forces = R._control_forces(level, R.Transform(W, H, t.matrix, grid), bins, logs).reshape(6, 6, 2) / total
    grid[2, 3, 0] = 0.1
    assert forces[2, 3, 0] == pytest.approx((at(t.matrix, grid) - at(t.matrix, -grid)) / 0.2, rel=0.15, abs=2e-3)


def test_edges(spark):
    """Empty images and images of one value keep the start; a shift beyond the reach makes new patches."""
    one, none = _pixels(spark, lambda x, y: x * 0 + 1), _pixels(spark, _scene).where("px < 0")
    for a, b in ((one, one), (none, one), (one, none)):
        t = R.register_affine(a, b, "v", W, H, R.Settings(tile=64, affine_levels=(4,)), R.identity(W, H))
        assert np.allclose(t.matrix, R.identity(W, H).matrix)
    level = R._Level(one, one, "v", 1, SMALL, Scratch(spark, "edges"), "one")
    t = R.identity(W, H)
    level.near(t)
    t.matrix[0, 2] += 30
    level.near(t)
    assert level.count == 2
    rows = R.resample(one, one, "v", t, SMALL).where("v = 0").count()
    assert rows == 30 * H  # the moving image's last column and row count


def test_table(spark):
    t = R.identity(W, H)
    t.matrix[0, 2] = 3.0
    got = {(r["part"], r["row"], r["col"]): r["value"] for r in R.transform_table(t, spark).collect()}
    assert got == pytest.approx({("matrix", 0, 0): 1, ("matrix", 0, 1): 0, ("matrix", 0, 2): 3, ("matrix", 1, 0): 0, ("matrix", 1, 1): 1, ("matrix", 1, 2): 0})
