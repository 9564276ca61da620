"""What steps shuffle and keep grows no faster than their input."""

import numpy as np
import pandas as pd
import pyarrow as pa

from tessella.operators import manifold, ml, raster, stats
from tessella.scratch import Scratch


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_points_of_one_place_ask_once(spark):
    """points meet the pixels by their distinct places and radii, and each gets its place's values."""
    rng = np.random.default_rng(4)
    a = rng.integers(0, 256, (20, 23))
    y, x = np.indices(a.shape)
    image = spark.createDataFrame(pd.DataFrame({"px": x.ravel(), "py": y.ravel(), "g": a.ravel()}))
    n = 300
    at = pd.DataFrame({"nid": range(n), "cx": rng.integers(-9, 30, n), "cy": rng.integers(-9, 30, n), "rad": 2 + np.arange(n) % 2, "outr": 4 + np.arange(n) % 3})
    at.loc[200:, ["cx", "cy", "rad", "outr"]] = [11, 9, 2, 5]
    got = raster.patch_intensity(spark.createDataFrame(at), image, "g", "nid", "rad", "outr", 6)
    before_blocks = plan(got).split("Generate")
    assert len(before_blocks) == 3 and "Aggregate" in before_blocks[-1]
    rows = got.toPandas().set_index("nid")
    assert len(rows) == n
    for r in at.itertuples():
        d2 = (x - r.cx) ** 2 + (y - r.cy) ** 2
        own, ring = a[d2 <= r.rad**2], a[(d2 > r.rad**2) & (d2 <= r.outr**2)]
        want = [own.mean(), own.max(), own.std(), (own > 30).mean()] if len(own) else [0] * 4
        want += [ring.mean(), (ring > 30).mean()] if len(ring) else [0] * 2
        assert np.allclose(rows.loc[r.nid].to_numpy(float), want)


def test_a_task_sends_one_row_for_each_sub_cluster(spark):
    """sums of a round are added up over all batches of a task."""
    rng = np.random.default_rng(5)
    x, g = rng.normal(size=(90, 3)), np.arange(90) % 2
    whole = pa.record_batch({"g": pa.array(g, pa.int32()), "_a": pa.array(x.tolist(), pa.list_(pa.float64()))})
    centres = {0: x[:3], 1: x[3:4]}
    out = list(ml._sub_sums((whole.slice(k, 7) for k in range(0, 90, 7)), "g", 3, centres, {0, 1}))
    rows = pa.Table.from_batches(out).to_pandas()
    assert len(rows) == 4 and rows["_n"].sum() == 90
    for r in rows.itertuples(index=False):
        part = x[g == r.g]
        part = part[((part[:, None] - centres[r.g]) ** 2).sum(axis=2).argmin(axis=1) == r[1]]
        assert len(part) == r[2] and np.allclose(part.sum(axis=0), r[3:])
    assert not list(ml._sub_sums(iter([whole]), "g", 3, centres, set()))


def test_neighbours_of_a_skeleton_are_counted_in_tiles(spark):
    """pixels are dealt to tiles once, borders and repeated rows included; no join of all pixels with their neighbours."""
    rng = np.random.default_rng(6)
    a = rng.random((2, 40, 31)) < 0.3
    k, y, x = np.nonzero(a)
    rows = pd.DataFrame({"image": k, "px": x - 9, "py": y - 20})
    got = raster.topology(spark.createDataFrame(rows), ["image"], 8)
    assert "Join" not in plan(got)
    for r in got.toPandas().itertuples():
        m = np.pad(a[r.image], 1).astype(int)
        near = sum(np.roll(m, (dy, dx), (0, 1)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
        assert (r.skeleton_px, r.endpoints, r.branches) == (m.sum(), (near[m > 0] == 1).sum(), (near[m > 0] >= 3).sum())
    none = spark.createDataFrame(rows).where("px > 99")
    assert [tuple(r) for r in raster.topology(none.select("px", "py"), []).collect()] == [(0, 0, 0)] and raster.topology(none, ["image"]).isEmpty()


def test_rows_stay_where_they_are_while_cells_are_made(spark, monkeypatch):
    """vectors aren't shuffled to find their cells while all pivots can be broadcast, and the cells are those of the shuffled way."""
    x = np.random.default_rng(7).normal(size=(900, 4))
    x[500:620] = x[500]
    data = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "_a": list(x)})).select("id", "_a")
    found = manifold.cells(data, "id", Scratch(spark, "cells"), "c", most=20)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    sizes = found.groupBy("_cell").count().toPandas()["count"]
    assert sizes.sum() == len(x) and sizes.max() <= 20
    monkeypatch.setattr(manifold, "SENT", 40 * 4 * manifold.PIVOTS)
    one, other = (sorted(tuple(r) for r in c.select("id", "_cell").collect()) for c in (found, manifold.cells(data, "id", Scratch(spark, "cells"), "c", most=20)))
    assert one == other


def test_percentiles_of_a_column_come_from_one_count(spark):
    """F16: a group's values are counted once, however many percentiles are asked for."""
    rng = np.random.default_rng(8)
    x = pd.DataFrame({"s": np.arange(400) % 3, "den": rng.random(400), "on": (rng.random(400) > 0.5).astype(int), "v": rng.random(400)})
    df = spark.createDataFrame(x)
    got = stats.positive_summary(df, "on", "v", "den", ["s"])
    assert plan(got).count("percentile(") == 1
    for r in got.toPandas().itertuples():
        own = x[x.s == r.s]
        assert np.allclose([r.density_median, r.density_p10, r.density_p90], np.quantile(own.den, [0.5, 0.1, 0.9])) and r.n_positive == own.on.sum()
    both = stats.percentiles(df, ["den", "v"], [0.25, 0.75])
    assert plan(both).count("percentile(") == 2 and both.columns == ["den_p25", "den_p75", "v_p25", "v_p75"]
    assert np.allclose(list(both.first()), [*np.quantile(x.den, [0.25, 0.75]), *np.quantile(x.v, [0.25, 0.75])])
