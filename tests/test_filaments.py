"""Thinning over tiles, shaped morphology, contours, placement and the small helpers, against direct code."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.functions import slides as S
from tessella.operators import placement, raster, stats
from tessella.scratch import Scratch
from tests.test_raster import array, frame


@pytest.mark.parametrize("seed", [1, 2])
def test_tiled_thinning_is_the_whole_images(spark, seed):
    rng = np.random.default_rng(seed)
    a = np.zeros((60, 75), int)
    for _ in range(14):  # thick strokes across tile borders
        y, x, h, w = rng.integers(0, 50), rng.integers(0, 60), rng.integers(3, 25), rng.integers(3, 40)
        a[y : y + h, x : x + w] = 1
    a[rng.random(a.shape) < 0.03] = 0
    got = raster.skeleton_whole(frame(spark, a), "v", [], Scratch(spark, "thin"), tile=16, halo=4).withColumn("v", F.lit(1))
    assert (array(got, a.shape) == raster.thin(a).astype(int)).all() and raster.thin(a).sum() > 50
    two = frame(spark, a).withColumn("s", F.lit("x")).unionByName(frame(spark, a[::-1]).withColumn("s", F.lit("y")))
    both = raster.skeleton_whole(two, "v", ["s"], Scratch(spark, "thin")).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in both} == {"x": raster.thin(a).sum(), "y": raster.thin(a[::-1]).sum()}
    assert raster.skeleton_whole(frame(spark, a * 0), "v", [], Scratch(spark, "thin")).count() == 0


@pytest.mark.parametrize("k", [3, 5, 7])
def test_elliptic_closing(spark, k):
    a = (np.random.default_rng(k).random((14, 19)) > 0.75).astype(int)
    offsets = [(dy, dx) for dy, h in raster.ellipse(k) for dx in range(-h, h + 1)]
    assert (len(offsets), k) in ((5, 3), (17, 5), (33, 7)) or len(offsets) > k

    def extreme(m, pick):
        out = np.zeros_like(m)
        for y in range(14):
            for x in range(19):
                out[y, x] = pick(m[y + dy, x + dx] for dy, dx in offsets if 0 <= y + dy < 14 and 0 <= x + dx < 19)
        return out

    got = array(raster.close_shape(frame(spark, a), "v", raster.ellipse(k), []), a.shape)
    assert (got == extreme(extreme(a, max), min)).all()


def test_external_contours_leave_holes_out(spark):
    rng = np.random.default_rng(8)
    a = (rng.random((30, 34)) > 0.45).astype(int)
    a[5:20, 5:20] = 1
    a[8:16, 8:16] = 0
    a[11:13, 11:13] = 1  # an object in a hole
    out = np.zeros((32, 36), bool)
    todo = [(0, 0)]
    pad = np.pad(a, 1)
    while todo:
        y, x = todo.pop()
        if 0 <= y < 32 and 0 <= x < 36 and not out[y, x] and not pad[y, x]:
            out[y, x] = True
            todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    beside = np.zeros_like(out)
    for s, axis in ((1, 0), (-1, 0), (1, 1), (-1, 1)):
        beside |= np.roll(out, s, axis)
    want = (beside & (pad > 0))[1:-1, 1:-1]
    got = raster.external_contour(frame(spark, a), "v", [], Scratch(spark, "contour")).withColumn("v", F.lit(1))
    assert (array(got, a.shape) == want.astype(int)).all() and not want[11, 11]


def test_components_by_sides(spark):
    a = np.array([[1, 0, 1], [0, 1, 0], [1, 1, 0]])
    table = lambda corners: sorted(r.area for r in raster.component_table(raster.components(frame(spark, a), "v", [], Scratch(spark, "c"), corners), []).collect())
    assert table(True) == [5] and table(False) == [1, 1, 3]
    long = np.zeros((2, 700), int)
    long[0, :400] = long[1, 400:] = 1  # touch at a corner, runs over several blocks
    wide = lambda corners: raster.component_table(raster.components(frame(spark, long), "v", [], Scratch(spark, "c"), corners), []).count()
    assert wide(True) == 1 and wide(False) == 2


def test_brown_per_object(spark):
    rng = np.random.default_rng(4)
    y, x = np.indices((20, 25))
    image = pd.DataFrame({"px": x.ravel(), "py": y.ravel(), **{c: rng.integers(0, 256, 500) for c in "rgb"}})
    at = pd.DataFrame({"nid": range(30), "cx": rng.uniform(-4, 30, 30), "cy": rng.uniform(-4, 24, 30), "major_axis_length": rng.uniform(0, 6, 30)})
    od = lambda c: -np.log10(np.maximum(image[c].to_numpy().reshape(20, 25), 1e-6) / 255)
    dab = od("g") + 0.57 * od("b")
    got = placement.brown_per_object(spark.createDataFrame(at), spark.createDataFrame(image), 25, 20, "nid").toPandas().set_index("nid")
    for r in at.itertuples():
        half = int(r.major_axis_length * 1.5)
        cx, cy = math.floor(r.cx), math.floor(r.cy)
        part = dab[max(0, cy - half) : max(0, cy + half), max(0, cx - half) : max(0, cx + half)]
        mean = part.mean() if part.size else 0.0
        assert got.loc[r.nid, "brown_intensity"] == pytest.approx(mean) and got.loc[r.nid, "has_brown"] == int(mean > 0.15)


def test_placement_keeps_every_object(spark):
    tiles = spark.createDataFrame([(0, 1, 10, 20), (0, 1, 9, 50), (1, 1, None, 7)], "x int, y int, x_lvl0 int, y_lvl0 int")
    objects = spark.createDataFrame([(1, "0_1", 2.5, 3.0), (2, "1_1", 1.0, 1.0), (3, "4_5", 1.0, 2.0), (4, None, 1.0, 1.0)], "id int, tile_id string, x_px double, y_px double")
    got = {r.id: (r.x, r.y, r.in_catalogue) for r in placement.catalogue_position(objects, tiles, 0.5, 100, 2.0).collect()}
    assert got == {1: (11.5, 53.0, True), 2: (201.0, 201.0, False), 3: (801.0, 1002.0, False), 4: (None, None, False)}
    scaled = placement.rescaled(spark.createDataFrame([(1, 4.0, -1.0), (1, 2.0, -2.0), (2, 8.0, 5.0)], "g int, x double, y double"), {"x": 100, "y": 10}, ["g"])
    assert sorted(map(tuple, scaled.collect())) == [(1, 50.0, -2.0), (1, 100.0, -1.0), (2, 100.0, 10.0)]
    one = spark.range(1).select(placement.mask_corrected(F.lit(2.0), F.lit(0.0), 1.0).alias("a"), placement.mask_corrected(F.lit(2.0), F.lit(4.0), 2.0).alias("b")).first()
    assert one.a == pytest.approx(2 * math.pi / 1e-6) and one.b == pytest.approx(2 * math.pi)


def test_small_columns(spark):
    one = spark.range(1).select(
        C.log_area(F.lit(99)).alias("log"), C.diameter_px(8.0, 0.25).alias("d"), C.in_box(F.lit(1.0), F.lit(2.0), (1, 2), (3, 4)).alias("at"), C.in_box(F.lit(1.0), F.lit(2.1), (1, 0), (3, 2)).alias("off"),
        C.file_name("{s}_{k}_x.csv", s=F.lit("H&E"), k=F.lit(4)).alias("name"), S.is_ihc(F.lit("IHC_CD3")).alias("ihc"), S.marker(F.lit("IHC_PGP95")).alias("m"), S.marker(F.lit("H&E")).alias("none"),
        S.marker_info(F.lit("pgp95"), {"PGP9-5": "nerve", "CD3": "T"}).alias("info"), S.marker_info(F.lit("cd-3"), {"PGP9-5": "nerve", "CD3": "T"}).alias("cd"), S.marker_info(F.lit("X"), {}).alias("unknown"),
        C.content_id(F.lit("abc")).alias("id"),
    ).first()
    assert tuple(one) == (2.0, 32.0, True, False, "HandE_4_x.csv", True, "PGP95", None, "nerve", "T", "Unknown marker", "900150983cd24fb0")
    x, y = C.arrow(F.lit(0.0), F.lit(4.0), 2.0)
    a, b = C.tile_parts(F.lit("12_7"))
    more = spark.range(1).select(x.alias("x"), y.alias("y"), a.alias("a"), b.alias("b"), C.colour_norm(F.lit(5.0), F.lit(0.0), F.lit(4.0)).alias("n"), C.blend(F.lit(10), F.lit(20), 0.5).alias("blend"), C.angle_proxy(F.lit(0.0), F.lit(1.0)).alias("p"), C.to_um(F.lit(4.0), 0.25).alias("um")).first()
    assert tuple(more) == (4.0, 0.0, 12, 7, 1.0, 15, pytest.approx(math.pi / 2), 1.0)


def test_feature_lists():
    names = ["a_variance", "density_1", "b_variance", "x", "density_2", "density_3"]
    assert stats.limited_features(names, {"variance": 1, "density": 2}) == ["a_variance", "density_1", "x", "density_2"]


def test_moments_add_up(spark):
    rows = [(i % 3, i, i / 7, None if i % 5 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, a long, b double, c long")
    parts = stats.moments(df.where("a < 80"), ["g"], ["a", "b", "c"]).unionByName(stats.moments(df.where("a >= 80"), ["g"], ["a", "b", "c"]))
    got = stats.merged_moments(parts, ["g"], ["a", "b", "c"]).toPandas().set_index("g").sort_index()
    want = df.toPandas().groupby("g")
    for c in "abc":
        assert np.allclose(got[f"{c}_mean"].astype(float), want[c].mean()) and np.allclose(got[f"{c}_std"].astype(float), want[c].std()) and np.allclose(got[f"{c}_max"].astype(float), want[c].max())
    assert stats.common_features(df, df.drop("b").withColumn("z", F.lit(1)), ["g"]) == ["a", "c"]
