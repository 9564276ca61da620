"""Functions, sources, models, streaming, plans and the registered queries."""

import os
import struct
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.functions import slides as S
from tessella.operators import ml, raster, stats
from tessella.operators.manifold import umap
from tessella.plans.slide import SlideSpec, run_slides
from tessella.queries import ORACLES, QUERIES
from tessella.sources import tables
from tessella.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"kmeans", "pca", "umap", "slide_pipeline"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_queries(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got.columns)
        return
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns)
    a, b = (f[cols].sort_values(cols).reset_index(drop=True) for f in (got, want))
    for c in cols:
        if a[c].dtype.kind in "fiu":
            assert np.allclose(a[c].astype(float), b[c].astype(float), atol=2e-6, equal_nan=True), c
        else:
            assert (a[c].fillna("") == b[c].fillna("")).all(), c


def test_slide_names(spark):
    names = ["CD3-S25", "HE-B17", "PGP9-5-B27", "BIDS19", "GFAP_x", "odd", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    stain, sample = S.parse_name(F.col("n"))
    got = {r.n: (r.kind, r.stain, r.sample) for r in df.select("n", S.slide_type(F.col("n")).alias("kind"), stain.alias("stain"), sample.alias("sample")).collect()}
    assert got["CD3-S25"] == ("IHC_CD3", "CD3", "S25") and got["HE-B17"] == ("H&E", "H&E", "B17")
    assert got["PGP9-5-B27"] == ("IHC_PGP95", "PGP9.5", "B27") and got["BIDS19"][1:] == ("PID", "S19") and got["odd"] == ("H&E", None, None)
    want = {
        "IBA1-S25": ("Iba1", "S25"), "PGP-B1": ("PGP9.5", "B1"), "HE-B17-2": ("H&E", "B17"), "cd3-s1": ("CD3", "S1"), "pid30b17": ("PID", "B17"), "PID30": (None, None),
        "HE=-b2": ("H&E", "B2"), "Odd-x": ("Odd", "X"), "PGP9-5-b1-c": ("PGP9.5", "5"), "bids19": (None, None), "HE-": ("H&E", ""),
    }
    df = spark.createDataFrame([(n,) for n in want], "n string")
    assert {r.n: (r.stain, r.sample) for r in df.select("n", stain.alias("stain"), sample.alias("sample")).collect()} == want
    names = ["HEB17", "handE-1", "CD3_1", "cd3-1", "Ibal-2", "PGP9_5-1", "PGP5-1", "BID19", "bids2", "NF-1"]
    of = {s: S.stain_slide(F.col("n"), s).alias(f"s{k}") for k, s in enumerate(["H&E", "CD3", "Iba1", "PGP9-5", "PID", "none"])}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", *of.values(), S.normalized(F.col("n"), "separate").alias("m")).collect()
    assert [[r.n for r in rows if r[f"s{k}"]] for k in range(6)] == [["HEB17", "handE-1"], ["cd3-1"], ["Ibal-2"], ["PGP9_5-1"], ["BID19", "bids2"], []]
    assert {r.n: r.m for r in rows}["bids2"] == "PID2"


def test_outer_boundary(spark):
    rng = np.random.default_rng(4)
    grid = rng.integers(0, 4, (14, 17)) * (rng.random((14, 17)) < 0.5)
    rows = [(int(x), int(y), int(grid[y, x])) for y in range(14) for x in range(17)]
    want = set()
    for x, y, v in rows:
        near = {(a, b): int(grid[y + b, x + a]) for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= y + b < 14 and 0 <= x + a < 17}
        differs = any(u != v for (a, b), u in near.items() if a * b == 0)
        if differs and (v == 0 or set(near.values()) - {0, v}):
            want.add((x, y))
    got = raster.outer_boundary(spark.createDataFrame(rows, "px int, py int, label int"), "label", []).collect()
    assert {(r.px, r.py) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("most_edges", [1 << 20, 3])
def test_long_chains_are_settled(spark, most_edges):
    """A chain is settled whole, and by rounds where it has more edges than a task may hold; so is a random graph, keys of any type."""
    from tessella.operators.dedup import dominated
    from tessella.scratch import Scratch

    rng = np.random.default_rng(5)
    n = 3000 if most_edges > 3 else 12
    edges = {(k, k + 1) for k in range(n)} | {(int(min(p)), int(max(p))) for p in rng.integers(5000, 5300, (300, 2)) if p[0] != p[1]}
    fallen = set()
    for k in sorted({x for e in edges for x in e}):
        if k not in fallen:
            fallen |= {b for a, b in edges if a == k}
    name = lambda k: f"k{k:05d}"
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "hi string, lo string")
    assert {r.id for r in dominated(df, Scratch(spark, "t"), most_edges).collect()} == set(map(name, fallen))


def test_t_tail():
    assert stats.t_tail(0.0, 10) == pytest.approx(1)
    assert stats.t_tail(2.228138852, 10) == pytest.approx(0.05, rel=1e-8)
    assert stats.t_tail(63.65674116, 1) == pytest.approx(0.01, rel=1e-8)


def test_columns(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (100, 40, 2.0)], "area_px int, perimeter_px int, minor double")
    rows = df.select(C.circularity(F.col("area_px"), F.col("perimeter_px")).alias("c"), C.aspect_ratio(F.lit(3.0), F.col("minor")).alias("a")).collect()
    assert rows[0].c == 0 and rows[0].a == 0 and rows[1].c == pytest.approx(np.pi / 4) and rows[1].a == 1.5
    nan = spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "v double")
    assert [r.v for r in C.filled(nan, ["v"]).collect()] == [0, 0, 2]


def test_standardize_uses_population_deviation(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(10)], "a double, b double")
    got = ml.standardize(df, ["a", "b"]).toPandas()
    assert got.a.std(ddof=0) == pytest.approx(1) and (got.b == 0).all()


def test_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.1, (60, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    df = spark.createDataFrame(pd.DataFrame({"id": range(180), "a": x[:, 0], "b": x[:, 1], "g": np.repeat([0, 1, 2], 60)}))
    got = ml.birch(df, ["a", "b"], 3).toPandas()
    assert got.groupby("g").cluster.nunique().eq(1).all() and got.cluster.nunique() == 3
    best, _ = ml.kmeans(df, ["a", "b"], 3, seeds=3)
    assert best.toPandas().groupby("g").cluster.nunique().eq(1).all()
    labels = ml.hierarchical_labels(df, ["a", "b"], "g", "id").toPandas()
    assert len(labels) == 180 and labels.cluster_hierarchical.str.match(r"^[0-2][a-d]$").all()
    flat = umap(df, ["a", "b"], "id", neighbours=10).toPandas().merge(df.toPandas(), on="id")
    centre = flat.groupby("g")[["umap_1", "umap_2"]].mean()
    spread = flat.groupby("g")[["umap_1", "umap_2"]].std().to_numpy().max()
    assert min(np.linalg.norm(centre.loc[i] - centre.loc[j]) for i, j in ((0, 1), (0, 2), (1, 2))) > spread


def test_hierarchical_labels_fit_every_row(spark):
    """Sub-clusters of a few rows among 40,000 get their own letters, and each row the letter of the nearest mean of a letter's rows."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.01, (40_000, 2)), *[rng.normal(c, 0.01, (3, 2)) for c in ((900, 0), (0, 900), (900, 900))], [[1.0, 1.0]]])
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "a": x[:, 0], "b": x[:, 1], "g": [7] * (len(x) - 1) + [8]})).repartition(6)
    got = ml.hierarchical_labels(df, ["a", "b"], "g", "id").toPandas().sort_values("id").cluster_hierarchical.to_numpy()
    assert len(got) == len(x) and got[-1] == "8a"
    parts = [set(got[a:b]) for a, b in ((0, 40_000), (40_000, 40_003), (40_003, 40_006), (40_006, 40_009))]
    assert all(len(p) == 1 for p in parts) and len(set.union(*parts)) == 4


@pytest.mark.skipif(not os.path.isdir(SF.replace("0.001", "0.01")), reason="needs the test tables")
def test_whole_queries_cover_their_tables(spark):
    """On an image of more than 100 rows, and on all slides."""
    sf = SF.replace("0.001", "0.01")
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("best_orientation", "mask_resize", "patch_intensity", "feature_splat"):
        got, want = QUERIES[name](spark, sf).toPandas(), db.sql(ORACLES[name]).df()
        keys = [c for c in ("name", "nid", "slide_no", "px", "py") if c in got]
        both = got.merge(want, on=keys, suffixes=("", "_w"))
        assert len(got) == len(want) == len(both)
        assert all(np.allclose(both[c], both[f"{c}_w"], atol=2e-6) for c in got if c not in keys)
    assert QUERIES["patch_intensity"](spark, sf).count() == db.sql("select count(*) from orders").fetchall()[0][0]
    assert QUERIES["feature_splat"](spark, sf).select("slide_no").distinct().count() == 4


def test_registered_clustering_uses_the_defaults(spark, monkeypatch, tmp_path):
    import inspect

    from tessella.queries import QUERIES

    rng = np.random.default_rng(4)
    pd.DataFrame({"vec_id": range(60), "embedding": list(rng.normal(size=(60, 64)).astype("float32")), "label": [0] * 60}).to_parquet(f"{tmp_path}/embeddings.parquet")
    for name, function, defaults in (("kmeans", "kmeans", ["seeds"]),):
        real, seen = getattr(ml, function), {}

        def spy(*args, real=real, seen=seen, **how):
            bound = inspect.signature(real).bind(*args, **how)
            bound.apply_defaults()
            seen.update(bound.arguments)
            return real(*args, **how)

        monkeypatch.setattr(ml, function, spy)
        QUERIES[name](spark, str(tmp_path)).count()
        assert all(seen[d] >= inspect.signature(real).parameters[d].default for d in defaults)


def nuclei(spark):
    rng = np.random.default_rng(1)
    n = 200
    p = pd.DataFrame({c: rng.uniform(5, 50, n) for c in ("area_px", "perimeter_px", "major_axis_length", "minor_axis_length", "orientation", "r", "g", "b")})
    p["nucleus_id"], p["slide_id"] = [f"n{i}" for i in range(n)], [f"s{i % 2}" for i in range(n)]
    p["x_um"], p["y_um"] = rng.uniform(0, 300, n), rng.uniform(0, 300, n)
    return spark.createDataFrame(p)


def test_run_slides(spark):
    out = run_slides(nuclei(spark), SlideSpec(radii_um=(50.0,), clusters=4))
    kept, features = out["nuclei"].count(), out["features"]
    assert features.count() == kept <= 200
    assert {"coherency_50um", "density_um2_r50.0", "circularity_local_median_50um", "gray_mean_local_variance_50um"} <= set(features.columns)
    assert out["clusters"].select("cluster").distinct().count() <= 4 and out["report"].count() == 2


def png(path, pixels):
    h, w, _ = pixels.shape
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_sources(spark, tmp_path):
    (tmp_path / "n.csv").write_text("slide_id,nucleus_id,x,y,area_px,coherency_50um\ns,a,1,2,3,\ns,b,4,5,6,0.5\n")
    df = tables.read_nuclei(spark, str(tmp_path / "n.csv"))
    assert [r["coherency_50um"] for r in df.orderBy("nucleus_id").collect()] == [None, 0.5]
    (tmp_path / "tiles.json").write_text('{"tiles":[{"x":0,"y":0,"w":4,"h":3,"level":0,"x_lvl0":0,"y_lvl0":0},{"x":8,"y":0,"w":4,"h":3,"level":0,"x_lvl0":8,"y_lvl0":0}],"level":0,"downsample":1.0,"tile_size":4,"overlap":0,"level_mpp":0.25}')
    catalogue = tables.read_tiles(spark, str(tmp_path / "tiles.json"))
    rgb = np.random.default_rng(0).integers(0, 256, (3, 4, 3), dtype=np.uint8)
    (tmp_path / "tiles").mkdir()
    png(tmp_path / "tiles" / "tile_8_0.png", rgb)
    images = tables.tile_images(tables.read_images(spark, str(tmp_path / "tiles")), catalogue)
    assert images.count() == 1
    got = tables.image_pixels(images).toPandas()
    back = np.zeros_like(rgb)
    back[got.py, got.px] = got[["r", "g", "b"]]
    assert (back == rgb).all()
    files = tables.list_files(spark, str(tmp_path / "tiles"), "*.png")
    assert files.count() == 1
    tables.write_table(df, str(tmp_path / "out"), ["slide_id"])
    assert tables.read_nuclei(spark, str(tmp_path / "out")).count() == 2
    tables.write_catalogue(catalogue.drop("level_mpp", "downsample", "tile_size", "overlap"), str(tmp_path / "cat"), level=0, tile_size=4)
    assert spark.read.json(str(tmp_path / "cat")).selectExpr("size(tiles)").first()[0] == 2
    assert tables.slide_config({"IHC_CD3": {"k": 15}, "default": {"k": 20}}, "ihccd3") == {"k": 15} and tables.empty_nuclei(spark).count() == 0


def test_streaming(spark, tmp_path):
    src = nuclei(spark).select("slide_id", "nucleus_id", "area_px", "x_um", "y_um")
    src.where("slide_id = 's0'").write.parquet(str(tmp_path / "in" / "a"))
    stream = ingest.stream_nuclei(spark, str(tmp_path / "in" / "*"), src.schema)
    refresh = lambda: ingest.refresh_slides(stream, str(tmp_path / "store"), lambda d: d.groupBy("slide_id").agg(F.count("*").alias("n")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    refresh()
    src.where("slide_id = 's1'").write.parquet(str(tmp_path / "in" / "b"))
    refresh()
    assert {(r.slide_id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("s0", 100), ("s1", 100)}
    q = ingest.running_summary(stream).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from running").first()[0] == 200
