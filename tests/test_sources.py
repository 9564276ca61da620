"""Slide images by a stand-in reader, PNG content, candidates, reports and saved models."""

import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import StandardScalerModel
from pyspark.sql import functions as F

from tessella.operators import ml, stats
from tessella.sources import png, tables, wsi

#: A slide of 70 x 50 pixels and two levels whose pixels tell where they are.
READER = '''
class Region:
    def __init__(self, x, y, w, h):
        self.at = x, y, w, h
    def convert(self, mode):
        return self
    def tobytes(self):
        x, y, w, h = self.at
        return bytes(v for j in range(h) for i in range(w) for v in (x + i, y + j, 7))
class OpenSlide:
    def __init__(self, path):
        self.dimensions, self.level_dimensions = (70, 50), [(70, 50), (35, 25)]
        self.level_count, self.level_downsamples = 2, (1.0, 2.0)
        self.properties = {"openslide.mpp-x": "0.25", "openslide.mpp-y": "0.5"} if "plain" not in path else {}
    def read_region(self, at, level, size):
        scale = int(self.level_downsamples[level])
        return Region(at[0] // scale, at[1] // scale, *size)
'''


@pytest.fixture(scope="module")
def slide(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("reader") / "openslide.py"
    path.write_text(READER)
    spark.sparkContext.addPyFile(str(path))
    spark.dataSource.register(wsi.WsiSource)
    return lambda name, **options: spark.read.format("wsi").options(path=name, **options).load()


def test_regions_are_whole_tiles_of_a_level(slide):
    got = {(r.x, r.y): r for r in slide("s.svs", tile="20", overlap="5").collect()}
    assert set(got) == {(x, y) for x in (0, 15, 30, 45) for y in (0, 15, 30)}
    rgb = np.frombuffer(got[15, 30].rgb, np.uint8).reshape(20, 20, 3)
    assert rgb[0, 0].tolist() == [15, 30, 7] and rgb[19, 19].tolist() == [34, 49, 7]
    small = slide("s.svs", tile="20", overlap="5", level="1")
    assert {(r.x, r.y, r.level) for r in small.collect()} == {(0, 0, 1), (15, 0, 1)} and bytes(small.where("x = 15").first().rgb[:3]) == bytes([15, 0, 7])
    assert slide("s.svs", tile="100", overlap="5").count() == 0
    with pytest.raises(Exception, match="overlap of 128"):
        slide("s.svs", tile="100").count()


def test_metadata_and_resolution(slide):
    both = slide("s.svs", metadata="true").union(slide("plain.svs", metadata="true"))
    got = {r.path: r for r in tables.slide_probe(both).collect()}
    assert (got["s.svs"].width, got["s.svs"].height, got["s.svs"].levels, got["s.svs"].downsamples) == (70, 50, 2, [1.0, 2.0])
    assert (got["s.svs"].mpp, got["s.svs"].mpp_found) == (0.375, True) and (got["plain.svs"].mpp, got["plain.svs"].mpp_found) == (0.25, False)


def test_segmenter_gets_tiles(slide):
    def bright(rgb, w, h):
        image = np.frombuffer(rgb, np.uint8).reshape(h, w, 3)
        py, px = np.nonzero(image[..., 0] == 16)
        return pd.DataFrame({"label": 1, "px": px, "py": py})

    got = wsi.segment(slide("s.svs", tile="20", overlap="5"), bright).toPandas()
    assert set(got["tile_x"]) == {0, 15} and set(got["tile_x"] + got["px"]) == {16} and len(got) == 2 * 3 * 20


def _decode(content):
    w, h, bits, colour = struct.unpack(">IIBB", content[16:26])
    at, data = 8, b""
    while at < len(content):
        (n,) = struct.unpack(">I", content[at : at + 4])
        kind, body = content[at + 4 : at + 8], content[at + 8 : at + 8 + n]
        assert struct.unpack(">I", content[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, -1)
    assert not lines[:, 0].any()
    return np.ascontiguousarray(lines[:, 1:]).view(">u2" if bits == 16 else np.uint8).reshape((h, w, 3) if colour == 2 else (h, w))


def test_label_masks_of_16_bits(spark, tmp_path):
    """A mask comes back whole from the written table; gaps and nulls are 0, values out of range are cut, and an empty table has no image."""
    rows = [("s", 0, 0, 1), ("s", 3, 1, 70000), ("s", 2, 2, 40000), ("s", 1, 1, None), ("s", 9, 9, 5), ("t", 0, 2, -4)]
    labels = spark.createDataFrame(rows, "slide string, px int, py int, label long")
    images = png.encoded_images(labels, F.lit("mask.png"), ["label"], (4, 3), ["slide"], True)
    tables.write_table(images, str(tmp_path / "masks"), ["slide"])
    got = {r.slide: _decode(bytes(r.content)) for r in spark.read.parquet(str(tmp_path / "masks")).collect()}
    want = np.zeros((3, 4), int)
    want[0, 0], want[1, 3], want[2, 2] = 1, 65535, 40000
    assert set(got) == {"s", "t"} and (got["s"] == want).all() and not got["t"].any()
    assert png.encoded_images(labels.where("px > 99"), F.lit("m"), ["label"], (4, 3), ["slide"], True).count() == 0
    with pytest.raises(ValueError):
        png.encoded_images(labels, F.lit("m"), ["label", "label"], (4, 3))


def test_tiles_are_readable_images(spark, tmp_path):
    """Colour tiles whose content Spark's image reader takes, under names that the catalogue's lookup knows."""
    pixels = spark.range(200).select((F.lit(5) * F.floor(F.col("id") / 100)).alias("x"), F.lit(0).alias("y"), (F.col("id") % 10).alias("px"), F.floor(F.col("id") % 100 / 10).alias("py"), (F.col("id") % 251).alias("r"), (F.col("id") * 3 % 251).alias("g"), F.lit(9).alias("b"))
    for r in png.encoded_images(pixels, png.tile_name(F.col("x"), F.col("y")), ["r", "g", "b"], (10, 10)).collect():
        (tmp_path / r["name"]).write_bytes(bytes(r["content"]))
    images = tables.read_images(spark, str(tmp_path))
    catalogue = spark.createDataFrame([(0, 0), (5, 0), (10, 0)], "x int, y int")
    named = tables.tile_images(images, catalogue)
    back = tables.image_pixels(named).join(named.select("origin", "x", "y"), "origin").select("x", "y", "px", "py", "r", "g", "b")
    assert back.count() == 200 and back.exceptAll(pixels.select(*[F.col(c).cast(back.schema[c].dataType) for c in back.columns])).isEmpty()
    assert [tuple(r) for r in tables.missing_tiles(images, catalogue).collect()] == [(10, 0)]


def test_candidates(spark):
    files = spark.createDataFrame([("a", "/1/a_mask.png", "a_mask.png"), ("a", "/1/a-mask.png", "a-mask.png"), ("b", "/2/b-mask.png", "b-mask.png"), ("c", "/3/c.txt", "c.txt")], "slide string, path string, name string")
    patterns = ["_mask[.]png$", "-mask[.]png$"]
    assert {(r.slide, r.name) for r in tables.first_candidate(files, patterns, ["slide"]).collect()} == {("a", "a_mask.png"), ("b", "b-mask.png")}
    assert tables.required_candidate(files.where("slide < 'c'"), patterns, ["slide"]).count() == 2
    with pytest.raises(FileNotFoundError, match="c"):
        tables.required_candidate(files, patterns, ["slide"])


def test_reports(spark, tmp_path):
    row = spark.createDataFrame([(3, None, "x")], "n int, mean double, `odd name` string")
    assert stats.report_text(row, "Slide").first().value == "Slide\nn: 3\nmean: n/a\nodd name: x"
    assert [r.value for r in stats.markdown_head(row).union(stats.markdown(row)).collect()] == ["| n | mean | odd name |\n| --- | --- | --- |", "| 3 |  | x |"]
    tables.write_summary(row, str(tmp_path / "summary"))
    got = spark.read.json(str(tmp_path / "summary")).first()
    assert got["n"] == 3 and got["odd name"] == "x"


def test_models_are_saved_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(9)], "a double, b double")
    labelled, model = ml.kmeans(df, ["a", "b"], 2, seeds=2)
    for _ in range(2):  # a second save replaces the first
        ml.save_model(model, str(tmp_path / "model"))
    again = ml.load_model(type(model), str(tmp_path / "model"))
    assert again.transform(ml.assemble(df, ["a", "b"], "_x")).select("a", "cluster").exceptAll(labelled.select("a", "cluster")).isEmpty()
    with pytest.raises(Exception):
        ml.load_model(StandardScalerModel, str(tmp_path / "none"))


def test_rows_are_numbered_by_ranges(spark):
    """Places equal a sort's whatever the ranges; one group holds most rows, and null groups are groups."""
    rng = np.random.default_rng(2)
    keys = rng.permutation(5000)
    rows = pd.DataFrame({"k": keys, "g": np.where(keys % 10 < 8, "big", np.where(keys % 10 == 8, "small", None))})
    df = spark.createDataFrame([(int(k), g) for k, g in zip(rows["k"], rows["g"])], "k long, g string")
    got = stats.numbered(df, "k", ["g"], "n").toPandas()
    assert len(got) == 5000
    for _, part in got.groupby("g", dropna=False):
        part = part.sort_values("k")
        assert part["n"].tolist() == list(range(len(part)))
    assert sorted(r.k for r in stats.every_nth(df, 1000, "k", ()).collect()) == [0, 1000, 2000, 3000, 4000]
    assert stats.numbered(df.where("k < 0"), "k", ["g"], "n").count() == 0
    codes = {(r.g, r.code) for r in stats.ordinal(df, "g", "code").select("g", "code").distinct().collect()}
    assert codes == {("big", 0), ("small", 1)}


def test_columns_described_without_nan(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, float("nan")), ("b", None, 2.0)], "g string, v double, w double")
    got = {(r.g, r.feature): (r.n, r["mean"], r.max) for r in stats.describe_each(df, ["v", "w"], ["g"]).collect()}
    assert got == {("a", "v"): (2, 2.0, 3.0), ("a", "w"): (0, None, None), ("b", "v"): (0, None, None), ("b", "w"): (1, 2.0, 2.0)}
