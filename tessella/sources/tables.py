"""Readers and writers of the pipeline's tables, images and documents."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D = T.DoubleType()
#: Columns of a segmented object and their types; further columns are doubles.
NUCLEI = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("slide_id", "nucleus_id")]
    + [T.StructField(c, _D) for c in ("x", "y", "x_um", "y_um", "area_px", "perimeter_px", "eccentricity", "solidity", "major_axis_length", "minor_axis_length", "aspect_ratio", "orientation", "r", "g", "b")]
    + [T.StructField(c, T.IntegerType()) for c in ("tile_x", "tile_y")]
    + [T.StructField(c, T.StringType()) for c in ("tile_id", "tile")]
    + [T.StructField("label", T.IntegerType())]
)
TILES = "tiles array<struct<x:int,y:int,w:int,h:int,level:int,x_lvl0:int,y_lvl0:int>>, level int, downsample double, level_dimensions array<int>, tile_size int, overlap int, level_mpp double"
_STRINGS = {"slide_id", "nucleus_id", "tile_id", "tile"}


def read_nuclei(spark: SparkSession, path: str) -> DataFrame:
    """A table of objects: Parquet as it is; CSV with a header by name, without inferring types from the data.

    Columns outside the base schema are doubles.
    """
    if not path.rstrip("/").endswith(".csv"):
        return spark.read.parquet(path)
    names = spark.read.option("header", True).csv(path).columns  # reads the header line only
    known = {f.name: f for f in NUCLEI}
    schema = T.StructType([known.get(c, T.StructField(c, T.StringType() if c in _STRINGS else _D)) for c in names])
    return spark.read.schema(schema).option("header", True).csv(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """A tile catalogue's JSON, one row per tile with the catalogue's own fields."""
    doc = spark.read.schema(TILES).option("multiLine", True).json(path)
    return doc.select(F.explode("tiles").alias("t"), "level_mpp", "downsample", "tile_size", "overlap").select("t.*", "level_mpp", "downsample", "tile_size", "overlap")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images as (origin, height, width, channels, data); channel order is blue, green, red."""
    return spark.read.format("image").load(path).select("image.*").withColumnRenamed("nChannels", "channels")


def image_pixels(images: DataFrame) -> DataFrame:
    """(origin, px, py, r, g, b) of three-channel images, or (.., r = g = b) of one-channel ones; no Python."""
    i = F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("_i")
    byte = lambda k: F.conv(F.hex(F.expr(f"substring(data, _i * channels + {k + 1}, 1)")), 16, 10).cast("int")
    flat = images.select("origin", "width", "channels", "data", i)
    colour = lambda k: F.when(F.col("channels") >= 3, byte(k)).otherwise(byte(0))
    return flat.select("origin", (F.col("_i") % F.col("width")).alias("px"), F.floor(F.col("_i") / F.col("width")).alias("py"), colour(2).alias("r"), colour(1).alias("g"), colour(0).alias("b"))


def tile_images(images: DataFrame, tiles: DataFrame) -> DataFrame:
    """Images named ``tile_<x>_<y>`` that the catalogue has; others are left out, as are tiles without an image."""
    x, y = (F.regexp_extract("origin", r"tile_(\d+)_(\d+)\.", k).cast("int") for k in (1, 2))
    return images.withColumns({"x": x, "y": y}).join(tiles, ["x", "y"])


def missing_tiles(images: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tiles of the catalogue without an image: what ``tile_images`` leaves out."""
    x, y = (F.regexp_extract("origin", r"tile_(\d+)_(\d+)\.", k).cast("int") for k in (1, 2))
    return tiles.join(images.select(x.alias("x"), y.alias("y")), ["x", "y"], "left_anti")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.svs") -> DataFrame:
    """Paths and names of files; their content is never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def first_candidate(files: DataFrame, patterns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Of each group's files (path, name) the one whose name fits the earliest pattern; ties by path."""
    rank = F.lit(None).cast("int")
    for k, p in reversed(list(enumerate(patterns))):
        rank = F.when(F.col("name").rlike(p), k).otherwise(rank)
    ranked = files.withColumn("_rank", rank).where("_rank is not null")
    best = F.row_number().over(Window.partitionBy(*by).orderBy("_rank", "path"))
    return ranked.withColumn("_n", best).where("_n = 1").drop("_n", "_rank")


def required_candidate(files: DataFrame, patterns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``first_candidate``, or FileNotFoundError naming the first twenty groups that have none (one pass over the listing)."""
    found = first_candidate(files, patterns, by)
    lacking = files.select(*by).distinct().join(found.select(*by), list(by), "left_anti").orderBy(*by).limit(20).collect()
    if lacking:
        raise FileNotFoundError(f"no file like {list(patterns)} for {[tuple(r) for r in lacking]}")
    return found


def slide_probe(meta: DataFrame, fallback_mpp: float = 0.25) -> DataFrame:
    """Resolution of slides(mpp_x, mpp_y, ...): the mean where both are positive, else the fallback, with a flag."""
    both = (F.col("mpp_x") > 0) & (F.col("mpp_y") > 0)
    return meta.withColumns({"mpp": F.when(both, (F.col("mpp_x") + F.col("mpp_y")) / 2).otherwise(F.lit(fallback_mpp)), "mpp_found": F.coalesce(both, F.lit(False))})


def union_slides(tables: dict[str, DataFrame], name: str = "slide_id") -> DataFrame | None:
    """Tables of several slides as one, missing columns as nulls."""
    out = None
    for slide, df in tables.items():
        part = df.withColumn(name, F.lit(slide))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite", fmt: str = "parquet", single: bool = False) -> None:
    """A stage's output.  ``mode='ignore'`` skips what is there; ``single`` gives one CSV or JSON file."""
    if single:
        df = df.coalesce(1)
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def write_summary(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)  # one row


def write_catalogue(tiles: DataFrame, path: str, **fields: object) -> None:
    """A tile catalogue as one JSON document; a catalogue is one slide's."""
    order = F.sort_array(F.collect_list(F.struct("y", "x", "w", "h", "level", "x_lvl0", "y_lvl0")))
    doc = tiles.agg(F.transform(order, lambda t: F.struct(*[t[c].alias(c) for c in ("x", "y", "w", "h", "level", "x_lvl0", "y_lvl0")])).alias("tiles"))
    doc.withColumns({k: F.lit(v) for k, v in fields.items()}).coalesce(1).write.mode("overwrite").json(path)


def empty_nuclei(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NUCLEI)


def load_config(path: str) -> dict[str, dict]:
    """A YAML file of settings by slide type."""
    import yaml

    with open(PurePosixPath(path)) as f:
        return yaml.safe_load(f)


def slide_config(config: dict[str, dict], kind: str) -> dict:
    """Settings of a slide type, whatever its spelling; an unknown type has the default's."""
    key = lambda s: s.upper().replace("_", "").replace("&", "")
    found = {key(k): v for k, v in config.items()}
    return found.get(key(kind), config.get("default", {}))
