"""Objects of overlapping tiles as objects of the whole image.

A segmenter sees one tile at a time, so an object in an overlap is found in each
tile, and one on a border in parts.  Two tiles' labels are the same object if they
agree where both tiles look; chains of labels go through a distributed union-find.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.graph import connected_components
from tessella.scratch import Scratch


def covering(c: Column, tile: int, overlap: int) -> Column:
    """Starts of all tiles of a grid that a coordinate lies in, those beyond the image's last whole tile too."""
    step = tile - overlap
    first = F.greatest(F.ceil((c - (tile - 1)) / step), F.lit(0))
    return F.transform(F.sequence(first, F.floor(c / step)), lambda k: k * step)


def stitched_labels(labels: DataFrame, tile: int, overlap: int, scratch: Scratch, by: Sequence[str] = ("path",), least: float = 0.5) -> DataFrame:
    """(by, object, px, py) of labels (by, tile_x, tile_y, label, px, py in the tile): every pixel once, in the whole image's coordinates.

    Labels of two tiles are one object if their common pixels are at least ``least`` of
    the larger one's, counting only pixels that both tiles see.  A pixel of several
    objects goes to the smallest number.  Labels that are null or not positive are
    background; repeated rows count once.  A pixel is in at most
    (tile / (tile - overlap) + 1) squared tiles, which bounds what meets on it.
    Numbers are 64-bit hashes of tile and label.
    """
    at = labels.where("label > 0").select(*by, "tile_x", "tile_y", (F.col("tile_x") + F.col("px")).cast("long").alias("px"), (F.col("tile_y") + F.col("py")).cast("long").alias("py"), F.xxhash64(*by, "tile_x", "tile_y", "label").alias("id"))
    own = scratch.write(at.distinct(), "labels")
    tiles = own.withColumn("_ox", F.explode(covering(F.col("px"), tile, overlap))).withColumn("_oy", F.explode(covering(F.col("py"), tile, overlap)))
    seen = tiles.where("_ox <> tile_x or _oy <> tile_y")
    sizes = seen.groupBy("id", "_ox", "_oy").agg(F.count(F.lit(1)).alias("n"))
    both = seen.select(*by, "px", "py").distinct()
    inside = own.join(both, [*by, "px", "py"], "left_semi")
    left, right = (inside.select(*by, "px", "py", F.col("id").alias(f"_{s}"), F.col("tile_x").alias(f"_{s}x"), F.col("tile_y").alias(f"_{s}y")) for s in "ab")
    shared = left.join(right, [*by, "px", "py"]).where("_ax < _bx or (_ax = _bx and _ay < _by)").groupBy("_a", "_ax", "_ay", "_b", "_bx", "_by").agg(F.count(F.lit(1)).alias("common"))

    def size(label: str, other: str) -> DataFrame:
        return sizes.select(F.col("id").alias(f"_{label}"), F.col("_ox").alias(f"_{other}x"), F.col("_oy").alias(f"_{other}y"), F.col("n").alias(f"_n{label}"))

    judged = shared.join(size("a", "b"), ["_a", "_bx", "_by"]).join(size("b", "a"), ["_b", "_ax", "_ay"])
    same = judged.where(F.col("common") >= F.greatest("_na", "_nb") * least)
    comps = connected_components(same.select(F.col("_a").alias("a"), F.col("_b").alias("b")), scratch, "objects")
    found = own.join(comps, "id", "left")
    return found.groupBy(*by, "px", "py").agg(F.min(F.coalesce("comp", "id")).alias("object")).select(*by, "object", "px", "py")


def stitched_objects(pixels: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """(by, object) with area, box and centroid."""
    box = [f(c).alias(f"{n}_{a}") for c, a in (("px", "x"), ("py", "y")) for n, f in (("min", F.min), ("max", F.max))]
    return pixels.groupBy(*by, "object").agg(F.count(F.lit(1)).alias("area"), *box, F.avg("px").alias("cx"), F.avg("py").alias("cy"))
