"""Objects of tiles on their slide: absolute coordinates by the tile catalogue, and stain around each object."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.operators.raster import integral, window_sums


def offset_position(objects: DataFrame, mpp: float) -> DataFrame:
    """Objects (tile_x, tile_y, cx, cy) with x, y and their micrometres: the tile's origin and the place in it are in the same pixels."""
    x, y = F.col("tile_x") + F.col("cx"), F.col("tile_y") + F.col("cy")
    return objects.withColumns({"x": x, "y": y, "x_um": C.to_um(x, mpp), "y_um": C.to_um(y, mpp)})


def catalogue_position(objects: DataFrame, tiles: DataFrame, mpp: float, tile_size: int = 1024, downsample: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Objects (tile_id, x_px, y_px) with x, y, x_um and y_um as floats, and ``in_catalogue``.

    The tile's level-0 origin is looked up in the catalogue (x, y, x_lvl0, y_lvl0);
    where it has no such tile or origin, the origin follows from the tile's grid
    number.  Of several entries of a tile the smallest counts.  Every object stays.
    """
    tx, ty = C.tile_parts(F.col("tile_id"))
    known = tiles.where("x_lvl0 is not null and y_lvl0 is not null").groupBy(*by, F.col("x").cast("int").alias("_tx"), F.col("y").cast("int").alias("_ty")).agg(F.min(F.struct("x_lvl0", "y_lvl0")).alias("_at"))
    found = objects.withColumns({"_tx": tx, "_ty": ty}).join(known, [*by, "_tx", "_ty"], "left")
    step = F.lit(float(tile_size * downsample))

    def place(name: str, tile: str) -> Column:
        origin = F.coalesce(F.col(f"_at.{name}_lvl0").cast("double"), F.col(tile) * step)
        return (origin + F.col(f"{name}_px")).cast("float")

    to_um = lambda c: (F.col(c) * F.lit(mpp).cast("float")).cast("float")
    placed = found.withColumns({"x": place("x", "_tx"), "y": place("y", "_ty"), "in_catalogue": F.col("_at").isNotNull()})
    return placed.withColumns({"x_um": to_um("x"), "y_um": to_um("y")}).select(*[F.col(f"`{c}`") for c in objects.columns if c not in ("x", "y", "x_um", "y_um", "in_catalogue")], "x", "y", "x_um", "y_um", "in_catalogue")


def brown_per_object(objects: DataFrame, pixels: DataFrame, width: int, height: int, key: str, by: Sequence[str] = (), threshold: float = 0.15, multiplier: float = 1.5) -> DataFrame:
    """(key, brown_intensity, has_brown) of objects(cx, cy, major_axis_length) on images of pixels(px, py, r, g, b).

    The intensity is the mean DAB density of the square of ``multiplier`` major
    axes to each side, clipped to the image: four look-ups in an integral image,
    whatever its size.  An empty square has 0 and is negative.
    """
    dab = pixels.select(*by, "px", "py", C.stain(C.DAB, *[F.col(c) for c in "rgb"]).alias("_dab"))
    half = F.floor(F.col("major_axis_length") * multiplier).cast("long")
    whole = objects.withColumns({"cx": F.floor("cx").cast("long"), "cy": F.floor("cy").cast("long"), "_half": half})
    sums = window_sums(whole, integral(dab, "_dab", by), F.col("_half"), width, height, key, by)
    mean = F.when(F.col("cells") > 0, F.col("total") / F.col("cells")).otherwise(F.lit(0.0))
    return sums.select(key, mean.alias("brown_intensity")).withColumn("has_brown", (F.col("brown_intensity") > threshold).cast("int"))


def marker_features(objects: DataFrame, markers: DataFrame, key: str, other: str, intensity: str, by: Sequence[str] = (), near: float = 50.0, around: float = 100.0, positive: float = 0.15, unit: float = 1.0, x: str = "x", y: str = "y") -> DataFrame:
    """(key, intensity, local_density, positives): of each object the nearest marker's intensity (0 beyond ``near``), the markers' density and the positive ones within ``around``.

    Distances are in the coordinates' unit; densities divide by the area in ``unit``-scaled ones.
    """
    from tessella.operators.spatial import Ask, nearest, neighbourhood

    closest = nearest(objects, markers, key, other, by, near, True, True, x, y).join(markers.select(other, F.col(intensity).alias("_i")), other, "left")
    given = markers.withColumn("_positive", F.coalesce(F.col(intensity) > positive, F.lit(False)).cast("int"))
    counts = neighbourhood(objects, [Ask("_n", "total", around), Ask("_p", "sum", around, "_positive")], key, by, x, y, of=given).select(key, "_n", "_p")
    area = F.pi() * F.lit((around * unit) ** 2)
    return closest.join(counts, key, "left").select(key, F.coalesce("_i", F.lit(0.0)).alias("intensity"), (F.coalesce("_n", F.lit(0)) / area).alias("local_density"), F.coalesce("_p", F.lit(0)).cast("long").alias("positives"))


def mask_corrected(density: Column, mask_area: Column, radius_px: float) -> Column:
    """A density scaled by the circle's share of the tissue around the object."""
    return density * (F.pi() * F.lit(radius_px * radius_px)) / F.greatest(mask_area, F.lit(1e-6))


def rescaled(df: DataFrame, sizes: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Each column of ``sizes`` scaled so that its group's largest value becomes the size; as it is where that isn't positive."""
    tops = df.groupBy(*by).agg(*[F.max(c).alias(f"_top_{c}") for c in sizes])
    joined = df.join(tops, list(by)) if by else df.crossJoin(F.broadcast(tops))  # one row
    out = {c: F.col(c) * F.when(F.col(f"_top_{c}") > 0, F.lit(float(n)) / F.col(f"_top_{c}")).otherwise(F.lit(1.0)) for c, n in sizes.items()}
    return joined.withColumns(out).select(*[F.col(f"`{c}`") for c in df.columns])
