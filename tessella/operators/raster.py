"""Raster operators over pixel rows (image keys, px, py, values).

Everything relational is Catalyst: colour masks, morphology by window frames,
integral images by prefix sums, components over runs and a distributed
union-find, moments by group-by.  Only thinning, contour length and convex
hulls, which have no relational form, are numpy kernels over bounded tiles or
single objects.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.graph import connected_components
from tessella.scratch import Scratch


# -- morphology: pixels outside the image are ignored; the anchor of an even kernel is right of its centre


def _extreme(df: DataFrame, v: str, k: int, by: Sequence[str], agg) -> DataFrame:
    low, high = -(k // 2), k - 1 - k // 2
    rows = Window.partitionBy(*by, "py").orderBy("px").rangeBetween(low, high)
    cols = Window.partitionBy(*by, "px").orderBy("py").rangeBetween(low, high)
    return df.withColumn(v, agg(v).over(rows)).withColumn(v, agg(v).over(cols))


def dilate(df: DataFrame, v: str, k: int, by: Sequence[str], times: int = 1) -> DataFrame:
    for _ in range(times):
        df = _extreme(df, v, k, by, F.max)
    return df


def erode(df: DataFrame, v: str, k: int, by: Sequence[str], times: int = 1) -> DataFrame:
    for _ in range(times):
        df = _extreme(df, v, k, by, F.min)
    return df


def close(df: DataFrame, v: str, k: int, by: Sequence[str], times: int = 1) -> DataFrame:
    return erode(dilate(df, v, k, by, times), v, k, by, times)


def open_(df: DataFrame, v: str, k: int, by: Sequence[str], times: int = 1) -> DataFrame:
    return dilate(erode(df, v, k, by, times), v, k, by, times)


def ellipse(k: int) -> list[tuple[int, int]]:
    """Rows (dy, half width) of an elliptic kernel of odd size k; of size 3 it is a cross."""
    r = k // 2
    return [(dy, round(r * (1 - dy * dy / (r * r)) ** 0.5) if r else 0) for dy in range(-r, r + 1)]


def _shaped(df: DataFrame, v: str, kernel: Sequence[tuple[int, int]], by: Sequence[str], agg, pick) -> DataFrame:
    """The extreme over a symmetric kernel of rows: one frame along the rows for each width, then one look up or down for each row."""
    rows, cols = Window.partitionBy(*by, "py").orderBy("px"), Window.partitionBy(*by, "px").orderBy("py")
    wide = df.withColumns({f"_w{h}": agg(v).over(rows.rangeBetween(-h, h)) for h in {h for _, h in kernel}})
    shifted = wide.withColumns({f"_s{dy}": agg(f"_w{h}").over(cols.rangeBetween(dy, dy)) for dy, h in kernel})
    parts = [F.col(f"`_s{dy}`") for dy, _ in kernel]
    return shifted.withColumn(v, pick(*parts) if len(parts) > 1 else parts[0]).select(*df.columns)


def dilate_shape(df: DataFrame, v: str, kernel: Sequence[tuple[int, int]], by: Sequence[str]) -> DataFrame:
    return _shaped(df, v, kernel, by, F.max, F.greatest)


def erode_shape(df: DataFrame, v: str, kernel: Sequence[tuple[int, int]], by: Sequence[str]) -> DataFrame:
    return _shaped(df, v, kernel, by, F.min, F.least)


def close_shape(df: DataFrame, v: str, kernel: Sequence[tuple[int, int]], by: Sequence[str]) -> DataFrame:
    return erode_shape(dilate_shape(df, v, kernel, by), v, kernel, by)


# -- integral images


def integral(df: DataFrame, v: str, by: Sequence[str]) -> DataFrame:
    """(by, px, py, s): the sum of v over all pixels up to and including px and py; the grid must be dense."""
    rows = Window.partitionBy(*by, "py").orderBy("px").rowsBetween(Window.unboundedPreceding, 0)
    cols = Window.partitionBy(*by, "px").orderBy("py").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("s", F.sum(v).over(rows)).withColumn("s", F.sum("s").over(cols)).select(*by, "px", "py", "s")


def window_sums(points: DataFrame, image: DataFrame, half: int | Column, width: int, height: int, key: str, by: Sequence[str], cx: str = "cx", cy: str = "cy") -> DataFrame:
    """(key, total, cells): the integral image's sum over ``[c - half, c + half)`` in both directions, clipped to the image.

    Each point asks for the four corners of its window: one equi-join, whatever the window's size, which may be the point's own.
    """
    clip = lambda c, top: F.least(F.greatest(c, F.lit(0)), F.lit(top))
    x0, x1 = clip(F.col(cx) - half, width), clip(F.col(cx) + half, width)
    y0, y1 = clip(F.col(cy) - half, height), clip(F.col(cy) + half, height)
    corner = lambda x, y, sign: F.struct((x - 1).cast("long").alias("px"), (y - 1).cast("long").alias("py"), F.lit(sign).alias("sign"))
    asked = points.select(key, *by, ((x1 - x0) * (y1 - y0)).alias("cells"), F.explode(F.array(corner(x1, y1, 1), corner(x0, y1, -1), corner(x1, y0, -1), corner(x0, y0, 1))).alias("q"))
    asked = asked.select(key, *by, "cells", "q.px", "q.py", "q.sign")
    image = image.withColumns({"px": F.col("px").cast("long"), "py": F.col("py").cast("long")})
    found = asked.join(image, [*by, "px", "py"], "left")
    return found.groupBy(key).agg(F.coalesce(F.sum(F.col("sign") * F.col("s")), F.lit(0)).alias("total"), F.first("cells").alias("cells"))


# -- components


def runs(df: DataFrame, v: str, by: Sequence[str]) -> DataFrame:
    """Maximal horizontal runs of set pixels: (by, py, x0, x1, rid), ends included."""
    group = F.col("px") - F.row_number().over(Window.partitionBy(*by, "py").orderBy("px"))
    out = df.where(F.col(v) > 0).withColumn("_g", group).groupBy(*by, "py", "_g").agg(F.min("px").alias("x0"), F.max("px").alias("x1")).drop("_g")
    return out.withColumn("rid", F.xxhash64(*by, "py", "x0"))


#: Pixels of a row's blocks in which runs of neighbouring rows meet.
_RUN_BLOCK = 256


def components(df: DataFrame, v: str, by: Sequence[str], scratch: Scratch, corners: bool = True) -> DataFrame:
    """Connected components as runs with a component id; runs of neighbouring rows that touch are joined, at corners too or not.

    Runs meet in the blocks of a row that they reach, so a row of many runs isn't paired whole.
    """
    reach = int(corners)
    own = scratch.write(runs(df, v, by), "runs")
    cover = lambda a, b: F.explode(F.sequence(F.floor(a / _RUN_BLOCK), F.floor(b / _RUN_BLOCK)))
    here = own.withColumn("_block", cover(F.col("x0"), F.col("x1")))
    below = own.select(*by, (F.col("py") - 1).alias("py"), F.col("x0").alias("_b0"), F.col("x1").alias("_b1"), F.col("rid").alias("_brid"))
    below = below.withColumn("_block", cover(F.col("_b0") - reach, F.col("_b1") + reach))
    touch = here.join(below, [*by, "py", "_block"]).where((F.col("x0") <= F.col("_b1") + reach) & (F.col("_b0") <= F.col("x1") + reach))
    comps = connected_components(touch.select(F.col("rid").alias("a"), F.col("_brid").alias("b")), scratch, "components")
    return own.join(comps, own["rid"] == comps["id"], "left").select(*by, "py", "x0", "x1", F.coalesce("comp", "rid").alias("comp"))


def run_pixels(of: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, px, py) of the pixels of runs."""
    return of.select(*by, F.explode(F.sequence("x0", "x1")).alias("px"), "py")


def largest_centroid(comps: DataFrame, by: Sequence[str], scale: float = 1.0) -> DataFrame:
    """(by, cx, cy, area) of each image's largest component (of equals the first by row and column): the centroid cut to whole pixels, then scaled and rounded."""
    best = component_table(comps, by).groupBy(*by).agg(F.max_by(F.struct("cx", "cy", "area"), F.struct("area", -F.col("min_y"), -F.col("min_x"))).alias("b"))
    at = lambda c: F.round(F.floor(c) * F.lit(float(scale))).cast("long")
    return best.select(*by, at("b.cx").alias("cx"), at("b.cy").alias("cy"), F.col("b.area").alias("area"))


def external_contour(df: DataFrame, v: str, by: Sequence[str], scratch: Scratch) -> DataFrame:
    """Set pixels that border the outside: the image's edge or the background that reaches it (by sides); borders of holes, and objects in holes, are left out.

    The grid must be dense.
    """
    empty = components(df.select(*by, "px", "py", (F.col(v) <= 0).cast("int").alias("_e")), "_e", by, scratch, corners=False)
    edge = df.groupBy(*by).agg(F.min("px").alias("_l"), F.max("px").alias("_r"), F.min("py").alias("_t"), F.max("py").alias("_b"))
    bounded = lambda d: d.join(edge, list(by)) if by else d.crossJoin(F.broadcast(edge))  # noqa: E731  (one row)
    reach = bounded(empty).where("x0 = _l or x1 = _r or py = _t or py = _b").select(*by, "comp").distinct()
    outside = run_pixels(empty.join(reach, [*by, "comp"], "left_semi"), by)
    on = df.where(F.col(v) > 0).select(*by, "px", "py")
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))]))
    beside = outside.select(*by, "px", "py", step.alias("d")).select(*by, (F.col("px") + F.col("d.a")).alias("px"), (F.col("py") + F.col("d.b")).alias("py")).distinct()
    at_edge = bounded(on).where("px = _l or px = _r or py = _t or py = _b").select(*by, "px", "py")
    return on.join(beside, [*by, "px", "py"], "left_semi").union(at_edge).distinct()


def component_table(comps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Area, bounding box and centroid of each component."""
    n = F.col("x1") - F.col("x0") + 1
    return comps.groupBy(*by, "comp").agg(
        F.sum(n).alias("area"), F.min("x0").alias("min_x"), F.max("x1").alias("max_x"), F.min("py").alias("min_y"), F.max("py").alias("max_y"),
        (F.sum((F.col("x0") + F.col("x1")) / 2 * n) / F.sum(n)).alias("cx"), (F.sum(F.col("py") * n) / F.sum(n)).alias("cy"),
    )


def large_components(comps: DataFrame, by: Sequence[str], least: Column) -> DataFrame:
    return comps.join(component_table(comps, by).where(F.col("area") >= least).select(*by, "comp"), [*by, "comp"], "left_semi")


#: Sides of the kernels that close gaps and that remove specks, by pyramid level (the last one from there on).
TISSUE_KERNELS = [(10, 3), (15, 3), (25, 5)]


def tissue_mask(df: DataFrame, v: str, level: int, width: int, height: int, by: Sequence[str], scratch: Scratch, share: float = 1e-5, floor: int = 5000) -> DataFrame:
    """(by, px, py, v) of a raw tissue mask on a dense grid: gaps closed twice and specks opened by the level's kernels, then components of too few pixels removed."""
    closing, opening = TISSUE_KERNELS[min(level, len(TISSUE_KERNELS) - 1)]
    clean = scratch.write(open_(close(df.select(*by, "px", "py", v), v, closing, by, 2), v, opening, by), "clean")
    large = large_components(components(clean, v, by, scratch), by, F.lit(least_component_area(width, height, share, floor)))
    kept = run_pixels(large, by).withColumn("_kept", F.lit(1))
    return clean.join(kept, [*by, "px", "py"], "left").select(*by, "px", "py", F.coalesce("_kept", F.lit(0)).alias(v))


def least_component_area(width: int, height: int, share: float = 1e-5, floor: int = 5000) -> int:
    return max(int(share * width * height), floor)


# -- objects


def region_props(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Area, centroid, axes, eccentricity, orientation and mean colour of every label, from moments alone."""
    lab = df.where("label > 0").groupBy(*by, "label").agg(
        F.count(F.lit(1)).alias("area_px"), F.avg("px").alias("cx"), F.avg("py").alias("cy"), F.avg("r").alias("r"), F.avg("g").alias("g"), F.avg("b").alias("b"),
        F.var_pop("px").alias("_a"), F.var_pop("py").alias("_c"), F.covar_pop("px", "py").alias("_b"),
    )
    a, b, c = F.col("_a"), -F.col("_b"), F.col("_c")
    root = F.sqrt(4 * b * b + (a - c) * (a - c)) / 2
    big, small = (a + c) / 2 + root, F.greatest((a + c) / 2 - root, F.lit(0.0))
    turn = F.when(a == c, F.when(b < 0, F.lit(-np.pi / 4)).otherwise(F.lit(np.pi / 4))).otherwise(F.atan2(-2 * b, c - a) / 2)
    return lab.withColumns({
        "major_axis_length": 4 * F.sqrt(big), "minor_axis_length": 4 * F.sqrt(small),
        "eccentricity": F.when(big > 0, F.sqrt(1 - small / big)).otherwise(F.lit(0.0)), "orientation": turn,
    }).drop("_a", "_b", "_c")


#: Contour lengths of a border pixel by its pattern of border neighbours (4-neighbours 2, diagonals 10, itself 1).
_LENGTHS = {1.0: [5, 7, 15, 17, 25, 27], 2**0.5: [21, 33], (1 + 2**0.5) / 2: [13, 23]}


def perimeter(mask: np.ndarray) -> float:
    """Length of the border of a 0/1 mask, by local patterns."""
    m = np.pad(mask.astype(np.int64), 2)
    inner = m.copy()
    for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
        inner &= np.roll(m, (dy, dx), (0, 1))
    border = m - inner
    code = border * 1
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                code = code + np.roll(border, (dy, dx), (0, 1)) * (10 if dy and dx else 2)
    counts = np.bincount(code.ravel(), minlength=50)
    return float(sum(length * counts[codes].sum() for length, codes in _LENGTHS.items()))


def hull_area(xs: np.ndarray, ys: np.ndarray) -> float:
    """Pixels in the convex hull of pixels' corners, by its area."""
    pts = sorted({(float(x) + dx, float(y) + dy) for x, y in zip(xs, ys) for dx, dy in ((-0.5, 0), (0.5, 0), (0, -0.5), (0, 0.5))})

    def chain(points):
        out: list[tuple[float, float]] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    ring = np.array(chain(pts) + chain(pts[::-1]))
    x, y = ring[:, 0], ring[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def outlines(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Perimeter and solidity of each label; a group is one object."""
    schema = T.StructType([*[df.schema[c] for c in (*by, "label")], T.StructField("perimeter_px", T.DoubleType()), T.StructField("solidity", T.DoubleType())])

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g["px"].to_numpy(), g["py"].to_numpy()
        mask = np.zeros((int(y.max() - y.min()) + 1, int(x.max() - x.min()) + 1), bool)
        mask[y - y.min(), x - x.min()] = True
        n = int(mask.sum())
        row = {c: [g[c].iloc[0]] for c in (*by, "label")}
        return pd.DataFrame(row | {"perimeter_px": [perimeter(mask)], "solidity": [min(1.0, n / max(hull_area(x, y), n))]})

    return df.where("label > 0").groupBy(*by, "label").applyInPandas(kernel, schema)


# -- skeletons


def thin(mask: np.ndarray, most: int | None = None) -> np.ndarray:
    """Zhang and Suen's thinning of a 0/1 array, to its end or for at most so many passes."""
    m = np.pad(mask.astype(bool), 1)
    passes = 0
    while True:
        if passes == most:
            return m[1:-1, 1:-1]
        passes += 1
        before = m.copy()
        for odd in (False, True):
            n = [np.roll(m, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            total = sum(x.astype(int) for x in n)
            turns = sum((~n[i] & n[(i + 1) % 8]).astype(int) for i in range(8))
            up, right, down, left = n[0], n[2], n[4], n[6]
            ends = (~(up & right & left) & ~(up & down & left)) if odd else (~(up & right & down) & ~(right & down & left))
            m = m & ~((total >= 2) & (total <= 6) & (turns == 1) & ends)
            m[[0, -1]] = m[:, [0, -1]] = False
        if (m == before).all():
            return m[1:-1, 1:-1]


def skeleton(df: DataFrame, v: str, by: Sequence[str]) -> DataFrame:
    """Set pixels of each image's (or tile's) skeleton."""
    schema = T.StructType([*[df.schema[c] for c in by], T.StructField("px", T.LongType()), T.StructField("py", T.LongType())])

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g["px"].to_numpy(np.int64), g["py"].to_numpy(np.int64)
        mask = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
        mask[y - y.min(), x - x.min()] = True
        sy, sx = np.nonzero(thin(mask))
        return pd.DataFrame({c: np.full(len(sx), g[c].iloc[0], object) for c in by} | {"px": sx + x.min(), "py": sy + y.min()})

    return df.where(F.col(v) > 0).groupBy(*by).applyInPandas(kernel, schema)


def skeleton_whole(df: DataFrame, v: str, by: Sequence[str], scratch: Scratch, tile: int = 512, halo: int = 32) -> DataFrame:
    """Set pixels (by, px, py) of the skeleton of whole images, thinned in tiles that see ``halo`` pixels beyond their border.

    A pass looks two pixels far, so half as many passes as the halo has pixels
    are exact inside; then tiles exchange their borders through a written table,
    until a round removes nothing.  A task holds one tile, whatever the image.
    """
    now = scratch.write(df.where(F.col(v) > 0).select(*by, F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py")), "thin-0")
    cover = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)))
    names = list(by)

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g["_tx"].iloc[0] * tile, g["_ty"].iloc[0] * tile
        mask = np.zeros((tile + 2 * halo, tile + 2 * halo), bool)
        mask[g["py"].to_numpy() - y + halo, g["px"].to_numpy() - x + halo] = True
        sy, sx = np.nonzero(thin(mask, halo // 2)[halo:-halo, halo:-halo])
        return pd.DataFrame({c: np.full(len(sx), g[c].iloc[0], object) for c in names} | {"px": sx + x, "py": sy + y})

    k, n = 1, now.count()
    while True:
        cut = now.withColumn("_tx", cover("px")).withColumn("_ty", cover("py"))
        now = scratch.write(cut.groupBy(*by, "_tx", "_ty").applyInPandas(kernel, now.schema), f"thin-{k}")
        left = now.count()
        if left == n:
            return now
        scratch.drop(f"thin-{k - 1}")
        k, n = k + 1, left


def filament_mask(df: DataFrame, raw: Column, by: Sequence[str], scratch: Scratch, threshold: int = 30, least: int = 50) -> DataFrame:
    """(by, px, py, v): a projection scaled by its image's maximum to 0..255 (truncated), above the threshold, without objects (by sides) under ``least`` pixels, closed by a cross."""
    found = df.select(*by, "px", "py", F.greatest(raw, F.lit(0.0)).alias("_d"))
    tops = found.groupBy(*by).agg(F.max("_d").alias("_top"))
    scaled = found.join(tops, list(by)) if by else found.crossJoin(F.broadcast(tops))  # one row
    level = F.when(F.col("_top") > 0, F.floor(F.col("_d") / F.col("_top") * 255)).otherwise(F.lit(0))
    mask = scratch.write(scaled.select(*by, "px", "py", (level > threshold).cast("int").alias("v")), "filament-level")
    kept = run_pixels(large_components(components(mask, "v", by, scratch, corners=False), by, F.lit(least)), by).withColumn("_kept", F.lit(1))
    clean = mask.join(kept, [*by, "px", "py"], "left").select(*by, "px", "py", F.coalesce("_kept", F.lit(0)).alias("v"))
    return close_shape(clean, "v", ellipse(3), by)


def topology(skeleton_px: DataFrame, by: Sequence[str], tile: int = 512) -> DataFrame:
    """Per image: skeleton pixels, end points (one neighbour) and branch points (three or more).

    Neighbours are counted in tiles that see one pixel beyond their border, so pixels are dealt once and only tiles' counts are joined.
    """
    cover = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / tile), F.floor((F.col(c) + 1) / tile)))
    cut = skeleton_px.select(*by, F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py")).withColumn("_tx", cover("px")).withColumn("_ty", cover("py"))
    names = ["skeleton_px", "endpoints", "branches"]
    schema = T.StructType([*[cut.schema[c] for c in by], *[T.StructField(c, T.LongType()) for c in names]])

    def kernel(g: pa.Table) -> pa.Table:
        x, y = (g[c].to_numpy() - g[t][0].as_py() * tile + 1 for c, t in (("px", "_tx"), ("py", "_ty")))
        wide = tile + 2
        n = np.bincount(y * wide + x, minlength=wide * wide).reshape(wide, wide)
        near = sum(n[1 + dy : wide - 1 + dy, 1 + dx : wide - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
        n = n[1:-1, 1:-1]
        found = n.sum(), n[near == 1].sum(), n[near >= 3].sum()
        return pa.table({c: g[c].slice(0, 1) for c in by} | {c: pa.array([int(v)], pa.int64()) for c, v in zip(names, found)})

    counts = cut.groupBy(*by, "_tx", "_ty").applyInArrow(kernel, schema).where("skeleton_px > 0")
    return counts.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])


# -- geometry and comparison of images


def tile_grid(images: DataFrame, tile: int = 1024, overlap: int = 128) -> DataFrame:
    """Origins of all whole tiles of images(width, height, ...); a remainder at the far edges is left out."""
    start = lambda d: F.explode(F.when(F.col(d) >= tile, F.sequence(F.lit(0), (F.col(d) - tile).cast("int"), F.lit(tile - overlap))))
    return images.withColumn("x", start("width")).withColumn("y", start("height")).withColumns({"w": F.lit(tile), "h": F.lit(tile)})


def tile_tissue(tiles: DataFrame, mask: DataFrame, v: str, tile: int, by: Sequence[str], least: float = 0.5) -> DataFrame:
    """Tiles at least half of whose mask crop exists and whose mean mask is at least ``least``.

    Mask pixels and tiles meet on blocks of the tile's size: a pixel is in one block, a tile touches four at most.
    """
    block = lambda c: F.floor(F.col(c) / tile)
    cover = lambda c: F.explode(F.sequence(F.floor(F.col(c) / tile), F.floor((F.col(c) + tile - 1) / tile)))
    t = tiles.withColumn("_bx", cover("x")).withColumn("_by", cover("y"))
    m = mask.select(*by, "px", "py", v, block("px").alias("_bx"), block("py").alias("_by"))
    inside = (F.col("px") >= F.col("x")) & (F.col("px") < F.col("x") + tile) & (F.col("py") >= F.col("y")) & (F.col("py") < F.col("y") + tile)
    stats = t.join(m, [*by, "_bx", "_by"]).where(inside).groupBy(*by, "x", "y").agg(F.avg(v).alias("tissue"), (F.max("px") - F.min("px") + 1).alias("cw"), (F.max("py") - F.min("py") + 1).alias("ch"))
    return stats.where((F.col("tissue") >= least) & (F.col("cw") >= 0.5 * tile) & (F.col("ch") >= 0.5 * tile)).select(*by, "x", "y", "tissue")


def downsample(df: DataFrame, step: int, values: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Block means: a thumbnail."""
    return df.groupBy(*by, F.floor(F.col("px") / step).alias("px"), F.floor(F.col("py") / step).alias("py")).agg(*[F.avg(v).alias(v) for v in values])


def patch_stats(df: DataFrame, by: Sequence[str], raw: Column, threshold: int = 30) -> DataFrame:
    """A patch's projection scaled by its own maximum to 0..255 (truncated): mean, max, deviation and share above a threshold."""
    top = F.max("_d").over(Window.partitionBy(*by))
    scaled = df.withColumn("_d", F.greatest(raw, F.lit(0.0))).withColumn("_u", F.when(top > 0, F.floor(F.col("_d") / top * 255)).otherwise(F.lit(0)))
    return scaled.groupBy(*by).agg(F.avg("_u").alias("mean"), F.max("_u").alias("max"), F.stddev_pop("_u").alias("std"), F.avg((F.col("_u") > threshold).cast("int")).alias("positive_fraction"))


def orientations(df: DataFrame, width: int, height: int) -> DataFrame:
    """The four mirror images of an image, named."""
    x, y, fx, fy = F.col("px"), F.col("py"), F.lit(width - 1) - F.col("px"), F.lit(height - 1) - F.col("py")
    maps = [("identity", x, y), ("flip_h", fx, y), ("flip_v", x, fy), ("rot180", fx, fy)]
    options = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), a.alias("px"), b.alias("py")) for n, a, b in maps])).alias("_o")
    rest = [c for c in df.columns if c not in ("px", "py")]
    return df.select(*rest, options).select(*rest, F.col("_o.name").alias("name"), F.col("_o.px").alias("px"), F.col("_o.py").alias("py"))


def best_orientation(fixed: DataFrame, moving: DataFrame, v: str, width: int, height: int) -> DataFrame:
    """(name, score): correlation of every orientation of ``moving`` with ``fixed``."""
    turned = orientations(moving.select("px", "py", F.col(v).alias("_m")), width, height)
    return turned.join(fixed.select("px", "py", F.col(v).alias("_f")), ["px", "py"]).groupBy("name").agg(F.corr("_f", "_m").alias("score"))


def centre_of_mass(df: DataFrame, v: str, least: float = 0.01) -> DataFrame:
    return df.where(F.col(v) > least).agg(F.avg("px").alias("mx"), F.avg("py").alias("my"), F.count(F.lit(1)).alias("n"))


def translation(fixed: DataFrame, moving: DataFrame, v: str) -> DataFrame:
    """The shift between centres of mass; 0 where either image is empty."""
    f, m = centre_of_mass(fixed, v).toDF("fx", "fy", "fn"), centre_of_mass(moving, v).toDF("mx", "my", "mn")
    shift = lambda a, b: F.when((F.col("fn") > 0) & (F.col("mn") > 0), F.col(a) - F.col(b)).otherwise(F.lit(0.0))
    return f.crossJoin(m).select(shift("fx", "mx").alias("dx"), shift("fy", "my").alias("dy"))  # one row each


def checkerboard(a: Column, b: Column, square: int = 50) -> Column:
    odd = (F.floor(F.col("py") / square) + F.floor(F.col("px") / square)) % 2 == 1
    return F.when(odd, a).otherwise(b)


def splat(points: DataFrame, value: str, order: str, x: Column, y: Column, width: int, height: int, by: Sequence[str]) -> DataFrame:
    """3 x 3 marks of a value at points' pixels; the last in order wins a pixel; marks outside the image are cut."""
    offset = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    marks = points.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, value, order, x.alias("_x"), y.alias("_y"))
    marks = marks.where(F.col("_x").between(0, width - 1) & F.col("_y").between(0, height - 1)).withColumn("_dx", offset).withColumn("_dy", offset)
    marks = marks.select(*by, value, order, (F.col("_x") + F.col("_dx")).alias("px"), (F.col("_y") + F.col("_dy")).alias("py"))
    inside = F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)
    return marks.where(inside).groupBy(*by, "px", "py").agg(F.max_by(value, order).alias(value))


def zscore(df: DataFrame, v: str, by: Sequence[str], name: str) -> DataFrame:
    """Each image's values less their mean, by their deviation: one row of sums an image, joined back."""
    sums = df.groupBy(*by).agg(F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_dev"))
    joined = df.join(sums, list(by)) if by else df.crossJoin(F.broadcast(sums))  # one row
    return joined.withColumn(name, (F.col(v) - F.col("_mean")) / (F.col("_dev") + 1e-8)).drop("_mean", "_dev")


def outer_boundary(labels: DataFrame, v: str, by: Sequence[str]) -> DataFrame:
    """Outer borders of labels: every pixel has one row, 0 is background.

    A pixel is one if a 4-neighbour's value differs from its own and it either is background or has another label
    among its 8 neighbours, so of two labels that touch both sides are borders.
    """
    steps = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(a * b == 0).alias("four")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    sent = labels.select(*by, "px", "py", F.col(v).alias("_sent"), F.explode(F.array(*steps)).alias("d"))
    moved = sent.select(*by, (F.col("px") + F.col("d.a")).alias("px"), (F.col("py") + F.col("d.b")).alias("py"), "_sent", "d.four")
    four, label = F.when(F.col("four"), F.col("_sent")), F.when(F.col("_sent") > 0, F.col("_sent"))
    near = moved.groupBy(*by, "px", "py").agg(F.min(four).alias("_l4"), F.max(four).alias("_h4"), F.min(label).alias("_l8"), F.max(label).alias("_h8"))
    other = lambda low, high: F.coalesce((F.col(low) != F.col(v)) | (F.col(high) != F.col(v)), F.lit(False))
    return labels.join(near, [*by, "px", "py"]).where(other("_l4", "_h4") & ((F.col(v) == 0) | other("_l8", "_h8"))).select(*by, "px", "py")


def boundary(df: DataFrame, v: str, by: Sequence[str]) -> DataFrame:
    """Set pixels with an unset or missing 4-neighbour: the inner border of a mask (``outer_boundary`` gives that of labels)."""
    on = df.where(F.col(v) > 0).select(*by, "px", "py")
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))]))
    moved = on.select(*by, "px", "py", step.alias("d")).select(*by, (F.col("px") + F.col("d.a")).alias("px"), (F.col("py") + F.col("d.b")).alias("py"))
    full = moved.groupBy(*by, "px", "py").agg(F.count(F.lit(1)).alias("n")).where("n = 4")
    return on.join(full, [*by, "px", "py"], "left_anti")


def percentile_normalise(df: DataFrame, v: Sequence[str], by: Sequence[str], low: float = 0.01, high: float = 0.998) -> DataFrame:
    """Each channel of each tile scaled so that its low and high percentiles become 0 and 1."""
    bounds = df.groupBy(*by).agg(*[F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(f"_q_{c}") for c in v])
    scaled = {c: (F.col(c) - F.col(f"_q_{c}")[0]) / F.greatest(F.col(f"_q_{c}")[1] - F.col(f"_q_{c}")[0], F.lit(1e-20)) for c in v}
    return df.join(bounds, list(by)).withColumns(scaled).drop(*[f"_q_{c}" for c in v])


def resize_nearest(df: DataFrame, values: Sequence[str], size: tuple[int, int], to: tuple[int, int], by: Sequence[str] = ()) -> DataFrame:
    """Nearest-neighbour resize from ``size`` to ``to`` (width, height): every target pixel looks up one source pixel."""
    (w0, h0), (w1, h1) = size, to
    spread = lambda c, n0, n1: F.explode(F.expr(f"filter(sequence(cast(floor({c} * {n1} / {n0}) as int), cast(ceil(({c} + 1) * {n1} / {n0}) as int)), t -> t < {n1} and cast(floor(t * {n0} / {n1}) as int) = {c})"))
    return df.withColumn("_tx", spread("px", w0, w1)).withColumn("_ty", spread("py", h0, h1)).select(*by, F.col("_tx").alias("px"), F.col("_ty").alias("py"), *values)


def patch_intensity(points: DataFrame, image: DataFrame, v: str, key: str, radius: str, outer: str, most: int, by: Sequence[str] = (), threshold: float = 30) -> DataFrame:
    """Around each point: mean, maximum, deviation and positive share within ``radius``; mean and share of the ring out to ``outer``.

    Points and pixels meet on square blocks of the largest outer radius ``most``; a point asks for the blocks that its ring touches.
    Points with the same centre and radii ask once, so what meets and is summed follows from the places, not from the points.
    """
    block = lambda c: F.floor(c / most)
    cover = lambda c: F.explode(F.sequence(block(F.col(c) - F.col(outer)), block(F.col(c) + F.col(outer))))
    place = list(dict.fromkeys([*by, "cx", "cy", radius, outer]))
    asked = points.select(*place).distinct().withColumn("_bx", cover("cx")).withColumn("_by", cover("cy"))
    px = image.select(*by, "px", "py", v, block(F.col("px")).alias("_bx"), block(F.col("py")).alias("_by"))
    d2 = (F.col("px") - F.col("cx")) * (F.col("px") - F.col("cx")) + (F.col("py") - F.col("cy")) * (F.col("py") - F.col("cy"))
    near = asked.join(px, [*by, "_bx", "_by"]).withColumn("_d2", d2).where(F.col("_d2") <= F.col(outer) * F.col(outer))
    inside = F.col("_d2") <= F.col(radius) * F.col(radius)
    own, ring, hit = F.when(inside, F.col(v)), F.when(~inside, F.col(v)), (F.col(v) > threshold).cast("int")
    found = near.groupBy(*place).agg(
        F.avg(own).alias("marker_intensity_mean"), F.max(own).alias("marker_intensity_max"), F.stddev_pop(own).alias("marker_intensity_std"),
        F.avg(F.when(inside, hit)).alias("marker_positive_area_fraction"), F.avg(ring).alias("perinuclear_intensity_mean"), F.avg(F.when(~inside, hit)).alias("perinuclear_positive_fraction"),
    )
    names = [c for c in found.columns if c not in place]
    return points.select(key, *[c for c in place if c != key]).join(found, place, "left").select(key, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])


def filament_table(comps: DataFrame, by: Sequence[str], mpp: float, least: int = 20) -> DataFrame:
    """Skeleton components of at least ``least`` pixels, with length, box, centroid, aspect ratio and orientation."""
    n, mid = F.col("x1") - F.col("x0") + 1, (F.col("x0") + F.col("x1")) / 2
    # Second moments of a run of n pixels about its own middle are (n^2 - 1) / 12 each.
    sums = comps.groupBy(*by, "comp").agg(
        F.sum(n).alias("length_px"), F.min("x0").alias("_x0"), F.max("x1").alias("_x1"), F.min("py").alias("_y0"), F.max("py").alias("_y1"),
        (F.sum(mid * n) / F.sum(n)).alias("centroid_x"), (F.sum(F.col("py") * n) / F.sum(n)).alias("centroid_y"),
        (F.sum(n * mid * mid + n * (n * n - 1) / 12) / F.sum(n)).alias("_xx"), (F.sum(n * F.col("py") * F.col("py")) / F.sum(n)).alias("_yy"), (F.sum(n * mid * F.col("py")) / F.sum(n)).alias("_xy"),
    ).where(F.col("length_px") >= least)
    w, h = F.col("_x1") - F.col("_x0") + 1, F.col("_y1") - F.col("_y0") + 1
    cx, cy = F.col("centroid_x"), F.col("centroid_y")
    a, c, b = F.col("_xx") - cx * cx, F.col("_yy") - cy * cy, -(F.col("_xy") - cx * cy)
    turn = F.when(a == c, F.when(b < 0, F.lit(-np.pi / 4)).otherwise(F.lit(np.pi / 4))).otherwise(F.atan2(-2 * b, c - a) / 2)
    return sums.select(
        *by, "comp", "length_px", (F.col("length_px") * mpp).alias("length_um"), "centroid_x", "centroid_y", turn.alias("orientation_rad"), F.degrees(turn).alias("orientation_deg"),
        w.alias("bbox_width"), h.alias("bbox_height"), (F.greatest(w, h) / (F.least(w, h) + 1e-6)).alias("aspect_ratio"),
    )
