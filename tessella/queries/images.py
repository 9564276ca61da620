"""Queries over pixel tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.operators import placement, raster, registration, stats, stitching
from tessella.queries.registry import nuclei, pixels, query, r6
from tessella.scratch import Scratch
from tessella.sources import png

BLOCKS = """, lp as (select *, case when px % 6 between 1 and 4 and py % 6 between 1 and 4 then cast(floor(px / cast(6 as double)) as bigint) + 17 * cast(floor(py / cast(6 as double)) as bigint) + 1 else 0 end label from pixels)"""


def _mask(spark, sf):
    return pixels(spark, sf).select("px", "py", C.tissue(F.col("r"), F.col("g"), F.col("b")).alias("v"))


def _labels(spark, sf):
    inside = (F.col("px") % 6).between(1, 4) & (F.col("py") % 6).between(1, 4)
    number = (F.floor(F.col("px") / 6) + 17 * F.floor(F.col("py") / 6) + 1).cast("long")
    return pixels(spark, sf).withColumn("label", F.when(inside, number).otherwise(F.lit(0)))


def _height(image):
    return int(image.agg((F.max("py") + 1).alias("h")).first()["h"] or 0)


@query("tissue_mask_hsv", " select px, py, v from mask")
def tissue_mask_hsv(spark, sf):
    return _mask(spark, sf)


def _frames(steps: list[tuple[str, int]], last: str = "mask", tail: str = " select px, py, v from {}") -> str:
    out = ""
    for i, (f, k) in enumerate(steps):
        a, b = k // 2, k - 1 - k // 2
        out += f""", h{i} as materialized (select px, py, {f}(v) over (partition by py order by px range between {a} preceding and {b} following) v from {last}),
 w{i} as materialized (select px, py, {f}(v) over (partition by px order by py range between {a} preceding and {b} following) v from h{i})"""
        last = f"w{i}"
    return out + tail.format(last)


@query("mask_morphology", _frames([("max", 5), ("max", 5), ("min", 5), ("min", 5), ("min", 3), ("max", 3)]))
def mask_morphology(spark, sf):
    return raster.open_(raster.close(_mask(spark, sf), "v", 5, [], 2), "v", 3, [], 1)


@query("tile_tissue_filter", """, t as (select x, y from (select unnest(range(0, 91, 9)) x), (select unnest(range(0, 100000, 9)) y) where y <= (select max(py) + 1 from pixels) - 10)
 select x, y, round(avg(v), 6) tissue from t join mask on px >= x and px < x + 10 and py >= y and py < y + 10 group by x, y having avg(v) >= 0.5 and max(px) - min(px) + 1 >= 5 and max(py) - min(py) + 1 >= 5""")
def tile_tissue_filter(spark, sf):
    mask = _mask(spark, sf)
    size = mask.agg(F.lit(100).alias("width"), (F.max("py") + 1).alias("height"))
    return raster.tile_tissue(raster.tile_grid(size, 10, 1), mask, "v", 10, []).select("x", "y", *r6("tissue"))


@query("stain_separation", """, od as (select px, py, -log10(greatest(r, 1e-6) / 255) o1, -log10(greatest(g, 1e-6) / 255) o2, -log10(greatest(b, 1e-6) / 255) o3 from pixels)
 select px, py, round(cast(1.88 as double) * o1 + cast(0.07 as double) * o2, 6) hematoxylin, round(o2 + cast(0.57 as double) * o3, 6) dab from od""")
def stain_separation(spark, sf):
    rgb = [F.col(c) for c in "rgb"]
    return pixels(spark, sf).select("px", "py", C.stain(C.HEMATOXYLIN, *rgb).alias("hematoxylin"), C.stain(C.DAB, *rgb).alias("dab")).select("px", "py", *r6("hematoxylin", "dab"))


@query("dab_patch_stats", """, od as (select cast(floor(px / cast(10 as double)) as bigint) tx, cast(floor(py / cast(10 as double)) as bigint) ty,
 greatest(cast(0.27 as double) * -ln(greatest(r / cast(255 as double), 1e-6)) + cast(0.57 as double) * -ln(greatest(g / cast(255 as double), 1e-6)) + cast(0.78 as double) * -ln(greatest(b / cast(255 as double), 1e-6)), 0) d from pixels),
 u as (select tx, ty, case when max(d) over (partition by tx, ty) > 0 then floor(d / max(d) over (partition by tx, ty) * 255) else 0 end u from od)
 select tx, ty, round(avg(u), 4) mean, cast(max(u) as bigint) max, round(stddev_pop(u), 4) std, round(avg(case when u > 30 then 1 else 0 end), 4) positive_fraction from u group by tx, ty""")
def dab_patch_stats(spark, sf):
    raw = C.stain(C.DAB_PATCH, *[F.col(c) for c in "rgb"], base10=False)
    tiles = pixels(spark, sf).withColumns({"tx": F.floor(F.col("px") / 10), "ty": F.floor(F.col("py") / 10)})
    out = raster.patch_stats(tiles, ["tx", "ty"], raw)
    return out.select("tx", "ty", F.round("mean", 4).alias("mean"), F.col("max").cast("long").alias("max"), F.round("std", 4).alias("std"), F.round("positive_fraction", 4).alias("positive_fraction"))


@query("region_props", BLOCKS + """, m as (select label, count(*) area_px, avg(px) cx, avg(py) cy, avg(r) r, avg(g) g, avg(b) b, var_pop(px) a, var_pop(py) c, -covar_pop(px, py) q from lp where label > 0 group by label),
 e as (select *, (a + c) / 2 + sqrt(4 * q * q + (a - c) * (a - c)) / 2 l1, greatest((a + c) / 2 - sqrt(4 * q * q + (a - c) * (a - c)) / 2, 0) l2 from m)
 select label, area_px, round(cx, 6) cx, round(cy, 6) cy, round(r, 6) r, round(g, 6) g, round(b, 6) b, round(4 * sqrt(l1), 6) major_axis_length, round(4 * sqrt(l2), 6) minor_axis_length, round(case when l1 > 0 then sqrt(1 - l2 / l1) else 0 end, 6) eccentricity from e""")
def region_props(spark, sf):
    out = raster.region_props(_labels(spark, sf), [])
    return out.select("label", "area_px", *r6("cx", "cy", "r", "g", "b", "major_axis_length", "minor_axis_length", "eccentricity"))


@query("region_outlines")
def region_outlines(spark, sf):
    return raster.outlines(_labels(spark, sf), [])


@query("connected_components", BLOCKS + " select count(*) area, min(px) min_x, max(px) max_x, min(py) min_y, max(py) max_y, round(avg(px), 6) cx, round(avg(py), 6) cy from lp where label > 0 group by label")
def connected_components_query(spark, sf):
    """Components of the block mask; each block is one, so the labels' own grouping is the answer."""
    mask = _labels(spark, sf).select("px", "py", (F.col("label") > 0).cast("int").alias("v"))
    out = raster.component_table(raster.components(mask, "v", [], Scratch(spark, "components")), [])
    return out.select("area", "min_x", "max_x", "min_y", "max_y", *r6("cx", "cy"))


@query("mask_components", """, on_ as materialized (select px, py from mask where v = 1), o as (select * from (values (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)) t(dx, dy)),
 cc as materialized (with recursive c(px, py, lab) using key (px, py) as (select px, py, py * 1000 + px from on_
  union (select r.px, r.py, min(c.lab) from c join o on true join recurring.c r on r.px = c.px + dx and r.py = c.py + dy where c.lab < r.lab group by r.px, r.py)) select * from c)
 select count(*) area, min(px) min_x, max(px) max_x, min(py) min_y, max(py) max_y, round(avg(px), 6) cx, round(avg(py), 6) cy from cc group by lab having count(*) >= 5""")
def mask_components(spark, sf):
    """Components of the tissue mask itself, largest objects only."""
    comps = raster.components(_mask(spark, sf), "v", [], Scratch(spark, "components"))
    out = raster.component_table(raster.large_components(comps, [], F.lit(5)), [])
    return out.select("area", "min_x", "max_x", "min_y", "max_y", *r6("cx", "cy"))


@query("skeleton_topology")
def skeleton_topology(spark, sf):
    """Ends and branches of the whole image's skeleton."""
    mask = pixels(spark, sf).select("px", "py", (C.stain(C.DAB, *[F.col(c) for c in "rgb"]) > 0.4).cast("int").alias("v"))
    return raster.topology(raster.skeleton_whole(mask, "v", [], Scratch(spark, "skeleton")), [])


@query("topology_counts", """, s as (select px, py from mask where v > 0), n as (select s.px, s.py, (select count(*) from s t where abs(t.px - s.px) <= 1 and abs(t.py - s.py) <= 1) - 1 k from s)
 select count(*) skeleton_px, count(*) filter (k = 1) endpoints, count(*) filter (k >= 3) branches from n""")
def topology_counts(spark, sf):
    return raster.topology(_mask(spark, sf).where("v > 0").select("px", "py"), [])


@query("best_orientation", """, h as (select max(py) bottom from pixels), m as (select 99 - px px, py, (r * 3 + g) / cast(4 as double) v from pixels),
 o as (select 'identity' name, px, py, v from m union all select 'flip_h', 99 - px, py, v from m union all select 'flip_v', px, bottom - py, v from m, h union all select 'rot180', 99 - px, bottom - py, v from m, h)
 select name, round(corr(r, v), 6) score from o join pixels using (px, py) group by name""")
def best_orientation(spark, sf):
    p = pixels(spark, sf)
    moving = p.select((99 - F.col("px")).alias("px"), "py", ((F.col("r") * 3 + F.col("g")) / 4).alias("v"))
    return raster.best_orientation(p.select("px", "py", F.col("r").alias("v")), moving, "v", 100, _height(p)).select("name", *r6("score"))


@query("center_of_mass", """ select round(a.x - b.x, 6) dx, round(a.y - b.y, 6) dy from (select avg(px) x, avg(py) y from pixels where r / cast(255 as double) > 0.01) a, (select avg(px) x, avg(py) y from pixels where g / cast(255 as double) > 0.5) b""")
def center_of_mass(spark, sf):
    p = pixels(spark, sf)
    fixed = p.select("px", "py", (F.col("r") / 255).alias("v"))
    moving = p.select("px", "py", F.when(F.col("g") / 255 > 0.5, F.col("g") / 255).otherwise(0.0).alias("v"))
    return raster.translation(fixed, moving, "v").select(*r6("dx", "dy"))


@query("checkerboard", """ select px, py, case when (cast(floor(px / cast(10 as double)) as bigint) + cast(floor(py / cast(10 as double)) as bigint)) % 2 = 1 then r else g end v from pixels""")
def checkerboard(spark, sf):
    return pixels(spark, sf).select("px", "py", raster.checkerboard(F.col("r"), F.col("g"), 10).alias("v"))


@query("thumbnail", " select cast(floor(px / cast(5 as double)) as bigint) px, cast(floor(py / cast(5 as double)) as bigint) py, round(avg(r), 6) r, round(avg(g), 6) g, round(avg(b), 6) b from pixels group by 1, 2")
def thumbnail(spark, sf):
    return raster.downsample(pixels(spark, sf), 5, ["r", "g", "b"], []).select("px", "py", *r6("r", "g", "b"))


@query("mask_boundary", " select m.px, m.py from mask m where m.v > 0 and (select count(*) from mask n where n.v > 0 and abs(n.px - m.px) + abs(n.py - m.py) = 1) < 4")
def mask_boundary(spark, sf):
    return raster.boundary(_mask(spark, sf), "v", [])


@query("zscore_image", " select px, py, round((r - avg(r) over ()) / (stddev_pop(r) over () + 1e-8), 6) z from pixels")
def zscore_image(spark, sf):
    return raster.zscore(pixels(spark, sf), "r", [], "z").select("px", "py", *r6("z"))


@query("tile_normalise", """, t as (select *, cast(floor(py / cast(50 as double)) as bigint) tile from pixels), q as (select tile, quantile_cont(r, 0.01) lo, quantile_cont(r, 0.998) hi from t group by tile)
 select px, py, round((r - lo) / greatest(hi - lo, 1e-20), 6) r from t join q using (tile)""")
def tile_normalise(spark, sf):
    tiles = pixels(spark, sf).withColumn("tile", F.floor(F.col("py") / 50))
    return raster.percentile_normalise(tiles, ["r"], ["tile"]).select("px", "py", *r6("r"))


@query("mask_resize", """, h as (select max(py) + 1 height from pixels), t as (select x, y from (select unnest(range(0, 37)) x), (select unnest(range(0, 41)) y))
 select x px, y py, v from t, h join mask on mask.px = cast(floor(x * 100 / cast(37 as double)) as bigint) and mask.py = cast(floor(y * height / cast(41 as double)) as bigint)""")
def mask_resize(spark, sf):
    return raster.resize_nearest(_mask(spark, sf), ["v"], (100, _height(pixels(spark, sf))), (37, 41))


def _patch_intensity(spark, sf, n):
    points = n.select("nid", F.floor(F.col("xi") / 200).alias("cx"), F.floor(F.col("yi") / 200).alias("cy"), (2 + F.col("nid") % 3).alias("rad"), (4 + F.col("nid") % 3).alias("outr"))
    out = raster.patch_intensity(points, pixels(spark, sf), "g", "nid", "rad", "outr", 6)
    return out.select("nid", *r6(*[c for c in out.columns if c != "nid"]))


@query("patch_intensity", """, n as (select nid, cast(floor(xi / cast(200 as double)) as bigint) cx, cast(floor(yi / cast(200 as double)) as bigint) cy, 2 + nid % 3 rad, 4 + nid % 3 outr from nuclei),
 o as (select dx, dy from (select unnest(range(-6, 7)) dx), (select unnest(range(-6, 7)) dy)),
 w as (select nid, cx + dx px, cy + dy py, dx * dx + dy * dy <= rad * rad inner_ from n join o on dx * dx + dy * dy <= outr * outr),
 j as (select nid, g v, inner_ from w join pixels using (px, py))
 select nid, round(coalesce(avg(v) filter (inner_), 0), 6) marker_intensity_mean, cast(coalesce(max(v) filter (inner_), 0) as double) marker_intensity_max, round(coalesce(stddev_pop(v) filter (inner_), 0), 6) marker_intensity_std,
 round(coalesce(avg(case when v > 30 then 1 else 0 end) filter (inner_), 0), 6) marker_positive_area_fraction, round(coalesce(avg(v) filter (not inner_), 0), 6) perinuclear_intensity_mean,
 round(coalesce(avg(case when v > 30 then 1 else 0 end) filter (not inner_), 0), 6) perinuclear_positive_fraction from n left join j using (nid) group by nid""")
def patch_intensity(spark, sf):
    return _patch_intensity(spark, sf, nuclei(spark, sf))


FILAMENTS = """, f as materialized (select px, py, greatest(cast(0.27 as double) * -ln(greatest(r / cast(255 as double), 1e-6)) + cast(0.57 as double) * -ln(greatest(g / cast(255 as double), 1e-6)) + cast(0.78 as double) * -ln(greatest(b / cast(255 as double), 1e-6)), 0) d from pixels),
 lv as materialized (select px, py, case when floor(d / (select max(d) from f) * 255) > 30 then 1 else 0 end v from f),
 o as (select * from (values (1, 0), (-1, 0), (0, 1), (0, -1)) t(dx, dy)), o5 as (select * from o union all select 0, 0),
 cc as materialized (with recursive c(px, py, lab) using key (px, py) as (select px, py, py * 1000 + px from lv where v = 1
  union (select r.px, r.py, min(c.lab) from c join o on true join recurring.c r on r.px = c.px + dx and r.py = c.py + dy where c.lab < r.lab group by r.px, r.py)) select * from c),
 clean as materialized (select lv.px, lv.py, case when lab in (select lab from cc group by lab having count(*) >= {least}) then 1 else 0 end v from lv left join cc using (px, py)),
 wide as materialized (select clean.px, clean.py, max(n.v) v from clean, o5 join clean n on n.px = clean.px + dx and n.py = clean.py + dy group by 1, 2),
 closed as materialized (select wide.px, wide.py, min(n.v) v from wide, o5 join wide n on n.px = wide.px + dx and n.py = wide.py + dy group by 1, 2)"""


@query("filament_mask", FILAMENTS.format(least=50) + " select px, py, v from closed")
def filament_mask(spark, sf):
    """The filaments' chain: level of the DAB projection, small objects away, closed by a cross."""
    raw = C.stain(C.DAB_PATCH, *[F.col(c) for c in "rgb"], base10=False)
    return raster.filament_mask(pixels(spark, sf), raw, [], Scratch(spark, "filament-mask"))


@query("filament_mask_sparse", FILAMENTS.replace("> 30 then", "> 40 then").format(least=6) + " select px, py, v from closed")
def filament_mask_sparse(spark, sf):
    """The chain at a higher level, for small objects."""
    raw = C.stain(C.DAB_PATCH, *[F.col(c) for c in "rgb"], base10=False)
    return raster.filament_mask(pixels(spark, sf), raw, [], Scratch(spark, "filament-mask"), 40, 6)


@query("filament_summary")
def filament_summary(spark, sf):
    """Filaments of the whole image: the mask's skeleton, its components measured and summed up."""
    scratch = Scratch(spark, "filaments")
    raw = C.stain(C.DAB_PATCH, *[F.col(c) for c in "rgb"], base10=False)
    mask = scratch.write(raster.filament_mask(pixels(spark, sf), raw, [], scratch), "mask")
    skeleton = raster.skeleton_whole(mask, "v", [], scratch).withColumn("v", F.lit(1))
    filaments = raster.filament_table(raster.components(skeleton, "v", [], scratch), [], 0.5, 5)
    area = mask.agg(F.sum("v").alias("positive_px"), F.count(F.lit(1)).alias("total_px"))
    return stats.filament_summary(filaments, raster.topology(skeleton, []), area, 0.5)


@query("label_boundaries", BLOCKS.replace("between 1 and 4 and py % 6 between 1 and 4", "between 1 and 5 and py % 6 between 0 and 4") + """, n as (select a.px, a.py, a.label, b.label other, abs(a.px - b.px) + abs(a.py - b.py) = 1 side from lp a
  join (select unnest([-1, 0, 1]) dx) on true join (select unnest([-1, 0, 1]) dy) on true join lp b on b.px = a.px + dx and b.py = a.py + dy where dx <> 0 or dy <> 0)
 select px, py from n group by px, py, label having bool_or(side and other <> label) and (label = 0 or bool_or(other > 0 and other <> label))""")
def label_boundaries(spark, sf):
    """Outer borders of labelled blocks, some of which touch."""
    inside = (F.col("px") % 6).between(1, 5) & (F.col("py") % 6).between(0, 4)
    number = (F.floor(F.col("px") / 6) + 17 * F.floor(F.col("py") / 6) + 1).cast("long")
    labels = pixels(spark, sf).withColumn("label", F.when(inside, number).otherwise(F.lit(0)))
    return raster.outer_boundary(labels, "label", [])


@query("external_contours", """, o as (select * from (values (1, 0), (-1, 0), (0, 1), (0, -1)) t(dx, dy)), top as (select max(px) w, max(py) h from pixels),
 outside as materialized (with recursive c(px, py) as (select px, py from mask, top where v = 0 and (px = 0 or py = 0 or px = w or py = h)
  union select m.px, m.py from c join o on true join mask m on m.px = c.px + dx and m.py = c.py + dy where m.v = 0) select * from c)
 select px, py from mask, top where v = 1 and (px = 0 or py = 0 or px = w or py = h) union select m.px, m.py from outside join o on true join mask m on m.px = outside.px + dx and m.py = outside.py + dy where m.v = 1""")
def external_contours(spark, sf):
    return raster.external_contour(_mask(spark, sf), "v", [], Scratch(spark, "contours"))


@query("tissue_centroid", BLOCKS + """, c as (select label, count(*) area, avg(px) cx, avg(py) cy, min(py) my, min(px) mx from lp where label > 0 group by label)
 select cast(round(floor(cx) * cast(4 as double)) as bigint) cx, cast(round(floor(cy) * cast(4 as double)) as bigint) cy, area from c order by area desc, my, mx limit 1""")
def tissue_centroid(spark, sf):
    mask = _labels(spark, sf).select("px", "py", (F.col("label") > 0).cast("int").alias("v"))
    return raster.largest_centroid(raster.components(mask, "v", [], Scratch(spark, "centroid")), [], 4.0)


@query("brown_detection", """, dab as (select px, py, -log10(greatest(g, 1e-6) / 255) + cast(0.57 as double) * -log10(greatest(b, 1e-6) / 255) d from pixels),
 rows as materialized (select px, py, sum(d) over (partition by py order by px) s from dab), top as (select max(py) + 1 h from pixels),
 n as (select nid, cast(floor(xi / cast(200 as double)) as bigint) cx, cast(floor(yi / cast(200 as double)) as bigint) cy, cast(floor(major_axis_length * cast(1.5 as double)) as bigint) rad from nuclei),
 w as materialized (select nid, greatest(cx - rad, 0) x0, least(cx + rad, 100) x1, greatest(cy - rad, 0) y0, least(cy + rad, h) y1 from n, top),
 l as (select nid, x0, x1, unnest(range(y0, y1)) py, (x1 - x0) * (y1 - y0) cells from w where x1 > x0 and y1 > y0),
 m as (select l.nid, sum(b.s - coalesce(a.s, 0)) / any_value(cells) v from l join rows b on b.py = l.py and b.px = x1 - 1 left join rows a on a.py = l.py and a.px = x0 - 1 group by l.nid)
 select n.nid, round(coalesce(v, 0), 6) brown_intensity, case when coalesce(v, 0) > 0.15 then 1 else 0 end has_brown from n left join m using (nid)""")
def brown_detection(spark, sf):
    """Brown stain around every object of the image."""
    p = pixels(spark, sf)
    points = nuclei(spark, sf).select("nid", (F.col("xi") / 200).alias("cx"), (F.col("yi") / 200).alias("cy"), "major_axis_length")
    return placement.brown_per_object(points, p, 100, _height(p), "nid").select("nid", *r6("brown_intensity"), "has_brown")


def density_scene(points, side: int):
    """A smooth square image of points (x, y in 0..side): their counts per cell, averaged over squares of nine cells twice."""
    cells = points.select(F.floor("x").alias("px"), F.floor("y").alias("py")).where(F.col("px").between(0, side - 1) & F.col("py").between(0, side - 1)).groupBy("px", "py").agg(F.count(F.lit(1)).alias("v"))
    grid = points.sparkSession.range(side * side).select((F.col("id") % side).alias("px"), F.floor(F.col("id") / side).alias("py"))
    image = grid.join(cells, ["px", "py"], "left").select("px", "py", F.coalesce("v", F.lit(0)).cast("double").alias("v"))
    for _ in range(2):
        for across, along in (("px", "py"), ("py", "px")):
            image = image.withColumn("v", F.avg("v").over(Window.partitionBy(along).orderBy(across).rangeBetween(-4, 4)))
    return image


@query("image_registration")
def image_registration(spark, sf):
    """Two density images of all objects, one of them turned and moved: the map that lays them on one another."""
    scratch = Scratch(spark, "registration")
    own = nuclei(spark, sf).select((F.col("xi") / 200).alias("x"), (F.col("yi") / 200).alias("y"))
    turned = own.select((F.col("x") * 0.998 - F.col("y") * 0.06 + 4).alias("x"), (F.col("x") * 0.06 + F.col("y") * 0.998 - 3).alias("y"))
    fixed, moving = (scratch.write(density_scene(p, 100), n) for p, n in ((own, "fixed"), (turned, "moving")))
    t = registration.register_affine(fixed, moving, "v", 100, 100, registration.Settings(affine_levels=(2, 1)), registration.identity(100, 100))
    return registration.transform_table(t, spark).withColumn("value", F.round("value", 2))


@query("stitched_tiles", BLOCKS + """, top as (select case when max(py) + 1 >= 28 then cast(floor((max(py) + 1 - 28) / cast(18 as double)) as bigint) * 18 + 28 else 0 end h from pixels)
 select count(*) area, min(px) min_x, max(px) max_x, min(py) min_y, max(py) max_y, round(avg(px), 6) cx, round(avg(py), 6) cy from lp, top where label > 0 and py < h group by label""")
def stitched_tiles(spark, sf):
    """Objects found tile by tile, under numbers of each tile's own, in tiles that overlap by 10 pixels."""
    scratch, own = Scratch(spark, "stitched"), _labels(spark, sf)
    starts = raster.tile_grid(own.agg(F.lit(100).alias("width"), (F.max("py") + 1).alias("height")), 28, 10).select(F.col("x").cast("long").alias("tile_x"), F.col("y").cast("long").alias("tile_y"))
    at = lambda c: F.explode(stitching.covering(F.col(c), 28, 10))
    tiled = own.withColumn("tile_x", at("px")).withColumn("tile_y", at("py")).join(starts, ["tile_x", "tile_y"])
    local = F.when(F.col("label") > 0, F.col("label") * 1000 + F.pmod(F.col("tile_x") * 7 + F.col("tile_y"), F.lit(1000)))
    found = tiled.select("tile_x", "tile_y", local.alias("label"), (F.col("px") - F.col("tile_x")).alias("px"), (F.col("py") - F.col("tile_y")).alias("py"))
    objects = stitching.stitched_objects(stitching.stitched_labels(found, 28, 10, scratch, ()), ())
    return objects.select("area", "min_x", "max_x", "min_y", "max_y", *r6("cx", "cy"))


@query("tile_images", """, t as (select *, cast(floor(px / cast(50 as double)) as bigint) * 50 tx, cast(floor(py / cast(50 as double)) as bigint) * 50 ty from pixels)
 select 'tile_' || cast(tx as varchar) || '_' || cast(ty as varchar) || '.png' as name, 50 width, 50 height, true as png from t group by tx, ty""")
def tile_images(spark, sf):
    """The image as PNG tiles of 50 pixels."""
    start = lambda c: (F.floor(F.col(c) / 50) * 50).cast("long")
    tiled = pixels(spark, sf).withColumns({"tx": start("px"), "ty": start("py")}).withColumns({"px": F.col("px") - F.col("tx"), "py": F.col("py") - F.col("ty")})
    images = png.encoded_images(tiled, png.tile_name(F.col("tx"), F.col("ty")), ["r", "g", "b"], (50, 50))
    return images.select("name", "width", "height", (F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A").alias("png"))


#: Boxes of two sizes that the image's tissue is cut to.
BOXES = "px % 50 < 20 + 10 * (cast(floor(py / cast(50 as double)) as bigint) % 2) and py % 50 < 30"


@query("tissue_pieces", f""", boxed as (select px, py, case when {BOXES} then v else 0 end v from mask)""" + _frames([("max", 10)] * 2 + [("min", 10)] * 2 + [("min", 3), ("max", 3)], "boxed", """, on_ as materialized (select px, py from {0} where v = 1), o as (select * from (values (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)) t(dx, dy)),
 cc as materialized (with recursive c(px, py, lab) using key (px, py) as (select px, py, py * 1000 + px from on_
  union (select r.px, r.py, min(c.lab) from c join o on true join recurring.c r on r.px = c.px + dx and r.py = c.py + dy where c.lab < r.lab group by r.px, r.py)) select * from c),
 big as (select lab from cc group by lab having count(*) >= 700)
 select w.px, w.py, case when big.lab is null then 0 else 1 end v from {0} w left join cc using (px, py) left join big using (lab)"""))
def tissue_pieces(spark, sf):
    """The tissue mask of the full resolution as a run makes it, pieces of under 700 pixels removed."""
    raw = _mask(spark, sf).withColumn("v", F.when(F.expr(BOXES), F.col("v")).otherwise(F.lit(0)))
    return raster.tissue_mask(raw, "v", 0, 100, _height(raw), [], Scratch(spark, "pieces"), floor=700)
