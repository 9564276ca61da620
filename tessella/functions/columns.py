"""Column expressions over object tables: shape, colour, stain and identity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the optical densities of R, G, B in each stain's projection.
HEMATOXYLIN = (1.88, 0.07, 0.0)
DAB = (0.0, 1.0, 0.57)
DAB_PATCH = (0.27, 0.57, 0.78)


def to_um(pixels: Column, mpp: float | Column) -> Column:
    return pixels * mpp


def aspect_ratio(major: Column, minor: Column) -> Column:
    return F.when(minor > 0, major / minor).otherwise(F.lit(0.0))


def circularity(area: Column, perimeter: Column) -> Column:
    """4 pi A / P^2, clipped to [0, 1]."""
    raw = 4 * F.pi() * area / F.greatest(perimeter * perimeter, F.lit(1e-6))
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def gray_mean(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / 3


def with_derived(df: DataFrame) -> DataFrame:
    """Adds circularity, aspect_ratio and gray_mean where they are absent and their inputs are there (decided at plan time)."""
    have, c = set(df.columns), F.col
    add: dict[str, Column] = {}
    if "circularity" not in have and {"area_px", "perimeter_px"} <= have:
        add["circularity"] = circularity(c("area_px"), c("perimeter_px"))
    if "aspect_ratio" not in have and {"major_axis_length", "minor_axis_length"} <= have:
        add["aspect_ratio"] = aspect_ratio(c("major_axis_length"), c("minor_axis_length"))
    if "gray_mean" not in have and {"r", "g", "b"} <= have:
        add["gray_mean"] = gray_mean(c("r"), c("g"), c("b"))
    return df.withColumns(add) if add else df


def equivalent_radius(area_px: Column, mpp: float, expansion: float = 0.0) -> Column:
    """Radius of the circle of an area, optionally grown by a share."""
    return F.sqrt(area_px * (mpp * mpp) / F.pi()) * (1 + expansion)


def stable_id(slide: Column, x_tenths: Column, y_tenths: Column) -> Column:
    """A 16-digit id from slide and position in tenths; equal positions collide, so it is no key."""
    tenth = lambda v: F.concat(F.floor(v / 10).cast("string"), F.lit("."), F.pmod(v, F.lit(10)).cast("string"))
    return F.substring(F.md5(F.concat_ws(":", slide, tenth(x_tenths), tenth(y_tenths))), 1, 16)


def content_id(text: Column, digits: int = 16) -> Column:
    """The first hex digits of a text's MD5: equal texts, equal ids; null of a null text."""
    return F.substring(F.md5(text.cast("binary")), 1, digits)


def optical_density(v: Column, base10: bool = True) -> Column:
    """Minus the log of transmittance; the two floors differ as the two conventions do."""
    if base10:
        return -F.log10(F.greatest(v.cast("double"), F.lit(1e-6)) / F.lit(255.0))
    return -F.log(F.greatest(v / F.lit(255.0), F.lit(1e-6)))


def stain(weights: Sequence[float], r: Column, g: Column, b: Column, base10: bool = True) -> Column:
    """A stain's projection of the optical densities."""
    terms = [F.lit(w) * optical_density(v, base10) for w, v in zip(weights, (r, g, b)) if w]
    return reduce(lambda x, y: x + y, terms)


def hsv_saturation(r: Column, g: Column, b: Column) -> Column:
    """Saturation on 0..255, rounded half up."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top > 0, F.floor((top - low) * F.lit(255.0) / top + 0.5)).otherwise(F.lit(0)).cast("int")


def tissue(r: Column, g: Column, b: Column, saturation: int = 10, value: int = 20) -> Column:
    """1 where a pixel is tissue: enough saturation and value."""
    return ((hsv_saturation(r, g, b) > saturation) & (F.greatest(r, g, b) > value)).cast("int")


def filled(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    """Nulls and NaN as one value."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(value)), F.lit(value)) for c in columns})


def tile_parts(tile_id: Column) -> tuple[Column, Column]:
    """x and y of an ``x_y`` tile id."""
    parts = F.split(tile_id, "_")
    return parts[0].cast("int"), parts[1].cast("int")


def arrow(orientation: Column, major: Column, scale: float) -> tuple[Column, Column]:
    """Display vector of an object's orientation."""
    length = major / 2 * scale
    return length * F.cos(orientation), length * F.sin(orientation)


def colour_norm(v: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def blend(a: Column, b: Column, alpha: float) -> Column:
    """An overlay of b on a."""
    return F.least(F.greatest(F.round(a * (1 - alpha) + b * alpha), F.lit(0)), F.lit(255)).cast("int")


def angle_proxy(major: Column, minor: Column) -> Column:
    """The older stand-in for an orientation, where a table has none."""
    return F.atan2(minor, major)


def log_area(area: Column) -> Column:
    """A display scale of areas."""
    return F.log10(area + 1)


def diameter_px(diameter_um: float, mpp: float | Column) -> Column:
    return F.lit(diameter_um) / mpp


def in_box(x: Column, y: Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """Whether a point is in a closed box."""
    return x.between(low[0], high[0]) & y.between(low[1], high[1])


def file_name(pattern: str, **parts: Column) -> Column:
    """A pattern's ``{name}`` filled in; an ampersand, which shells read, becomes ``and``."""
    out, rest = [], pattern
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), F.replace(parts[name].cast("string"), F.lit("&"), F.lit("and"))]
    return F.concat(*out, F.lit(rest))
