"""Registration of two images: an affine map, then a warp by a grid of cubic splines, both by mutual information.

Images are pixel rows.  They are dealt to tiles; each tile of the fixed image is
written once beside the patch of the moving image that it can reach, so that an
evaluation is one pass over that table without a shuffle of pixels.  A step that
leaves the patches' reach makes new ones.  A pass gives the joint histogram (cubic
Parzen windows along the moving values) and its derivatives, summed per task and
then by bin or control point.  The driver holds parameters and histograms alone:
6 numbers or two a control point, and ``bins`` squared sums.

Positions are pixels of the whole image, whatever the level; a moving pixel that
doesn't exist takes no part in the measure and is 0 in the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.raster import centre_of_mass, downsample
from tessella.scratch import Scratch


@dataclass(frozen=True)
class Settings:
    """Bins of the histogram, pixels of a tile's side and of a patch's reach (both of the level), levels' shrink factors, most steps a level, the spline grid's cells."""

    bins: int = 32
    tile: int = 128
    reach: int = 16
    affine_levels: tuple[int, ...] = (4, 2, 1)
    warp_levels: tuple[int, ...] = (2, 1)
    iterations: int = 30
    mesh: int = 8
    tolerance: float = 1e-4
    foreground: float = 0.01


@dataclass(frozen=True)
class Transform:
    """Where a fixed pixel lies in the moving image: ``matrix (x + u(x) - centre) / scale + centre``, u by a grid of splines.

    ``matrix`` is 2 x 3, in pixels of shift at the image's border; ``grid`` has the shifts of (mesh + 3) squared control points.
    """

    width: int
    height: int
    matrix: np.ndarray
    grid: np.ndarray | None = None

    @property
    def scale(self) -> float:
        return max(self.width, self.height) / 2

    def basis(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """What each number of a row of ``matrix`` adds at a position."""
        return np.stack([(x - (self.width - 1) / 2) / self.scale, (y - (self.height - 1) / 2) / self.scale, np.ones_like(x)])

    def splines(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(control points, weights), 16 of each for a position."""
        n = self.grid.shape[0]
        at, weights = [], []
        for c, size in ((x, self.width), (y, self.height)):
            t = np.clip(c / max(1, size - 1), 0, 1) * (n - 3)
            i = np.minimum(t.astype(int), n - 4)
            at.append(i[None] + np.arange(4)[:, None])
            weights.append(_cubic(t[None] - i[None] - np.arange(-1, 3)[:, None]))
        points = at[1][:, None] * n + at[0][None]
        return points.reshape(16, -1), (weights[1][:, None] * weights[0][None]).reshape(16, -1)

    def shift(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.grid is None:
            return np.zeros_like(x), np.zeros_like(y)
        at, w = self.splines(x, y)
        flat = self.grid.reshape(-1, 2)
        return (flat[at, 0] * w).sum(axis=0), (flat[at, 1] * w).sum(axis=0)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the moving image."""
        dx, dy = self.shift(x, y)
        b = self.basis(x + dx, y + dy)
        return self.matrix[0] @ b + (self.width - 1) / 2, self.matrix[1] @ b + (self.height - 1) / 2


def identity(width: int, height: int) -> Transform:
    s = max(width, height) / 2
    return Transform(width, height, np.array([[s, 0.0, 0.0], [0.0, s, 0.0]]))


def _cubic(t: np.ndarray) -> np.ndarray:
    a = np.abs(t)
    return np.where(a < 1, (4 - 6 * a**2 + 3 * a**3) / 6, np.where(a < 2, (2 - a) ** 3 / 6, 0.0))


def _cubic_slope(t: np.ndarray) -> np.ndarray:
    a, s = np.abs(t), np.sign(t)
    return s * np.where(a < 1, (-12 * a + 9 * a**2) / 6, np.where(a < 2, -((2 - a) ** 2) / 2, 0.0))


# -- tiles and patches


def _tiles(image: DataFrame, v: str, side: int) -> DataFrame:
    """(tx, ty, data): squares of floats by row, NaN where there is no pixel."""

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        out = np.full((side, side), np.nan, np.float32)
        out[g["py"] % side, g["px"] % side] = g["v"]
        return pd.DataFrame({"tx": g["tx"].iloc[:1], "ty": g["ty"].iloc[:1], "data": [out.tobytes()]})

    rows = image.where(F.col(v).isNotNull()).select(F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"), F.col(v).cast("float").alias("v"))
    return rows.withColumns({"tx": F.floor(F.col("px") / side), "ty": F.floor(F.col("py") / side)}).groupBy("tx", "ty").applyInPandas(pack, "tx long, ty long, data binary")


class _Level:
    """Both images at a shrink factor, and the table of fixed tiles with patches around a transform."""

    def __init__(self, fixed: DataFrame, moving: DataFrame, v: str, step: int, s: Settings, scratch: Scratch, label: str):
        small = lambda df: df if step == 1 else downsample(df, step, [v], [])
        self.step, self.s, self.scratch, self.label = step, s, scratch, label
        self.fixed = scratch.write(_tiles(small(fixed), v, s.tile), f"{label}-fixed")
        self.moving = scratch.write(_tiles(small(moving), v, s.tile), f"{label}-moving")
        self.pairs, self.around, self.reach, self.count = None, None, 0.0, 0

    def near(self, t: Transform) -> DataFrame:
        """The pairs that serve a transform: those there are, or new ones around it."""
        if self.around is None or self._moved(t) > self.reach:
            self._gather(t)
        return self.pairs

    def _moved(self, t: Transform) -> float:
        """How far, in pixels of the level, a transform may take a position from where the patches lie: affine maps differ most at a corner, a spline is within its control points."""
        x, y = np.array([0.0, t.width - 1, 0.0, t.width - 1]), np.array([0.0, 0.0, t.height - 1, t.height - 1])
        plain, before = Transform(t.width, t.height, t.matrix), Transform(t.width, t.height, self.around.matrix)
        (ax, ay), (bx, by) = plain(x, y), before(x, y)
        far = max(np.abs(ax - bx).max(), np.abs(ay - by).max())
        if t.grid is not None:
            far += np.abs(t.matrix[:, :2] / t.scale).sum(axis=1).max() * np.abs(t.grid).max()
        return far / self.step

    def _gather(self, t: Transform) -> None:
        side, step, half = self.s.tile, self.step, (self.step - 1) / 2
        plain = Transform(t.width, t.height, t.matrix.copy())
        self.around = plain
        self.reach = max(self.s.reach, 1.5 * self._moved(t))
        pad = int(np.ceil(self.reach)) + 2

        @F.pandas_udf("x0 long, y0 long, x1 long, y1 long")
        def box(tx: pd.Series, ty: pd.Series) -> pd.DataFrame:
            edge = np.array([0, side - 1])
            x, y = tx.to_numpy()[:, None] * side + edge[[0, 1, 0, 1]], ty.to_numpy()[:, None] * side + edge[[0, 0, 1, 1]]
            mx, my = plain(x.ravel() * step + half, y.ravel() * step + half)
            mx, my = ((m.reshape(x.shape) - half) / step for m in (mx, my))
            low, high = (lambda m: np.floor(m.min(axis=1)).astype(int) - pad), (lambda m: np.ceil(m.max(axis=1)).astype(int) + pad)
            return pd.DataFrame({"x0": low(mx), "y0": low(my), "x1": high(mx), "y1": high(my)})

        asked = self.fixed.withColumn("box", box("tx", "ty"))
        cover = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / side), F.floor(F.col(b) / side)))
        keys = asked.select("tx", "ty", "box").withColumn("mtx", cover("box.x0", "box.x1")).withColumn("mty", cover("box.y0", "box.y1"))
        found = keys.join(self.moving.select(F.col("tx").alias("mtx"), F.col("ty").alias("mty"), F.col("data").alias("part")), ["mtx", "mty"])

        def patch(g: pd.DataFrame) -> pd.DataFrame:
            b = g["box"].iloc[0]
            out = np.full((b["y1"] - b["y0"] + 1, b["x1"] - b["x0"] + 1), np.nan, np.float32)
            for mtx, mty, data in zip(g["mtx"], g["mty"], g["part"]):
                x, y = mtx * side - b["x0"], mty * side - b["y0"]
                own = np.frombuffer(data, np.float32).reshape(side, side)
                cut = own[max(0, -y) : max(0, out.shape[0] - y), max(0, -x) : max(0, out.shape[1] - x)]
                out[max(0, y) : max(0, y) + cut.shape[0], max(0, x) : max(0, x) + cut.shape[1]] = cut
            return pd.DataFrame({"tx": g["tx"].iloc[:1], "ty": g["ty"].iloc[:1], "patch": [out.tobytes()]})

        patches = found.groupBy("tx", "ty").applyInPandas(patch, "tx long, ty long, patch binary")
        pairs = asked.join(patches, ["tx", "ty"], "left").select("tx", "ty", "data", F.col("box.x0").alias("x0"), F.col("box.y0").alias("y0"), (F.col("box.x1") - F.col("box.x0") + 1).alias("w"), "patch")
        self.count += 1
        self.pairs = self.scratch.write(pairs, f"{self.label}-pairs{self.count}")
        if self.count > 1:
            self.scratch.drop(f"{self.label}-pairs{self.count - 1}")


@dataclass(frozen=True)
class _Sampler:
    """Reads a pair: fixed values with their positions, and the moving values and slopes there."""

    t: Transform
    step: int
    side: int

    def __call__(self, row) -> tuple[np.ndarray, ...]:
        """(x, y, px, py, fixed, moving, slope in x, slope in y); moving is NaN where it isn't known."""
        f = np.frombuffer(row.data, np.float32).reshape(self.side, self.side)
        py, px = np.nonzero(~np.isnan(f))
        f, px, py = f[py, px].astype(float), px + row.tx * self.side, py + row.ty * self.side
        x, y = px * self.step + (self.step - 1) / 2, py * self.step + (self.step - 1) / 2
        if row.patch is None:
            none = np.full(len(f), np.nan)
            return x, y, px, py, f, none, none, none
        m = np.frombuffer(row.patch, np.float32).reshape(-1, row.w)
        mx, my = self.t(x, y)
        mx, my = (mx - (self.step - 1) / 2) / self.step - row.x0, (my - (self.step - 1) / 2) / self.step - row.y0
        i, j = np.floor(mx).astype(int), np.floor(my).astype(int)
        ok = (i >= 0) & (j >= 0) & (i < m.shape[1] - 1) & (j < m.shape[0] - 1)
        i, j = np.where(ok, i, 0), np.where(ok, j, 0)
        a, b = mx - i, my - j
        p, q, r, u = m[j, i], m[j, i + 1], m[j + 1, i], m[j + 1, i + 1]
        right, down = (a == 0) & np.isnan(q), (b == 0) & np.isnan(r)  # on the image's last column or row
        q, u = np.where(right, p, q), np.where(right, r, u)
        r, u = np.where(down, p, r), np.where(down, q, u)
        low, high = p + (q - p) * a, r + (u - r) * a
        value = np.where(ok, low + (high - low) * b, np.nan)
        return x, y, px, py, f, value, ((q - p) * (1 - b) + (u - r) * b) / self.step, (high - low) / self.step


@dataclass(frozen=True)
class _Bins:
    """Ranges of both images as bins; two bins at either end of the moving axis keep its windows inside."""

    n: int
    fixed: tuple[float, float]
    moving: tuple[float, float]

    def of_fixed(self, v: np.ndarray) -> np.ndarray:
        low, high = self.fixed
        return np.clip(((v - low) / max(high - low, 1e-12) * self.n).astype(int), 0, self.n - 1)

    @property
    def unit(self) -> float:
        return (self.n - 5) / max(self.moving[1] - self.moving[0], 1e-12)

    def of_moving(self, v: np.ndarray) -> np.ndarray:
        return np.clip((v - self.moving[0]) * self.unit + 2, 2, self.n - 3)


def _histogram(level: _Level, t: Transform, bins: _Bins, slopes: bool) -> np.ndarray:
    """Sums by (fixed bin, moving bin): windows, and with ``slopes`` their derivatives by the six numbers of the matrix."""
    read, n, width = _Sampler(t, level.step, level.s.tile), bins.n, 7 if slopes else 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, n * n))
        for batch in batches:
            for row in batch.itertuples():
                x, y, _, _, f, m, gx, gy = read(row)
                ok = ~np.isnan(m)
                f, m = bins.of_fixed(f[ok]), bins.of_moving(m[ok])
                if slopes:
                    force = np.concatenate([g[ok] * b for g in (gx, gy) for b in t.basis(x[ok], y[ok])[:, None]]) * bins.unit
                first = np.floor(m).astype(int) - 1
                for k in range(4):
                    at, d = f * n + first + k, m - first - k
                    total[0] += np.bincount(at, _cubic(d), n * n)
                    if slopes:
                        w = _cubic_slope(d)
                        for i in range(6):
                            total[1 + i] += np.bincount(at, w * force[i], n * n)
        at = np.flatnonzero(total.any(axis=0))
        yield pd.DataFrame({"bin": at, **{f"h{i}": total[i, at] for i in range(width)}})

    names = [f"h{i}" for i in range(width)]
    sums = level.near(t).mapInPandas(run, "bin int, " + ", ".join(f"{c} double" for c in names)).groupBy("bin").agg(*[F.sum(c).alias(c) for c in names]).toPandas()  # at most n * n rows
    out = np.zeros((width, n * n))
    out[:, sums["bin"]] = sums[names].to_numpy().T
    return out


def _information(h: np.ndarray, n: int) -> tuple[float, np.ndarray, float]:
    """Mutual information (nats), log(p / p of the moving bin) by bin, and the samples."""
    total = h.sum()
    if total <= 0:
        return 0.0, np.zeros(n * n), 0.0
    p = (h / total).reshape(n, n)
    pf, pm = p.sum(axis=1, keepdims=True), p.sum(axis=0, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        own, ratio = np.where(p > 0, np.log(p / pm), 0.0), np.where(p > 0, p * np.log(p / (pf * pm)), 0.0)
    return float(ratio.sum()), own.ravel(), float(total)


def _control_forces(level: _Level, t: Transform, bins: _Bins, table: np.ndarray) -> np.ndarray:
    """Sums of the derivatives by control point's x and y, given the histogram's logs."""
    read, n, lin, points = _Sampler(t, level.step, level.s.tile), bins.n, t.matrix[:, :2] / t.scale, t.grid.shape[0] ** 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, points))
        for batch in batches:
            for row in batch.itertuples():
                x, y, _, _, f, m, gx, gy = read(row)
                ok = ~np.isnan(m)
                f, m = bins.of_fixed(f[ok]), bins.of_moving(m[ok])
                first, force = np.floor(m).astype(int) - 1, np.zeros(len(m))
                for k in range(4):
                    force += _cubic_slope(m - first - k) * table[f * n + first + k]
                force *= bins.unit
                at, w = t.splines(x[ok], y[ok])
                for axis in (0, 1):
                    push = force * (gx[ok] * lin[0, axis] + gy[ok] * lin[1, axis])
                    total[axis] += np.bincount(at.ravel(), (w * push).ravel(), points)
        yield pd.DataFrame({"point": np.arange(points), "fx": total[0], "fy": total[1]})

    sums = level.near(t).mapInPandas(run, "point int, fx double, fy double").groupBy("point").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy")).toPandas()  # a row per control point
    out = np.zeros((points, 2))
    out[sums["point"]] = sums[["fx", "fy"]].to_numpy()
    return out


# -- optimisation


Measure = Callable[[np.ndarray], tuple[float, Callable[[], np.ndarray]]]


def _climb(start: np.ndarray, measure: Measure, first: float, s: Settings) -> np.ndarray:
    """Ascends by a limited-memory quasi-Newton direction and halved steps; the first one moves no number by more than ``first``."""
    x, (value, slope) = start, measure(start)
    g, steps = slope(), []
    for _ in range(s.iterations):
        d = g.copy()
        kept = []
        for dx, dg in reversed(steps):
            a = (dx @ d) / (dx @ dg)
            d -= a * dg
            kept.append(a)
        if steps:
            dx, dg = steps[-1]
            d *= (dx @ dg) / (dg @ dg)
        for (dx, dg), a in zip(steps, reversed(kept)):
            d += (a - (dg @ d) / (dx @ dg)) * dx
        top = np.abs(d).max()
        if not np.isfinite(top) or top == 0:
            break
        if not steps or top > 4 * first:
            d *= first / top
        for _ in range(6):
            nearer, more = measure(x + d)
            if nearer > value:
                break
            d = d / 2
        else:
            if not steps:
                break
            steps = []  # once more along the slope itself
            continue
        new = more()
        dx, dg = d, g - new  # of the negative measure, whose curvature is positive
        if dx @ dg > 1e-12:
            steps = [*steps, (dx, dg)][-5:]
        gain, x, value, g = nearer - value, x + d, nearer, new
        if gain < s.tolerance * abs(value):
            break
    return x


def _bounds(df: DataFrame, v: str) -> tuple[float, float]:
    low, high = df.agg(F.min(v), F.max(v)).first()
    return (0.0, 0.0) if low is None else (float(low), float(high))


def centred(fixed: DataFrame, moving: DataFrame, v: str, width: int, height: int, foreground: float = 0.01) -> Transform:
    """The shift that lays the images' centres of mass on one another; the identity where either has no foreground."""
    t = identity(width, height)
    a, b = (centre_of_mass(df, v, foreground).first() for df in (fixed, moving))
    if a["n"] and b["n"]:
        t.matrix[:, 2] = b["mx"] - a["mx"], b["my"] - a["my"]
    return t


def register_affine(fixed: DataFrame, moving: DataFrame, v: str, width: int, height: int, s: Settings = Settings(), start: Transform | None = None) -> Transform:
    """The affine map of largest mutual information near the start (the centres of mass), from coarse levels to fine ones.

    Images are (px, py, v) with whole pixel numbers from 0; null values are missing
    pixels.  Images without overlap or with one value alone keep the start.
    """
    scratch = Scratch(fixed.sparkSession, "affine")
    bins = _Bins(s.bins, _bounds(fixed, v), _bounds(moving, v))
    t = start or centred(fixed, moving, v, width, height, s.foreground)
    for step in s.affine_levels:
        level = _Level(fixed, moving, v, step, s, scratch, f"level{step}")

        def measure(x: np.ndarray) -> tuple[float, Callable[[], np.ndarray]]:
            h = _histogram(level, Transform(width, height, x.reshape(2, 3)), bins, True)
            value, logs, total = _information(h[0], s.bins)
            return value, lambda: h[1:] @ logs / max(total, 1.0)

        t = Transform(width, height, _climb(t.matrix.ravel(), measure, float(step), s).reshape(2, 3))
    return t


def register_warp(fixed: DataFrame, moving: DataFrame, v: str, affine: Transform, s: Settings = Settings()) -> Transform:
    """The affine map with a grid of cubic splines before it, of largest mutual information near no warp."""
    scratch = Scratch(fixed.sparkSession, "warp")
    bins = _Bins(s.bins, _bounds(fixed, v), _bounds(moving, v))
    n = s.mesh + 3
    grid = np.zeros((n, n, 2))
    for step in s.warp_levels:
        level = _Level(fixed, moving, v, step, s, scratch, f"level{step}")

        def measure(x: np.ndarray) -> tuple[float, Callable[[], np.ndarray]]:
            t = Transform(affine.width, affine.height, affine.matrix, x.reshape(n, n, 2))
            value, logs, total = _information(_histogram(level, t, bins, False)[0], s.bins)
            return value, lambda: _control_forces(level, t, bins, logs).ravel() / max(total, 1.0)

        grid = _climb(grid.ravel(), measure, float(step), s).reshape(n, n, 2)
    return Transform(affine.width, affine.height, affine.matrix, grid)


def register(fixed: DataFrame, moving: DataFrame, v: str, width: int, height: int, s: Settings = Settings()) -> Transform:
    """Centres of mass, then the affine map, then the warp."""
    return register_warp(fixed, moving, v, register_affine(fixed, moving, v, width, height, s), s)


def resample(fixed: DataFrame, moving: DataFrame, v: str, t: Transform, s: Settings = Settings()) -> DataFrame:
    """(px, py, v): the moving image on the fixed one's pixels, linearly; 0 where it has none."""
    level = _Level(fixed, moving, v, 1, s, Scratch(fixed.sparkSession, "resample"), "whole")
    read = _Sampler(t, 1, s.tile)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                _, _, px, py, _, m, _, _ = read(row)
                yield pd.DataFrame({"px": px, "py": py, v: np.nan_to_num(m)})

    return level.near(t).mapInPandas(run, f"px long, py long, `{v}` double")


def transform_table(t: Transform, spark) -> DataFrame:
    """One row per number of a transform: (part, row, col, value); ``matrix`` in pixels of the image, its last column the shift of the origin."""
    lin = t.matrix[:, :2] / t.scale
    centre = np.array([(t.width - 1) / 2, (t.height - 1) / 2])
    shift = t.matrix[:, 2] + centre - lin @ centre
    rows = [("matrix", i, j, float(x)) for i, line in enumerate(np.column_stack([lin, shift])) for j, x in enumerate(line)]
    if t.grid is not None:
        rows += [(f"shift_{'xy'[k]}", i, j, float(t.grid[i, j, k])) for k in (0, 1) for i in range(t.grid.shape[0]) for j in range(t.grid.shape[1])]
    return spark.createDataFrame(rows, "part string, row int, col int, value double")
