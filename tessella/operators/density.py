"""Density clustering of points in the plane (HDBSCAN): excess-of-mass clusters of a mutual-reachability tree.

Four steps, each distributed over tiles of the plane and written tables:

1. ``core_distances``: the distance to the k-th nearest other point.  A radius
   doubles; a point is done once the radius holds k others.
2. ``reachability_tree``: the minimum spanning tree under the mutual reachability
   max(core a, core b, distance).  At a radius r, blocks of points reduce the
   edges of up to r that join different components to their own spanning forest
   (an edge that is heaviest in a cycle is in no minimum tree), and the forests'
   edges are reduced together; then r doubles.  Points inside a component, with no
   other in reach, drop out by occupied cells.  Edges are in one total order
   (weight, then keys), so the tree doesn't depend on the blocks.
   In steps 1 and 2, what is left of a group meets all of it once it fits a block.
3. ``contracted``: components under ``least`` points are never clusters.  Tiles that
   grow merge what no edge beyond them can precede, until what is left is the tree
   of merges between components of at least ``least`` points, and every point's
   weight of joining one.
4. The condensed tree of those merges, stabilities, and the clusters of largest
   excess of mass; points outside all of them are noise, -1.

Merges of equal weight are one merge of many, so ties have one result.  Blocks
and tiles are bounded in rows.  The condensed tree has at most 2 / ``least`` nodes a
row of its group (the ``by`` columns) and is made in one task for each group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.graph import connected_components
from tessella.scratch import Scratch

#: Rows of either side that meet in one block.
BLOCK = 1 << 17
#: Todo rows times rows of a group up to which they meet without tiles.
MEET = 1 << 26
#: Edges of a group that one task reduces or contracts; beyond, rounds and tiles do.
MOST_EDGES = 1 << 20
#: Tile width in radii, and rows that a tile should have on average, over all groups, where radii are short.
WIDE, FILL = 64.0, 20_000
#: Pairs that are measured at once, and edges that a block holds before they are reduced.
PAIRS, HELD = 1 << 19, 1 << 21
#: Weights of zero count as this much.
LEAST_WEIGHT = 1e-9


def _cell(c: str, edge: float) -> Column:
    return F.floor(F.col(c) / F.lit(edge)).cast("long")


def _blocks(todo: DataFrame, points: DataFrame, r: float | None, key: str, by: Sequence[str], most: int, room: float = 0.0) -> DataFrame:
    """Todo rows (``_home``) and the points within r of their tile, dealt to blocks (by, _tx, _ty, _i, _j) of about ``most`` rows of each.

    ``_parts``: the blocks that the tile's points are dealt to.  Without a radius the group is one tile: a few todo rows meet all points.
    """
    tile = [*by, "_tx", "_ty"]
    if r is None:
        home, around = (df.withColumns({c: F.lit(0).cast("long") for c in ("_tx", "_ty")}) for df in (todo, points))
    else:
        edge, halo = max(WIDE * r, room), r * (1 + 1e-9)
        spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / edge).cast("long"), F.floor((F.col(c) + halo) / edge).cast("long")))
        home = todo.withColumns({"_tx": _cell("_x", edge), "_ty": _cell("_y", edge)})
        around = points.withColumn("_tx", spread("_x")).withColumn("_ty", spread("_y"))
    rows = F.ceil(F.col("n") / most).cast("int")
    ours = home.groupBy(*tile).agg(F.count(F.lit(1)).alias("n")).select(*tile, rows.alias("_ni"))
    near = around.join(ours.select(*tile), tile, "left_semi")
    theirs = near.groupBy(*tile).agg(F.count(F.lit(1)).alias("n")).select(*tile, rows.alias("_parts"))
    size = ours.join(theirs, tile)
    deal = lambda n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = home.join(size, tile).withColumns({"_i": deal("_ni"), "_home": F.lit(True)}).withColumn("_j", all_of("_parts"))
    b = near.join(size, tile).withColumns({"_j": deal("_parts"), "_home": F.lit(False)}).withColumn("_i", all_of("_ni"))
    return a.unionByName(b, allowMissingColumns=True)


def _largest(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group."""
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def _ranges(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, lo, n): places b in an order by cells of r, and for each a the three ranges of it, (3, a), that hold all b within r."""
    edge = r * (1 + 1e-9)
    x0, y0 = min(ax.min(), bx.min()), min(ay.min(), by.min())
    width = int((max(ax.max(), bx.max()) - x0) / edge) + 4
    a, b = ((np.floor((y - y0) / edge).astype(np.int64) + 1) * width + np.floor((x - x0) / edge).astype(np.int64) + 1 for x, y in ((ax, ay), (bx, by)))
    order = np.argsort(b, kind="stable")
    ordered = b[order]
    rows = [a + row * width for row in (-1, 0, 1)]
    lo = np.stack([np.searchsorted(ordered, c - 1, "left") for c in rows])
    return order, lo, np.stack([np.searchsorted(ordered, c + 1, "right") for c in rows]) - lo


def _slices(n: np.ndarray) -> Iterator[slice]:
    """Runs of rows that have about PAIRS pairs together."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        yield slice(at, stop)
        at = stop


def _spelled(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of ranges that begin at lo and have n, one range after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _best(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, k: int, r: float) -> np.ndarray:
    """(a, k): the k least distances of each a to places b, in order; infinite where less than k are within r."""
    out = np.full((len(ax), k), np.inf)
    if not len(bx) or not len(ax):
        return out
    if not np.isfinite(r):
        r = max(float(np.hypot(max(ax.max(), bx.max()) - min(ax.min(), bx.min()), max(ay.max(), by.max()) - min(ay.min(), by.min()))) * (1 + 1e-9), LEAST_WEIGHT)
    # The first radius suits the densest of a grid's cells; it doubles for those that stay open.
    wide = max(float(np.ptp(bx)), float(np.ptp(by)), LEAST_WEIGHT)
    grid = wide / max(1.0, np.sqrt(len(bx) / (4.0 * k)))
    _, held = np.unique(np.floor((bx - bx.min()) / grid) * (len(bx) + 2) + np.floor((by - by.min()) / grid), return_counts=True)
    rho, todo = min(r, max(grid * float(np.sqrt(k / held.max())), LEAST_WEIGHT)), np.arange(len(ax))
    while len(todo):
        order, lo, n = _ranges(ax[todo], ay[todo], bx, by, rho)
        by_width = np.argsort(n.sum(axis=0), kind="stable")
        todo, lo, n = todo[by_width], lo[:, by_width], n[:, by_width]
        total, done = n.sum(axis=0), np.zeros(len(todo), bool)
        for s in _slices(np.maximum(total, 1)):
            m, i = total[s], todo[s]
            j = order[_spelled(lo[:, s].T.ravel(), n[:, s].T.ravel())]
            row = np.repeat(np.arange(len(m)), m)
            d = np.full((len(m), max(int(m.max()), k)), np.inf)
            d[row, np.arange(len(j)) - np.repeat(np.cumsum(m) - m, m)] = np.sqrt((ax[i][row] - bx[j]) ** 2 + (ay[i][row] - by[j]) ** 2)
            best = np.sort(np.partition(d, k - 1, axis=1)[:, :k], axis=1)
            best[best > rho] = np.inf
            out[i], done[s] = best, np.isfinite(best[:, -1])
        todo = todo[~done]
        if rho >= r:
            return out
        rho = min(2 * rho, r)
    return out


def _places(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each point in its place, from 0; number of its place)."""
    order = np.lexsort((y, x))
    new = np.r_[True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])] if len(x) else np.zeros(0, bool)
    rank, place, first = np.empty(len(x), np.int64), np.empty(len(x), np.int64), np.flatnonzero(new)
    number = np.cumsum(new) - 1
    rank[order], place[order] = np.arange(len(x)) - first[number], number
    return rank, place


def core_distances(points: DataFrame, k: int, key: str, by: Sequence[str], scratch: Scratch, most: int = BLOCK) -> DataFrame:
    """points(key, by, _x, _y) with ``_core``: the distance to the k-th nearest other point of the group, or to the farthest where it has fewer; 0 for a lone point."""
    one = points.agg(F.count(F.lit(1)).alias("n"), F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    wide = max(one[2] - one[1], one[4] - one[3], LEAST_WEIGHT) if one["n"] else 1.0
    # The first radius suits the densest of a grid's cells; each doubling takes in what is sparser.
    grid = wide / max(1.0, np.sqrt(one["n"] / (8.0 * k)))
    densest = points.groupBy(*by, _cell("_x", grid), _cell("_y", grid)).count().agg(F.max("count")).first()[0] or 1
    r = max(grid * float(np.sqrt(2.0 * k / densest)), LEAST_WEIGHT)
    sizes = points.groupBy(*by).agg(F.least(F.lit(k), F.count(F.lit(1)) - 1).cast("int").alias("_k"))
    group = _largest(points, by)
    sized = points.join(sizes, list(by)).select(*points.columns, "_k")
    todo, done, step = sized.where("_k > 0"), sized.where("_k = 0").drop("_k").withColumn("_core", F.lit(0.0)), 0
    names = points.columns
    schema = T.StructType([*points.schema.fields, T.StructField("_k", T.IntegerType()), T.StructField("_parts", T.IntegerType()), T.StructField("_d", T.ArrayType(T.DoubleType()))])

    def kernel(radius: float):
        def best_of(g: pd.DataFrame) -> pd.DataFrame:
            mine = g["_home"].to_numpy(bool)
            a, b = g[mine], g[~mine]
            if not len(a):
                return pd.DataFrame({c: g[c][:0] for c in (*names, "_k", "_parts")} | {"_d": []})
            x, y, bx, by_ = a["_x"].to_numpy(), a["_y"].to_numpy(), b["_x"].to_numpy(), b["_y"].to_numpy()
            n, whole = int(a["_k"].iloc[0]) + 1, int(a["_parts"].iloc[0]) == 1  # with the point itself, at 0
            first, place = _places(x, y)
            few = _places(bx, by_)[0] < n  # more points of one place change nothing
            one_each = first == 0
            best = np.empty((int(place.max()) + 1, n))
            best[place[one_each]] = _best(x[one_each], y[one_each], bx[few], by_[few], n, radius)
            best = best[place]
            found = [[v] if np.isfinite(v) else [] for v in best[:, -1].tolist()] if whole else [v[np.isfinite(v)].tolist() for v in best]
            return a[[*names, "_k", "_parts"]].assign(_d=found)

        return best_of

    while left := _largest(todo, by):
        last = r > 2 * wide or left * group <= MEET  # few enough to meet all points
        near = points if last or not step else _within_cells(points, todo, r, by)
        met = _blocks(todo, near, None if last else r, key, by, most)
        found = scratch.write(met.groupBy(*by, "_tx", "_ty", "_i", "_j").applyInPandas(kernel(np.inf if last else r), schema), f"core-found-{step}")
        whole = found.where("_parts = 1").select(*names, "_k", F.try_element_at("_d", F.lit(1)).alias("_core"))
        parts = found.where("_parts > 1").groupBy(*names, "_k").agg(F.sort_array(F.flatten(F.collect_list("_d"))).alias("_d"))
        reached = whole.unionByName(parts.select(*names, "_k", F.try_element_at("_d", F.col("_k") + 1).alias("_core")))
        done = done.unionByName(reached.where("_core is not null").drop("_k"))
        if last:
            return done
        todo = scratch.write(reached.where("_core is null").drop("_core"), f"core-todo-{step + 1}")
        r, step = 2 * r, step + 1
    return done


def _within_cells(points: DataFrame, todo: DataFrame, r: float, by: Sequence[str]) -> DataFrame:
    """The points in the cells of r around todo rows, which hold all within r of them."""
    edge, around = r * (1 + 1e-9), F.explode(F.sequence(F.lit(-1), F.lit(1)))
    cells = todo.select(*by, _cell("_x", edge).alias("_cx"), _cell("_y", edge).alias("_cy")).distinct().withColumn("_dx", around).withColumn("_dy", around)
    near = cells.select(*by, (F.col("_cx") + F.col("_dx")).alias("_cx"), (F.col("_cy") + F.col("_dy")).alias("_cy")).distinct()
    return points.withColumns({"_cx": _cell("_x", edge), "_cy": _cell("_y", edge)}).join(near, [*by, "_cx", "_cy"], "left_semi").drop("_cx", "_cy")


# -- the minimum spanning tree


def _boruvka(edges: np.ndarray, ca: np.ndarray, cb: np.ndarray, label: np.ndarray, chooses: np.ndarray | None = None) -> np.ndarray:
    """Of edges in ascending order between labels ca and cb those of the minimum spanning forest; ``label`` becomes the label of each label's tree.

    With ``chooses`` only labels of trees whose labels all choose take their least edge; the others are joined by those that do.
    """
    kept, n = [], len(label)
    free = np.ones(n, bool) if chooses is None else chooses.copy()
    ca, cb = label[ca], label[cb]
    while True:
        live = ca != cb
        if chooses is not None:
            live &= free[ca] | free[cb]
        edges, ca, cb = edges[live], ca[live], cb[live]
        if not len(edges):
            return np.concatenate(kept) if kept else edges
        at = np.arange(len(edges))
        best = np.full(n, len(edges))
        other = np.full(n, len(edges))
        best[ca[::-1]], other[cb[::-1]] = at[::-1], at[::-1]  # the last of a label is its first edge
        best = np.minimum(best, other)
        who = np.flatnonzero((best < len(edges)) & free)
        take = best[who]
        to = np.arange(n)
        to[who] = ca[take] + cb[take] - who
        both = who[(to[to[who]] == who) & (who < to[who])]  # two that take the same edge
        to[both] = both
        while True:
            further = to[to]
            if (further == to).all():
                break
            to = further
        kept.append(edges[np.unique(take)])
        if chooses is not None:
            bound = np.zeros(n, bool)
            bound[to[~free]] = True
            free = ~bound[to]
        label[:] = to[label]
        ca, cb = to[ca], to[cb]


def _pair_slices(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, r: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, d) of a and b in cells of r that touch, a slice at a time."""
    order, lo, n = _ranges(ax, ay, bx, by, r)
    for s in _slices(n.sum(axis=0)):
        i = np.repeat(np.arange(s.start, s.stop), n[:, s].sum(axis=0))
        j = order[_spelled(lo[:, s].T.ravel(), n[:, s].T.ravel())]
        yield i, j, np.sqrt((ax[i] - bx[j]) ** 2 + (ay[i] - by[j]) ** 2)


def _open(x: np.ndarray, y: np.ndarray, comp: np.ndarray, r: float) -> np.ndarray:
    """Points that may have one of another component within r: cells of r whose neighbours hold one component drop out."""
    edge = r * (1 + 1e-9)
    cx, cy = (np.floor((c - c.min()) / edge).astype(np.int64) + 1 for c in (x, y))
    width = int(cx.max()) + 2
    cells, at = np.unique(cy * width + cx, return_inverse=True)
    low, high = np.full(len(cells), len(comp)), np.full(len(cells), -1)
    np.minimum.at(low, at, comp)
    np.maximum.at(high, at, comp)
    least, most = low.copy(), high.copy()
    for o in (dy * width + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy):
        k = np.minimum(np.searchsorted(cells, cells + o), len(cells) - 1)
        there = cells[k] == cells + o
        least[there] = np.minimum(least[there], low[k[there]])
        most[there] = np.maximum(most[there], high[k[there]])
    return (least < most)[at]


def _tile_forest(x: np.ndarray, y: np.ndarray, core: np.ndarray, comp: np.ndarray, mine: np.ndarray, near: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, w): the minimum spanning forest of the edges of up to r between points ``mine`` and ``near``, of points in key order with components ``comp``.

    A radius doubles up to r; points that have no other component in reach drop out between.
    """
    label, n = np.arange(int(comp.max()) + 1), len(x)
    is_mine, is_near = np.zeros(n, bool), np.zeros(n, bool)
    is_mine[mine], is_near[near] = True, True
    some = core[mine]
    if not np.isfinite(r):
        r = max(float(np.hypot(np.ptp(x), np.ptp(y))), float(core.max()), LEAST_WEIGHT) * (1 + 1e-9)
    # Cells of the first radius can be numbered, however far the points lie apart.
    wx, wy = float(np.ptp(x)), float(np.ptp(y))
    rho, live, out = min(r, max(float(np.quantile(some, 0.25)), np.sqrt(wx * wy / n) / 4, 2.0**-20 * max(wx, wy), LEAST_WEIGHT)), np.ones(n, bool), []
    while True:
        use = live & (core <= rho)
        a, b = np.flatnonzero(use & is_mine), np.flatnonzero(use & is_near)
        held, many = [], 0

        def reduced() -> list:
            i, j, w = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((j, i, w))
            i, j, w = i[order], j[order], w[order]
            kept = np.sort(_boruvka(np.arange(len(i)), comp[i], comp[j], label.copy()))
            return [(i[kept], j[kept], w[kept])]

        if len(a) and len(b):
            for i, j, d in _pair_slices(x[a], y[a], x[b], y[b], rho):
                i, j = a[i], b[j]
                w = np.maximum(np.maximum(d, core[i]), core[j])
                ok = (label[comp[i]] != label[comp[j]]) & (w <= rho) & ~((j < i) & is_mine[j] & is_near[i])
                if ok.any():
                    held.append((np.minimum(i, j)[ok], np.maximum(i, j)[ok], w[ok]))
                    many += int(ok.sum())
                    if many > HELD:
                        held = reduced()
                        many = len(held[0][0])
        if held:
            held = reduced()
            i, j, w = held[0]
            _boruvka(np.arange(len(i)), comp[i], comp[j], label)
            out += held
        if rho >= r:
            break
        rho = min(2 * rho, r)
        live = _open(x, y, label[comp], rho)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, w = (np.concatenate(c) for c in zip(*out))
    return i, j, w


def kruskal(edges: pd.DataFrame) -> pd.DataFrame:
    """The minimum spanning forest of edges(a, b, w, ca, cb) between components, in the order of w, then keys."""
    lo, hi = np.minimum(edges["a"], edges["b"]), np.maximum(edges["a"], edges["b"])
    ranks, at = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    order = np.lexsort((at[len(lo) :], at[: len(lo)], edges["w"].to_numpy()))
    names, at = np.unique(np.concatenate([edges["ca"], edges["cb"]]), return_inverse=True)
    ca, cb = at[: len(edges)].tolist(), at[len(edges) :].tolist()
    parent, kept = list(range(len(names))), []
    for e in order.tolist():
        x, y = ca[e], cb[e]
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(e)
    return edges.iloc[kept]


def _spanning(edges: DataFrame, by: Sequence[str], scratch: Scratch, label: str, most_edges: int) -> DataFrame:
    """The minimum spanning forest of edges(by, a, b, w, ca, cb): groups of up to ``most_edges`` in one task each, others by rounds of least edges."""
    if _largest(edges, by) <= most_edges:
        return scratch.write(edges.groupBy(*by).applyInPandas(kruskal, edges.schema), f"{label}-small")
    tagged = edges.join(edges.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), list(by)).select(*edges.columns, "_n")
    out = scratch.write(tagged.where(F.col("_n") <= most_edges).drop("_n").groupBy(*by).applyInPandas(kruskal, edges.schema), f"{label}-small")
    left = scratch.write(tagged.where(F.col("_n") > most_edges).drop("_n"), f"{label}-large-0")
    step = 0
    while not left.isEmpty():
        order = F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        row = F.struct(*[F.col(c) for c in edges.columns])
        ends = left.select(F.col("ca").alias("c"), order.alias("o"), row.alias("e")).union(left.select("cb", order, row))
        least = ends.groupBy("c").agg(F.min_by("e", "o").alias("e")).select("e.*").distinct()
        least = scratch.write(least, f"{label}-least-{step}")
        out = out.unionByName(least)
        comp = connected_components(least.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch, f"{label}-comps-{step}")
        named = lambda df, c: df.join(comp.select(F.col("id").alias(c), F.col("comp").alias("_c")), c, "left").withColumn(c, F.coalesce("_c", c)).drop("_c")
        step += 1
        left = scratch.write(named(named(left, "ca"), "cb").where("ca <> cb").select(*edges.columns), f"{label}-large-{step}")
    return out


def reachability_tree(points: DataFrame, key: str, by: Sequence[str], scratch: Scratch, most: int = BLOCK, most_edges: int = MOST_EDGES) -> DataFrame:
    """(by, a, b, w): the minimum spanning tree of each group of points(key, by, _x, _y, _core) under mutual reachability."""
    none = points.limit(0).select(*by, F.col(key).alias("a"), F.col(key).alias("b"), F.col("_core").alias("w"))
    one = points.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y"), F.expr("percentile_approx(_core, 0.5)").alias("r")).first()
    if one["r"] is None:
        return none
    # A place's points hang on the one with the least core: whatever another one reaches, that one reaches at no greater weight.
    first = F.min(F.struct("_core", key))
    at = points.groupBy(*by, "_x", "_y").agg(first.alias("_first"), F.count(F.lit(1)).alias("_n"))
    stars = points.join(at.where("_n > 1"), [*by, "_x", "_y"]).where(F.col(key) != F.col(f"_first.{key}")).select(*by, F.col(f"_first.{key}").alias("a"), F.col(key).alias("b"), F.col("_core").alias("w"))
    points = scratch.write(at.select(F.col(f"_first.{key}").alias(key), *by, "_x", "_y", F.col("_first._core").alias("_core"), F.col(f"_first.{key}").alias("_comp")), "tree-places")
    wide, n = max(one[1] - one[0], one[3] - one[2]), max(1, points.count())
    area = max(one[1] - one[0], 1e-6 * wide) * max(one[3] - one[2], 1e-6 * wide)
    spacing, room = float(np.sqrt(area / n)), float(np.sqrt(FILL * area / n))
    r, step, tree, group = max(one["r"], spacing, LEAST_WEIGHT), 0, none.unionByName(scratch.write(stars, "tree-stars")), _largest(points, by)
    kind = points.schema[key].dataType
    edge = T.StructType([*[points.schema[c] for c in by], T.StructField("what", T.IntegerType()), *[T.StructField(c, kind) for c in ("a", "b")], T.StructField("w", T.DoubleType()), *[T.StructField(c, kind) for c in ("ca", "cb")]])

    def kernel(radius: float):
        def forest_of(g: pd.DataFrame) -> pd.DataFrame:
            """Rows 0: component ca is part of cb now; 1: a, b is an edge of the tree; 2: an edge that others must be held against."""
            names, at, nth = np.unique(g[key].to_numpy(), return_index=True, return_inverse=True)
            x, y, core = (g[c].to_numpy()[at] for c in ("_x", "_y", "_core"))
            comps, comp = np.unique(g["_comp"].to_numpy()[at], return_inverse=True)
            home = g["_home"].to_numpy(bool)
            if home.all() or not home.any():
                return pd.DataFrame({f.name: np.zeros(0, object) for f in edge})
            mine, near = np.unique(nth[home]), np.unique(nth[~home])
            i, j, w = _tile_forest(x, y, core, comp, mine, near, radius)
            order = np.lexsort((j, i, w))
            i, j, w = i[order], j[order], w[order]
            label, sure = np.arange(len(comps)), np.zeros(len(i), bool)
            if int(g["_parts"].iloc[0]) == 1:
                # All edges of the tile's points are here: a component that lies whole in it has its least edge in the tree.
                inside = np.zeros(len(names), bool)
                inside[mine] = True
                size = np.zeros(len(comps), np.int64)
                size[comp] = g["_size"].to_numpy()[at]
                whole = np.bincount(comp[mine], minlength=len(comps)) == size
                sure[_boruvka(np.arange(len(i)), comp[i], comp[j], label, whole)] = True
                sure &= inside[i] & inside[j]
                label = np.arange(len(comps))
                _boruvka(np.arange(int(sure.sum())), comp[i[sure]], comp[j[sure]], label)
                # A tree of them has one component at most that isn't whole, and its name.
                name = np.full(len(comps), len(comps))
                np.minimum.at(name, label, np.arange(len(comps)))
                name[label[~whole]] = np.flatnonzero(~whole)
                label = name[label]
            moved, left = np.flatnonzero(label != np.arange(len(comps))), ~sure
            parts = [(0, comps[moved], comps[label[moved]], np.nan, comps[moved], comps[label[moved]])]
            parts += [(what, names[i[s]], names[j[s]], w[s], comps[label[comp[i[s]]]], comps[label[comp[j[s]]]]) for what, s in ((1, sure), (2, left))]
            out = pd.concat([pd.DataFrame(dict(zip(("a", "b", "w", "ca", "cb"), p[1:]))).assign(what=p[0]) for p in parts], ignore_index=True)
            return out.assign(**{c: g[c].iloc[0] for c in by})[edge.names]

        return forest_of

    while True:
        sizes = points.groupBy(*by, "_comp").agg(F.count(F.lit(1)).alias("_size"))
        # All but the points of each group's largest component; of equals the one with the largest key.
        lead = sizes.groupBy(*by).agg(F.max_by("_comp", F.struct("_size", "_comp")).alias("_lead"))
        rest = points.join(lead, list(by)).where("_comp <> _lead").select(*points.columns)
        left = _largest(rest, by)
        if not left:
            return tree
        last = r > 2 * wide or left * group <= MEET  # few enough to meet all points
        # Points whose core is beyond r have no edge of up to r.
        able = points.where(F.col("_core") <= r)
        todo = rest if last else able if not step else scratch.write(_meeting(able, r, by), f"tree-todo-{step}")
        with_size = todo.withColumn("_size", F.lit(1).cast("long")) if not step else todo.join(sizes, [*by, "_comp"])
        met = _blocks(with_size, points.withColumn("_size", F.lit(0).cast("long")) if last else with_size, None if last else r, key, by, most, room)
        if last:  # the lead's points meet no one here, so no component's edges are all at hand
            met = met.withColumn("_parts", F.lit(2))
        got = scratch.write(met.groupBy(*by, "_tx", "_ty", "_i", "_j").applyInPandas(kernel(np.inf if last else r), edge), f"tree-found-{step}")
        moved = got.where("what = 0").select(F.col("ca").alias("_comp"), F.col("cb").alias("_to"))
        renamed = lambda df, c: df.join(moved.select(F.col("_comp").alias(c), "_to"), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        open_ = renamed(renamed(got.where("what = 2"), "ca"), "cb").where("ca <> cb").select(*by, "a", "b", "w", "ca", "cb")
        kept = _spanning(scratch.write(open_, f"tree-open-{step}"), by, scratch, f"tree-{step}", most_edges)
        tree = tree.unionByName(got.where("what = 1").select(*by, "a", "b", "w")).unionByName(kept.select(*by, "a", "b", "w"))
        if last:
            return tree
        comp = connected_components(kept.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch, f"tree-comps-{step}").select(F.col("id").alias("_comp"), F.col("comp").alias("_to"))
        named = renamed(points, "_comp").join(comp, "_comp", "left").withColumn("_comp", F.coalesce("_to", "_comp"))
        points = scratch.write(named.select(key, *by, "_x", "_y", "_core", "_comp"), f"tree-points-{step}")
        r, step = 2 * r, step + 1


def _meeting(points: DataFrame, r: float, by: Sequence[str]) -> DataFrame:
    """Points that may have another component's point within r: by occupied cells of r, of which those of a component's inside drop out."""
    edge, cell = r * (1 + 1e-9), [*by, "_cx", "_cy"]
    placed = points.withColumns({"_cx": _cell("_x", edge), "_cy": _cell("_y", edge)})
    mixed = placed.groupBy(*cell).agg(F.min("_comp").alias("lo"), F.max("_comp").alias("hi"))
    for c in ("_cx", "_cy"):
        mixed = mixed.withColumn("_d", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(c, F.col(c) + F.col("_d")).groupBy(*cell).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return placed.join(mixed.where("lo <> hi").select(*cell), cell, "left_semi").select(*points.columns)


# -- contraction to the merges of large components


def contract(nodes: pd.DataFrame, edges: pd.DataFrame, least: int) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Merges that no edge to outside can precede, of nodes(node, size, big) along tree edges(u, v, w, inside).

    Gives (old node, new node, seed, weight) of every node, the seed and weight
    where it now is part of a large component; (seed, seed, weight) of merges of
    large components; and (new node, size, big).
    """
    names = nodes["node"].tolist()
    at = {x: k for k, x in enumerate(names)}
    parent, size, big = list(range(len(names))), nodes["size"].tolist(), nodes["big"].tolist()
    ident, frozen = list(names), [np.inf] * len(names)
    members = [[k] if not big[k] else [] for k in range(len(names))]
    joined: dict[int, tuple] = {}
    merges: list[tuple] = []
    inside = edges["inside"].to_numpy(bool)
    for u, v, w in edges[~inside][["u", "v", "w"]].itertuples(index=False):
        for x in (u, v):
            if x in at:
                frozen[at[x]] = min(frozen[at[x]], w)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def unite(a: int, b: int, w: float) -> None:
        """b becomes part of a."""
        if big[a] and big[b]:
            merges.append((ident[a], ident[b], w))
        fresh = members[b] if big[a] else members[a] + members[b] if big[b] or size[a] + size[b] >= least else []
        if big[a] or not big[b]:
            name = ident[a] if big[a] and not big[b] else min(ident[a], ident[b])
        else:
            name = ident[b]
        parent[b], size[a], frozen[a] = a, size[a] + size[b], min(frozen[a], frozen[b])
        if fresh:
            for k in fresh:
                joined[k] = (name, w)
            members[a] = []
        else:
            members[a] = [] if big[a] or big[b] else members[a] + members[b]
        members[b] = []
        big[a], ident[a] = big[a] or big[b] or size[a] >= least, name

    own = edges[inside].sort_values(["w", "u", "v"], kind="stable")
    for u, v, w in own[["u", "v", "w"]].itertuples(index=False):
        a, b = root(at[u]), root(at[v])
        if a == b:
            continue
        ready = w < frozen[a], w < frozen[b]
        if all(ready) or (big[a] and not big[b] and ready[1]):
            unite(a, b, w)
        elif big[b] and not big[a] and ready[0]:
            unite(b, a, w)
        else:
            frozen[a], frozen[b] = min(frozen[a], w), min(frozen[b], w)
    moved = [(names[k], ident[root(k)], *joined.get(k, (None, None))) for k in range(len(names))]
    return moved, merges, [(ident[k], size[k], big[k]) for k in range(len(names)) if parent[k] == k]


def contracted(tree: DataFrame, points: DataFrame, least: int, key: str, by: Sequence[str], scratch: Scratch, most_edges: int = MOST_EDGES) -> tuple[DataFrame, DataFrame]:
    """((by, key, seed, w) of every point that joins a large component, (by, a, b, w) of their merges)."""
    kind = points.schema[key].dataType
    kinds = [points.schema[c] for c in by]
    out = T.StructType([*kinds, T.StructField("what", T.IntegerType()), *[T.StructField(c, kind) for c in ("a", "b", "seed")], T.StructField("w", T.DoubleType()), T.StructField("size", T.LongType()), T.StructField("big", T.BooleanType())])
    nodes = points.select(*by, F.col(key).alias("node"), F.lit(1).cast("long").alias("size"), F.lit(least <= 1).alias("big"), F.col("_x").alias("x"), F.col("_y").alias("y"))
    edges = tree.select(*by, F.col("a").alias("u"), F.col("b").alias("v"), "w")
    now = points.select(*by, key, F.col(key).alias("node"))
    joined, merges, step = [], [], 0
    one = points.agg(F.count(F.lit(1)).alias("n"), F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    far = max(one[2] - one[1], one[4] - one[3], LEAST_WEIGHT) if one["n"] else 1.0
    tiles = max(1, int(np.ceil(np.sqrt(8 * _largest(edges, by) / most_edges))))  # an eighth of it a tile, so that tasks are many

    def kernel(key_: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame({f.name: np.zeros(0, object) for f in out})
        moved, met, left = contract(n, e, least)
        rows = [(0, a, b, s, w, None, None) for a, b, s, w in moved] + [(1, a, b, None, w, None, None) for a, b, w in met] + [(2, a, None, None, None, z, g) for a, z, g in left]
        table = pd.DataFrame(rows, columns=["what", "a", "b", "seed", "w", "size", "big"]).astype({"a": object, "b": object, "seed": object, "size": "Int64"})
        for k, c in enumerate(by):
            table[c] = np.full(len(table), key_[k], object)
        return table

    while True:
        whole = tiles == 1
        place = lambda c: (F.lit(0) if whole else F.floor((F.col(c) - one[1 if c == "x" else 3]) / F.lit(far / tiles))).cast("long")
        nodes = nodes.withColumns({"_tx": place("x"), "_ty": place("y")})
        spot = lambda c, p: nodes.select(*by, F.col("node").alias(c), F.col("_tx").alias(f"{p}x"), F.col("_ty").alias(f"{p}y"))
        at = edges.join(spot("u", "p"), [*by, "u"]).join(spot("v", "q"), [*by, "v"]).withColumn("inside", (F.col("px") == F.col("qx")) & (F.col("py") == F.col("qy")))
        side = lambda p, df: df.select(*by, "u", "v", "w", "inside", F.col(f"{p}x").alias("_tx"), F.col(f"{p}y").alias("_ty"))
        cut = side("p", at).unionByName(side("q", at.where("not inside")))
        tile = [*by, "_tx", "_ty"]
        got = scratch.write(nodes.groupBy(*tile).cogroup(cut.groupBy(*tile)).applyInPandas(_named(kernel, len(by)), out), f"contract-{step}")
        moved = got.where("what = 0").select(*by, F.col("a").alias("node"), F.col("b").alias("to"), "seed", "w")
        merges.append(got.where("what = 1").select(*by, "a", "b", "w"))
        points_now = now.join(moved, [*by, "node"])
        joined.append(points_now.where("seed is not null").select(*by, key, "seed", "w"))
        if whole:
            break
        now = scratch.write(points_now.where("seed is null").select(*by, key, F.col("to").alias("node")), f"contract-now-{step}")
        named = lambda df, c: df.join(moved.select(*by, F.col("node").alias(c), F.col("to").alias("_to")), [*by, c]).withColumn(c, F.col("_to")).drop("_to")
        edges = scratch.write(named(named(edges, "u"), "v").where("u <> v").select(*by, "u", "v", "w"), f"contract-edges-{step}")
        alive = got.where("what = 2").select(*by, F.col("a").alias("node"), "size", "big")
        nodes = scratch.write(alive.join(nodes.select(*by, "node", "x", "y"), [*by, "node"]), f"contract-nodes-{step}")
        tiles, step = max(1, tiles // 4), step + 1
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    return union(joined), union(merges)


def _named(f, n: int):
    """A cogroup function that is given the first n values of the key."""
    return lambda key, a, b: f(key[:n], a, b)


# -- the condensed tree


def _lambda(w: np.ndarray) -> np.ndarray:
    return 1 / np.maximum(w, LEAST_WEIGHT)


def merge_tree(seeds: list, merges: pd.DataFrame) -> pd.DataFrame:
    """(node, parent, w, seed, depth) of a group's merges of large components: leaves (w = 0) are seeds in order, parent -1 is the root's."""
    at = {s: k for k, s in enumerate(seeds)}
    top, formed, parent = list(range(len(seeds))), [0.0] * len(seeds), [-1] * len(seeds)
    comp = list(range(len(seeds)))

    def root(x: int) -> int:
        while comp[x] != x:
            comp[x] = x = comp[comp[x]]
        return x

    for w, level in merges.sort_values("w", kind="stable").groupby("w", sort=True):
        under: dict[int, set[int]] = {}
        for a, b in zip(level["a"], level["b"]):
            x, y = root(at[a]), root(at[b])
            if x != y:
                both = under.pop(x, {top[x]}) | under.pop(y, {top[y]})
                comp[max(x, y)] = min(x, y)
                under[min(x, y)] = both
        for x, children in under.items():
            parent.append(-1)
            formed.append(float(w))
            for c in children:
                parent[c] = len(parent) - 1
            top[x] = len(parent) - 1
    depth = [0] * len(parent)
    for k in range(len(parent) - 1, -1, -1):
        depth[k] = 0 if parent[k] < 0 else depth[parent[k]] + 1
    return pd.DataFrame({"node": range(len(parent)), "parent": parent, "w": formed, "seed": np.array([*seeds, *[None] * (len(parent) - len(seeds))], object), "depth": depth})


def excess_of_mass(tree: pd.DataFrame, single: bool = False) -> np.ndarray:
    """The cluster of every node of a tree(node, parent, w, n, mass), -1 for none: n and mass are the points that leave the node, and the sum of their 1 / weight.

    ``single``: whether the root may be a cluster.
    """
    tree = tree.sort_values("node")
    parent, w = tree["parent"].to_numpy(), tree["w"].to_numpy()
    n, mass = tree["n"].to_numpy().astype(float), tree["mass"].to_numpy().astype(float)
    size, best, chosen = n.copy(), np.zeros(len(n)), np.zeros(len(n), bool)
    children: list[list[int]] = [[] for _ in n]
    for k, p in enumerate(parent):  # children come before their parents
        if p >= 0:
            children[p].append(k)
    for k in range(len(n)):
        below = children[k]
        size[k] = n[k] + sum(size[c] for c in below)
        birth = _lambda(w[parent[k]]) if parent[k] >= 0 else 0.0
        stability = mass[k] + sum(size[c] for c in below) * (_lambda(w[k]) if below else 0.0) - size[k] * birth
        inner = sum(best[c] for c in below)
        root = parent[k] < 0
        chosen[k] = (not below or stability >= inner) and (single or not root)
        best[k] = stability if chosen[k] else inner
    label = np.full(len(n), -1)
    for k in range(len(n) - 1, -1, -1):  # parents come after their children
        up = label[parent[k]] if parent[k] >= 0 else -1
        label[k] = up if up >= 0 else k if chosen[k] else -1
    return label


def hdbscan(df: DataFrame, key: str, x: str, y: str, by: Sequence[str] = (), min_cluster_size: int = 50, min_samples: int = 10, label: str = "cluster", single: bool = False, most: int = BLOCK, most_edges: int = MOST_EDGES) -> DataFrame:
    """The rows of df with ``label``: the cluster's number in its group, from 0, or -1 for noise.

    The key must be unique over all groups; a column that has the label's name is replaced.  Clusters are numbered by their smallest seed, which is
    the smallest key of a first component of ``min_cluster_size`` points.  Rows
    without coordinates, groups under ``min_cluster_size`` rows and, unless ``single``,
    groups that never split are noise.  Weights under 1e-9 count as 1e-9.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "hdbscan")
    xy = [F.col(c).cast("double") for c in (x, y)]
    # One group as a column, so that every step has a group to deal by.
    groups = list(by) or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    given = base.where(~(xy[0].isNull() | xy[1].isNull() | F.isnan(xy[0]) | F.isnan(xy[1])))
    points = scratch.write(given.select(key, *groups, xy[0].alias("_x"), xy[1].alias("_y")), "points")
    points = scratch.write(core_distances(points, min_samples, key, groups, scratch, most), "cores")
    tree = scratch.write(reachability_tree(points, key, groups, scratch, most, most_edges), "tree")
    joined, merges = (scratch.write(t, n) for t, n in zip(contracted(tree, points, min_cluster_size, key, groups, scratch, most_edges), ("joined", "merges")))
    kinds = [points.schema[c] for c in groups]
    nodes = T.StructType([*kinds, T.StructField("node", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("w", T.DoubleType()), T.StructField("seed", points.schema[key].dataType), T.StructField("depth", T.LongType())])

    def shape(names: tuple, seeds: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        out = merge_tree(sorted(seeds["seed"]), met)
        for c, v in zip(groups, names):
            out[c] = np.full(len(out), v, object)
        return out[nodes.names]

    seeds = joined.select(*groups, "seed").distinct()
    shaped = scratch.write(seeds.groupBy(*groups).cogroup(merges.groupBy(*groups)).applyInPandas(shape, nodes), "nodes")
    deepest = shaped.agg(F.max("depth")).first()[0] or 0
    # Every point leaves the highest node that was formed at or under its weight: climbed by powers of two.
    up = shaped.select(*groups, "node", F.col("parent").alias("up")).join(shaped.select(*groups, F.col("node").alias("up"), F.col("w").alias("up_w")), [*groups, "up"])
    lifts = [scratch.write(up.select(*groups, "node", "up", "up_w"), "lift-0")]
    while 2 ** len(lifts) <= deepest:
        last = lifts[-1]
        lifts.append(scratch.write(last.select(*groups, "node", F.col("up").alias("mid")).join(last.select(*groups, F.col("node").alias("mid"), "up", "up_w"), [*groups, "mid"]).select(*groups, "node", "up", "up_w"), f"lift-{len(lifts)}"))
    placed = joined.join(shaped.where("seed is not null").select(*groups, "seed", "node"), [*groups, "seed"]).select(*groups, key, "w", "node")
    for k, lift in reversed(list(enumerate(lifts))):
        climbed = placed.join(lift, [*groups, "node"], "left")
        placed = climbed.select(*groups, key, "w", F.when(F.col("up_w") <= F.col("w"), F.col("up")).otherwise(F.col("node")).alias("node"))
    placed = scratch.write(placed, "placed")
    left = placed.groupBy(*groups, "node").agg(F.count(F.lit(1)).alias("n"), F.sum(1 / F.greatest("w", F.lit(LEAST_WEIGHT))).alias("mass"))
    filled = shaped.join(left, [*groups, "node"], "left").fillna({"n": 0, "mass": 0.0})
    clusters = T.StructType([*kinds, T.StructField("node", T.LongType()), T.StructField(label, T.IntegerType())])

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node", ignore_index=True)
        own = excess_of_mass(g, single)
        leaf = g["seed"].notna().to_numpy()
        first = pd.Series(g["node"].to_numpy()[leaf]).groupby(own[leaf]).min()  # leaves are in the order of seeds
        number = {c: k for k, c in enumerate(first[first.index >= 0].sort_values().index)}
        return pd.DataFrame({c: g[c] for c in groups} | {"node": g["node"], label: np.array([number.get(c, -1) for c in own], np.int32)})

    named = filled.groupBy(*groups).applyInPandas(choose, clusters)
    done = placed.join(named, [*groups, "node"]).select(key, label)
    return df.drop(label).join(done, key, "left").withColumn(label, F.coalesce(label, F.lit(-1)))
