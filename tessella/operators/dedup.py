"""Spatial de-duplication: both rules are greedy in a total order, in which a point falls to one that stands.

Whether a point stands depends on few points around it.  So points are dealt to
tiles with a border of several radii, and each tile decides what its own points
allow: one falls that has a sure winner within reach, one stands whose rivals have
all surely fallen and whose reach lies inside the tile and its border; that takes
one shuffle.  The few whose chains of rivals lead out of the tile, and tiles with
very many points, go on as a small edge table: connected groups of edges don't
influence one another, so groups of bounded size are dealt to tasks, many side by
side, and only larger ones take rounds of written tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.graph import connected_components
from tessella.operators.spatial import radius_join
from tessella.scratch import Scratch


#: Passes over all edges before the rest is walked node by node.
PASSES = 32


def _falling(edges: pd.DataFrame) -> pd.DataFrame:
    """The nodes that fall in whole groups of edges: passes settle short chains, one walk in order the long ones."""
    nodes, at = np.unique(np.concatenate([edges["hi"].to_numpy(), edges["lo"].to_numpy()]), return_inverse=True)
    hi, lo = at[: len(edges)], at[len(edges) :]
    down = np.zeros(len(nodes), bool)
    for _ in range(PASSES):
        if not len(hi):
            break
        below = np.zeros(len(nodes), bool)
        below[lo] = True
        down[lo[~below[hi]]] = True
        left = below[hi] & ~down[hi] & ~down[lo]
        hi, lo = hi[left], lo[left]
    if len(hi):
        order = np.argsort(hi, kind="stable")
        under = lo[order].tolist()
        starts = np.searchsorted(hi[order], np.arange(len(nodes) + 1)).tolist()
        rivals, fell = np.bincount(lo, minlength=len(nodes)).tolist(), down.tolist()
        todo = [k for k in np.unique(hi).tolist() if not rivals[k]]
        while todo:
            top = todo.pop()
            for k in under[starts[top] : starts[top + 1]]:
                if not fell[k]:
                    fell[k] = True
                    for n in under[starts[k] : starts[k + 1]]:
                        rivals[n] -= 1
                        if not rivals[n] and not fell[n]:
                            todo.append(n)
        down = np.array(fell)
    return pd.DataFrame({"id": nodes[down]})


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches come sorted by group; the last group of a batch may go on in the next one."""
    held = None
    for rows in batches:
        if not len(rows):
            continue
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        whole = rows["group"] != rows["group"].iloc[-1]
        if whole.any():
            yield _falling(rows[whole])
        held = rows[~whole]
    if held is not None:
        yield _falling(held)


def dominated(edges: DataFrame, scratch: Scratch, most_edges: int = 1 << 20) -> DataFrame:
    """(id) of the nodes that fall: a node falls when one that stands has an edge (hi, lo) to it.

    Edges follow a total order, so they have no cycles.  ``most_edges`` bounds the group that one task holds.
    """
    own = scratch.write(edges.select("hi", "lo").distinct(), "edges")
    a, b = F.xxhash64("hi"), F.xxhash64("lo")  # equal hashes only put two groups into one
    groups = connected_components(own.select(a.alias("a"), b.alias("b")), scratch, "groups").toDF("_node", "_comp")
    tagged = scratch.write(own.join(groups, a == F.col("_node"), "left").select("hi", "lo", F.coalesce("_comp", a).alias("group")), "grouped")
    sized = tagged.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    small = tagged.join(sized.where(F.col("_n") <= most_edges).select("group"), "group", "left_semi")
    kind = edges.schema["lo"].dataType.simpleString()
    fallen = scratch.write(small.repartition("group").sortWithinPartitions("group").mapInPandas(_settle, f"id {kind}"), "fallen")
    large = tagged.join(sized.where(F.col("_n") > most_edges).select("group"), "group", "left_semi")
    return _by_rounds(large.select("hi", "lo"), fallen, scratch)


def _by_rounds(edges: DataFrame, fallen: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds the nodes that fall by ``edges`` to ``fallen``; every round settles a node at least."""
    now = scratch.write(edges, "edges-0")
    for k in count(1):
        if now.isEmpty():
            return fallen
        top = now.select(F.col("hi").alias("id")).distinct().join(now.select(F.col("lo").alias("id")), "id", "left_anti")
        top = scratch.write(top, f"top-{k}")
        down = scratch.write(now.join(top, now["hi"] == top["id"], "left_semi").select(F.col("lo").alias("id")).distinct(), f"down-{k}")
        fallen = fallen.unionByName(down)
        gone = top.unionByName(down)
        left = now.join(gone, now["hi"] == gone["id"], "left_anti").join(down, now["lo"] == down["id"], "left_anti")
        now = scratch.write(left, f"edges-{k}")
        scratch.drop(f"edges-{k - 1}")


# -- tiles

#: Tile and border widths in radii, and points of a tile with its border that one task decides.
TILE, BORDER, MOST = 24, 6, 100_000
#: Times MOST that a tile may hold whose points are settled by cells, and passes over what stays open, each with tiles twice as wide.
BY_CELLS, WIDER = 40, 2
#: Points that a tile should have on average, over all groups, where radii are short.
FILL = 20_000
#: Pairs that are measured at once, pairs of a tile's open points that are kept, and cells of a tile.
PAIRS, KEPT, CELLS = 1 << 21, 1 << 24, 1 << 24


def _pairs(x: np.ndarray, y: np.ndarray, r: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, d2) of pairs in cells of r that touch, a slice at a time, each pair both ways."""
    cx, cy = (np.floor(c / r).astype(np.int64) for c in (x, y))
    width = int(cx.max() - cx.min()) + 3
    code = (cy - cy.min() + 1) * width + cx - cx.min() + 1
    order = np.argsort(code, kind="stable")
    ordered = code[order]
    for row in (-1, 0, 1):
        lo, hi = np.searchsorted(ordered, code + row * width - 1, "left"), np.searchsorted(ordered, code + row * width + 1, "right")
        ends = np.cumsum(hi - lo)
        at = 0
        while at < len(x):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            n = (hi - lo)[at:stop]
            i = np.repeat(np.arange(at, stop), n)
            j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:stop], n)]
            yield i, j, (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2
            at = stop


def _decided(hi: np.ndarray, lo: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 for nodes that surely stand, -1 for those that surely fall, 0 for others; only ``whole`` nodes have all their rivals among the edges."""
    state = np.zeros(len(whole), np.int8)
    while True:
        rivals = np.zeros(len(whole), bool)
        rivals[lo] = True
        up = (state == 0) & whole & ~rivals
        state[up] = 1
        down = lo[state[hi] == 1]
        state[down] = -1
        if not up.any() and not len(down):
            return state
        left = (state[hi] == 0) & (state[lo] == 0)
        hi, lo = hi[left], lo[left]


def _boxes(x: np.ndarray, y: np.ndarray, r: float, level: np.ndarray | None) -> tuple[np.ndarray, int, list[int]]:
    """(box of each point, number of boxes, offsets of the boxes that hold all within r, own and near ones first): cells whose diagonal is r, by level.

    With levels, rivals that outweigh a point are at its own level or the next one.
    """
    side = r / 2**0.5 * (1 - 1e-9)
    cx, cy = (np.floor(c / side).astype(np.int64) for c in (x, y))
    width, height = int(cx.max() - cx.min()) + 5, int(cy.max() - cy.min()) + 5
    code = (cy - cy.min() + 2) * width + cx - cx.min() + 2
    cells = sorted(((dy, dx) for dy in range(-2, 3) for dx in range(-2, 3)), key=lambda c: c[0] ** 2 + c[1] ** 2)
    around = [dy * width + dx for dy, dx in cells]
    if level is None:
        return code, width * height, around
    plane = width * height
    return (level - level.min()) * plane + code, plane * (int(level.max() - level.min()) + 2), [o + up * plane for o in around for up in (0, 1)]


def _settled(x: np.ndarray, y: np.ndarray, rank: np.ndarray, whole: np.ndarray, r: float, level: np.ndarray | None = None, beats: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """States as of ``_decided`` where the lower rank wins, without pairs.

    Of a cell whose diagonal is r one point stands at most (with levels: of a cell's
    points of one level, those that outweigh all standing before them).  A cell's first open
    point stands if it precedes the first ones of the cells around; what it ``beats``
    (by default: within its radius) falls.  That settles dense tiles in time that grows with their points.
    Points of a negative level have no rivals.
    """
    state = np.zeros(len(x), np.int8)
    if level is not None:
        state[level < 0] = 1
    order = np.argsort(rank)
    live = order[state[order] == 0]
    if not len(live):
        return state
    code, size = np.zeros(len(x), np.int64), 0
    code[live], size, around = _boxes(x[live], y[live], r, None if level is None else level[live])
    if size > CELLS:  # far fewer points than cells: pairs are few
        return state
    while len(live):
        first = np.full(size, len(x))
        first[code[live[::-1]]] = rank[live[::-1]]
        cells = np.flatnonzero(first < len(x))
        ahead = np.ones(len(cells), bool)
        for o in around:
            ahead &= first[cells + o] >= first[cells]
        up = order[first[cells[ahead]]]
        up = up[whole[up]]
        if not len(up):
            break
        stands = np.full(size, -1)
        stands[code[up]] = up
        at, down = code[live], np.zeros(len(live), bool)
        for o in around:
            by = stands[at + o]
            near = np.flatnonzero(by >= 0)
            a, b = live[near], by[near]
            d2 = (x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2
            down[near] |= d2 <= r * r if beats is None else beats(b, a, d2)
        state[live[down]] = -1
        state[up] = 1
        live = live[state[live] == 0]
    return state


def _pair_count(x: np.ndarray, y: np.ndarray, r: float) -> int:
    """About as many pairs as ``_pairs`` would measure."""
    if not len(x):
        return 0
    cx, cy = (np.floor(c / r).astype(np.int64) for c in (x, y))
    _, n = np.unique((cy - cy.min()) * (int(cx.max() - cx.min()) + 1) + cx - cx.min(), return_counts=True)
    return 9 * int((n.astype(np.int64) ** 2).sum())


def _room(points: DataFrame, x: str, y: str) -> float:
    """The width of tiles that hold FILL points on average."""
    one = points.agg(F.count(F.lit(1)).alias("n"), (F.max(x) - F.min(x)).alias("w"), (F.max(y) - F.min(y)).alias("h")).first()
    return (FILL * float(one["w"]) * float(one["h"]) / one["n"]) ** 0.5 if one["w"] is not None and one["h"] is not None else 0.0


def _statuses(points: DataFrame, r: float, key: str, by: Sequence[str], x: str, y: str, values: dict[str, Column], beats: Callable[[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray], np.ndarray], ranks: Callable[[pd.DataFrame], np.ndarray], levels: Callable[[pd.DataFrame], np.ndarray] | None = None, wide: int = 1) -> DataFrame:
    """(key, stands) of every point, null where its tile can't tell; ``beats`` says for which pairs (rows, i, j, d2) the first is a rival of the second.

    ``ranks``: each row's place in the order, by which dense tiles are settled by cells first.  ``levels``: of rules where not
    any two points within r are rivals, each row's level, as ``_settled`` takes it.
    ``wide`` multiplies the widths of tiles and borders.
    """
    edge, border = max(wide * TILE * r, _room(points, x, y)), wide * BORDER * r
    base = points.select(key, *by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), *[v.alias(c) for c, v in values.items()])
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - border) / edge), F.floor((F.col(c) + border) / edge)))
    placed = base.withColumn("_tx", spread("_x")).withColumn("_ty", spread("_y"))
    tile = [*by, "_tx", "_ty"]
    full = placed.groupBy(*tile).count().where(F.col("count") > MOST * BY_CELLS).select(*tile)  # their points stay open
    schema = T.StructType([points.schema[key], T.StructField("stands", T.BooleanType())])

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key, kind="stable", ignore_index=True)
        px, py = g["_x"].to_numpy(), g["_y"].to_numpy()
        x0, y0 = g["_tx"].iloc[0] * edge, g["_ty"].iloc[0] * edge
        home = (px >= x0) & (px < x0 + edge) & (py >= y0) & (py < y0 + edge)
        reach = border - r * (1 + 1e-9)
        whole = (px >= x0 - reach) & (px < x0 + edge + reach) & (py >= y0 - reach) & (py < y0 + edge + reach)
        state = _settled(px, py, ranks(g), whole, r, *([levels(g), lambda i, j, d2: beats(g, i, j, d2)] if levels else []))
        left = np.flatnonzero(state == 0)
        if len(left) and _pair_count(px[left], py[left], r) <= KEPT:
            rest, hi, lo = g.iloc[left].reset_index(drop=True), [], []
            for i, j, d2 in _pairs(px[left], py[left], r):
                won = beats(rest, i, j, d2)
                hi.append(i[won])
                lo.append(j[won])
            state[left] = _decided(np.concatenate(hi), np.concatenate(lo), whole[left])
        state = state[home]
        out = np.full(len(state), None, object)
        out[state > 0], out[state < 0] = True, False
        return pd.DataFrame({key: g[key][home], "stands": out})

    found = placed.join(full, tile, "left_anti").groupBy(*tile).applyInPandas(kernel, schema)
    return points.select(key).join(found, key, "left")


def _by_tiles(own: DataFrame, r: float, key: str, by: Sequence[str], x: str, y: str, values: dict[str, Column], beats: Callable, ranks: Callable, scratch: Scratch, levels: Callable | None = None) -> DataFrame:
    """``_statuses`` by tiles that widen for what stays open."""
    found = scratch.write(_statuses(own, r, key, by, x, y, values, beats, ranks, levels), "tiles-0")
    for k in range(1, WIDER + 1):  # what has fallen decides nothing more; the others are far fewer
        if found.where("stands is null").isEmpty():
            break
        rest = own.join(found.where("coalesce(stands, true)"), key, "left_semi")
        down = found.where("not stands")
        found = scratch.write(down.unionByName(_statuses(rest, r, key, by, x, y, values, beats, ranks, levels, 2**k)), f"tiles-{k}")
    return found


def _fallen(points: DataFrame, decided: DataFrame, key: str, edges: Callable[[DataFrame, DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """(key) of the points that fall: as decided (a written table), or by the edges that undecided ones get from one another and from those that stand."""
    down = decided.where("not stands").select(key)
    open_ = decided.where("stands is null").select(key)
    if open_.isEmpty():
        return down
    left, rivals = (points.join(decided.where(c).select(key), key, "left_semi") for c in ("stands is null", "coalesce(stands, true)"))
    return down.unionByName(dominated(edges(rivals, left), scratch).withColumnRenamed("id", key))


def nms_dedup(points: DataFrame, r: float, key: str, prefer: str, by: Sequence[str], scratch: Scratch, x: str = "x", y: str = "y") -> DataFrame:
    """Keeps a point if no kept one lies within r; larger ``prefer`` first, null last, ties by the smaller key."""
    own = points.select(key, prefer, x, y, *by)
    value = F.col(prefer).cast("double")
    values = {"_p": F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(value), "_class": F.when(value.isNull(), 0).when(F.isnan(value), 2).otherwise(1)}

    def beats(g: pd.DataFrame, i: np.ndarray, j: np.ndarray, d2: np.ndarray) -> np.ndarray:
        p, c = g["_p"].to_numpy(), g["_class"].to_numpy()
        first = (c[i] > c[j]) | ((c[i] == c[j]) & ((p[i] > p[j]) | ((p[i] == p[j]) & (i < j))))  # rows are in key order
        return first & (d2 <= r * r)

    def edges(of: DataFrame, to: DataFrame) -> DataFrame:
        pairs = radius_join(of, to, r, by, x, y)
        l, rr = F.col(f"l_{prefer}"), F.col(f"r_{prefer}")
        first = (l > rr) | (l.isNotNull() & rr.isNull()) | (l.eqNullSafe(rr) & (F.col(f"l_{key}") < F.col(f"r_{key}")))
        return pairs.where(first).select(F.col(f"l_{key}").alias("hi"), F.col(f"r_{key}").alias("lo"))

    def ranks(g: pd.DataFrame) -> np.ndarray:
        out = np.empty(len(g), np.int64)
        out[np.lexsort((np.arange(len(g)), -g["_p"].to_numpy(), -g["_class"].to_numpy()))] = np.arange(len(g))
        return out

    found = _by_tiles(own, r, key, by, x, y, values, beats, ranks, scratch)
    # A table of its own, whose size is known before the join: where few stand, the points with all their columns aren't shuffled.
    stand = found.where("coalesce(stands, true)").select(key).join(_fallen(own, found, key, edges, scratch), key, "left_anti")
    kept = points.join(scratch.write(stand, "standing"), key, "left_semi")
    return kept.unionByName(points.where(F.col(key).isNull()))  # rows without a key fall to none


def pair_dedup(points: DataFrame, r: float, share: float, key: str, area: str, by: Sequence[str], scratch: Scratch, x: str = "x", y: str = "y") -> DataFrame:
    """Of two points nearer than r whose areas' ratio exceeds ``share`` the smaller goes (ties: the later key).

    Points are visited in key order; a visited point that still stands removes
    smaller later duplicates and is itself removed by larger ones that stand.
    """
    own = points.select(key, area, x, y, *by)
    values = {"_a": F.col(area).cast("double")}

    def alike(a: np.ndarray, i: np.ndarray, j: np.ndarray, d2: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (np.minimum(a[i], a[j]) / np.maximum(a[i], a[j]) > share) & (d2 < r * r)

    def beats(g: pd.DataFrame, i: np.ndarray, j: np.ndarray, d2: np.ndarray) -> np.ndarray:
        a = g["_a"].to_numpy()
        return (i < j) & (a[i] >= a[j]) & alike(a, i, j, d2)

    def edges(of: DataFrame, to: DataFrame) -> DataFrame:
        l, rr = F.col(f"l_{area}"), F.col(f"r_{area}")
        near = radius_join(of, to, r, by, x, y).where((F.col("d2") < r * r) & (F.col(f"l_{key}") < F.col(f"r_{key}")) & (l >= rr))
        return near.where(F.least(l, rr) / F.nullif(F.greatest(l, rr), F.lit(0)) > share).select(F.col(f"l_{key}").alias("hi"), F.col(f"r_{key}").alias("lo"))

    def levels(g: pd.DataFrame) -> np.ndarray:
        return _levels(g["_a"].to_numpy(), share)

    ranks = lambda g: np.arange(len(g))  # noqa: E731 - rows are in key order
    found = _by_tiles(own, r, key, by, x, y, values, beats, ranks, scratch, levels)
    idle = scratch.write(_fallen(own, found, key, edges, scratch).select(key), "idle")
    # What the points that stand remove: a tile's own points need the later ones within r, and those the ones within r that removed them.
    edge, border = max(TILE / 2 * r, _room(own, x, y)), 2 * r * (1 + 1e-9)
    marked = own.join(idle.withColumn("_idle", F.lit(True)), key, "left").select(key, *by, F.coalesce("_idle", F.lit(False)).alias("_idle"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), *[v.alias(c) for c, v in values.items()])
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - border) / edge), F.floor((F.col(c) + border) / edge)))
    placed = marked.withColumn("_tx", spread("_x")).withColumn("_ty", spread("_y"))

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key, kind="stable", ignore_index=True)
        px, py, a = (g[c].to_numpy() for c in ("_x", "_y", "_a"))
        x0, y0 = g["_tx"].iloc[0] * edge, g["_ty"].iloc[0] * edge
        home = (px >= x0) & (px < x0 + edge) & (py >= y0) & (py < y0 + edge)
        out = _outweighed(px, py, a, _levels(a, share), g["_idle"].to_numpy(bool), home, r, lambda i, j, d2: alike(a, i, j, d2))
        return pd.DataFrame({key: g[key][out]})

    gone = placed.groupBy(*by, "_tx", "_ty").applyInPandas(kernel, T.StructType([points.schema[key]]))
    return points.join(idle.unionByName(gone), key, "left_anti")


def _levels(a: np.ndarray, share: float) -> np.ndarray:
    """Levels of areas such that a ratio over ``share`` spans no more than two that follow; -1 of areas that are like none."""
    step = 1 / share * (1 + 1e-9) if 0 < share < 1 else 2.0
    level = np.full(len(a), -1, np.int64)
    level[(a < 0) & np.isfinite(a)] = 0
    some = (a > 0) & np.isfinite(a)
    if some.any() and share > 0:
        at = np.floor(np.log(a[some]) / np.log(step)).astype(np.int64)
        level[some] = at - at.min() + 2  # no level follows that of negative ones
    level[some & (level < 0)] = 2
    return level


def _ranges(table: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, at): query i beside each place of the sorted ``table`` that is from low[i] to under high[i], a slice at a time."""
    lo = np.searchsorted(table, low, "left")
    n = np.maximum(np.searchsorted(table, high, "left") - lo, 0)
    some = np.flatnonzero(n)
    lo, n = lo[some], n[some]
    ends, at = np.cumsum(n), 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        m = n[at:stop]
        yield np.repeat(some[at:stop], m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[at:stop], m)
        at = stop


def _outweighed(x: np.ndarray, y: np.ndarray, a: np.ndarray, level: np.ndarray, idle: np.ndarray, home: np.ndarray, r: float, alike: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The home points, among those that aren't idle, that a larger later duplicate removes; points are in key order.

    A duplicate is there until its own visit, or until the first visit of one that stands and removes it.
    Boxes are searched in the order of those visits, so that a point goes through no more than it must.
    """
    out = np.zeros(len(x), bool)
    use = np.flatnonzero(level >= 0)
    if not len(use):
        return out
    n = len(x) + 1
    code = np.zeros(len(x), np.int64)
    code[use], _, around = _boxes(x[use], y[use], r, level[use])
    until = np.arange(len(x))
    up = use[~idle[use]]
    up = up[np.argsort(code[up], kind="stable")]
    table = code[up] * n + up
    seek = use[idle[use]]
    seek = seek[np.argsort(code[seek], kind="stable")]
    for o in around:
        box = (code[seek] + o) * n
        best = until[seek]
        for i, k in _ranges(table, box, box + best):
            p, q = up[k], seek[i]
            hit = (a[p] >= a[q]) & alike(p, q, (x[p] - x[q]) ** 2 + (y[p] - y[q]) ** 2)
            np.minimum.at(best, i[hit], p[hit])
        until[seek] = best
    there = use[np.argsort(code[use] * n + (n - 1 - until[use]), kind="stable")]
    table = code[there] * n + (n - 1 - until[there])
    open_ = up[home[up]]
    for o in around:
        box = (code[open_] + o) * n
        fell = np.zeros(len(open_), bool)
        for i, k in _ranges(table, box, box + (n - 1 - open_)):
            p, q = open_[i], there[k]
            fell[i[(a[q] > a[p]) & alike(p, q, (x[p] - x[q]) ** 2 + (y[p] - y[q]) ** 2)]] = True
        out[open_[fell]] = True
        open_ = open_[~fell]
    return out
