"""Sums, order statistics and nearest points of balls in one tile, without going through all pairs.

Points are sorted by small cells.  For every row of cells a ball holds a run of
whole cells, whose sum is a difference of two running sums, and a few cells at its
border, whose points are measured.  The cells' width follows from the density, so a
query costs about r times the root of the density, not r squared times the density.
Points at one place count as one.  Where places are whole numbers and so dense that even
this is more, sums come from a convolution of the lattice with the ball, block by
block, whose time follows from the area and not from the points.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Pairs that are measured at once, cells of a tile, and points that are ranked directly.
PAIRS, CELLS, LEAF = 1 << 20, 1 << 24, 256
#: Slack, in cells, of what counts as surely inside or outside.
SLACK = 1e-6
#: The widest block of a convolution, and the cost of its sites beside that of a query's steps through cells.
BLOCK, SITE = 4608, 0.15
#: Widths that a fast transform takes.
WIDTHS = np.array(sorted(2**a * 3**b * 5**c for a in range(5, 13) for b in range(4) for c in range(4) if 2**a * 3**b * 5**c <= BLOCK))


def places(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal places together, and where each place starts in it."""
    order = np.lexsort((x, y))
    xs, ys = x[order], y[order]
    return order, np.flatnonzero(np.r_[True, (xs[1:] != xs[:-1]) | (ys[1:] != ys[:-1])][: len(x)])


class _Grid:
    """Points sorted by cells whose width suits their density (``fill`` points a cell, where it is dense), with room around."""

    def __init__(self, qx: np.ndarray, qy: np.ndarray, px: np.ndarray, py: np.ndarray, r: float, fill: float):
        cx, cy = np.floor(px / r).astype(np.int64), np.floor(py / r).astype(np.int64)
        _, n = np.unique((cy - cy.min()) * (int(cx.max() - cx.min()) + 1) + cx - cx.min(), return_counts=True)
        x0, y0 = min(qx.min(), px.min()), min(qy.min(), py.min())
        wide, high = max(qx.max(), px.max()) - x0 + 2 * r, max(qy.max(), py.max()) - y0 + 2 * r
        self.cell = s = min(r, max(r * (fill * n.sum() / (n.astype(float) ** 2).sum()) ** 0.5, (wide * high / CELLS) ** 0.5))
        self.reach = int(r / s) + 2
        self.width = int(wide / s) + 2 * self.reach + 4

        def code(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            column, row = (np.floor((c - c0) / s).astype(np.int64) + self.reach + 1 for c, c0 in ((x, x0), (y, y0)))
            return row * self.width + column

        at = code(px, py)
        self.order = np.argsort(at, kind="stable")
        self.query = code(qx, qy)
        size = self.width * (int(high / s) + 2 * self.reach + 4)
        self.first = np.zeros(size + 1, np.int32)
        np.cumsum(np.bincount(at, minlength=size), out=self.first[1:])


def _spans(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(at, stop, i, j): queries at..stop, a block at a time, each i (from ``at``) beside the j of its range."""
    n = (hi - lo).astype(np.int64)
    ends, at = np.cumsum(n), 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        m = n[at:stop]
        i = np.repeat(np.arange(stop - at), m)
        yield at, stop, i, np.arange(len(i)) + np.repeat(lo[at:stop] - (np.cumsum(m) - m), m)
        at = stop


def ball_sums(qx: np.ndarray, qy: np.ndarray, px: np.ndarray, py: np.ndarray, weights: Sequence[np.ndarray | None], r: float) -> np.ndarray:
    """For each weight (None: 1) its sum over the points of each query's closed ball."""
    out = np.zeros((len(weights), len(qx)))
    if not len(qx) or not len(px):
        return out
    one, starts = places(px, py)
    summed = [np.diff(np.r_[starts, len(px)]).astype(float) if w is None else np.add.reduceat(w[one], starts) for w in weights]
    px, py = px[one[starts]], py[one[starts]]
    if _lattice(qx, qy, px, py, summed, r):
        return _convolved(qx, qy, px, py, summed, r)
    grid = _Grid(qx, qy, px, py, r, 0.4)
    s, first = grid.cell, grid.first
    px, py, summed = px[grid.order], py[grid.order], [w[grid.order] for w in summed]
    running = [np.r_[0.0, np.cumsum(w)] for w in summed]
    by_cell = np.argsort(grid.query, kind="stable")
    x, y = qx[by_cell], qy[by_cell]
    cells, of = np.unique(grid.query[by_cell], return_inverse=True)
    inner, found = np.zeros((len(weights), len(cells))), np.zeros_like(out)
    for dy in range(-grid.reach, grid.reach + 1):
        low, high = max(0, abs(dy) - 1) * s, (abs(dy) + 1) * s
        if low > r:
            continue
        outer = int((r * r - low * low) ** 0.5 / s + SLACK) + 1
        whole = int(np.floor((r * r - high * high) ** 0.5 / s - SLACK)) - 1 if high < r else -1
        row = cells + dy * grid.width
        pieces = [(-outer, outer + 1)]
        if whole >= 0:
            a, b = first[row - whole], first[row + whole + 1]
            for k, total in enumerate(running):
                inner[k] += total[b] - total[a]
            pieces = [(-outer, -whole), (whole + 1, outer + 1)]
        for left, right in pieces:
            for at, stop, i, j in _spans(first[row + left][of], first[row + right][of]):
                hit = (x[at:stop][i] - px[j]) ** 2 + (y[at:stop][i] - py[j]) ** 2 <= r * r
                i, j = i[hit], j[hit]
                for k, w in enumerate(summed):
                    found[k, at:stop] += np.bincount(i, w[j], stop - at)
    out[:, by_cell] = found + inner[:, of]
    return out


def _blocks(x: np.ndarray, y: np.ndarray, r: float) -> tuple[int, int, np.ndarray]:
    """(width, inner width, block of each query) of blocks that suit the queries' extent; width 0 where the radius is too long."""
    most = BLOCK - 2 * int(r)
    if r < 1 or most < BLOCK // 4:
        return 0, 0, np.zeros(0, np.int64)
    extent = max(x.max() - x.min(), y.max() - y.min()) + 1
    width = int(WIDTHS[np.searchsorted(WIDTHS, np.ceil(extent / np.ceil(extent / most)) + 2 * int(r))])
    inner = width - 2 * int(r)
    bx, by = (np.floor((c - c.min()) / inner).astype(np.int64) for c in (x, y))
    return width, inner, by * (int(bx.max()) + 1) + bx


def _lattice(qx: np.ndarray, qy: np.ndarray, px: np.ndarray, py: np.ndarray, summed: list[np.ndarray], r: float) -> bool:
    """Whether all places are whole numbers, and a convolution takes less time than the cells and tells sums of whole numbers apart."""
    width, _, block = _blocks(qx, qy, r)
    if not width:
        return False
    blocks = len(np.unique(block))
    area = max((px.max() - px.min() + 1) * (py.max() - py.min() + 1), 1.0)
    steps = len(qx) * (8 + r * (len(px) / area) ** 0.5)  # places that lie in clusters are denser still
    if steps * (2 + len(summed)) / 3 < SITE * blocks * width**2 * (1 + 2 * len(summed)) / 3:
        return False
    if not all(2e-15 * r * float(np.linalg.norm(w)) < (0.1 if (w == np.rint(w)).all() else np.inf) for w in summed):
        return False
    return all(bool((c == np.rint(c)).all()) and float(np.abs(c).max()) < 2**52 for c in (qx, qy, px, py))


def _convolved(qx: np.ndarray, qy: np.ndarray, px: np.ndarray, py: np.ndarray, summed: list[np.ndarray], r: float) -> np.ndarray:
    """``ball_sums`` of places that are whole numbers: each block's queries read the block's convolution; sums of whole numbers are rounded to such."""
    out = np.zeros((len(summed), len(qx)))
    (width, inner, code), reach = _blocks(qx, qy, r), int(r)
    across = int((qx.max() - qx.min()) // inner) + 1
    d = np.minimum(np.arange(width), width - np.arange(width)).astype(float)
    ball = np.fft.rfft2((d[:, None] ** 2 + d**2 <= r * r).astype(float)).real.copy()  # symmetric, so its transform is real
    whole = [bool((w == np.rint(w)).all()) for w in summed]
    order = np.argsort(code, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(code[order])) + 1)
    row = np.argsort(py, kind="stable")
    ys = py[row]
    for part in parts:
        x0, y0 = (c.min() + b * inner - reach for c, b in ((qx, code[part[0]] % across), (qy, code[part[0]] // across)))
        near = row[np.searchsorted(ys, y0, "left") : np.searchsorted(ys, y0 + width, "left")]
        near = near[(px[near] >= x0) & (px[near] < x0 + width)]
        site = ((py[near] - y0) * width + px[near] - x0).astype(np.int64)
        at = (qy[part] - y0).astype(np.int64), (qx[part] - x0).astype(np.int64)
        for k, w in enumerate(summed):
            table = np.bincount(site, w[near], width * width).reshape(width, width)
            found = np.fft.rfft2(table)
            del table
            found *= ball
            got = np.fft.irfft2(found, (width, width))[at]
            out[k, part] = np.rint(got) if whole[k] else got
    return out


def ball_kth(qx: np.ndarray, qy: np.ndarray, k: np.ndarray, px: np.ndarray, py: np.ndarray, v: np.ndarray, r: float) -> np.ndarray:
    """The k-th smallest value (from 1) of each query's ball: the values' range is halved, and each query goes on in one half."""
    out = np.full(len(qx), np.nan)
    by_value = np.argsort(v, kind="stable")
    todo = [(0, len(v), np.arange(len(qx)), k.astype(float))]
    while todo:
        lo, hi, q, k = todo.pop()
        if not len(q):
            continue
        near = by_value[lo:hi]
        if v[near[0]] == v[near[-1]]:
            out[q] = v[near[0]]
        elif hi - lo <= LEAF:
            for at in range(0, len(q), PAIRS // LEAF):
                part = q[at : at + PAIRS // LEAF]
                seen = np.cumsum((qx[part, None] - px[near]) ** 2 + (qy[part, None] - py[near]) ** 2 <= r * r, axis=1)
                out[part] = v[near[np.argmax(seen >= k[at : at + PAIRS // LEAF, None], axis=1)]]
        else:
            mid = (lo + hi) // 2
            below = ball_sums(qx[q], qy[q], px[by_value[lo:mid]], py[by_value[lo:mid]], [None], r)[0]
            left = k <= below
            todo += [(lo, mid, q[left], k[left]), (mid, hi, q[~left], (k - below)[~left])]
    return out


def ball_nearest(qx: np.ndarray, qy: np.ndarray, px: np.ndarray, py: np.ndarray, r: float, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """(index, d2) of each query's nearest point within r (nearer than r, if ``strict``), of equally near ones the first; -1 without one."""
    best, which = np.full(len(qx), np.inf), np.full(len(qx), -1, np.int64)
    if not len(qx) or not len(px):
        return which, best
    one, starts = places(px, py)  # stable, so a place's first point comes first
    point = one[starts]
    grid = _Grid(qx, qy, px[point], py[point], r, 2.0)
    point = point[grid.order]
    x, y = px[point], py[point]
    todo, k = np.argsort(grid.query, kind="stable"), 1
    while len(todo):
        for dy in range(-k, k + 1):
            row = grid.query[todo] + dy * grid.width
            for at, stop, i, j in _spans(grid.first[row - k], grid.first[row + k + 1]):
                if not len(i):
                    continue
                part = todo[at:stop]
                d2 = (qx[part][i] - x[j]) ** 2 + (qy[part][i] - y[j]) ** 2
                begin = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                least = np.minimum.reduceat(d2, begin)
                tied = d2 == np.repeat(least, np.diff(np.r_[begin, len(i)]))
                index = np.minimum.reduceat(np.where(tied, point[j], len(px)), begin)
                q = part[i[begin]]
                better = (least < best[q]) | ((least == best[q]) & (index < which[q]))
                best[q[better]], which[q[better]] = least[better], index[better]
        if k >= grid.reach:
            break
        todo = todo[best[todo] >= (k * grid.cell * (1 - SLACK)) ** 2]  # nothing outside is as near
        k = min(2 * k, grid.reach)
    out = (best >= r * r) if strict else (best > r * r)
    best[out], which[out] = np.inf, -1
    return which, best
