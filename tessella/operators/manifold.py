"""Layout of feature rows in the plane from a fuzzy neighbour graph (UMAP), as distributed tables.

1. ``neighbour_graph``: rows are dealt to cells around random pivots, several
   times over, until a cell has a bounded number of rows; neighbours within cells
   are exact, and rounds of neighbour descent look at neighbours' neighbours.
2. ``fuzzy_edges``: each row's distances become memberships with its own offset and
   width, and the two directions of an edge are united.
3. ``umap``: cells of rows move by their edges and by rows drawn from the whole
   table; within a round the rows of other cells stand still, between rounds all
   positions are exchanged through a written table.

A task holds one cell, its edges and a sample of positions of fixed size.  All
draws are by hash of key and seed, so a layout depends on the data and the seed
alone, not on partitions or batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.ml import assemble
from tessella.scratch import Scratch

#: Rows of a cell, and pivots that split a larger one.
CELL, PIVOTS = 1024, 32
#: Rows that draw and push apart, and rows that meet a cell's pivots in one task.
POOL, CHUNK = 2048, 20_000
#: Numbers in all pivots that are broadcast; cells that need more meet theirs in a shuffle.
SENT = 1 << 21


def _hash(key: str, *more: int) -> Column:
    return F.xxhash64(F.col(key), *[F.lit(m) for m in more])


def _matrix(arrays: pd.Series) -> np.ndarray:
    return np.array(arrays.tolist(), float)


def _nearest_pivots(x: np.ndarray, p: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The nearest pivot of each row; rows as near to several are spread over them by hash, so that copies don't stay one cell."""
    d = (p**2).sum(axis=1) - 2 * x @ p.T
    at = d.argmin(axis=1)
    tied = np.isclose(d, d.min(axis=1, keepdims=True), rtol=0, atol=1e-12 * max(1.0, float(np.abs(d).max())))
    for i in np.flatnonzero(tied.sum(axis=1) > 1):
        own = np.flatnonzero(tied[i])
        at[i] = own[h[i] % len(own)]
    return at


def _by_pivots(data: DataFrame, key: str, levels: Sequence, seed: int) -> DataFrame:
    """data(key, _a) with ``_cell`` after some levels of broadcast pivots (a map of cells to pivots each); nothing is shuffled."""
    schema = T.StructType([*data.schema, T.StructField("_cell", T.LongType())])

    def run(batches):
        for b in batches:
            cell = np.zeros(b.num_rows, np.int64)
            x = b["_a"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            for step, level in enumerate(levels):
                pivots, h = level.value, b[f"_h{step}"].to_numpy()
                order = np.argsort(cell, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else ():
                    p = pivots.get(int(cell[own[0]]))
                    if p is not None:
                        cell[own] = cell[own] * (PIVOTS + 1) + 1 + _nearest_pivots(x[own], p, h[own])
            yield pa.record_batch([b[key], b["_a"], pa.array(cell)], names=[key, "_a", "_cell"])

    return data.withColumns({f"_h{k}": _hash(key, seed, k) for k in range(len(levels))}).mapInArrow(run, schema)


def _pivots(large: DataFrame) -> DataFrame:
    """(_cell, _h, _a): the rows of least hash of each cell of large(_cell, _n, _h, _a), drawn from about eight times as many."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("_h", "_a"))), 1, PIVOTS)
    drawn = large.where(F.abs(F.col("_h") % F.greatest(F.col("_n") / (8 * PIVOTS), F.lit(1)).cast("long")) == 0)
    return drawn.groupBy("_cell").agg(first.alias("_all")).select("_cell", F.inline("_all"))


def cells(data: DataFrame, key: str, scratch: Scratch, name: str, most: int = CELL, seed: int = 42) -> DataFrame:
    """data(key, _a) with ``_cell`` (long): rows around random pivots, cells of at most ``most`` rows or about so where rows are all alike.

    While all pivots have at most ``SENT`` numbers they are broadcast and rows stay where they are; larger tables go on by shuffles.
    """
    spark, levels, sent = data.sparkSession, [], 0
    while True:
        now = _by_pivots(data, key, levels, seed)
        sizes = scratch.write(now.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most), f"{name}-sizes-{len(levels)}")
        n = sizes.count()
        if not n:
            return now
        width = len(data.select("_a").first()["_a"])
        sent += n * PIVOTS * max(1, width)
        if sent > SENT:
            return _cells_by_shuffle(now, key, scratch, name, most, seed, len(levels))
        found: dict = {}
        for r in sorted(_pivots(now.join(F.broadcast(sizes), "_cell").withColumn("_h", _hash(key, seed, len(levels)))).collect(), key=lambda r: r["_h"]):
            found.setdefault(r["_cell"], []).append(r["_a"])
        levels.append(spark.sparkContext.broadcast({c: np.array(p, float) for c, p in found.items()}))


def _cells_by_shuffle(now: DataFrame, key: str, scratch: Scratch, name: str, most: int, seed: int, step: int) -> DataFrame:
    """``cells`` from a table with ``_cell`` on, whose rows meet their cells' pivots in chunks."""
    out, schema = None, T.StructType([*now.schema])

    def nearest_pivot(k: tuple, rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return rows[schema.names]
        at = _nearest_pivots(_matrix(rows["_a"]), _matrix(pivots.sort_values("_h")["_a"]), rows["_h"].to_numpy())
        return rows.assign(_cell=k[0] * (PIVOTS + 1) + 1 + at)[schema.names]

    while True:
        sizes = now.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
        placed = scratch.write(now.join(sizes, "_cell").select(*schema.names, "_n"), f"{name}-sized-{step}")
        done = placed.where(F.col("_n") <= most).drop("_n")
        out = done if out is None else out.unionByName(done)
        large = placed.where(F.col("_n") > most)
        if large.isEmpty():
            return scratch.write(out, name)
        ranked = large.withColumn("_h", _hash(key, seed, step))
        part = ranked.withColumn("_p", F.pmod("_h", F.ceil(F.col("_n") / CHUNK)).cast("int"))
        counts = ranked.select("_cell", F.ceil(F.col("_n") / CHUNK).cast("int").alias("_k")).distinct()
        pivots = scratch.write(_pivots(ranked).join(counts, "_cell").select("_cell", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_p"), "_h", "_a"), f"{name}-pivots-{step}")
        moved = part.select(*schema.names, "_h", "_p").groupBy("_cell", "_p").cogroup(pivots.groupBy("_cell", "_p")).applyInPandas(nearest_pivot, schema)
        now, step = scratch.write(moved, f"{name}-moved-{step}"), step + 1


def _best(pairs: DataFrame, key: str, k: int) -> DataFrame:
    """(key, near: the k nearest (d, id), nearest first) of pairs(key, _id, d), which may repeat."""
    once = pairs.repartition(F.col(key)).groupBy(key, "_id").agg(F.min("d").alias("d"))
    return once.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("d", F.col("_id").alias("id")))), 1, k).alias("near"))


def neighbour_graph(data: DataFrame, key: str, k: int, scratch: Scratch, trees: int = 6, rounds: int = 2, reach: int = 5, most: int = CELL, seed: int = 42) -> DataFrame:
    """(key, near): about the k nearest other rows of data(key, _a) as (d, id), nearest first; ``reach`` neighbours of as many are tried in each round."""
    kind = data.schema[key].dataType
    schema = T.StructType([data.schema[key], T.StructField("_id", kind), T.StructField("d", T.DoubleType())])

    def within(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key, kind="stable")
        x, ids = _matrix(g["_a"]), g[key].to_numpy()
        n = min(k, len(g) - 1)
        d = (x**2).sum(axis=1) - 2 * x @ x.T  # the row's own square doesn't change its order
        np.fill_diagonal(d, np.inf)
        at = np.argpartition(d, n - 1, axis=1)[:, :n] if n else np.zeros((len(g), 0), int)
        row = np.repeat(np.arange(len(g)), n)
        exact = np.sqrt(((x[row] - x[at.ravel()]) ** 2).sum(axis=1))
        return pd.DataFrame({key: ids[row], "_id": ids[at.ravel()], "d": exact})

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.sqrt(((_matrix(a) - _matrix(b)) ** 2).sum(axis=1)) if len(a) else np.zeros(0))

    found = None
    for t in range(trees):
        near = cells(data, key, scratch, f"cells-{t}", most, seed + t).groupBy("_cell").applyInPandas(within, schema)
        found = near if found is None else found.unionByName(near)
    graph = scratch.write(_best(found, key, k), "graph-0")
    for step in range(rounds):
        edges = graph.select(key, F.inline("near").alias("d", "_id")).select(key, "_id", "d")
        short = graph.select(key, F.inline(F.slice("near", 1, reach)).alias("d", "_id")).select(key, "_id")
        both = short.union(short.select("_id", key)).distinct()  # near in either direction
        hops = both.select(F.col(key).alias("_i"), F.col("_id").alias("_j")).join(short.select(F.col(key).alias("_j"), F.col("_id").alias("_l")), "_j")
        new = hops.where("_i <> _l").select(F.col("_i").alias(key), F.col("_l").alias("_id")).distinct().join(edges.select(key, "_id"), [key, "_id"], "left_anti")
        side = lambda c, a: data.select(F.col(key).alias(c), F.col("_a").alias(a))
        tried = new.join(side(key, "_x"), key).join(side("_id", "_y"), "_id").select(key, "_id", distance("_x", "_y").alias("d"))
        graph = scratch.write(_best(edges.unionByName(tried), key, k), f"graph-{step + 1}")
    return graph


def fuzzy_edges(graph: DataFrame, key: str) -> DataFrame:
    """(a, b, w) in both directions: memberships that sum to log2 k over a row's neighbours, united over the two directions."""
    kind = graph.schema[key].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("w", T.DoubleType())])

    def weigh(batches):
        for rows in batches:
            rows = rows[[len(x) > 0 for x in rows["near"]]]
            if not len(rows):
                continue
            n = np.array([len(x) for x in rows["near"]])
            d = np.full((len(rows), n.max()), np.inf)
            for i, x in enumerate(rows["near"]):
                d[i, : len(x)] = [p["d"] for p in x]
            positive = np.where(d > 0, d, np.inf).min(axis=1, keepdims=True)
            rho = np.where(np.isfinite(positive), positive, 0.0)
            over = np.maximum(d - rho, 0)
            low, high, want = np.full((len(d), 1), 1e-9), np.full((len(d), 1), 1e9), np.log2(np.maximum(n, 2))[:, None]
            for _ in range(64):
                mid = np.sqrt(low * high)
                big = np.exp(-over / mid).sum(axis=1, keepdims=True) > want
                high, low = np.where(big, mid, high), np.where(big, low, mid)
            w = np.exp(-over / mid)
            ids = [p["id"] for x in rows["near"] for p in x]
            yield pd.DataFrame({"a": np.repeat(rows[key].to_numpy(), n), "b": ids, "w": w[np.isfinite(d)]})

    one = graph.mapInPandas(weigh, schema)
    pair = one.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("s"), F.product("w").alias("p"), F.count(F.lit(1)).alias("n"))
    both = pair.select("a", "b", F.when(F.col("n") > 1, F.col("s") - F.col("p")).otherwise(F.col("s")).alias("w"))
    return both.union(both.select("b", "a", "w"))


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^(2b)), fitted to 1 up to ``min_dist`` and an exponential fall beyond."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    p = np.array([1.0, 1.0])
    for _ in range(100):  # damped Gauss-Newton steps
        t = d ** (2 * p[1])
        f = 1 / (1 + p[0] * t)
        j = np.stack([-t * f * f, -p[0] * t * 2 * np.log(d) * f * f], axis=1)
        p = np.maximum(p + 0.5 * np.linalg.solve(j.T @ j + 1e-9 * np.eye(2), j.T @ (y - f)), 1e-3)
    return float(p[0]), float(p[1])


def _moved(xy: np.ndarray, own: np.ndarray, row: np.ndarray, other: np.ndarray, w: np.ndarray, pool: np.ndarray, rates: np.ndarray, a: float, b: float, rng: np.random.Generator, pushes: int) -> np.ndarray:
    """The positions of a cell's rows (``own`` of xy) after a step for each rate, the other rows of xy standing still."""
    xy, degree = xy.copy(), np.maximum(np.bincount(row, w, len(own)), 1e-9)[:, None]
    for rate in rates:
        here = xy[own]
        gap = here[row] - xy[other]
        d2 = (gap**2).sum(axis=1) + 1e-12
        pull = (-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b) * w)[:, None] * gap
        move = np.stack([np.bincount(row, pull[:, c], len(own)) for c in (0, 1)], axis=1) / degree
        far = here[:, None] - pool[rng.integers(0, len(pool), (len(own), pushes))]
        f2 = (far**2).sum(axis=2)
        push = np.clip((2 * b / ((0.001 + f2) * (1 + a * f2**b)))[:, :, None] * far, -4, 4)
        push[f2 == 0] = 0  # the row itself, or one in its place
        xy[own] = here + rate * np.clip(move + push.mean(axis=1), -4, 4)
    return xy[own]


def umap(df: DataFrame, columns: Sequence[str], key: str, neighbours: int = 30, min_dist: float = 0.1, components: int | None = None, rounds: int = 10, steps: int = 40, pushes: int = 8, most: int = CELL, seed: int = 42) -> DataFrame:
    """(key, umap_1, umap_2) of every row: a layout of the fuzzy graph of ``neighbours`` nearest rows.

    ``components``: principal components that the distances are taken in, all
    columns where it is None or they are no more.  Rounds of ``steps`` moves each
    start from the first two principal components.  Nulls and NaN count as 0; the
    key must be unique.  A lone row is at its start.
    """
    scratch = Scratch(df.sparkSession, "umap")
    vectors = assemble(df, columns, "_x").select(key, "_x")
    if len(columns) > 1 and df.take(2)[1:]:
        model = PCA(k=min(max(2, components or 2), len(columns)), inputCol="_x", outputCol="_p").fit(vectors)
        vectors = model.transform(vectors).withColumn("_start", F.slice(vector_to_array("_p"), 1, 2))
        vectors = vectors.withColumn("_a", F.transform(vector_to_array("_p"), lambda v: F.round(v, 9)) if components and components < len(columns) else vector_to_array("_x"))
    else:
        vectors = vectors.withColumns({"_a": vector_to_array("_x"), "_start": F.array(F.get(vector_to_array("_x"), F.lit(0)), F.lit(0.0))})
    data = scratch.write(vectors.select(key, "_a", "_start"), "vectors")
    if data.where(F.exists("_a", lambda v: v != v.cast("float").cast("double"))).isEmpty():
        data = data.withColumn("_a", F.col("_a").cast("array<float>"))  # the same numbers in half the bytes
    graph = neighbour_graph(data.select(key, "_a"), key, neighbours, scratch, most=most, seed=seed)
    edges = scratch.write(fuzzy_edges(graph, key), "edges")
    # The start is spread to ten units, with a little noise that parts copies.
    one = data.agg(*[f(F.get("_start", F.lit(c))).alias(f"{n}{c}") for c in (0, 1) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    noise = lambda c: (F.pmod(_hash(key, seed, c), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 1e-2
    wide = max(one["s0"] or 0.0, 1e-12)
    start = [((F.get("_start", F.lit(c)) - F.lit(one[f"m{c}"] or 0.0)) / F.lit(wide) * 5.0 + noise(c)) for c in (0, 1)]
    # Rounded, so that the order of sums doesn't grow into another layout.
    start = [F.round(v, 6).alias(f"umap_{c + 1}") for c, v in enumerate(start)]
    placed = cells(data.select(key, "_a"), key, scratch, "layout-cells", most, seed).select(key, "_cell")
    now = scratch.write(data.join(placed, key).select(key, "_cell", *start), "layout-0")
    a, b = curve(min_dist)
    schema = T.StructType([now.schema[key], *[T.StructField(c, T.LongType() if c == "_cell" else T.DoubleType()) for c in ("_cell", "umap_1", "umap_2")]])
    owners = scratch.write(edges.join(placed.select(F.col(key).alias("a"), "_cell"), "a").select("_cell", "a", "b", "w").repartition("_cell").sortWithinPartitions("_cell", "a", "b"), "cell-edges")
    # Rows of other cells that a cell's edges lead to: a cell gets each one's position once a round.
    asked = owners.select("_cell", F.col("b").alias(key)).distinct().join(placed.select(key, F.col("_cell").alias("_own")), key).where("_cell <> _own")
    asked = scratch.write(asked.groupBy(key).agg(F.collect_list("_cell").alias("_cells")), "asked")

    def mover(round_: int, pool: np.ndarray):
        rates = 1 - (round_ * steps + np.arange(steps)) / (rounds * steps)

        def move(cell: tuple, rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            outside = rows[rows["_out"]].sort_values(key, kind="stable")
            rows = rows[~rows["_out"]].sort_values(key, kind="stable", ignore_index=True)
            near = near.sort_values(["a", "b"], kind="stable")
            at = {v: i for i, v in enumerate([*rows[key], *outside[key]])}
            xy = np.concatenate([g[["umap_1", "umap_2"]].to_numpy(float) for g in (rows, outside)])
            rng = np.random.default_rng([seed, round_, cell[0] % (1 << 32)])
            row, other = (near[c].map(at).to_numpy(np.int64) for c in "ab")
            out = _moved(xy, np.arange(len(rows)), row, other, near["w"].to_numpy(float), pool, rates, a, b, rng, pushes)
            return pd.DataFrame({key: rows[key], "_cell": rows["_cell"], "umap_1": out[:, 0], "umap_2": out[:, 1]})

        return move

    for r in range(rounds):
        # At most ``POOL`` rows by hash, another choice each round.
        pool = np.array([(p["umap_1"], p["umap_2"]) for p in now.orderBy(_hash(key, seed, r), key).limit(POOL).collect()], float)
        if len(pool) < 2:
            break
        beside = now.drop("_cell").join(asked, key).withColumn("_cell", F.explode("_cells")).select(*now.columns, F.lit(True).alias("_out"))
        met = now.withColumn("_out", F.lit(False)).union(beside)
        now = scratch.write(met.groupBy("_cell").cogroup(owners.groupBy("_cell")).applyInPandas(mover(r, pool), schema), f"layout-{r + 1}")
    return now.select(key, "umap_1", "umap_2")
