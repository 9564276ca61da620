"""Hard negatives by a two-dimensional block matrix product.

Scores are the products of an anchor-by-dimension and a row-by-dimension
integer matrix.  Both are cut into blocks of rows and chunks of dimensions.
A block of anchors goes to every block of rows that it meets and the other way
round, under the key (anchor block, row block, chunk); each such cell multiplies
one pair of blocks into a partial tile of int64 scores, and the tiles of a cell's
chunks are shuffled together and added.  Added tiles are reduced at once to the
best few of each anchor, so that no score leaves its tile but those.

Two products are made: anchors against the blocks that may hold their own label
(blocks are cut within groups of labels), which gives the positives and so each
anchor-positive pair's window of scores; then anchors against all blocks, whose
tiles keep the best rows of other labels within each window.

Every block, chunk and tile has a bounded size: blocks are dealt by hash within
a group of labels, into as many as the group's rows ask for, so a label that
holds a third of all rows is more blocks, not larger ones.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.scratch import Scratch


@dataclass(frozen=True)
class NegativeParams:
    """``low`` and ``high``: percent of the positive's score that bound a negative's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    anchor_block: int = 512
    row_block: int = 2048
    chunk: int = 32
    groups: int = 32
    #: Bytes of partial tiles that one partition of a product should hold.
    task_bytes: int = 256 << 20


BLOCK = "block int, chunk int, grp int, ids binary, labels binary, kind string, part binary"
TILE = "i int, j int, chunk int, tile binary, a_ids binary, a_labels binary, b_ids binary, b_labels binary, windows binary"
_WINDOW = np.dtype([("row", "<i4"), ("positive", "<i8"), ("score", "<i8")])


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, q): floor(scale * x) of every component, as longs.

    Rows with a null id, label, vector or component, or a component that isn't
    finite, have no row.  Rows that repeat an id and a label count once, with the
    smallest vector.
    """
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    whole = vectors.where("vec_id is not null and label is not null and embedding is not null").where(~odd)
    q = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return whole.select("vec_id", F.col("label").cast("long").alias("label"), q.alias("q")).groupBy("vec_id", "label").agg(F.min("q").alias("q"))


def _narrow(part: np.ndarray) -> np.ndarray:
    """The values in the smallest integer type that holds them."""
    low, high = (int(part.min()), int(part.max())) if part.size else (0, 0)
    for kind in ("<i2", "<i4"):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return np.ascontiguousarray(part, kind)
    return np.ascontiguousarray(part, "<i8")


def _packed(rows: DataFrame, width: int, p: NegativeParams) -> DataFrame:
    """A row for each block and chunk, its rows in order of (vec_id, label); shorter vectors end in zeros."""
    chunks = max(1, -(-width // p.chunk))

    def pack(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        ids, labels = (block[c].to_numpy().astype("<i8") for c in ("vec_id", "label"))
        order = np.lexsort((labels, ids))
        lists = block["q"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        ends = lists.offsets.to_numpy()
        lengths = np.diff(ends)
        dense = np.zeros((len(ids), chunks * p.chunk), np.int64)
        dense[np.repeat(np.arange(len(ids)), lengths), np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], lengths)] = lists.flatten().to_numpy()
        dense = dense[order]
        parts = [_narrow(dense[:, k * p.chunk : (k + 1) * p.chunk]) for k in range(chunks)]
        one = lambda x: [x] * chunks
        return pa.table(
            {
                "block": pa.array(one(block["block"][0].as_py()), pa.int32()), "chunk": pa.array(range(chunks), pa.int32()), "grp": pa.array(one(block["grp"][0].as_py()), pa.int32()),
                "ids": pa.array([ids[order].tobytes()] + [None] * (chunks - 1), pa.binary()), "labels": pa.array([labels[order].tobytes()] + [None] * (chunks - 1), pa.binary()),
                "kind": pa.array([x.dtype.str for x in parts], pa.string()), "part": pa.array([x.tobytes() for x in parts], pa.binary()),
            }
        )

    return rows.groupBy("block").applyInArrow(pack, BLOCK)


@dataclass(frozen=True)
class _Blocks:
    """Blocks of each group: how many, and the number of the first."""

    count: tuple[int, ...]

    @property
    def first(self) -> tuple[int, ...]:
        return tuple(int(x) for x in np.concatenate([[0], np.cumsum(self.count)[:-1]]))

    @property
    def total(self) -> int:
        return sum(self.count)

    def of(self, grp: Column, key: Column) -> Column:
        return self._at(self.first, grp) + F.pmod(key, self._at(self.count, grp)).cast("int")

    def all_of(self, grp: Column) -> Column:
        """Numbers of a group's blocks; none where it has none."""
        n, first = self._at(self.count, grp), self._at(self.first, grp)
        return F.when(n > 0, F.sequence(first, first + n - 1))

    def every(self) -> Column:
        return F.sequence(F.lit(0), F.lit(self.total - 1))

    @staticmethod
    def _at(values: Sequence[int], grp: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), grp + 1)


def _spread(df: DataFrame, tiles: int, tile_bytes: int, p: NegativeParams, *keys: str) -> DataFrame:
    """Dealt by key into as many partitions as the tiles ask for, and not fewer than the session's."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, min(1 << 17, -(-tiles * tile_bytes // p.task_bytes))), *keys)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The int64 product a b'; through doubles where every sum fits their 53 bits, else modulo 2**64."""
    top = [max(-int(x.min()), int(x.max())) if x.size else 0 for x in (a, b)]
    if top[0] * top[1] * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _partial_tiles(a: DataFrame, b: DataFrame, to_rows: Column, to_anchors: Column, tiles: int, p: NegativeParams) -> DataFrame:
    """One partial tile for each cell (i, j, chunk); ids, labels and windows go with chunk 0."""
    size = p.anchor_block * p.row_block * 8
    left = _spread(a.withColumn("j", F.explode(to_rows)).withColumnRenamed("block", "i"), tiles, size, p, "i", "j", "chunk")
    right = _spread(b.withColumn("i", F.explode(to_anchors)).withColumnRenamed("block", "j"), tiles, size, p, "i", "j", "chunk")
    width = p.chunk

    def cell(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        out = {f.name: [] for f in schema}
        for u, w in zip(x.to_pylist(), y.to_pylist()):  # one row each
            tile = multiply(*(np.frombuffer(r["part"], r["kind"]).reshape(-1, width) for r in (u, w)))
            values = (u["i"], u["j"], u["chunk"], tile.tobytes(), u["ids"], u["labels"], w["ids"], w["labels"], u["windows"])
            for name, v in zip(out, values):
                out[name].append(v)
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in schema})

    schema = pa.schema([(n, pa.int32()) for n in ("i", "j", "chunk")] + [(n, pa.binary()) for n in ("tile", "a_ids", "a_labels", "b_ids", "b_labels", "windows")])
    return left.groupBy("i", "j", "chunk").cogroup(right.groupBy("i", "j", "chunk")).applyInArrow(cell, TILE)


def _added(tiles: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """The scores of a cell, its ids and labels, and its anchors' windows."""
    rows = tiles.to_pylist()
    head = next(r for r in rows if r["chunk"] == 0)
    names = {c: np.frombuffer(head[c], "<i8") for c in ("a_ids", "a_labels", "b_ids", "b_labels")}
    shape = len(names["a_ids"]), len(names["b_ids"])
    total = np.zeros(shape, np.int64)
    for r in rows:
        total += np.frombuffer(r["tile"], "<i8").reshape(shape)
    return total, names, np.frombuffer(head["windows"] or b"", _WINDOW)


def _positives(tiles: DataFrame, p: NegativeParams) -> DataFrame:
    """(i, row, anchor_id, positive_id, score): each anchor's best rows of its own label in each tile."""

    def reduce(tile: pa.Table) -> pa.Table:
        scores, t, _ = _added(tile)
        i, found = tile["i"][0].as_py(), []
        for label in np.unique(t["a_labels"]):
            rows, cols = np.flatnonzero(t["a_labels"] == label), np.flatnonzero(t["b_labels"] == label)
            for row in rows:
                others = cols[t["b_ids"][cols] != t["a_ids"][row]]
                best = others[np.argsort(~scores[row, others], kind="stable")[: p.positives]]  # columns are in order of id
                found += [(i, int(row), int(t["a_ids"][row]), int(t["b_ids"][c]), int(scores[row, c])) for c in best]
        names = ("i", "row", "anchor_id", "positive_id", "score")
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({n: pa.array([f[k] for f in found], kind) for k, (n, kind) in enumerate(zip(names, kinds))})

    best = tiles.groupBy("i", "j").applyInArrow(reduce, "i int, row int, anchor_id long, positive_id long, score long")
    rank = F.row_number().over(Window.partitionBy("i", "row").orderBy(F.desc("score"), "positive_id"))
    return best.withColumn("_n", rank).where(F.col("_n") <= p.positives).drop("_n")


def _windows(positives: DataFrame) -> DataFrame:
    """(block, chunk 0, windows): an anchor block's positives and their scores."""

    def pack(rows: pa.Table) -> pa.Table:
        out = np.zeros(len(rows), _WINDOW)
        for name, column in (("row", "row"), ("positive", "positive_id"), ("score", "score")):
            out[name] = rows[column].to_numpy()
        return pa.table({"block": pa.array([rows["i"][0].as_py()], pa.int32()), "chunk": pa.array([0], pa.int32()), "windows": pa.array([np.sort(out, order=["row", "positive"]).tobytes()], pa.binary())})

    return positives.groupBy("i").applyInArrow(pack, "block int, chunk int, windows binary")


def _negatives(tiles: DataFrame, p: NegativeParams) -> DataFrame:
    """(anchor_id, anchor_label, positive_id, negative_id, positive_score, negative_score): a tile's best within each window."""

    def reduce(tile: pa.Table) -> pa.Table:
        scores, t, windows = _added(tile)
        found = []
        for row in np.unique(windows["row"]):
            mine = windows[windows["row"] == row]
            lows, highs = ([-(-p.low * int(s) // 100) for s in mine["score"]], [p.high * int(s) // 100 for s in mine["score"]])
            s = scores[row]
            cols = np.flatnonzero((t["b_labels"] != t["a_labels"][row]) & (s >= min(lows)) & (s <= max(highs)))
            cols = cols[np.argsort(~s[cols], kind="stable")]
            down = ~s[cols]  # ascends where the scores descend
            for w, low, high in zip(mine, lows, highs):
                at, end = np.searchsorted(down, ~high, "left"), np.searchsorted(down, ~low, "right")
                best = cols[at : min(end, at + p.negatives)]
                found += [(int(t["a_ids"][row]), int(t["a_labels"][row]), int(w["positive"]), int(t["b_ids"][c]), int(w["score"]), int(s[c])) for c in best]
        names = ("anchor_id", "anchor_label", "positive_id", "negative_id", "positive_score", "negative_score")
        return pa.table({n: pa.array([f[k] for f in found], pa.int64()) for k, n in enumerate(names)})

    return tiles.groupBy("i", "j").applyInArrow(reduce, "anchor_id long, anchor_label long, positive_id long, negative_id long, positive_score long, negative_score long")


def hard_negatives(vectors: DataFrame, anchor: Column, scratch: Scratch, p: NegativeParams = NegativeParams()) -> DataFrame:
    """(anchor_id, anchor_label, positive_id, rank, negative_id, positive_score, negative_score) of vectors(vec_id, embedding, label).

    ``anchor``: which rows are anchors, as a condition on vec_id and label.  An
    anchor's positives are its best other ids of its label; each positive gets the
    best rows of other labels whose scores are within ``low`` to ``high`` percent
    of its own, rank from 1.  Higher scores come first, ties by smaller vec_id.

    Rows with a null id, label, vector or component or a component that isn't
    finite take no part; rows that repeat an id and a label count once; an id with
    several labels is a row of each.  Vectors of different lengths count as ending
    in zeros, an empty one as all zeros.  Scores beyond 63 bits wrap.  An anchor
    without positives, a positive without rows in its window, and a table without
    rows or anchors give no rows.  Other columns are never read.
    """
    spark = vectors.sparkSession
    grp = F.pmod(F.xxhash64("label"), F.lit(p.groups)).cast("int")
    rows = scratch.write(quantised(vectors.select("vec_id", "embedding", "label"), p.scale).withColumns({"grp": grp, "is_anchor": F.coalesce(anchor, F.lit(False))}), "rows")
    # At most ``groups`` rows reach the driver.
    sizes = {r["grp"]: r for r in rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("anchors"), F.max(F.size("q")).alias("width")).collect()}
    of = lambda g, c, size: -(-(sizes[g][c] if g in sizes else 0) // size)
    ours = _Blocks(tuple(of(g, "anchors", p.anchor_block) for g in range(p.groups)))
    theirs = _Blocks(tuple(of(g, "n", p.row_block) for g in range(p.groups)))
    if not ours.total:
        return spark.createDataFrame([], "anchor_id long, anchor_label long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = max(r["width"] for r in sizes.values())
    chunks = max(1, -(-width // p.chunk))
    key, g = F.xxhash64("vec_id", "label"), F.col("grp")
    pack = lambda df, blocks, name: scratch.write(_packed(df.select("vec_id", "label", "q", "grp", blocks.of(g, key).alias("block")), width, p), name)
    a, b = pack(rows.where("is_anchor"), ours, "anchors"), pack(rows, theirs, "blocks")
    none = F.lit(None).cast("binary").alias("windows")
    size = p.anchor_block * p.row_block * 8
    added = lambda tiles, n: _spread(tiles, n * chunks, size, p, "i", "j")

    near = sum(x * y for x, y in zip(ours.count, theirs.count))
    own = _partial_tiles(a.select("*", none), b, theirs.all_of(g), ours.all_of(g), near * chunks, p)
    windows = scratch.write(_windows(_positives(added(own, near), p)), "windows")

    every = ours.total * theirs.total
    tiles = _partial_tiles(a.join(windows, ["block", "chunk"], "left"), b, theirs.every(), ours.every(), every * chunks, p)
    found = _negatives(added(tiles, every), p)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "anchor_label", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= p.negatives)
    return ranked.select("anchor_id", "anchor_label", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def sql(p: NegativeParams = NegativeParams()) -> str:
    """DuckDB SQL of the query."""
    return f"""with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor({p.scale} * cast(x as double))) as q from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_dot_product(a.q, b.q) as bigint) as score
  from v a, v b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
pos as (select anchor_id, other_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= {p.positives})
select pos.anchor_id, pos.positive_id, cast(row_number() over w as int) as rank, s.other_id as negative_id, pos.positive_score, s.score as negative_score
from pos join s on s.anchor_id = pos.anchor_id and not s.same and {p.low} * pos.positive_score <= 100 * s.score and 100 * s.score <= {p.high} * pos.positive_score
window w as (partition by pos.anchor_id, pos.positive_id order by s.score desc, s.other_id) qualify row_number() over w <= {p.negatives}"""
