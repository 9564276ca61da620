"""Distributed union-find: connected components of an edge table.

Alternates large-star and small-star steps, which end with every node linked
to the smallest node of its component.  Each round starts with spanning
forests of a partition's edges, made without a shuffle, so that chains and cycles that
lie together are contracted at once.  Edges stay distributed, but for the last
``EDGES``, which one task settles; the driver sees a count and a flag a round.  Each round is a written table, so a lost executor re-reads
instead of replaying.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.scratch import Scratch


#: Edges that a task contracts at once; so few in all are settled in one.
EDGES = 1 << 19


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ends of the edges of so many batches as have about ``EDGES``."""
    held, size = [], 0
    for edges in batches:
        held.append((edges["a"].to_numpy(), edges["b"].to_numpy()))
        size += len(edges)
        if size > EDGES:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges as stars around the smallest node of what they join, in parts of about ``EDGES``."""
    for a, b in _together(batches):
        if not len(a):
            continue
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
        while True:  # minimum labels over edges, with pointer jumping
            low = label.copy()
            np.minimum.at(low, a, label[b])
            np.minimum.at(low, b, label[a])
            np.minimum.at(low, label, low)
            low = low[low]
            if (low == label).all():
                break
            label = low
        leaf = np.flatnonzero(label != np.arange(len(nodes)))
        yield pd.DataFrame({"a": nodes[label[leaf]], "b": nodes[leaf]})


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a < b): neighbours are linked to the smallest one."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:
        near = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
    both = near.join(least, "u")
    if large:
        return both.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b")
    out = both.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m"), F.col("u")))
    return out.where("a < b")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no leaf has two centres, no centre is a leaf."""
    roles = edges.select(F.col("a").alias("n"), F.lit(1).alias("centre"), F.lit(0).alias("leaf")).union(edges.select("b", F.lit(0), F.lit(1)))
    return roles.groupBy("n").agg(F.max("centre").alias("c"), F.sum("leaf").alias("l")).where("l > 1 or (c = 1 and l > 0)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, label: str, most_rounds: int = 60) -> DataFrame:
    """(id, comp) for every node of edges(a, b); comp is the smallest id of the component.

    Edges may repeat, point either way or be loops; null ends are left out.
    """
    clean = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = scratch.write(clean.mapInPandas(forest, "a long, b long").distinct(), f"{label}-0")
    for k in range(1, most_rounds + 1):
        few = now.count() <= EDGES
        if few:
            now = scratch.write(now.coalesce(1).mapInPandas(forest, "a long, b long"), f"{label}-settled")
        if few or _settled(now):
            return now.select(F.col("b").alias("id"), F.col("a").alias("comp")).union(now.select("a", "a").distinct())
        now = scratch.write(_star(_star(now, True), False).mapInPandas(forest, "a long, b long").distinct(), f"{label}-{k}")
        scratch.drop(f"{label}-{k - 1}")
    raise RuntimeError(f"no fixpoint in {most_rounds} rounds")
