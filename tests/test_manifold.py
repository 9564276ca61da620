"""Neighbour graph, memberships and layout, on data with groups and on awkward rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array

from tessella.operators import manifold
from tessella.operators.ml import assemble
from tessella.scratch import Scratch

COLUMNS = [f"f{i}" for i in range(8)]


def sheets(n, groups=5):
    """Flat patches, each in a plane of its own."""
    rng = np.random.default_rng(7)
    parts = []
    for _ in range(groups):
        plane = np.linalg.qr(rng.normal(size=(8, 2)))[0]
        parts.append(rng.uniform(-2, 2, (n // groups, 2)) @ plane.T + rng.normal(0, 4, 8) + rng.normal(0, 0.02, (n // groups, 8)))
    return np.concatenate(parts), np.repeat(np.arange(groups), n // groups)


def nearest(x, k):
    d = ((x[:, None] - x) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def frame(spark, x, parts=4):
    table = pd.DataFrame(x, columns=COLUMNS[: x.shape[1]])
    table["id"] = np.arange(len(x)) * 3 + 2**60
    return spark.createDataFrame(table, ", ".join([*[f"{c} double" for c in table.columns[:-1]], "id long"])).repartition(parts)


@pytest.fixture(scope="module")
def grouped(spark):
    x, g = sheets(600)
    df = frame(spark, x)
    vectors = Scratch(spark, "vectors").write(assemble(df, COLUMNS, "_x").select("id", vector_to_array("_x").alias("_a")), "v")
    return x, g, df, vectors


def test_neighbours_over_many_cells(spark, grouped):
    x, _, _, vectors = grouped
    graph = manifold.neighbour_graph(vectors, "id", 10, Scratch(spark, "graph"), most=100).collect()
    want = nearest(x, 10)
    assert len(graph) == 600
    hits = 0
    for r in graph:
        i = (r.id - 2**60) // 3
        found = [(p.id - 2**60) // 3 for p in r.near]
        assert len(found) == len(set(found)) == 10 and i not in found
        assert [p.d for p in r.near] == pytest.approx(sorted(np.sqrt(((x[i] - x[found]) ** 2).sum(1))))
        hits += len(set(found) & set(want[i]))
    assert hits / 6000 > 0.97


def test_cells_are_bounded_and_whole(spark, grouped):
    *_, vectors = grouped
    alike = spark.range(700).selectExpr("id + 1 as id", "array(1.0D, 2.0D) as _a")  # all rows are copies
    for data, n, most in ((vectors, 600, 50), (alike, 700, 60)):
        got = manifold.cells(data, "id", Scratch(spark, "cells"), "c", most).toPandas()
        assert len(got) == n and got["id"].is_unique and got.groupby("_cell").size().max() <= most


def test_memberships(spark, grouped):
    *_, vectors = grouped
    graph = manifold.neighbour_graph(vectors, "id", 10, Scratch(spark, "graph"))
    edges = {(r.a, r.b): r.w for r in manifold.fuzzy_edges(graph, "id").collect()}
    assert all(0 < w <= 1 + 1e-9 and edges[b, a] == w for (a, b), w in edges.items())
    best = {}
    for (a, _), w in edges.items():
        best[a] = max(best.get(a, 0), w)
    assert all(w == pytest.approx(1) for w in best.values())  # a row is joined to its nearest for sure
    a, b = manifold.curve(0.1)
    assert a == pytest.approx(1.577, abs=0.02) and b == pytest.approx(0.895, abs=0.01)


def test_layout_keeps_neighbours_and_doesnt_depend_on_partitions(spark, grouped):
    x, g, df, _ = grouped
    how = {"neighbours": 15, "most": 250, "rounds": 5, "steps": 80}
    got = manifold.umap(df, COLUMNS, "id", **how).toPandas().sort_values("id")
    assert len(got) == 600 and np.isfinite(got[["umap_1", "umap_2"]]).all(axis=None)
    near = nearest(got[["umap_1", "umap_2"]].to_numpy(), 15)
    want = nearest(x, 15)
    kept = np.mean([len(set(a) & set(b)) / 15 for a, b in zip(near, want)])
    assert kept > 0.5 and (g[near] == g[:, None]).mean() > 0.98
    again = manifold.umap(df.repartition(7), COLUMNS, "id", **how).toPandas().sort_values("id")
    assert np.abs(got[["umap_1", "umap_2"]].to_numpy() - again[["umap_1", "umap_2"]].to_numpy()).max() < 1e-6


def test_layout_of_few_rows(spark):
    two = frame(spark, np.array([[0.0, 1.0], [np.nan, 5.0]]))
    assert manifold.umap(two, ["f0", "f1"], "id", rounds=1).count() == 2
    assert manifold.umap(two.limit(1), ["f0", "f1"], "id", rounds=1).count() == 1
    assert manifold.umap(two.limit(0), ["f0", "f1"], "id", rounds=1).count() == 0
    assert manifold.umap(frame(spark, np.zeros((40, 3))), ["f0", "f1", "f2"], "id", neighbours=5, rounds=2).count() == 40
