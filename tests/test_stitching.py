"""Stitched labels against objects of the whole image."""

import numpy as np
import pandas as pd
import pytest

from tessella.operators.stitching import stitched_labels, stitched_objects
from tessella.scratch import Scratch

LABELS = "path string, tile_x long, tile_y long, label int, px int, py int"


def _whole():
    """Discs apart from one another, of 3 to 9 pixels, on 100 x 100."""
    rng, image = np.random.default_rng(3), np.zeros((100, 100), int)
    y, x = np.mgrid[0:100, 0:100]
    for k in range(200):
        cx, cy, r = rng.integers(0, 100), rng.integers(0, 100), rng.integers(3, 10)
        if not image[(x - cx) ** 2 + (y - cy) ** 2 <= (r + 2) ** 2].any():
            image[(x - cx) ** 2 + (y - cy) ** 2 <= r * r] = k + 1
    return image


def _cut(image, tile, overlap, noise=False):
    rng, rows = np.random.default_rng(4), []
    for ty in range(0, 101 - tile, tile - overlap):
        for tx in range(0, 101 - tile, tile - overlap):
            part = image[ty : ty + tile, tx : tx + tile]
            names = {k: i + 1 for i, k in enumerate(rng.permutation(np.unique(part[part > 0])))}
            for py, px in zip(*np.nonzero(part)):
                if not noise or rng.random() > 0.05:
                    rows.append(("s", tx, ty, names[part[py, px]], int(px), int(py)))
    return pd.DataFrame(rows, columns=["path", "tile_x", "tile_y", "label", "px", "py"])


@pytest.mark.parametrize("tile,overlap,noise", [(40, 20, False), (28, 10, False), (52, 4, False), (40, 20, True)])
def test_every_object_once(spark, tile, overlap, noise):
    """Objects on borders count once, whatever the tiles; with pixels missing at random too, as long as labels agree on half."""
    image = _whole()
    assert (100 - tile) % (tile - overlap) == 0
    got = stitched_labels(spark.createDataFrame(_cut(image, tile, overlap, noise), LABELS), tile, overlap, Scratch(spark, "t")).toPandas()
    assert not got.duplicated(["px", "py"]).any()
    got["want"] = image[got["py"], got["px"]]
    assert got.groupby("want")["object"].nunique().max() == 1 and got.groupby("object")["want"].nunique().max() == 1
    assert set(got["want"]) == set(np.unique(image)) - {0}
    if not noise:
        assert len(got) == (image > 0).sum()


def test_labels_that_disagree_stay_apart_and_edges(spark):
    """Labels that share too little, background, null labels, repeats and an empty table."""
    rows = [("s", 0, 0, 1, x, 0) for x in range(4, 8)] + [("s", 4, 0, 1, x, 0) for x in range(3, 8)]
    labels = spark.createDataFrame(rows + rows[:2] + [("s", 0, 0, 0, 0, 0), ("s", 0, 0, None, 1, 0)], LABELS)
    got = stitched_objects(stitched_labels(labels, 8, 4, Scratch(spark, "t"))).toPandas()
    assert len(got) == 2 and got["area"].sum() == 8  # pixels 4..7 and 7..11 share one
    assert stitched_labels(labels.where("label > 5"), 8, 4, Scratch(spark, "t")).count() == 0
