"""Whole-slide images as a Python data source, where an image library is installed.

``spark.dataSource.register(WsiSource)``, then ``format("wsi")`` with options
path, tile, overlap and level gives one row per tile, one input partition per
row of tiles; ``format("wsi").option("metadata", "true")`` gives one row per slide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _open(path: str):
    try:
        import openslide  # optional: not a dependency of the library
    except ImportError as e:
        raise ImportError("the wsi source needs the optional package openslide") from e
    return openslide.OpenSlide(path)


class Row(InputPartition):
    def __init__(self, y: int, xs: list[int]):
        self.y, self.xs = y, xs


class WsiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wsi"

    def schema(self) -> str:
        if self.options.get("metadata") == "true":
            return "path string, width int, height int, mpp_x double, mpp_y double, levels int, downsamples array<double>"
        return "path string, x int, y int, w int, h int, level int, rgb binary"

    def reader(self, schema) -> DataSourceReader:
        return WsiReader(self.options)


class WsiReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.tile, self.overlap, self.level = (int(options.get(k, d)) for k, d in (("tile", 1024), ("overlap", 128), ("level", 0)))
        if not 0 <= self.overlap < self.tile:
            raise ValueError(f"an overlap of {self.overlap} doesn't fit tiles of {self.tile}")

    def partitions(self) -> list[InputPartition]:
        if self.options.get("metadata") == "true":
            return [Row(0, [])]
        w, h = _open(self.options["path"]).level_dimensions[self.level]
        step = self.tile - self.overlap
        # A slide smaller than a tile has a partition without any: Spark would read one that it makes up itself.
        return [Row(y, list(range(0, w - self.tile + 1, step))) for y in range(0, h - self.tile + 1, step)] or [Row(0, [])]

    def read(self, part: Row) -> Iterator[tuple]:
        path = self.options["path"]
        slide = _open(path)
        if self.options.get("metadata") == "true":
            mpp = [float(slide.properties.get(f"openslide.mpp-{a}", 0) or 0) for a in "xy"]
            yield (path, *slide.dimensions, *mpp, slide.level_count, [float(d) for d in slide.level_downsamples])
            return
        scale = slide.level_downsamples[self.level]
        for x in part.xs:  # regions are asked for in coordinates of level 0
            image = slide.read_region((int(x * scale), int(part.y * scale)), self.level, (self.tile, self.tile)).convert("RGB")
            yield (path, x, part.y, self.tile, self.tile, self.level, image.tobytes())


#: Finds objects in one RGB tile: (bytes, width, height) -> rows of label, px, py.
Segmenter = Callable[[bytes, int, int], pd.DataFrame]


def segment(tiles: DataFrame, segmenter: Segmenter) -> DataFrame:
    """Label pixels of tiles(path, x, y, w, h, rgb) by a pluggable model, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples():
                found = segmenter(t.rgb, t.w, t.h)
                yield pd.DataFrame({"path": t.path, "tile_x": t.x, "tile_y": t.y, "label": found["label"], "px": found["px"], "py": found["py"]})

    return tiles.select("path", "x", "y", "w", "h", "rgb").mapInPandas(run, "path string, tile_x int, tile_y int, label int, px int, py int")
