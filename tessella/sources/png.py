"""Tiles and label masks as PNG content, a row per image, for Spark's writers.

The rows are (by, name, width, height, content): written as Parquet they are a
partitioned tile store whose content any image library reads.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode(image: np.ndarray) -> bytes:
    """A PNG of 8-bit colour (h, w, 3), 8-bit or 16-bit gray (h, w)."""
    deep = image.dtype == np.uint16
    if not deep and image.dtype != np.uint8:
        raise TypeError(f"images have 8 or 16 unsigned bits, not {image.dtype}")
    h, w = image.shape[:2]
    lines = np.ascontiguousarray(image.astype(">u2") if deep else image).view(np.uint8).reshape(h, -1)
    data = np.concatenate([np.zeros((h, 1), np.uint8), lines], axis=1)  # each line says that it is stored as it is
    head = struct.pack(">IIBBBBB", w, h, 16 if deep else 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    out = b"\x89PNG\r\n\x1a\n"
    for kind, body in ((b"IHDR", head), (b"IDAT", zlib.compress(data.tobytes())), (b"IEND", b"")):
        out += struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return out


def encoded_images(pixels: DataFrame, name: Column, values: Sequence[str], size: tuple[int, int], by: Sequence[str] = (), deep: bool = False) -> DataFrame:
    """(by, name, width, height, content) of pixels (by, px, py, values): three channels are colour, one is gray, ``deep`` with 16 bits.

    Pixels that an image lacks, and null values, are 0; values are cut to the range of
    their bits, positions outside ``size`` (width, height) fall away.  A task holds one
    image, so images should be tiles.
    """
    if len(values) not in (1, 3):
        raise ValueError("an image has one channel or three")
    w, h = size
    kind, top = (np.uint16, 65535) if deep else (np.uint8, 255)
    keys = [pixels.schema[c] for c in by]
    schema = T.StructType([*keys, *[T.StructField(c, t) for c, t in (("name", T.StringType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("content", T.BinaryType()))]])
    channels = [f"_v{i}" for i in range(len(values))]

    def pack(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((h, w, len(channels)), kind)
        image[g["_py"], g["_px"]] = g[channels].to_numpy()
        row = dict(zip((*by, "name"), key)) | {"width": w, "height": h, "content": encode(image if len(channels) == 3 else image[..., 0])}
        return pd.DataFrame([row], columns=schema.names)

    cut = [F.least(F.greatest(F.coalesce(F.col(v).cast("long"), F.lit(0)), F.lit(0)), F.lit(top)).alias(c) for v, c in zip(values, channels)]
    rows = pixels.where(F.col("px").between(0, w - 1) & F.col("py").between(0, h - 1)).select(*by, name.alias("name"), F.col("px").cast("int").alias("_px"), F.col("py").cast("int").alias("_py"), *cut)
    return rows.groupBy(*by, "name").applyInPandas(pack, schema)


def tile_name(x: Column, y: Column) -> Column:
    """The name under which ``tables.tile_images`` looks a tile up."""
    return F.concat(F.lit("tile_"), x.cast("string"), F.lit("_"), y.cast("string"), F.lit(".png"))
