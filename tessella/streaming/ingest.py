"""Streaming ingest of object files: per-slide running summaries and recomputation of touched slides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.sources.tables import NUCLEI


def stream_nuclei(spark: SparkSession, folder: str, schema=NUCLEI, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of objects as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_summary(stream: DataFrame, time: str | None = None, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Objects, mean area and mean coordinates by slide; with a time column, by window under a watermark."""
    keys = [F.col("slide_id")]
    if time:
        stream = stream.withWatermark(time, late)
        keys.append(F.window(time, window))
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("area_px").alias("mean_area"), F.avg("x_um").alias("cx"), F.avg("y_um").alias("cy"))


def refresh_slides(stream: DataFrame, store: str, recompute: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch to the store and recomputes, whole, the slides that it touched.

    Batches are written under their number, so a batch that is replayed
    overwrites itself; results are partitioned by slide and replaced by slide.  The
    store is partitioned by slide within a batch, so that only touched slides are
    read; the driver holds their names, no more than a batch has.  Rows without a
    slide are stored and take no part.
    """

    def batch(df: DataFrame, number: int) -> None:
        read = df.sparkSession.read.schema(df.schema)
        df.write.mode("overwrite").partitionBy("slide_id").parquet(f"{store}/batch={number}")
        touched = [r["slide_id"] for r in read.parquet(f"{store}/batch={number}").select("slide_id").where("slide_id is not null").distinct().collect()]
        if not touched:
            return
        slides = read.parquet(store).where(F.col("slide_id").isin(touched)).select(*[F.col(f"`{c}`") for c in df.columns])
        recompute(slides).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slide_id").parquet(out)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
