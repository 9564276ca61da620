"""Feature tables of slides: from detected objects to one enriched row per object, partitioned by slide.

Reads the object table, keeps one of each group of objects nearer than a
distance (the largest first), drops objects outside the size range, derives
shape and colour, serves all neighbourhood statistics in one pass and writes
Parquet partitioned by slide.  Slides are a key, so all are one run.  Partitions
are replaced by slide: a rerun gives the same files' content, and ``slides`` in
the settings recomputes only some and leaves the others.

    python -m jobs.slide_features --tables IN --out OUT --config jobs/slide_features.json
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command_line
from tessella.functions.columns import with_derived
from tessella.operators.dedup import nms_dedup
from tessella.operators.spatial import Ask, density, neighbourhood
from tessella.operators.stats import size_filter
from tessella.scratch import Scratch

#: ``columns``: each column of an object as an expression over the source table; x, y and radii are in tenths of a micrometre.
DEFAULTS = {
    "table": "objects.parquet", "format": "parquet", "columns": {}, "key": "nid", "slide": "slide_no", "slides": [], "dedup": 200, "radius": 500, "unit_um": 0.1,
    "area_low": 50, "area_high": 300, "positive": 0.15, "feature": "area_px",
}


def objects(spark: SparkSession, tables: str, config: dict) -> DataFrame:
    """The source table under the objects' column names, of the wanted slides."""
    source = spark.read.format(config["format"]).load(f"{tables}/{config['table']}")
    found = source.select(*[F.expr(e).alias(c) for c, e in config["columns"].items()]) if config["columns"] else source
    return found.where(F.col(config["slide"]).isin(config["slides"])) if config["slides"] else found


def features(found: DataFrame, config: dict) -> DataFrame:
    """One enriched row per kept object."""
    spark, key, slide, r = found.sparkSession, config["key"], config["slide"], config["radius"]
    scratch = Scratch(spark, "slide-features")
    once = nms_dedup(found, config["dedup"], key, "area_px", [slide], Scratch(spark, "slide-dedup"), "x", "y")
    kept = size_filter(once, config["area_low"], config["area_high"], "area_px")
    kept = scratch.write(with_derived(kept).withColumn("has_brown", (F.col("brown_intensity") > config["positive"]).cast("int")), "kept")
    f = config["feature"]
    asks = [Ask("n_near", "count", r), Ask("coherency", "coherency", r, "orientation"), Ask(f"{f}_mean", "mean", r, f), Ask(f"{f}_variance", "var", r, f), Ask(f"{f}_median", "median", r, f), Ask("brown_density", "mean", r, "has_brown")]
    near = neighbourhood(kept, asks, key, [slide], "x", "y").withColumn("density_um2", density(F.col("n_near"), r * config["unit_um"]))
    doubles = ["coherency", f"{f}_mean", f"{f}_variance", f"{f}_median", "brown_density"]
    own = [F.col(key), F.col(slide), *[(F.col(c) * config["unit_um"]).alias(f"{c}_um") for c in ("x", "y")], F.col("area_px"), *[F.round(c, 6).alias(c) for c in ("aspect_ratio", "circularity", "gray_mean")], F.col("has_brown")]
    return kept.select(*own).join(near.select(key, slide, F.col("n_near").cast("long").alias("n_near"), F.round("density_um2", 9).alias("density_um2"), *[F.round(c, 6).alias(c) for c in doubles]), [key, slide])


def run(spark: SparkSession, tables: str, out: str, config: dict) -> DataFrame:
    """Writes the feature table below ``out`` and returns it, read back."""
    found = objects(spark, tables, config)
    slide = config["slide"]
    done = features(found, config)
    # Few files a slide, and a slide with very many rows split over tasks.
    done.hint("rebalance", slide).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(slide).parquet(f"{out}/features")
    back = spark.read.schema(done.schema).parquet(f"{out}/features")
    LOG.info("slide_features read %d objects of %s/%s", found.count(), tables, config["table"])
    for row in back.groupBy(slide).count().orderBy(slide).limit(1000).collect():  # the log names at most 1000 slides
        LOG.info("slide_features wrote %d rows of slide %s to %s/features", row["count"], row[slide], out)
    return back


if __name__ == "__main__":
    command_line(__doc__, run, DEFAULTS, {})
