"""Runs over many slides: settings by slide type, and slides that fail without stopping the others."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import slides as S
from tessella.operators import ml
from tessella.plans.slide import SlideSpec, clustered, deduplicated, enriched, slide_report
from tessella.scratch import Scratch
from tessella.sources.tables import slide_config

#: Columns that are clustered where a type's settings name none that a table has.
BASIC_FEATURES = ["area_px", "aspect_ratio", "circularity", "eccentricity", "r", "g", "b", "density_um2_r100.0", "coherency_150um"]
LOG = "slide string, status string, error string"


def spec_of(config: dict[str, dict], kind: str, base: SlideSpec = SlideSpec()) -> SlideSpec:
    """A type's settings on top of a run's: radii, the distance of de-duplication, clusters."""
    own = slide_config(config, kind)
    radii = tuple(float(r) for r in own.get("density_radii_um", base.density_um))
    dedup = float(own.get("segmentation", {}).get("dedup_radius_um", base.dedup_um))
    return replace(base, density_um=radii, radii_um=radii, dedup_um=dedup, clusters=int(own.get("clustering", {}).get("n_clusters", base.clusters)))


def features_of(df: DataFrame, config: dict[str, dict], kind: str) -> list[str]:
    """The columns that a type is clustered by (decided at plan time)."""
    return ml.select_features(df, slide_config(config, kind).get("clustering", {}).get("features", []), BASIC_FEATURES)


def run_by_type(nuclei: DataFrame, config: dict[str, dict], name: str = "slide_id", base: SlideSpec = SlideSpec()) -> dict[str, dict[str, DataFrame]]:
    """Per slide type: nuclei, features, clusters and report of all its slides at once, by the type's settings.

    The type follows from the slide's name; there are no more types than rules.
    Slides with a marker get ``has_brown`` from their brown intensity and its
    threshold, and so its local densities; others are run without.
    """
    scratch = Scratch(nuclei.sparkSession, "types")
    typed = nuclei.withColumn("_kind", S.slide_type(S.stem(F.col(name))))
    out = {}
    for kind in sorted(r["_kind"] for r in typed.select("_kind").distinct().collect()):
        spec, own = spec_of(config, kind, base), typed.where(F.col("_kind") == kind).drop("_kind")
        label = "".join(c if c.isalnum() else "_" for c in kind)
        if kind.startswith("IHC_") and "brown_intensity" in own.columns:
            threshold = float(slide_config(config, kind).get("brown_detection", {}).get("threshold", 0.15))
            own = own.withColumn("has_brown", (F.col("brown_intensity") > threshold).cast("int"))
        clean = scratch.write(deduplicated(own, spec, by=(name,)), f"{label}-nuclei")
        features = scratch.write(enriched(clean, spec, by=(name,)), f"{label}-features")
        labelled = scratch.write(clustered(features, spec, features_of(features, config, kind)), f"{label}-clusters")
        out[kind] = {"nuclei": clean, "features": features, "clusters": labelled, "report": slide_report(labelled, name)}
    return out


def run_each(spark: SparkSession, names: Iterable[str], run: Callable[[str], None], log: str, resume: bool = True) -> DataFrame:
    """Runs slide after slide; one that raises is logged and the next goes on.  Returns the log (slide, status, error), read back.

    The log is appended to, a row for each run.  With ``resume`` slides that it
    has as done are left out, so a rerun takes up the failed and the new ones.
    """
    try:
        done = {r["slide"] for r in spark.read.schema(LOG).parquet(log).where("status = 'done'").select("slide").distinct().collect()} if resume else set()
    except AnalysisException:  # no log yet
        done = set()
    for name in names:
        if name in done:
            continue
        try:
            run(name)
            row = (name, "done", None)
        except Exception as e:
            row = (name, "failed", f"{type(e).__name__}: {e}"[:2000])
        spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(log)
    return spark.read.schema(LOG).parquet(log)
