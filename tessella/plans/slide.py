"""Whole runs: one lazy DataFrame per stage, composed on the driver.

``run_slides`` takes all slides at once (they are a key, not a loop): clean,
de-duplicate, derive, neighbourhoods, stain summaries, clusters.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import with_derived
from tessella.operators import ml, stats
from tessella.operators.dedup import nms_dedup, pair_dedup
from tessella.operators.spatial import Ask, density, neighbourhood
from tessella.scratch import Scratch


@dataclass(frozen=True)
class SlideSpec:
    """Parameters of a run; the defaults are the ones of routine slides."""

    dedup_um: float = 6.0
    pair_um: float = 3.5
    pair_share: float = 0.8
    density_um: Sequence[float] = (50.0, 100.0)
    radii_um: Sequence[float] = (50.0, 100.0, 150.0)
    features: Sequence[str] = ("circularity", "gray_mean")
    statistics: Sequence[str] = ("mean", "var", "cv", "median")
    min_area: float | None = None
    max_area: float | None = None
    clusters: int = 20
    extra: dict[str, object] = field(default_factory=dict)


#: Column suffix of a statistic.
NAMES = {"mean": "local_mean", "var": "local_variance", "cv": "local_cv", "median": "local_median"}


def requests(spec: SlideSpec, columns: Sequence[str]) -> list[Ask]:
    """All neighbourhood statistics of a run, to be served in one pass."""
    out = [Ask(f"_n_{r:g}", "count", r) for r in spec.density_um]
    if "orientation" in columns:
        out += [Ask(f"coherency_{r:g}um", "coherency", r, "orientation") for r in spec.radii_um]
    out += [Ask(f"{f}_{NAMES[s]}_{r:g}um", s, r, f) for f in spec.features if f in columns for r in spec.radii_um for s in spec.statistics]
    if "has_brown" in columns:
        out += [Ask(f"brown_density_{r:g}um", "mean", r, "has_brown") for r in spec.radii_um]
    return out


def deduplicated(nuclei: DataFrame, spec: SlideSpec, key: str = "nucleus_id", by: Sequence[str] = ("slide_id",)) -> DataFrame:
    spark = nuclei.sparkSession
    once = pair_dedup(nuclei, spec.pair_um, spec.pair_share, key, "area_px", by, Scratch(spark, "pair"), "x_um", "y_um")
    once = Scratch(spark, "once").write(once, "points")
    return nms_dedup(once, spec.dedup_um, key, "area_px", by, Scratch(spark, "nms"), "x_um", "y_um")


def enriched(nuclei: DataFrame, spec: SlideSpec = SlideSpec(), key: str = "nucleus_id", by: Sequence[str] = ("slide_id",)) -> DataFrame:
    """Objects with derived shape and colour and every neighbourhood column."""
    base = with_derived(stats.size_filter(nuclei, spec.min_area, spec.max_area, "area_px"))
    near = neighbourhood(base, requests(spec, base.columns), key, by, "x_um", "y_um")
    named = near.withColumns({f"density_um2_r{float(r)}": density(F.col(f"`_n_{r:g}`"), r) for r in spec.density_um}).drop(*[f"_n_{r:g}" for r in spec.density_um])
    return base.join(named, [key, *by])


def clustered(features: DataFrame, spec: SlideSpec = SlideSpec(), columns: Sequence[str] | None = None) -> DataFrame:
    wanted = list(columns or [c for c in features.columns if "_local_" in c or c.startswith(("coherency_", "density_", "circularity", "area_px"))])
    used = ml.select_features(features, wanted, ["area_px", "circularity"])
    safe = {c: c.replace(".", "_") for c in used}
    data = features.withColumnsRenamed(safe)
    out = ml.birch(ml.standardize(data, list(safe.values()), "_z"), [f"{c}_z" for c in safe.values()], spec.clusters)
    return out.drop(*[f"{c}_z" for c in safe.values()])


def run_slides(nuclei: DataFrame, spec: SlideSpec = SlideSpec()) -> dict[str, DataFrame]:
    """All stages' tables by name: nuclei, features, clusters, report."""
    scratch = Scratch(nuclei.sparkSession, "slides")
    clean = scratch.write(deduplicated(nuclei, spec), "nuclei")
    features = scratch.write(enriched(clean, spec), "features")
    labelled = scratch.write(clustered(features, spec), "clusters")
    return {"nuclei": clean, "features": features, "clusters": labelled, "report": slide_report(labelled)}


def slide_report(df: DataFrame, by: str = "slide_id") -> DataFrame:
    """One row per slide: counts and means; a column that a slide's table lacks is null (decided at plan time)."""
    have = set(df.columns)
    mean = lambda c: F.avg(f"`{c}`") if c in have else F.lit(None).cast("double")
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_nuclei"), mean("area_px").alias("mean_area"), mean("coherency_50um").alias("mean_coherency"),
        (F.count_distinct("cluster") if "cluster" in have else F.lit(None).cast("long")).alias("n_clusters"), (100 * mean("has_brown")).alias("brown_pct"),
        mean("density_um2_r100.0").alias("mean_density"), mean("brown_intensity").alias("mean_brown"),
    )


