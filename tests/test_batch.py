"""Runs by slide type and runs that outlive a broken slide."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.plans import batch
from tessella.plans.slide import SlideSpec

CONFIG = {
    "default": {"clustering": {"features": ["no_such_column"], "n_clusters": 3}, "density_radii_um": [20]},
    "IHC_CD3": {"clustering": {"features": ["area_px", "brown_density_30um", "missing"], "n_clusters": 2}, "density_radii_um": [30], "brown_detection": {"threshold": 0.08}, "segmentation": {"dedup_radius_um": 4.0}},
}


def slides(spark):
    rng = np.random.default_rng(3)
    parts = []
    for name in ("HE-B1", "HE-B2", "CD3-B1"):
        n = 60
        parts.append(pd.DataFrame({
            "slide_id": name, "nucleus_id": [f"{name}{i}" for i in range(n)], "x_um": rng.uniform(0, 200, n), "y_um": rng.uniform(0, 200, n), "area_px": rng.uniform(30, 90, n), "perimeter_px": rng.uniform(20, 40, n),
            "orientation": rng.uniform(-1, 1, n), "major_axis_length": rng.uniform(5, 9, n), "minor_axis_length": rng.uniform(2, 5, n), "r": 1.0, "g": 2.0, "b": 3.0, "brown_intensity": rng.uniform(0, 0.2, n),
        }))
    return spark.createDataFrame(pd.concat(parts))


def test_types_have_their_own_settings(spark):
    nuclei = slides(spark)
    assert batch.spec_of(CONFIG, "IHC_CD3").clusters == 2 and batch.spec_of(CONFIG, "IHC_CD3").dedup_um == 4.0 and batch.spec_of(CONFIG, "H&E").radii_um == (20.0,)
    out = batch.run_by_type(nuclei, CONFIG, base=SlideSpec(features=(), dedup_um=1.0, pair_um=0.5))
    assert set(out) == {"H&E", "IHC_CD3"}
    he, cd3 = out["H&E"], out["IHC_CD3"]
    assert "has_brown" not in he["features"].columns and {"brown_density_30um", "coherency_30um", "density_um2_r30.0"} <= set(cd3["features"].columns)
    assert batch.features_of(cd3["features"], CONFIG, "IHC_CD3") == ["area_px", "brown_density_30um"]
    assert batch.features_of(he["features"], CONFIG, "H&E") == ["area_px", "aspect_ratio", "circularity", "r", "g", "b"]
    kept = cd3["features"].select(F.avg((F.col("brown_intensity") > 0.08).cast("int") - F.col("has_brown")).alias("d")).first().d
    assert kept == 0 and cd3["clusters"].select("cluster").distinct().count() == 2
    report = {r.slide_id: r for r in he["report"].collect()}
    assert set(report) == {"HE-B1", "HE-B2"} and all(0 < r.n_nuclei <= 60 for r in report.values())


def test_one_broken_slide_of_three(spark, tmp_path):
    log, seen = str(tmp_path / "log"), []

    def run(name, broken=("b",)):
        seen.append(name)
        if name in broken:
            raise ValueError(f"{name} has no tiles")
        spark.range(3).write.mode("overwrite").parquet(str(tmp_path / name))

    got = {(r.slide, r.status, r.error) for r in batch.run_each(spark, ["a", "b", "c"], run, log).collect()}
    assert got == {("a", "done", None), ("b", "failed", "ValueError: b has no tiles"), ("c", "done", None)}
    assert all(spark.read.parquet(str(tmp_path / n)).count() == 3 for n in "ac")
    again = batch.run_each(spark, ["a", "b", "c", "d"], lambda n: run(n, ()), log)
    assert seen == ["a", "b", "c", "b", "d"] and again.where("status = 'done'").count() == 4 and again.count() == 5
    with pytest.raises(KeyboardInterrupt):
        batch.run_each(spark, ["e"], lambda n: (_ for _ in ()).throw(KeyboardInterrupt()), log)
