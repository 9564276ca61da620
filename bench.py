"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tessella.queries import QUERIES
from tessella.session import session

HEADLINE = [
    "density_summary", "density_multi_radius", "density_grid_join", "coherency", "local_stats", "mask_corrected_density", "nms_dedup", "pair_dedup",
    "multimodal_features", "segmenter_agreement", "feature_ttest", "cluster_stats", "slide_report", "mask_morphology", "region_props",
    "connected_components", "standardize", "slide_pipeline",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf}/orders.parquet").count()  # starts the engine
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline query seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
