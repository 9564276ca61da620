"""A session with the settings the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, Arrow on, UTC; shuffle partitions only where asked for."""
    builder = SparkSession.builder.appName("tessella")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.session.timeZone": "UTC",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    return builder.config(map=settings | conf).getOrCreate()
