"""Written intermediate tables in the folder the cluster shares.

Every eager step of an operator cuts its lineage by writing Parquet below
``spark.checkpoint.dir`` and reading it back.  Lost executors then re-read the
table instead of replaying the steps before it, and the driver and executors
see the same files.  Tables that only an eager step needed are dropped at once;
those a returned DataFrame still reads stay until the application ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEPT: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a temporary one on a local master and an error on a cluster."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessella-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """A folder of written tables that belong to one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _KEPT.append((spark, self.root))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, root in _KEPT:
        try:
            _delete(spark, root)
        except Exception:  # the JVM has gone; the shared folder is the cluster's to clear
            return
