"""Incremental intake of text tables: quality control of what arrived since the last run.

The texts that come with slides (notes, reports, exported records) are checked as
object tables are: every record gets a stable id from its content, its size and
whether that is in the wanted range, and each source and language gets a summary.
New files of the table are a file stream that ends when all present files are
taken (``availableNow``); its checkpoint is the mark of what was taken.  Each
batch writes its records and its partial sums under its own number, so that a
batch which is replayed after a loss replaces itself.  The summary is the sum of
the partial sums: no earlier record is read again.

    python -m jobs.text_intake --tables IN --out OUT --checkpoint MARK --config jobs/text_intake.json
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command_line
from tessella.functions.columns import content_id
from tessella.operators.stats import merged_moments, moments

#: ``bins`` and ``bin_chars``: the histogram of sizes; its last bin has every larger text.
DEFAULTS = {"table": "documents.parquet", "files_per_batch": 200, "low": 200, "high": 20000, "bins": 20, "bin_chars": 1000}
RECORDS = "doc_id long, record_id string, lang string, n_chars long, n_words long, in_range boolean, size_bin int, batch long, source string"
KEYS = ["source", "lang"]


def records(texts: DataFrame, config: dict) -> DataFrame:
    """A row for each text: content id (null of a null text), size, range and bin.  An empty source counts as none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.char_length(text).cast("long")
    place = F.least(F.floor(n / config["bin_chars"]), F.lit(config["bins"] - 1)).cast("int")
    return texts.select(
        F.col("doc_id").cast("long").alias("doc_id"), content_id(F.col("text")).alias("record_id"), F.col("lang"), n.alias("n_chars"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"), n.between(config["low"], config["high"]).alias("in_range"), place.alias("size_bin"), F.nullif("source", F.lit("")).alias("source"),
    )


def partial_sums(of: DataFrame) -> DataFrame:
    """A batch's sums by source and language, which add up over batches."""
    return moments(of.withColumns({"size": F.col("n_chars"), "kept": F.col("in_range").cast("long")}), KEYS, ["size", "kept"])


def summary(sums: DataFrame) -> DataFrame:
    """Texts, kept and left out, and the distribution's moments of each source and language."""
    m = merged_moments(sums, KEYS, ["size", "kept"])
    kept = F.col("kept_sum").cast("long")
    return m.select(*KEYS, "n", kept.alias("n_kept"), (F.col("n") - kept).alias("n_removed"), F.round("size_mean", 6).alias("mean_chars"), F.round("size_std", 6).alias("std_chars"), F.col("size_min").cast("long").alias("min_chars"), F.col("size_max").cast("long").alias("max_chars"))


def run(spark: SparkSession, tables: str, out: str, checkpoint: str, config: dict) -> DataFrame:
    """Takes the new files, and returns all records with their group's summary, read back."""
    path = f"{tables}/{config['table']}"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern it may be a folder or one file
    taken: list[int] = []

    def batch(df: DataFrame, number: int) -> None:
        part = f"{out}/records/batch={number}"
        records(df, config).hint("rebalance", "source").write.mode("overwrite").partitionBy("source").parquet(part)
        written = df.sparkSession.read.schema(RECORDS.replace(" batch long,", "")).parquet(part)
        partial_sums(written).coalesce(1).write.mode("overwrite").parquet(f"{out}/sums/batch={number}")  # a row for each source and language
        taken.append(number)
        LOG.info("text_intake batch %d: read and wrote %d records to %s", number, written.count(), part)

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start().awaitTermination()
    sums = spark.read.parquet(f"{out}/sums").drop("batch")
    if taken:
        summary(sums).coalesce(1).write.mode("overwrite").parquet(f"{out}/summary")
    LOG.info("text_intake took %d batches of %s; the summary is in %s/summary", len(taken), path, out)
    return read_back(spark, out)


def read_back(spark: SparkSession, out: str) -> DataFrame:
    """All records and their group's summary."""
    table = spark.read.schema(RECORDS).parquet(f"{out}/records").drop("batch").alias("r")
    groups = spark.read.parquet(f"{out}/summary").alias("s")
    on = F.col("r.source").eqNullSafe(F.col("s.source")) & F.col("r.lang").eqNullSafe(F.col("s.lang"))
    return table.join(groups, on, "left").select("r.*", *[f"s.{c}" for c in groups.columns if c not in KEYS])


if __name__ == "__main__":
    command_line(__doc__, run, DEFAULTS, {"checkpoint": "folder of the stream's checkpoint"})
