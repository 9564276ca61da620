"""The queries of the training-data operators, with their DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontam, licenses, linededup, mixing, neardup, negatives, ogg, pst, quality, sharding, toxicity, urls
from tessella.scratch import Scratch
from tessella.llm.text import documents

RULES = [
    urls.Rule("com/en/", "block"), urls.Rule("example.com/en/7", "allow"), urls.Rule("net/de/", "allow"),
    urls.Rule("example.net/de/8", "block"), urls.Rule("org/es/", "block"),
]


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose label says low quality or toxic are bad."""
    bad = F.expr("CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE 0 END")
    return labels(spark, sf_dir).groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_byte_conv_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity_scores(documents(spark, sf_dir), labels(spark, sf_dir))
    return scored.withColumn("n_spans", F.size("spans"))


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urls.filter_urls(pages, page_outcomes(spark, sf_dir), RULES).drop("bound")


def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_columns(documents(spark, sf_dir), with_media=False).drop("media", "timestamps")


def op5_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir), Scratch(spark, "mix")).drop("copies", "skey", "h")


def op6_odd_sketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = neardup.NearDupParams(shingle=3, percent=85)
    return neardup.near_duplicates(documents(spark, sf_dir), Scratch(spark, "neardup"), p)


def op7_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(documents(spark, sf_dir), Scratch(spark, "shards"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_minhash_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = linededup.line_plan(documents(spark, sf_dir), Scratch(spark, "lines"))
    return plan.select("doc_id", "n_lines", F.size("kept").alias("n_kept"), "kept")


def op10_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.suffix_tree_scores(documents(spark, sf_dir), Scratch(spark, "pst"))


def op11_summa_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0, Scratch(spark, "negatives"))
    return found.drop("anchor_label")


def op12_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labelled(licenses.scan_licenses(documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_conv_quality": op1_byte_conv_quality,
    "op2_url_reputation": op2_url_reputation,
    "op3_crf_toxicity": op3_crf_toxicity,
    "op4_ogg_media": op4_ogg_media,
    "op5_subset_sum_mix": op5_subset_sum_mix,
    "op6_odd_sketch_neardup": op6_odd_sketch_neardup,
    "op7_qgram_decontamination": op7_qgram_decontamination,
    "op8_hypergeometric_shards": op8_hypergeometric_shards,
    "op9_minhash_line_dedup": op9_minhash_line_dedup,
    "op10_suffix_tree_lm": op10_suffix_tree_lm,
    "op11_summa_hard_negatives": op11_summa_hard_negatives,
    "op12_license_set_join": op12_license_set_join,
}
ORACLES: dict[str, str] = {"op2_url_reputation": urls.sql(RULES), "op11_summa_hard_negatives": negatives.sql(), "op12_license_set_join": licenses.sql()}
