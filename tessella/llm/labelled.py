"""Bounded labelled samples and batched scoring, shared by the classifiers.

A model is fitted on at most ``rows`` documents of at most ``most_bytes`` bytes,
taken from the training labels in hash order (the documented bound of the
sample); every document of any length is scored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.text import encode, held_out

#: The share of labels that no model sees: crc32 of the id as text mod 5 is 0.
HOLD_OUT = (5, 0)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int, seed: int) -> DataFrame:
    """(text, label), in hash order of the id; null labels, ids and texts aren't used.

    A document with several labels counts with the highest.
    """
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), *HOLD_OUT))
        .groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)
    )
    # The broadcast side has at most ``rows`` narrow rows.
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.octet_length("text") <= most_bytes)
    # Repeated ids can lengthen the join; the limit keeps the sample bounded.
    return sample.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "text").limit(rows).select("text", "label")


def _example(text: str, label: int) -> tuple[bytes, int]:
    return encode(text), int(label > 0)


def training_sample(*args) -> list[tuple[bytes, int]]:
    """``training_rows`` on the driver."""
    return [_example(r["text"], r["label"]) for r in training_rows(*args).collect()]


def fitted(fit: Callable[[list[tuple[bytes, int]]], Any], *args) -> Any:
    """What ``fit`` makes of ``training_rows``, in the task that orders them: only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [_example(*row) for batch in batches for row in zip(batch["text"].to_pylist(), batch["label"].to_pylist())]
        yield pa.record_batch({"model": pa.array([pickle.dumps(fit(sample))], pa.binary())})

    made = training_rows(*args).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else fit([])


def score_documents(docs: DataFrame, score: Callable[[list[bytes]], np.ndarray], threshold: float) -> DataFrame:
    """doc_id, held_out, score and predicted for every document, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # ids stay Arrow's: beside a null, pandas would make them doubles
            values = score([encode(t) for t in batch["text"].to_pylist()]) if len(batch) else np.zeros(0)
            yield pa.record_batch({"doc_id": batch["doc_id"].cast(pa.int64()), "held_out": batch["held_out"], "score": pa.array(values, pa.float64()), "predicted": pa.array((values >= threshold).astype(np.int32))})

    ready = docs.select("doc_id", "text", held_out(F.col("doc_id"), *HOLD_OUT).alias("held_out"))
    return ready.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
