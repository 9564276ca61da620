"""MinHash near-duplicates with odd sketches.

A document is the set of its distinct word shingles (A-Z lower-cased; with
fewer words than a shingle, the whole sequence).  MinHash samples give bands;
the same kind of samples, folded into a parity bitmap, give an odd sketch: the
population count of two sketches' XOR estimates high similarities precisely
and rejects most false candidates before the exact check on full sets.

Documents with equal sets (one 128-bit key) are one class, found by map-side
aggregation, so exact copies never meet in pairs.  Links and components join
classes; a document's component is the smallest doc_id reachable.

Null and empty texts and texts without words have an empty set and are linked
with nothing.  Rows that share a doc_id are one node.  Rows without a doc_id are
never linked: their component is null and they are kept.  A text of any length is
compared whole.  Ties of leaders are broken by hash, and the result doesn't depend
on them.  An empty table gives an empty result; other columns, whatever their names,
are never read and are passed on by ``keep_one_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.banding import MET, link_components, meeting, partitions, wanted_ids
from tessella.operators.graph import connected_components
from tessella.scratch import Scratch
from tessella.llm.text import WordHashes, free_name, hash_seeds, mix, words


@dataclass(frozen=True)
class NearDupParams:
    """Link sets with 100 * intersection >= percent * union."""

    shingle: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 5
    samples: int = 128
    bits: int = 512
    seed: int = 31

    @property
    def most_differ(self) -> int:
        """Differing sketch bits at six standard deviations under the wanted similarity."""
        t = self.percent / 100
        low = max(0.0, t - 6 * sqrt(t * (1 - t) / self.samples))
        return int(self.bits / 2 * (1 - exp(-4 * self.samples * (1 - low) / self.bits)) + 8)


class Sketcher:
    def __init__(self, p: NearDupParams):
        self.p = p
        n = max(p.samples, p.bands * p.rows)
        a, b = hash_seeds(n, p.seed)
        self.a = ((a >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]
        self.b = (b >> np.uint64(32)).astype(np.uint32)[:, None]
        self.salt = mix(np.arange(1, n + 1, dtype=np.uint64))
        self.hashes = WordHashes()

    def __getstate__(self):
        return {"p": self.p}

    def __setstate__(self, state):
        self.__init__(state["p"])

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit shingle hashes."""
        tokens = words(text)
        if not tokens:
            return np.zeros(0, np.uint64)
        h = self.hashes.array(tokens)
        k = min(self.p.shingle, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
        return np.unique(out)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        return [self.shingles(t) for t in texts]

    def samples(self, s: np.ndarray) -> np.ndarray:
        """MinHash samples: the least value of each function over the set."""
        low = (s >> np.uint64(20)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 2048):
            np.minimum(out, (self.a * low[at : at + 2048] + self.b).min(axis=1), out=out)
        return out

    def bands(self, samples: np.ndarray) -> np.ndarray:
        p = self.p
        own = samples[: p.bands * p.rows].reshape(p.bands, p.rows).astype(np.uint64)
        h = np.arange(1, p.bands + 1, dtype=np.uint64)
        for r in range(p.rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + own[:, r])
        return h.view(np.int64)

    def odd(self, samples: np.ndarray) -> bytes:
        n = self.p.samples
        at = mix(samples[:n].astype(np.uint64) ^ self.salt[:n]) % np.uint64(self.p.bits)
        return np.packbits(np.bincount(at.astype(np.int64), minlength=self.p.bits) & 1).astype(np.uint8).tobytes()


def sketch_rows(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """id, n_shingles, key (128 bits as hi, lo; null for the empty set), bands and odd sketch."""
    sketcher = Sketcher(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # ids stay Arrow's: beside a null, pandas would make them doubles
            rows = []
            for text in batch["text"].to_pylist():
                s = sketcher.shingles(text)
                if not len(s):
                    rows.append((0, None, None, None, None))
                    continue
                key = xxhash.xxh3_128_digest(s.tobytes())
                x = sketcher.samples(s)
                hi, lo = (int.from_bytes(key[k : k + 8], "big", signed=True) for k in (0, 8))
                rows.append((len(s), hi, lo, sketcher.bands(x).tolist(), sketcher.odd(x)))
            kinds = {"n_shingles": pa.int64(), "hi": pa.int64(), "lo": pa.int64(), "bands": pa.list_(pa.int64()), "sketch": pa.binary()}
            yield pa.record_batch({"id": batch["id"].cast(pa.int64())} | {c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(kinds.items())})

    return docs.mapInArrow(run, "id long, n_shingles long, hi long, lo long, bands array<long>, sketch binary")


def _near(sketches: DataFrame, p: NearDupParams, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that pass the tests of size and of odd sketches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            ok = np.zeros(len(x), bool)
            if len(x):
                left, right = (np.frombuffer(b"".join(x[c]), np.uint64).reshape(len(x), -1) for c in ("sa", "sb"))
                ok = np.bitwise_count(left ^ right).sum(axis=1) <= p.most_differ
            yield x.loc[ok, ["a", "b"]]

    side = lambda c: sketches.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {p.percent} * greatest(na, nb)")
    return sized.select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, s): the texts of ids(id); a row with another text under the same id is one more row."""
    test = wanted_ids(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            x = x.filter(pa.array(~x["id"].is_null().to_numpy(zero_copy_only=False)))
            keep = pa.array(test(x["id"].to_numpy().astype(np.int64)))
            yield pa.record_batch({"id": x["id"].filter(keep).cast(pa.int64()), "s": x["text"].filter(keep)})

    # A null text is in no class.
    return docs.where("text is not null").mapInArrow(run, "id long, s string").join(ids, "id", "left_semi")


def near_duplicates(docs: DataFrame, scratch: Scratch, p: NearDupParams = NearDupParams()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs(doc_id, text)."""
    base = docs.select(F.col("doc_id").alias("id"), "text")
    rows = scratch.write(sketch_rows(base, p), "sketches")
    classes = scratch.write(rows.where("hi is not null and id is not null").groupBy("hi", "lo").agg(F.min("id").alias("rep")), "classes")
    reps = scratch.write(
        rows.where("hi is not null").join(classes.select("hi", "lo", F.col("rep").alias("id")), ["hi", "lo", "id"], "left_semi")
        .select("id", F.col("n_shingles").alias("n"), "bands", "sketch"),
        "reps",
    )
    sketches = reps.select("id", "n", "sketch")
    parts = partitions(docs)

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield meeting(list(np.stack(b["bands"].to_numpy()).T), b["id"].to_numpy(), parts)

    buckets = reps.select("bands", "id").mapInPandas(met, MET)
    comps = link_components(
        buckets, lambda pairs: _near(sketches, p, pairs), lambda ids: sketches.select("id", "sketch"), lambda ids: _texts(base, ids),
        Sketcher(p).sets, p.most_differ, p.percent, scratch,
    )
    # An id with several texts is one node that ties its classes together.
    split = scratch.write(rows.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 and id is not null").select("id"), "repeated")
    if not split.isEmpty():
        extra = rows.where("hi is not null").join(split, "id", "left_semi").join(classes, ["hi", "lo"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
        joined = extra.union(comps.select(F.col("comp"), F.col("id")))
        comps = connected_components(joined, scratch, "comps-3")
    named = classes.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("hi", "lo", F.coalesce("comp", "rep").alias("comp"))
    # Rows without a set have no class to look up and don't meet under one null key.
    own = rows.select("hi", "lo", "id", "n_shingles")
    placed = own.where("hi is not null").join(named, ["hi", "lo"], "left").unionByName(own.where("hi is null").withColumn("comp", F.lit(None).cast("long")))
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return placed.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_one_each(docs: DataFrame, scratch: Scratch, p: NearDupParams = NearDupParams()) -> DataFrame:
    """The rows of docs, all columns, of which each group of near-duplicates keeps its smallest doc_id once.

    Rows without a doc_id stay; repeated rows of one doc_id leave the one whose text sorts first.
    """
    kept = near_duplicates(docs, scratch, p).where("kept and doc_id is not null").select("doc_id").distinct()
    stay = docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    name = free_name(docs.columns, "_first")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    return stay.withColumn(name, first).where(F.col(name) == 1).drop(name).unionByName(docs.where("doc_id is null"))
