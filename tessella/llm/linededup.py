"""Fuzzy line dedup: one line stays of each component of similar lines in the corpus.

A line is compared as the set of its distinct shingles of characters after
lower-casing A-Z and stripping white space at its ends (a line shorter than a
shingle is one shingle).  Equal lines share a 64-bit id; MinHash signatures over shingles give
high-recall bands, candidates are verified by exact Jaccard similarity, and a
distributed union-find joins links.  Each component keeps its first occurrence
by doc_id and line number, wherever in the corpus it is.

Blank lines are no lines: they are never counted, compared or removed.  Null
and empty texts have none.  Rows without a doc_id sort first.  Rows that repeat
both doc_id and text are numbered: the first of them is the document, the others
keep no line.  Lines end at line feeds only.  Ties of leaders are broken by hash, and
the result doesn't depend on them.  An empty table gives an empty result; other columns
are passed on by ``dedup_lines``, whatever their names but those that begin with _line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.banding import MET, link_components, meeting, partitions, wanted_ids
from tessella.scratch import Scratch
from tessella.llm.text import encode, hash_seeds, mix

SPACE = b" \t\n\r\x0b\x0c"
BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class LineParams:
    shingle: int = 5
    percent: int = 80
    functions: int = 96
    bands: int = 32
    rows: int = 6
    samples: int = 128
    bits: int = 512
    block: int = 1 << 16
    seed: int = 41

    @property
    def most_differ(self) -> int:
        t = self.percent / 100
        low = max(0.0, t - 6 * sqrt(t * (1 - t) / self.samples))
        return int(self.bits / 2 * (1 - exp(-4 * self.samples * (1 - low) / self.bits)) + 8)


def line_keys(text: str | None) -> list[bytes]:
    """The compared form of every line, blank ones included as b''."""
    return [line.strip(SPACE) for line in encode(text).lower().split(b"\n")]


def line_id(line: bytes) -> int:
    v = xxhash.xxh3_64_intdigest(line)
    return v - (1 << 64) if v >> 63 else v


def shingle_hashes(lines: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of k characters of all lines, and where each line's begin."""
    # Line feeds, which no line has, end each line, so that a shorter one has a shingle of its own.
    pad = b"\n" * k
    data = pad.join(lines) + pad
    if data.isascii():
        code = np.frombuffer(data, np.uint8)
    else:
        code = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(code == 10)[k - 1 :: k] + 1
    begin = np.r_[0, ends[:-1]]
    # A polynomial of k characters from every one, by those of half as many.
    one = code.astype(np.uint64)
    out, n = one, 1
    for bit in bin(k)[3:]:
        out = out[:-n] * np.uint64(pow(BASE, n, 1 << 64)) + out[n:]
        n *= 2
        if bit == "1":
            out = out[:-1] * np.uint64(BASE) + one[n:]
            n += 1
    # Those that begin a line's shingle: all but the ones that reach into its end, and at least one.
    keep = np.ones(len(code), bool)
    for j in range(1, 2 * k):
        keep[np.maximum(ends - j, 0)] = False
    keep[begin] = True
    first = np.r_[0, np.cumsum(np.maximum(1, ends - begin - 2 * k + 1))]
    return mix(out[keep[: len(out)]]), first


class LineBands:
    def __init__(self, p: LineParams, functions: int):
        self.p = p
        a, _ = hash_seeds(functions, p.seed)
        self.a = (a >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # odd multipliers permute 32-bit hashes
        rng = np.random.default_rng(p.seed)
        self.chosen = np.stack([rng.choice(p.functions, p.rows, replace=False) for _ in range(p.bands)])

    def samples(self, lines: list[bytes]) -> np.ndarray:
        """[function, line] least values."""
        h, first = shingle_hashes(lines, self.p.shingle)
        low = (h >> np.uint64(16)).astype(np.uint32)
        out = np.empty((len(self.a), len(lines)), np.uint32)
        value = np.empty_like(low)
        for f in range(len(self.a)):
            np.multiply(low, self.a[f], out=value)
            np.minimum.reduceat(value, first[:-1], out=out[f])
        return out

    def bands(self, samples: np.ndarray) -> np.ndarray:
        """[band, line] buckets; each band has its own choice of the first functions, which it shares with others."""
        p = self.p
        h = np.repeat(np.arange(1, p.bands + 1, dtype=np.uint64)[:, None], samples.shape[1], axis=1)
        for r in range(p.rows):
            h *= np.uint64(BASE)
            h += samples[self.chosen[:, r]]
        return mix(h).view(np.int64)

    def odd(self, samples: np.ndarray) -> list[bytes]:
        n = self.p.samples
        at = mix(samples[:n].astype(np.uint64) ^ mix(np.arange(1, n + 1, dtype=np.uint64))[:, None]) % np.uint64(self.p.bits)
        at += np.arange(at.shape[1], dtype=np.uint64) * np.uint64(self.p.bits)
        odd = np.bincount(at.ravel().astype(np.int64), minlength=at.shape[1] * self.p.bits).astype(np.uint8) & 1
        return [x.tobytes() for x in np.packbits(odd.reshape(-1, self.p.bits), axis=1)]


def _blocks(lines: list[bytes], most: int) -> Iterator[list[bytes]]:
    own, size = [], 0
    for x in lines:
        own.append(x)
        size += len(x)
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


def _band_rows(docs: DataFrame, p: LineParams) -> DataFrame:
    """The distinct lines of each batch with their buckets, as ``meeting`` gives them."""
    bands, parts = LineBands(p, p.functions), partitions(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            distinct = list(dict.fromkeys(x for t in batch["text"] for x in line_keys(t) if x))
            if distinct:
                found = np.concatenate([bands.bands(bands.samples(own)) for own in _blocks(distinct, p.block)], axis=1)
                yield meeting(list(found), np.array([line_id(x) for x in distinct], np.int64), parts)

    return docs.select("text").mapInPandas(run, MET)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, s) of the lines in ids(id), once each."""
    test = wanted_ids(ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = list(dict.fromkeys(x for t in batch["text"] for x in line_keys(t) if x))
            found = np.array([line_id(x) for x in lines], np.int64)
            keep = test(found)
            yield pd.DataFrame({"id": found[keep], "s": [x for x, k in zip(lines, keep) if k]})

    return docs.select("text").mapInPandas(run, "id long, s binary").join(ids.hint("merge"), "id", "left_semi").groupBy("id").agg(F.first("s").alias("s"))


def _sketches(lines: DataFrame, ids: DataFrame, p: LineParams) -> DataFrame:
    """(id, sketch) of the lines in ids(id), and of few others."""
    maker, test = LineBands(p, p.samples), wanted_ids(ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch, at = batch[test(batch["id"].to_numpy())], 0
            for own in _blocks(list(batch["s"]), p.block):
                yield pd.DataFrame({"id": batch["id"].iloc[at : at + len(own)], "sketch": maker.odd(maker.samples(own))})
                at += len(own)

    return lines.mapInPandas(run, "id long, sketch binary")


def line_components(docs: DataFrame, scratch: Scratch, p: LineParams = LineParams()) -> DataFrame:
    """(id, comp) of the lines that are similar to others."""
    stored = lambda: docs.sparkSession.read.schema("id long, s binary").parquet(f"{scratch.root}/texts")
    given = iter([lambda ids: _texts(docs, ids), lambda ids: stored().join(ids.hint("merge"), "id", "left_semi")])  # first from the documents, then from what was stored

    def as_sets(lines: list[bytes]) -> list[np.ndarray]:
        h, first = shingle_hashes(lines, p.shingle)
        for a, b in zip(first.tolist(), first[1:].tolist()):
            h[a:b].sort()
        keep = np.r_[True, h[1:] != h[:-1]]
        keep[first[:-1]] = True
        ends = np.r_[0, np.cumsum(np.add.reduceat(keep.astype(np.int64), first[:-1]))].tolist() if len(lines) else [0]
        h = h[keep]
        return [h[a:b] for a, b in zip(ends, ends[1:])]

    return link_components(_band_rows(docs, p), None, lambda ids: _sketches(stored(), ids, p), lambda ids: next(given)(ids), as_sets, p.most_differ, p.percent, scratch)


def line_plan(docs: DataFrame, scratch: Scratch, p: LineParams = LineParams()) -> DataFrame:
    """doc_id, rid, nth, n_lines and kept (numbers of the lines that stay) for every row of docs(doc_id, text); nth numbers equal rows."""
    base = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))
    comps = line_components(base, scratch, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # ids stay Arrow's: beside a null, pandas would make them doubles
            found = [[(line_id(x), k) for k, x in enumerate(line_keys(t)) if x] for t in batch["text"].to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]).astype(np.int64))
            ids, pos = (pa.array([x[k] for f in found for x in f], kind) for k, kind in ((0, pa.int64()), (1, pa.int32())))
            yield pa.record_batch({"doc_id": batch["doc_id"].cast(pa.int64()).take(row), "rid": batch["rid"].take(row), "id": ids, "pos": pos})

    lines = base.mapInArrow(run, "doc_id long, rid long, id long, pos int")
    # Occurrences of equal lines are reduced map-side before classes meet.
    first = lines.groupBy("id").agg(F.min(F.struct("doc_id", "rid", "pos")).alias("at"))
    winners = first.join(comps.hint("merge"), "id", "left").groupBy(F.coalesce("comp", "id").alias("class")).agg(F.min("at").alias("at"))
    kept = winners.groupBy("at.rid").agg(F.sort_array(F.collect_list("at.pos")).alias("kept"))
    own = base.select("doc_id", "rid", _count_lines(F.col("text")).alias("n_lines")).groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("n_lines").alias("n_lines"), F.count(F.lit(1)).alias("rows"))
    none = F.array().cast("array<int>")
    each = own.join(kept, "rid", "left").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select("doc_id", "rid", "nth", "n_lines", F.when(F.col("nth") == 1, F.coalesce("kept", none)).otherwise(none).alias("kept"))


def _count_lines(text: Column) -> Column:
    """Lines with a character that isn't white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?dm)^[ \t\r\x0B\x0C]*[^ \t\r\n\x0B\x0C]")), F.lit(0))


def dedup_lines(docs: DataFrame, scratch: Scratch, p: LineParams = LineParams()) -> DataFrame:
    """The rows of docs, all columns, with the text of the lines that stay (blank ones stay too)."""
    plan = line_plan(docs, scratch, p).select(F.col("rid").alias("_line_rid"), F.col("nth").alias("_line_nth"), F.col("kept").alias("_line_kept"))
    lines = F.split("text", "\n")
    blank = lambda x: F.regexp_replace(x, r"[ \t\r\n\x0B\x0C]", "") == ""
    stay = F.filter(lines, lambda x, i: blank(x) | F.array_contains("_line_kept", i))
    own = docs.withColumn("_line_own", F.xxhash64("doc_id", "text"))
    own = own.withColumn("_line_k", F.row_number().over(Window.partitionBy("_line_own").orderBy(F.lit(1))))
    joined = own.join(plan, (F.col("_line_own") == F.col("_line_rid")) & (F.col("_line_k") == F.col("_line_nth")))
    return joined.withColumn("text", F.when(F.col("text").isNotNull(), F.concat_ws("\n", stay))).select(*[F.col(f"`{c}`") for c in docs.columns])
