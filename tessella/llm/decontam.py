"""Benchmark decontamination by the q-gram lemma.

Texts are compared in normal form: A-Z lower-cased, white space runs as one
space.  A benchmark window of m bytes that occurs in a document with at most e
edits keeps at least m - q + 1 - q * e of its q-grams, all on diagonals at most
e apart.  Shared q-grams are counted in overlapping diagonal bands; bands that
reach the bound are retained and every window in them with enough q-grams is
verified by banded alignment.  An item longer than a window has one at every
byte, so that any run of a window's length counts; a shorter one is one window with
an edit budget in proportion, and one shorter than a q-gram matches where it
stands exactly, between spaces or ends.  Windows that repeat in an item are looked
for once, and texts are searched a stretch at a time, shorter where q-grams are
frequent, so repetitive texts take time in proportion and bounded memory.

Documents are read whole.  The benchmark is read in blocks of bounded bytes
with one pass over the documents for each, so its broadcast index has a fixed size.
Null and empty texts hold no passage; null and empty items are skipped; repeated
items and repeated rows give repeated rows; the first window with the fewest edits
counts, of those at every half window or, where these fail, at every byte; an empty benchmark leaves all documents alone.  ``without_leaks``
passes all columns on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.scratch import Scratch
from tessella.llm.text import encode, mix

#: Documents that are searched together.
ROWS = 1024


@dataclass(frozen=True)
class LeakParams:
    """Windows of ``window`` bytes with ``edits`` edits each; ``block`` bounds an index's bytes, ``pairs`` the q-grams compared at once."""

    q: int = 12
    window: int = 80
    edits: int = 4
    block: int = 2_000_000
    pairs: int = 2_000_000


def normal(text: str | None) -> bytes:
    return b" ".join(encode(text).lower().split())


def edit_distance_within(pattern: bytes, region: bytes, most: int) -> tuple[int, int] | None:
    """The least edits of the pattern against any part of the region, and where that part ends; None above ``most``.

    The region is a diagonal band, so the matrix of alignments is a band too.
    """
    at = region.find(pattern)
    if at >= 0:
        return 0, at + len(pattern)
    text = np.frombuffer(region, np.uint8)
    ramp = np.arange(len(text) + 1, dtype=np.int32)
    row = np.zeros(len(text) + 1, np.int32)
    for i, c in enumerate(pattern, 1):
        down = row + 1
        down[1:] = np.minimum(down[1:], row[:-1] + (text != c))
        down[0] = i
        row = np.minimum.accumulate(down - ramp) + ramp
        if row.min() > most:
            return None
    end = int(row.argmin())
    return (int(row[end]), end) if row[end] <= most else None


class LeakIndex:
    """Sorted q-grams of a block of benchmark items, with a bitmap that rejects most others."""

    def __init__(self, items: list[tuple[int, str | None]], p: LeakParams):
        self.p = p
        kept = [(i, normal(t)) for i, t in items]
        self.short: dict[bytes, list[int]] = {}
        for i, t in kept:
            if 0 < len(t) < p.q:
                self.short.setdefault(t, []).append(i)
        kept = [(i, t) for i, t in kept if len(t) >= p.q]
        self.ids, self.texts = [i for i, _ in kept], [t for _, t in kept]
        self.windows = [self._window(len(t)) for t in self.texts]
        self.starts = [self._starts(t, m) for t, (m, _, _) in zip(self.texts, self.windows)]
        grams, items_, places = [], [], []
        for k, (t, (m, _, _)) in enumerate(zip(self.texts, self.windows)):
            n = len(t) - p.q + 1
            # Only q-grams of windows that are looked for.
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, self.starts[k], 1)
            np.add.at(cover, self.starts[k] + m - p.q + 1, -1)
            own = np.flatnonzero(np.cumsum(cover[:-1]))
            grams.append(self._grams(np.frombuffer(t + b"\n" * 8, np.uint8), n)[own])
            items_.append(np.full(len(own), k, np.int32))
            places.append(own.astype(np.int32))
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.h = h[order]
        self.item, self.pos = (np.concatenate(x)[order] if grams else np.zeros(0, np.int32) for x in (items_, places))
        self.need = np.array([need for _, _, need in self.windows], np.int64)
        self._map()

    def _map(self) -> None:
        self.shift = np.uint64(64 - min(26, max(16, (64 * len(self.h)).bit_length())))
        self.map = np.zeros(1 << (64 - int(self.shift)), bool)
        self.map[self.h >> self.shift] = True

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "map"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._map()

    def _window(self, n: int) -> tuple[int, int, int]:
        """Length, edits and shared q-grams needed of an item's windows."""
        p = self.p
        m = min(n, p.window)
        edits = min(p.edits * m // p.window, (m - p.q) // p.q)  # the bound must stay positive
        return m, edits, m - p.q + 1 - p.q * edits

    def _starts(self, text: bytes, m: int) -> np.ndarray:
        """Where the item's different windows begin, each at its first place."""
        n = len(text) - m + 1
        seen: dict[bytes, int] = {}
        for s in range(n):
            seen.setdefault(text[s : s + m], s)
        return np.fromiter(seen.values(), np.int64, len(seen))

    def _grams(self, data: np.ndarray, n: int, at: int = 0) -> np.ndarray:
        """Hashes of the n q-grams from ``at``; data has 8 bytes more than they need."""
        out = np.full(n, 7, np.uint64)
        for k in range(0, self.p.q, 8):
            word = np.ndarray((n,), "<u8", data, at + k, (1,)) if n else np.zeros(0, np.uint64)
            if self.p.q - k < 8:
                word = word & np.uint64((1 << 8 * (self.p.q - k)) - 1)
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word)
        return out

    def find(self, texts: list[str | None], step: int = 1 << 18) -> list[tuple[int, int, int, int, int]]:
        """(row, item id, start, end, edits) of every leak: the first best window of each item in each text."""
        p = self.p
        plain = [normal(t) for t in texts]
        out = self._find_short(plain) if self.short else []
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        if self.ids and texts:
            ends = np.cumsum([len(t) + 1 for t in plain])  # a line feed, which no normal form has, ends each text
            data = np.frombuffer(b"\n".join(plain) + b"\n" * (p.q + 16), np.uint8)
            # A window with its edits lies within one of two stretches that share this many bytes.
            share = 2 * (p.window + 2 * p.edits)
            at, end = 0, int(ends[-1])
            while at < end:
                n, where, which = min(step, end - at), None, None
                h = self._grams(data, n, at)
                hit = np.flatnonzero(self.map[h >> self.shift])
                left = np.searchsorted(self.h, h[hit], "left")
                count = np.searchsorted(self.h, h[hit], "right") - left
                total = np.cumsum(count)
                if len(total) and total[-1] > p.pairs:  # a shorter stretch, but one that gets on
                    n = min(n, max(2 * share, int(hit[np.searchsorted(total, p.pairs)])))
                    some = hit < n
                    hit, left, count, total = hit[some], left[some], count[some], total[some]
                if len(total) and total[-1]:  # the bitmap may let others pass
                    where = np.repeat(hit + at, count)
                    which = np.arange(total[-1]) - np.repeat(total - count, count) + np.repeat(left, count)
                    self._compare(where, which, plain, ends, found)
                at = end if at + n >= end else at + n - share
        out += [(row, self.ids[i], start, stop, edits) for (row, i), (edits, start, stop) in found.items()]
        return sorted(out, key=lambda x: x[:3])

    def _find_short(self, plain: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """Items shorter than a q-gram where they stand between spaces or ends."""
        lengths = sorted({t.count(b" ") + 1 for t in self.short})
        out = []
        for row, text in enumerate(plain):
            words, seen = text.split(b" "), set()
            begin = np.cumsum([0, *(len(w) + 1 for w in words)])
            for n in lengths:
                for k in range(len(words) - n + 1):
                    if begin[k + n] - 1 - begin[k] >= self.p.q:
                        continue
                    x = b" ".join(words[k : k + n])
                    if x in self.short and x not in seen:
                        seen.add(x)
                        out += [(row, i, int(begin[k]), int(begin[k]) + len(x), 0) for i in self.short[x]]
        return out

    def _compare(self, where: np.ndarray, which: np.ndarray, plain: list[bytes], ends: np.ndarray, found: dict) -> None:
        """Counts shared q-grams in diagonal bands and verifies those that reach the bound."""
        p = self.p
        item, pos = self.item[which].astype(np.int64), self.pos[which].astype(np.int64)
        width = p.edits + 1
        diagonal = where - pos + max(map(len, self.texts))
        bands = int(diagonal.max()) // width + 2
        # Band k holds the diagonals k * width to (k + 2) * width - 1; each diagonal is in two bands.
        key = np.concatenate([item * bands + diagonal // width + 1, item * bands + diagonal // width])
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
        size = np.diff(np.r_[first, len(sorted_)])
        for k in np.flatnonzero(size >= self.need[sorted_[first] // bands]):
            own = order[first[k] : first[k] + size[k]] % len(where)
            self._verify(int(item[own[0]]), where[own], pos[own], plain, ends, found)

    def _verify(self, i: int, where: np.ndarray, pos: np.ndarray, plain: list[bytes], ends: np.ndarray, found: dict) -> None:
        rows = np.searchsorted(ends, where, "right")
        for row in np.unique(rows).tolist():
            if (row, i) in found and found[row, i][0] == 0:
                continue
            base = int(ends[row]) - len(plain[row]) - 1
            at, p0 = where[rows == row] - base, pos[rows == row]
            starts = self._passing(i, p0)
            sparse = (starts % (self.p.window // 2) == 0) | (starts == self.starts[i][-1])
            self._align(row, i, starts[sparse], at, p0, plain, found)
            if (row, i) not in found:  # a shorter run may hold none of these
                self._align(row, i, starts[~sparse], at, p0, plain, found)

    def _passing(self, i: int, p0: np.ndarray) -> np.ndarray:
        """The starts of the item's windows with enough different q-grams."""
        m, _, need = self.windows[i]
        u, starts = np.unique(p0), self.starts[i]
        return starts[np.searchsorted(u, starts + m - self.p.q, "right") - np.searchsorted(u, starts, "left") >= need]

    def _align(self, row: int, i: int, starts: np.ndarray, at: np.ndarray, p0: np.ndarray, plain: list[bytes], found: dict) -> None:
        """Aligns windows of item i with the text; the first with the least edits stays."""
        slack = 2 * self.p.edits + 2
        m, edits, _ = self.windows[i]
        for start in starts.tolist():
            inside = (p0 >= start) & (p0 <= start + m - self.p.q)
            shift = at[inside] - p0[inside]
            lo = max(0, int(shift.min()) + start - slack)
            region = plain[row][lo : int(shift.max()) + start + m + slack]
            # Only fewer edits than were found are of use.
            best = edit_distance_within(self.texts[i][start : start + m], region, min(edits, found[row, i][0] - 1) if (row, i) in found else edits)
            if best is not None:
                end = lo + best[1]
                found[row, i] = (best[0], max(0, end - m), end)
                if best[0] == 0:
                    return


def _indexes(benchmark: DataFrame, p: LeakParams) -> Iterator[LeakIndex]:
    """Indexes of blocks of the benchmark; a block has about ``block`` bytes."""
    items = benchmark.where("text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // p.block) + 1
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield LeakIndex([(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()], p)


def find_leaks(docs: DataFrame, benchmark: DataFrame, p: LeakParams = LeakParams()) -> DataFrame:
    """doc_id, item_id, start, end (bytes of the normal form) and edits of each benchmark passage in docs(doc_id, text)."""
    schema = "doc_id string, item_id long, start long, end long, edits int"
    context = docs.sparkSession.sparkContext

    def search(index):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), ROWS):
                    ids = batch["doc_id"].iloc[at : at + ROWS].array
                    rows = [(ids[r], i, s, e, d) for r, i, s, e, d in index.value.find(list(batch["text"].iloc[at : at + ROWS]))]
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "edits"])

        return run

    out = None
    # An id beside a null one would pass through pandas as a float: text keeps it whole.
    read = docs.select(F.col("doc_id").cast("string"), "text")
    for index in _indexes(benchmark, p):
        part = read.mapInPandas(search(context.broadcast(index)), schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, p: LeakParams = LeakParams()) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark passage is found."""
    context = docs.sparkSession.sparkContext

    def keep(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    clean = np.ones(part.num_rows, bool)
                    clean[[row for row, *_ in index.value.find(part.column(part.schema.get_field_index("text")).to_pylist())]] = False
                    yield part.filter(pa.array(clean))

        return run

    scratch = None
    for index in _indexes(benchmark, p):
        if scratch is not None:  # the passes before are written, so that a task holds one index
            docs = scratch.write(docs, f"pass{k}")
        scratch, k = scratch or Scratch(docs.sparkSession, "leaks"), 0 if scratch is None else k + 1
        docs = docs.mapInArrow(keep(context.broadcast(index)), docs.schema)
    return docs
