"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Documents lie in hash partitions.  How many go from each partition to each
shard is drawn from the multivariate hypergeometric law whose margins are the
partition and shard sizes, which is the law of a uniform permutation.  Each
partition orders its rows at random and deals them out by its row of the
matrix; each shard orders what it receives at random again.

Null texts have no bytes and the checksum of the empty text; null ids and
repeated rows are rows like others; an empty table gives an empty result; very long
texts only give their length and checksum.  Rows that are alike are numbered, and
which of them is which makes no difference.  Columns of a name that is added here
keep it, and the added one is called ``shard_`` and that name.
Only DataFrame functions touch rows; the driver draws the matrix of ``partitions``
times the number of shards.
"""

from __future__ import annotations

import json
import random
from math import exp, lgamma

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.scratch import Scratch


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """One draw by inversion that walks outwards from the mode; about a standard deviation of steps."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = max(low, min(high, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    peak = exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - peak
    left, p_left, right, p_right = mode, peak, mode, peak
    while u > 0 and (left > low or right < high):
        if right < high:
            p_right *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > low:
            p_left *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= p_left
            if u <= 0:
                return left
        if p_left < 1e-300 and p_right < 1e-300:
            break
    return mode


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts with these row and column sums, as a uniform permutation would give them."""
    rng, left, out = random.Random(seed), list(shards), []
    for n in rows:
        room, line = sum(left), []
        for s, m in enumerate(left):
            room -= m
            x = hypergeometric(rng, m, room, n)
            line.append(x)
            left[s] -= x
            n -= x
        out.append(line)
    return out


def _lookup(table: list[list[int]], row: Column) -> Column:
    return F.element_at(F.from_json(F.lit(json.dumps(table)), "array<array<bigint>>"), row + 1)


def _measures() -> tuple[Column, Column]:
    text = F.coalesce("text", F.lit(""))
    return (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")


def shard_rows(docs: DataFrame, scratch: Scratch, shards: int = 40, seed: int = 23, partitions: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row of docs(doc_id, text).

    ``partitions`` is the same at every size; a task orders one of them at a time.
    """
    key = ["doc_id", "size", "text_crc32"]
    # Repeated rows are numbered, so that they are permuted apart; which is which makes no difference.
    base = docs.select("doc_id", *_measures()).withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))))
    local, again = F.xxhash64(F.lit(seed), *key, "nth"), F.xxhash64(F.lit(seed + 1), *key, "nth")
    rows = scratch.write(base.withColumns({"local": local, "again": again}).drop("nth"), "rows")
    part = F.pmod(F.xxhash64("local"), F.lit(partitions)).cast("int")
    counted = {r["part"]: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}  # one row a partition
    counts = [counted.get(p, 0) for p in range(partitions)]
    total = sum(counts)
    matrix = communication_matrix(counts, [total // shards + (s < total % shards) for s in range(shards)], seed)
    ends = [[sum(line[: s + 1]) for s in range(shards)] for line in matrix]
    rank = F.row_number().over(Window.partitionBy("part").orderBy("local", *key))
    shard = F.size(F.filter(_lookup(ends, F.col("part")), lambda end: end < F.col("rank")))
    dealt = scratch.write(
        rows.withColumn("part", part).withColumn("rank", rank).select(*key, "again", shard.cast("int").alias("shard"))
        .withColumn("bin", F.pmod(F.xxhash64("again"), F.lit(partitions)).cast("int")),
        "dealt",
    )
    # A shard's order in two steps: hash bins counted first, then rows ordered within each bin.
    bins = dealt.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bins.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("again", *key))
    return dealt.withColumn("place", place).join(offsets, ["shard", "bin"]).select(*key, "shard", (F.col("offset") + F.col("place") - 1).alias("slot"))


def with_shards(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """The rows of docs, all columns, with size, text_crc32, shard and slot (a clashing name gets ``shard_`` before it).

    Repeats of a document are numbered on both sides of the join back, so each gets a place of its own.
    """
    own_names = {c.lower() for c in docs.columns}
    mark = "_shard"
    while any(c.startswith(mark) for c in own_names):
        mark = f"_{mark}"
    key = [f"{mark}_{k}" for k in ("id", "size", "crc")]
    ours = {k: f"{mark}_own{k}" for k in key}
    shard, slot, k_there, k_here = (f"{mark}_{c}" for c in ("shard", "slot", "k_there", "k_here"))
    placed = shard_rows(docs, scratch, **how).toDF(*key, shard, slot)
    copy = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    placed = placed.withColumn(k_there, copy(key, [shard, slot]))
    names = []
    for name in ("size", "text_crc32", "shard", "slot"):
        while name in own_names:
            name = f"shard_{name}"
        names.append(name)
    own = docs.select("*", F.col("doc_id").alias(ours[key[0]]), *(m.alias(ours[k]) for m, k in zip(_measures(), key[1:])))
    own = own.withColumn(k_here, copy(ours.values(), ["text"]))
    same = F.col(ours[key[0]]).eqNullSafe(F.col(key[0])) & (F.col(k_here) == F.col(k_there))
    for k in key[1:]:
        same &= F.col(ours[k]) == F.col(k)
    return own.join(placed, same).select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(c).alias(name) for c, name in zip((key[1], key[2], shard, slot), names)])
