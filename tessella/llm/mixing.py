"""Mixing sources to target weights by subset-sum budget fitting.

Targets: sources share a budget by weight; a target stops at ``most`` times its
source's size and the excess is shared again among the others (water filling).
Fitting: a source takes whole passes while they fit; for the remaining budget,
documents are counted by exact length, every length gives its even share, and
a bounded knapsack over lengths closes the gap.  Which documents of a length
are taken follows a seeded hash, so reruns agree.

Null texts have no words, null sources are one source that sorts last, an empty
table gives an empty result, and repeated rows count as rows of their own, each
with its own copies.  Ties of the hash are broken by doc_id; rows that are alike in
doc_id, text and source are numbered, and which of them is taken makes no difference.
Only doc_id, text and source are read; ``repeat_documents`` passes all columns on,
whatever their names but those that begin with _mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.scratch import Scratch
from tessella.llm.text import word_count

#: The gap, in words, that the knapsack closes over all lengths that fit in it, and hash buckets that split a length.
GAP, BUCKETS = 16_384, 256


def source_targets(totals: DataFrame, weights: list[int], budget: float, most: float) -> DataFrame:
    """``totals(skey, source_size)`` with targets.

    The window runs over one row per source, the only table without a key here.
    """
    order = Window.orderBy("skey")
    weighted = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    filled = Window.orderBy(F.col("source_size") / F.col("w"), "skey")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cap = most * F.col("source_size")
    stepped = (
        weighted.withColumn("budget", budget * F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("open_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open_w"))
    )
    # The water level is the first one, in this order, that its own source's cap doesn't fall below.
    level = F.min(F.when(F.col("level") * F.col("w") <= cap, F.struct("pos", "level"))).over(everything)["level"]
    return stepped.withColumn("pos", F.row_number().over(filled)).withColumn("water", level).select(
        "skey", "source_size", F.coalesce(F.least(cap, F.col("water") * F.col("w")), cap, F.lit(0.0)).cast("double").alias("target")
    )


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near under the budget as can be."""
    order = np.argsort(-lengths)
    size, have = lengths[order].astype(object), counts[order].astype(object)
    total = int((size * have).sum())
    take = np.array([int(c) * budget // total for c in have], dtype=object) if total else have * 0
    rest = budget - int((size * take).sum())
    for i, l in enumerate(size):  # the rounding of every length, largest first, down to the gap
        if rest <= GAP:
            break
        if l and (n := min(have[i] - take[i], (rest - GAP // 2) // l)) > 0:
            take[i] += n
            rest -= n * l
    reach, seen = 1, []
    for i in range(len(size) - 1, -1, -1):  # bounded knapsack: each length's multiples in binary parts, reachable sums as a bit set
        if reach >> rest & 1:
            break
        if not 0 < size[i] <= rest or have[i] <= take[i]:
            continue
        seen.append((i, reach))
        left, part = min(int(have[i] - take[i]), int(rest // size[i])), 1
        while left:
            n = min(part, left)
            reach |= (reach << int(n * size[i])) & ((1 << (rest + 1)) - 1)
            left, part = left - n, part * 2
    at = reach.bit_length() - 1
    for i, before in reversed(seen):
        while not before >> at & 1:
            take[i] += 1
            at -= int(size[i])
    out = np.zeros(len(size), dtype=np.int64)
    out[order] = take.astype(np.int64)
    return out


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    passes = int(target // total) if total else 0
    rest = max(0, min(round(target - passes * total), total))
    extra = fit_lengths(group["size"].to_numpy(), group["n"].to_numpy(), rest)
    return pd.DataFrame({"skey": group["skey"], "size": group["size"], "passes": passes, "extra": extra})


def _source_key() -> Column:
    """Sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1"))


def mix_sources(docs: DataFrame, scratch: Scratch, weights: list[int] = [5, 2, 1], budget: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target and taken words, copies, source key and hash for every row of docs(doc_id, text, source)."""
    rows = scratch.write(
        docs.select(
            "doc_id", _source_key().alias("skey"), word_count(F.col("text")).alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"),
        ),
        "rows",
    )
    totals = rows.groupBy("skey").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, budget, most)
    lengths = rows.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n"))
    plan = scratch.write(
        lengths.join(targets, "skey").groupBy("skey").applyInPandas(_fit, "skey string, size long, passes long, extra long"), "plan"
    )
    # The rank of a document among those of its source and length, in two steps:
    # hash buckets counted first, so that one hot length is ranked by many tasks.
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    before = Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("skey", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).join(plan, ["skey", "size"]).drop("n")
    )
    rank = F.row_number().over(Window.partitionBy("skey", "size", "bucket").orderBy("h", "doc_id")) + F.col("offset")
    return (
        rows.join(offsets, ["skey", "size", "bucket"]).withColumn("copies", F.col("passes") + (rank <= F.col("extra")).cast("long"))
        .join(targets, "skey").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "skey", "h")
    )


def repeat_documents(docs: DataFrame, scratch: Scratch, seed: int = 11, **how) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it.

    Decisions are joined back by id, source and text hash; rows alike in these are numbered on both sides, so each gets its own.
    """
    key = ["_mix_id", "_mix_source", "_mix_h"]
    nth = lambda *order: F.row_number().over(Window.partitionBy(*key).orderBy(*order)).alias("_mix_nth")
    mixed = mix_sources(docs, scratch, seed=seed, **how).select(F.col("doc_id").alias(key[0]), F.col("skey").alias(key[1]), F.col("h").alias(key[2]), F.col("copies").alias("_mix_n"))
    copies = mixed.select("*", nth(F.desc("_mix_n"))).where("_mix_n > 0").withColumnsRenamed({c: f"{c}_" for c in [*key, "_mix_nth"]})
    own = docs.withColumns({key[0]: F.col("doc_id"), key[1]: _source_key(), key[2]: F.xxhash64(F.lit(seed), "doc_id", "text")}).select("*", nth(F.lit(1)))
    same = F.col(key[0]).eqNullSafe(F.col(f"{key[0]}_"))
    for c in [*key[1:], "_mix_nth"]:
        same &= F.col(c) == F.col(f"{c}_")
    joined = own.join(copies, same)
    return joined.withColumn("_mix_k", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).select(*[F.col(f"`{c}`") for c in docs.columns])
