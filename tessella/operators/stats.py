"""Summaries, comparisons, ranking and sampling over object tables."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.scratch import Scratch


def percentiles(df: DataFrame, columns: Sequence[str], at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear percentiles, as ``<column>_p<percent>``; all of a column come from one count of its values."""
    all_ = df.groupBy(*by).agg(*[_percentiles(c, at).alias(f"_q_{c}") for c in columns])
    return all_.select(*by, *[F.col(f"`_q_{c}`")[i].alias(f"{c}_p{round(q * 100)}") for c in columns for i, q in enumerate(at)])


def _percentiles(column: str, at: Sequence[float]) -> Column:
    return F.percentile(f"`{column}`", F.array(*[F.lit(float(q)) for q in at]))


def column_summary(df: DataFrame, patterns: Sequence[str] = ("^corrected_density", "local"), by: Sequence[str] = ()) -> DataFrame:
    """Row count, mean and median of every column that a pattern fits (chosen at plan time)."""
    picked = [c for c in df.columns if any(re.search(p, c) for p in patterns)]
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in picked:
        aggs += [F.avg(f"`{c}`").alias(f"{c}_mean"), F.median(f"`{c}`").alias(f"{c}_median")]
    return df.groupBy(*by).agg(*aggs)


def describe(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    c = F.col(column)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))


def describe_each(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, n, mean, std, min, max): a row for each column, in one pass; nulls and NaN don't count."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("_x")
    rows = df.select(*by, pairs).select(*by, "_x.feature", F.when(~F.isnan("_x.v"), F.col("_x.v")).alias("v"))
    return rows.groupBy(*by, "feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def moments(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sums that add up over parts of a table: n and, per column, sum, sum of squares, least and largest value.

    Whole-number columns are summed as decimals, which are exact in any order.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        whole = df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long")
        v = F.col(c).cast("decimal(19,0)" if whole else "double")
        aggs += [F.count(c).alias(f"{c}_n"), F.sum(v).alias(f"{c}_sum"), F.sum(v * v).alias(f"{c}_sq"), F.min(v).cast("double").alias(f"{c}_min"), F.max(v).cast("double").alias(f"{c}_max")]
    return df.groupBy(*by).agg(*aggs)


def merged_moments(parts: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The parts' ``moments`` as one: n and, per column, sum, mean, sample deviation, least and largest value; nulls don't count."""
    aggs = [F.sum("n").alias("n")]
    for c in columns:
        aggs += [*[F.sum(f"{c}_{k}").alias(f"{c}_{k}") for k in ("n", "sum", "sq")], F.min(f"{c}_min").alias(f"{c}_min"), F.max(f"{c}_max").alias(f"{c}_max")]
    out = parts.groupBy(*by).agg(*aggs)
    for c in columns:
        n, total = F.col(f"{c}_n"), F.col(f"{c}_sum")
        spread = (n * F.col(f"{c}_sq") - total * total).cast("double")
        out = out.withColumns({f"{c}_mean": F.when(n > 0, total.cast("double") / n), f"{c}_std": F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n * (n - 1))))})
    return out.select(*by, "n", *[f"{c}_{k}" for c in columns for k in ("sum", "mean", "std", "min", "max")])


def size_filter(df: DataFrame, low: float | None, high: float | None, area: str | None = None) -> DataFrame:
    """Rows whose area is in the closed range; a bound that is 0 or None doesn't count."""
    area = area or next((c for c in ("area_px", "area", "Area") if c in df.columns), None)
    if area is None or not (low or high):
        return df
    if low:
        df = df.where(F.col(area) >= low)
    return df.where(F.col(area) <= high) if high else df


def size_filter_report(df: DataFrame, low: float, high: float, area: str, by: Sequence[str]) -> DataFrame:
    inside = F.col(area).between(low, high)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_before"), F.count_if(inside).alias("n_kept"), F.count_if(~inside).alias("n_removed"))


def group_profile(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """Per group: n, share of all rows in percent, mean and sample deviation of each feature."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in features:
        aggs += [F.avg(f).alias(f"{f}_mean"), F.stddev_samp(f).alias(f"{f}_std")]
    grouped = df.groupBy(group).agg(*aggs)
    total = grouped.agg(F.sum("n").alias("_all"))  # one row
    return grouped.crossJoin(F.broadcast(total)).withColumn("pct_total", 100 * F.col("n") / F.col("_all")).drop("_all")


def marker_profile(df: DataFrame, group: str, means: Sequence[str], markers: Sequence[str], positive: float = 0.15) -> DataFrame:
    """Per group: n, share, means, and each marker's mean and percent above ``positive``."""
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"{m}_mean") for m in means]]
    for m in markers:
        aggs += [F.avg(m).alias(f"{m}_mean"), (100 * F.avg((F.col(m) > positive).cast("int"))).alias(f"{m}_pct_positive")]
    grouped = df.groupBy(group).agg(*aggs)
    return grouped.crossJoin(F.broadcast(grouped.agg(F.sum("n").alias("_all")))).withColumn("pct_total", 100 * F.col("n") / F.col("_all")).drop("_all")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(bin, n): equal bins over a closed range; the last bin holds the upper bound."""
    c = F.col(column)
    place = F.least(F.floor((c - low) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(c.between(low, high)).groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density_grid(df: DataFrame, value: str, x: str, y: str, edge: float, by: Sequence[str] = ()) -> DataFrame:
    """Mean of a value on a square grid."""
    return df.groupBy(*by, F.floor(F.col(x) / edge).cast("int").alias("gx"), F.floor(F.col(y) / edge).cast("int").alias("gy")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def numbered(df: DataFrame, key: str, by: Sequence[str], name: str) -> DataFrame:
    """Rows with their place from 0 in their group, in order of ``key``, which is unique in a group.

    A group is dealt to ranges of its keys, so that no task sorts a whole one; only
    the ranges' counts, a row for each group and range, meet in one window.
    """
    ranged = Scratch(df.sparkSession, "numbered").write(df.repartitionByRange(*by, key).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_from"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = ranged.withColumn(name, F.row_number().over(Window.partitionBy(*by, "_range").orderBy(key)) - 1)
    same = F.col("_range") == F.col("_from")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return own.join(starts, same).withColumn(name, F.col(name) + F.col("_start")).select(*[F.col(f"`{c}`") for c in df.columns], name)


def every_nth(df: DataFrame, n: int, key: str, by: Sequence[str]) -> DataFrame:
    """Rows 0, n, 2n, ... of each group in order of the unique key."""
    return numbered(df, key, by, "_rn").where(F.col("_rn") % n == 0).drop("_rn")


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows by seeded hash order: the same rows on every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def zoom_region(df: DataFrame, value: str, n: int, key: str, largest: bool, x: str, y: str) -> DataFrame:
    """Median position of the n rows with the largest or smallest value."""
    order = F.desc(value) if largest else F.asc(value)
    return top(df, n, order, F.asc(key)).agg(F.median(x).alias("cx"), F.median(y).alias("cy"))


def count_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    n = a.agg(F.count(F.lit(1)).alias("n_a")).crossJoin(b.agg(F.count(F.lit(1)).alias("n_b")))  # one row each
    gap = F.abs(F.col("n_a") - F.col("n_b"))
    return n.select("n_a", "n_b", gap.alias("difference"), (gap / F.greatest("n_a", "n_b") * 100).alias("pct_difference"))


def agreement(nearest_ab: DataFrame, nearest_ba: DataFrame, within: float) -> DataFrame:
    """From (key, d2) tables: percent of each side with a partner nearer than ``within``, mean and median distance."""
    def side(df: DataFrame, s: str) -> DataFrame:
        d = F.sqrt("d2")
        return df.agg((100 * F.avg((d < within).cast("int"))).alias(f"pct_{s}"), F.avg(d).alias(f"mean_{s}"), F.median(d).alias(f"median_{s}"))

    return side(nearest_ab, "ab").crossJoin(side(nearest_ba, "ba"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    if t != t or df <= 0:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_test(df: DataFrame, group: str, a: str, b: str, features: Sequence[str], p_value: bool = True) -> DataFrame:
    """Per feature: means, deviations and the pooled two-sample t of group a against b, with its p."""
    stats = df.where(F.col(group).isin(a, b)).select(group, F.explode(F.create_map(*[v for f in features for v in (F.lit(f), F.col(f).cast("double"))])).alias("feature", "v"))
    pick = lambda g, agg: agg(F.when(F.col(group) == g, F.col("v")))
    wide = stats.groupBy("feature").agg(*[agg_(g, fn).alias(f"{n}_{s}") for g, s in ((a, "a"), (b, "b")) for n, fn, agg_ in (("n", F.count, lambda g, f: pick(g, f)), ("mean", F.avg, lambda g, f: pick(g, f)), ("var", F.var_samp, lambda g, f: pick(g, f)))])
    dof = F.col("n_a") + F.col("n_b") - 2
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / dof
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b")))
    out = wide.select("feature", "n_a", "n_b", "mean_a", "mean_b", F.sqrt("var_a").alias("std_a"), F.sqrt("var_b").alias("std_b"), t.alias("t"), dof.alias("dof"))
    if not p_value:
        return out

    @F.pandas_udf("double")
    def tail(t: pd.Series, dof: pd.Series) -> pd.Series:  # one row per feature
        return pd.Series([t_tail(x, d) for x, d in zip(t, dof)])

    return out.withColumn("p", tail("t", "dof"))


def ordinal(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values numbered from 0 in order, joined back."""
    values = numbered(df.select(column).where(F.col(column).isNotNull()).distinct(), column, (), name)
    return df.join(values.withColumn(name, F.col(name).cast("int")), column)


def report_text(row: DataFrame, title: str) -> DataFrame:
    """A one-row table as lines of ``name: value``."""
    parts = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("n/a"))) for c in row.columns]
    return row.select(F.concat_ws("\n", F.lit(title), *parts).alias("value"))


def markdown(df: DataFrame) -> DataFrame:
    """Rows as lines of a Markdown table (``markdown_head`` has its first two)."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def markdown_head(df: DataFrame) -> DataFrame:
    """The names and the rule of a Markdown table, in one row, for the lines of ``markdown`` to follow."""
    names = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return df.sparkSession.range(1).select(F.lit(names).alias("value"))


def marker_summary(df: DataFrame, by: Sequence[str] = (), high: float = 0.5) -> DataFrame:
    """Of patch intensities: mean and deviation, and objects whose positive share exceeds ``high``."""
    over = F.col("marker_positive_area_fraction") > high
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("marker_intensity_mean").alias("mean_intensity"), F.stddev_samp("marker_intensity_mean").alias("std_intensity"),
        F.count_if(over).alias("n_highly_positive"), (100 * F.avg(over.cast("int"))).alias("pct_highly_positive"),
    )


def positive_summary(df: DataFrame, flag: str, intensity: str, density: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives in number and percent, their intensity, and the distribution of a local density."""
    names = ["density_median", "density_p10", "density_p90"]
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag).cast("long").alias("n_positive"), (100 * F.avg(flag)).alias("pct_positive"), F.avg(intensity).alias("mean_intensity"),
        F.stddev_samp(intensity).alias("std_intensity"), F.avg(density).alias("density_mean"), _percentiles(density, [0.5, 0.1, 0.9]).alias("_q"),
    )
    return sums.withColumns({n: F.col("_q")[i] for i, n in enumerate(names)}).drop("_q")


def filament_summary(filaments: DataFrame, topology: DataFrame, area_px: DataFrame, mpp: float) -> DataFrame:
    """One row from filaments, skeleton topology (skeleton_px, endpoints, branches) and areas (positive_px, total_px)."""
    n = filaments.agg(F.count(F.lit(1)).alias("n_filaments"), F.coalesce(F.avg("length_um"), F.lit(0.0)).alias("mean_length_um"))
    t = topology.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("skeleton_px", "endpoints", "branches")])
    out = n.crossJoin(t).crossJoin(area_px)  # one row each
    share = F.when(F.col("total_px") > 0, F.col("positive_px") / F.col("total_px")).otherwise(F.lit(0.0))
    return out.withColumns({"area_fraction": share, "skeleton_length_um": F.col("skeleton_px") * mpp})


def column_check(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(column, present, mean, min, max) of columns that a table should have."""
    have = set(df.columns)
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in have).alias("present"), *[(f(c) if c in have else F.lit(None)).cast("double").alias(s) for s, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]) for c in wanted]).alias("r"))
    return row.select(F.inline("r"))


def first_seen(df: DataFrame, column: str, order: str) -> DataFrame:
    """(column, first) of every value in the order in which values first come; values are few."""
    return df.groupBy(column).agg(F.min(order).alias("first")).orderBy("first", column)


def common_features(a: DataFrame, b: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns of both tables, in the first one's order (decided at plan time)."""
    return [c for c in a.columns if c in set(b.columns) and c not in exclude]


def limited_features(columns: Sequence[str], limits: dict[str, int]) -> list[str]:
    """The columns without those that fit a pattern beyond its first n, in their order."""
    seen = dict.fromkeys(limits, 0)
    out = []
    for c in columns:
        fits = [p for p in limits if re.search(p, c)]
        for p in fits:
            seen[p] += 1
        if all(seen[p] <= limits[p] for p in fits):
            out.append(c)
    return out
