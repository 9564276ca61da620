"""Scaling, projection, clustering and embedding over feature columns.

Statistics are SQL aggregates and models are Spark ML's where it has them.
What Spark lacks here (BIRCH) keeps only bounded summaries outside the executors.
Density clustering is in ``density``, layouts are in ``manifold``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.scratch import Scratch


def select_features(df: DataFrame, wanted: Sequence[str], fallback: Sequence[str] = ()) -> list[str]:
    """The wanted columns that exist; else the fallback's (decided at plan time)."""
    have = set(df.columns)
    return [c for c in wanted if c in have] or [c for c in fallback if c in have]


def standardize(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """Zero mean and unit population deviation; constant columns become 0.  The statistics are one row."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    scaled = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0))
    joined = df.crossJoin(F.broadcast(stats)).withColumns({c + suffix: scaled(c) for c in columns})
    return joined.drop(*[f"_{k}_{c}" for k in "ms" for c in columns])


def unpack(df: DataFrame, array: str, n: int, prefix: str = "f") -> tuple[DataFrame, list[str]]:
    """An array column as n double columns."""
    names = [f"{prefix}{i}" for i in range(n)]
    return df.withColumns({c: F.get(array, F.lit(i)).cast("double") for i, c in enumerate(names)}), names


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """One vector per row; nulls and NaN as 0."""
    clean = df.withColumns({f"_v_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=[f"_v_{c}" for c in columns], outputCol=out).transform(clean).drop(*[f"_v_{c}" for c in columns])


def pca(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """Adds ``pca`` (array) of centred features; as they are if there are no more than k.

    Signs are fixed so that each component's largest loading is positive.
    """
    scaled = assemble(standardize(df, columns), columns, "_x")
    if len(columns) <= k:
        return scaled.withColumn("pca", vector_to_array("_x")).drop("_x")
    model = PCA(k=k, inputCol="_x", outputCol="_p").fit(scaled)
    loadings = model.pc.toArray()
    sign = np.sign(loadings[np.abs(loadings).argmax(axis=0), range(k)])
    fixed = F.transform(vector_to_array("_p"), lambda v, i: v * F.element_at(F.array(*[F.lit(float(s)) for s in sign]), i + 1))
    return model.transform(scaled).withColumn("pca", fixed).drop("_x", "_p")


def kmeans(df: DataFrame, columns: Sequence[str], k: int, seeds: int = 10, seed: int = 42, label: str = "cluster") -> tuple[DataFrame, KMeansModel]:
    """The best of several seeded runs, by cost."""
    data = assemble(df, columns, "_x").persist()
    models = [KMeans(k=k, seed=seed + s, featuresCol="_x", predictionCol=label, maxIter=50).fit(data) for s in range(seeds)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    data.unpersist()
    return best.transform(assemble(df, columns, "_x")).drop("_x"), best


class ClusterFeatures:
    """Counts, sums and sums of squares of sub-clusters no wider than a threshold; merged until at most ``most`` are left."""

    def __init__(self, threshold: float, most: int):
        self.threshold, self.most = threshold, most
        self.n = self.s = self.q = None

    def add(self, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> None:
        for i in range(len(n)):
            self._one(n[i], s[i], q[i])

    def _one(self, n: float, s: np.ndarray, q: float) -> None:
        if self.n is None:
            self.n, self.s, self.q = np.array([n]), s[None].copy(), np.array([q])
            return
        at = int((((self.s / self.n[:, None]) - s / n) ** 2).sum(axis=1).argmin())
        nn, ss, qq = self.n[at] + n, self.s[at] + s, self.q[at] + q
        if max(0.0, qq / nn - ((ss / nn) ** 2).sum()) ** 0.5 <= self.threshold:
            self.n[at], self.s[at], self.q[at] = nn, ss, qq
            return
        self.n, self.s, self.q = np.append(self.n, n), np.vstack([self.s, s]), np.append(self.q, q)
        if len(self.n) > self.most:
            self.threshold *= 1.5
            n0, s0, q0 = self.n, self.s, self.q
            self.n = None
            self.add(n0, s0, q0)


def _agglomerate(n: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Ward's method on weighted centroids."""
    label, n, c = np.arange(len(n)), n.astype(float).copy(), c.copy()
    live = list(range(len(n)))
    cost = lambda i, js: n[i] * n[js] / (n[i] + n[js]) * ((c[i] - c[js]) ** 2).sum(axis=1)
    while len(live) > k:
        idx = np.array(live)
        d = np.array([np.where(idx == i, np.inf, cost(i, idx)) for i in idx])
        a, b = (int(idx[x]) for x in np.unravel_index(d.argmin(), d.shape))
        c[a] = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b])
        n[a] += n[b]
        label[label == label[b]] = label[a]
        live.remove(b)
    return np.unique(label, return_inverse=True)[1]


def birch(df: DataFrame, columns: Sequence[str], k: int, threshold: float = 0.5, label: str = "cluster", most: int = 256) -> DataFrame:
    """BIRCH: each partition reduces its rows to clustering features, at most ``most``; their union is agglomerated to k.

    Features of partitions are merged in one bounded step (partitions times ``most`` rows), rows are then assigned to the nearest centroid.
    """
    width = len(columns)
    data = assemble(df, columns, "_x").withColumn("_a", vector_to_array("_x")).drop("_x")

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cf = ClusterFeatures(threshold, most)
        for b in batches:
            x = np.array(b["_a"].tolist(), float).reshape(-1, width)
            cf.add(np.ones(len(x)), x, (x**2).sum(axis=1))
        if cf.n is not None:
            yield pd.DataFrame({"n": cf.n, "s": list(cf.s), "q": cf.q})

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        cf = ClusterFeatures(threshold, most)
        g = g.sort_values(["n", "q"], ascending=False)
        cf.add(g["n"].to_numpy(), np.array(g["s"].tolist()), g["q"].to_numpy())
        return pd.DataFrame({"n": cf.n, "s": list(cf.s), "q": cf.q})

    schema = "n double, s array<double>, q double"
    small = data.select("_a").mapInPandas(reduce, schema)
    rows = small.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(merge, schema).toPandas()  # at most ``most`` rows
    if not len(rows):
        return df.withColumn(label, F.lit(None).cast("int"))
    n, centre = rows["n"].to_numpy(), np.array(rows["s"].tolist()) / rows["n"].to_numpy()[:, None]
    return data.withColumn(label, _nearest(F.col("_a"), centre, _agglomerate(n, centre, k))).drop("_a")


def _nearest(x: Column, centres: np.ndarray, labels: np.ndarray) -> Column:
    @F.pandas_udf("int")
    def assign(s: pd.Series) -> pd.Series:
        v = np.array(s.tolist(), float)
        d = (v**2).sum(1)[:, None] - 2 * v @ centres.T + (centres**2).sum(1)
        return pd.Series(labels[d.argmin(axis=1)].astype(np.int32))

    return assign(x)


def _by_group(batch: pa.RecordBatch, cluster: str, width: int) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """(cluster, places, vectors) of a batch's rows of each cluster, without a Python object for each number."""
    x = batch["_a"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    code = batch[cluster].dictionary_encode()
    at = code.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(at, kind="stable")
    for c, own in zip(code.dictionary.to_pylist(), np.split(order, np.cumsum(np.bincount(at, minlength=len(code.dictionary)))[:-1])):
        yield c, own, x[own]


def _distances(x: np.ndarray, grid: np.ndarray) -> np.ndarray:
    return np.stack([((x - g) ** 2).sum(axis=1) for g in grid], axis=1)


def _sub_sums(batches: Iterator[pa.RecordBatch], cluster: str, width: int, centres: dict, only: set) -> Iterator[pa.RecordBatch]:
    """One row of counts and sums for each sub-cluster that a task's rows have."""
    sums: dict = {}
    kind = None
    for batch in batches:
        kind = batch.schema.field(cluster).type
        for c, _, x in _by_group(batch, cluster, width):
            if c in only:
                k = len(centres[c])
                own = _distances(x, centres[c]).argmin(axis=1)
                n, s = sums.setdefault(c, (np.zeros(k, np.int64), np.zeros((k, width))))
                n += np.bincount(own, minlength=k)
                for j in range(k):
                    s[j] += x[own == j].sum(axis=0)
    rows = [(c, j, n[j], s[j]) for c, (n, s) in sums.items() for j in range(len(n)) if n[j]]
    if rows:
        c, j, n, s = zip(*rows)
        yield pa.record_batch({cluster: pa.array(c, kind), "_j": pa.array(j, pa.int32()), "_n": pa.array(n, pa.int64())} | {f"_s{i}": v for i, v in enumerate(np.array(s).T.copy())})


def hierarchical_labels(df: DataFrame, columns: Sequence[str], cluster: str, key: str, most: int = 4, seed: int = 42, rounds: int = 50) -> DataFrame:
    """(key, cluster_hierarchical): each cluster's rows in at most four sub-clusters, as ``3b``; clusters under ``most`` rows are all ``a``.

    Centroids are fitted on all rows of a cluster: k-means++ draws by hash, then
    Lloyd rounds.  Each round sends only sums to the driver, a row per sub-cluster.
    """
    spark, width = df.sparkSession, len(columns)
    scratch = Scratch(spark, "hierarchy")
    data = scratch.write(assemble(df, columns, "_x").where(F.col(cluster).isNotNull()).select(key, cluster, vector_to_array("_x").alias("_a")).repartition(key), "rows")  # dealt anew, as a task reads a row group whole
    kind, out = df.schema[cluster], T.ArrayType(T.DoubleType())
    draws = T.StructType([kind, T.StructField("_e", T.DoubleType()), T.StructField("_a", out), T.StructField("_n", T.LongType())])
    sums = T.StructType([kind, T.StructField("_j", T.IntegerType()), T.StructField("_n", T.LongType()), *[T.StructField(f"_s{i}", T.DoubleType()) for i in range(width)]])
    centres: dict = {}

    def drawn(grids, step: int) -> dict:
        """Per cluster a row drawn by its squared distance to the nearest centre (any row where there is none), and how many rows there are."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                u, rows = b["_u"].to_numpy(), []
                for c, own, x in _by_group(b, cluster, width):
                    d = _distances(x, grids.value[c]).min(axis=1) if c in grids.value else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        e = -np.log(u[own]) / d
                    at = int(e.argmin())
                    rows.append((c, e[at], x[at], len(x)))
                if rows:
                    c, e, x, n = zip(*rows)
                    yield pa.record_batch({cluster: pa.array(c, b.schema.field(cluster).type), "_e": pa.array(e), "_a": pa.array([v.tolist() for v in x], pa.list_(pa.float64())), "_n": pa.array(n, pa.int64())})

        u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed + step)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        found = data.withColumn("_u", u).select(cluster, "_a", "_u").mapInArrow(run, draws)
        best = found.groupBy(cluster).agg(F.min_by("_a", F.struct("_e", "_a")).alias("_a"), F.min("_e").alias("_e"), F.sum("_n").alias("_n"))
        return {r[cluster]: r for r in best.collect()}

    for step in range(most):
        grids = spark.sparkContext.broadcast(dict(centres))
        for c, r in drawn(grids, step).items():
            if c not in centres:
                centres[c] = np.array([r["_a"]])
            elif r["_n"] >= most and np.isfinite(r["_e"]):
                centres[c] = np.vstack([centres[c], r["_a"]])

    def summed(grids, only: set) -> dict:
        names = [f"_s{i}" for i in range(width)]
        rows = data.select(cluster, "_a").mapInArrow(lambda batches: _sub_sums(batches, cluster, width, grids.value, only), sums)
        rows = rows.groupBy(cluster, "_j").agg(F.sum("_n").alias("_n"), *[F.sum(n).alias(n) for n in names])
        return {(r[cluster], r["_j"]): np.array([r[n] for n in names]) / r["_n"] for r in rows.collect()}

    moving = set(centres)
    for _ in range(rounds):
        if not moving:
            break
        found = summed(spark.sparkContext.broadcast(dict(centres)), moving)
        for c in list(moving):
            new = np.array([found.get((c, j), old) for j, old in enumerate(centres[c])])
            if np.allclose(new, centres[c]):
                moving.remove(c)
            centres[c] = new
    final = spark.sparkContext.broadcast(centres)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            letter = np.zeros(b.num_rows, np.int64)
            for c, own, x in _by_group(b, cluster, width):
                letter[own] = _distances(x, final.value[c]).argmin(axis=1)
            yield pa.record_batch({key: b[key], cluster: b[cluster], "_l": pa.array([chr(ord("a") + i) for i in letter])})

    lettered = data.mapInArrow(label, T.StructType([df.schema[key], kind, T.StructField("_l", T.StringType())]))
    return lettered.select(key, F.concat(F.col(cluster).cast("string"), "_l").alias("cluster_hierarchical"))


def centroids(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])


def save_model(model, path: str) -> None:
    """Any Spark ML model, replacing what is there."""
    model.write().overwrite().save(path)


def load_model(kind: type, path: str):
    """A saved model of a class; a path without one raises."""
    return kind.load(path)
