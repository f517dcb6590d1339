"""Clusters of integer vectors by Lloyd's rounds with Hamerly's bounds, exact in every assignment."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import has_columns, new_folder, prepare

#: Components are below this, so that a squared distance of 64 of them fits in 64 bits; below ``_EXACT`` sums of products fit in a double.
LARGEST, _EXACT = 1 << 27, 1 << 22
#: By how much bounds give way, so that no rounding makes them false.
_GIVE = 1e-12
_STATE = "vec_id {kind}, q array<int>, cluster int, upper double, lower double, scanned boolean"


def quantised(vectors: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, q) of the vectors with exactly ``dims`` components, none null or non-finite: q is floor(scale * x)."""
    has_columns(vectors, "vec_id", "embedding")

    def component(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < LARGEST, F.floor(y).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact 64-bit distances")).cast("int"))

    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.select("vec_id", "embedding").where((F.size("embedding") == dims) & ~odd).select("vec_id", F.transform("embedding", component).alias("q"))


def first_centroids(vectors: DataFrame, k: int = 40, salt: str = "2:") -> np.ndarray:
    """The k vectors with the smallest sha256 of salt and id; ties by the vectors themselves, a null id as empty text."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances between all rows of x and of c."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), np.int64)
    if max(np.abs(x).max(), np.abs(c).max()) < _EXACT:
        dot = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        dot = x @ c.T
    return (x * x).sum(axis=1)[:, None] - 2 * dot + (c * c).sum(axis=1)


def own_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(axis=1)


class Round:
    """What the workers need for one assignment: centroids, how far each has moved since the last one, half the way to its nearest other."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None):
        self.now, self.first = now, before is None
        k = len(now)
        apart = squared(now, now).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        self.half = np.sqrt(apart.min(axis=1)) / 2 * (1 - _GIVE)
        self.moved = np.zeros(k) if before is None else np.sqrt(own_squared(now, before).astype(np.float64)) * (1 + _GIVE)
        ranked = np.argsort(-self.moved, kind="stable")
        self.others = np.full(k, self.moved[ranked[0]])
        self.others[ranked[0]] = self.moved[ranked[1]] if k > 1 else 0

    def assign(self, x, cluster, upper, lower):
        """(cluster, upper, lower, scanned) after this round; only vectors whose bounds don't decide are scanned."""
        scan = np.ones(len(x), bool)
        if not self.first:
            upper = np.nextafter(upper + self.moved[cluster], np.inf)
            lower = np.nextafter(lower - self.others[cluster], -np.inf)
            bar = np.maximum(lower, self.half[cluster])
            loose = np.flatnonzero(~(upper < bar))
            upper[loose] = np.sqrt(own_squared(x[loose], self.now[cluster[loose]]).astype(np.float64)) * (1 + _GIVE)
            scan = ~(upper < bar)
        rows = np.flatnonzero(scan)
        if len(rows):
            d = squared(x[rows], self.now)
            best = d.argmin(axis=1)  # the first of equals
            least = d[np.arange(len(rows)), best]
            d[np.arange(len(rows)), best] = np.iinfo(np.int64).max
            cluster[rows] = best
            upper[rows] = np.sqrt(least.astype(np.float64)) * (1 + _GIVE)
            lower[rows] = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - _GIVE) if d.shape[1] > 1 else np.inf
        return cluster, upper, lower, scan


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _assigned(batches, of: Round):
    for b in batches:
        x = _matrix(b.column(1), of.now.shape[1])
        if of.first:
            state = (np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x)))
        else:
            state = (b.column(2).to_numpy().astype(np.int64), np.array(b.column(3)), np.array(b.column(4)))
        cluster, upper, lower, scanned = of.assign(x, *state)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(scanned)], ["vec_id", "q", "cluster", "upper", "lower", "scanned"])


def _measured(batches, now: np.ndarray):
    for b in batches:
        cluster = b.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(own_squared(_matrix(b.column(1), now.shape[1]), now[cluster]))], ["vec_id", "cluster", "distance"])


def _means(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """The componentwise floor of each cluster's mean; sums are made by Spark, one row for each cluster comes back."""
    new = now.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("q")[i]) for i in range(now.shape[1]))).collect():
        new[r[0]] = [int(s) // r[1] for s in r[2:]]
    return new


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:", keep: bool = False):
    """(state, centroids): after ``rounds`` rounds of assigning and averaging and one more assignment.

    The state (vec_id, q, cluster, upper, lower, scanned) is a table in the shared folder, rewritten each round:
    upper bounds the distance to the own centroid, lower that to the second nearest, scanned says whether the
    last round needed all distances.  Centroids (bounded by k) pass through the driver.  Ties go to the smaller
    number; empty clusters keep their centroid.  Fewer than k vectors make fewer clusters, none an empty table.
    Vectors with another number of components, or a null or non-finite one, don't take part; a component of
    2^27 / scale or more is an error.  Repeated rows count as often as they occur, also among the first
    centroids; of centroids that are equal only the smallest number gets vectors.  ``keep`` leaves all rounds' tables.
    """
    spark = prepare(vectors.sparkSession)
    kind = dict(vectors.dtypes)["vec_id"]
    folder = new_folder(spark, "clusters")
    quantised(vectors, dims, scale).write.mode("overwrite").parquet(f"{folder}/vectors")
    state = spark.read.parquet(f"{folder}/vectors")
    now = first_centroids(state, k, salt)
    if not len(now):
        return spark.createDataFrame([], _STATE.format(kind=kind)), now.reshape(0, dims)
    before = None
    names = ["vectors", *(f"round-{i}" for i in range(rounds + 1))]
    for i, (last, name) in enumerate(pairwise(names)):
        of = Round(now, before)
        state.mapInArrow(lambda b, of=of: _assigned(b, of), _STATE.format(kind=kind)).write.mode("overwrite").parquet(f"{folder}/{name}")
        state = spark.read.parquet(f"{folder}/{name}")
        if not keep:
            _drop(spark, f"{folder}/{last}")
        if i < rounds:
            before, now = now, _means(state, now)
    return state, now


def clusters(vectors: DataFrame, **parameters) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) for each vector that takes part; see ``cluster``."""
    spark = vectors.sparkSession
    state, now = cluster(vectors, **parameters)
    kind = dict(vectors.dtypes)["vec_id"]
    own = state.mapInArrow(lambda b: _measured(b, now), f"vec_id {kind}, cluster int, distance long") if len(now) else state.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance"))
    sums = own.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    means = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(now)], "cluster int, centroid array<long>")
    by_cluster = means.join(F.broadcast(sums), "cluster").join(F.broadcast(total))  # at most k rows and one
    return own.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
