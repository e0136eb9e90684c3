"""Centroid clustering in exact integers, by a tournament of bisectors.

Components become integers floor(scale * x). For centroids a and b with a < b
a vector v is nearer to b only where 2 (b - a) . v > |b|^2 - |a|^2, so the
normal 2 (b - a) and the threshold on the right are made once for every pair
and round. A vector then plays k - 1 linear sign tests: the winner so far
meets the next centroid, and a zero leaves the smaller number in. Only the
distance to the last winner is computed in full.

A round is one pass over the staged integers: every task adds up its vectors
by cluster and hands k rows of sums to Spark, which adds those; k * dims sums
reach the driver. Nothing else is collected, and every pass is a pure function
of the staged table, so lost executors cost only their tasks.

Vectors with another number of components, or with a null or non-finite one,
take no part. Rows without an id take part but never start a centroid; repeated
rows count as often as they occur, and equal start digests are ordered by the
vectors. Fewer vectors than k make as many centroids as there are vectors; an
empty table has an empty result. Integers beyond a long count as its ends; a
distance or an inertia beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

#: Up to this size products, distances and their sums over 64 components stay below 2**63.
SMALL = 1 << 27
LONG = 1 << 63


def quantised(vectors: DataFrame, *, dims: int, scale: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors with ``dims`` finite components; v are integers."""
    x = F.col(embedding)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(F.when(x.isNotNull() & (F.size(x) == dims), finite).otherwise(False))
    return kept.select(F.col(vec_id).alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


class Tournament:
    """The pairs' normals and thresholds of some centroids."""

    def __init__(self, centroids: list[list[int]]) -> None:
        self.wide = any(abs(x) > SMALL for c in centroids for x in c)
        self.centroids = np.array(centroids, dtype=object if self.wide else np.int64)
        norms = (self.centroids * self.centroids).sum(1)
        self.normals = 2 * (self.centroids[None, :, :] - self.centroids[:, None, :])
        self.thresholds = norms[None, :] - norms[:, None]

    def winners(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row, the smaller number on ties, and the squared distance to it."""
        if self.wide or (v.size and max(int(v.max()), -int(v.min())) > SMALL):
            v = v.astype(object)
        best = np.zeros(len(v), dtype=np.int64)
        for rival in range(1, len(self.centroids)):
            side = (v * self.normals[best, rival]).sum(1) - self.thresholds[best, rival]
            best[(side > 0).astype(bool)] = rival
        gap = v - self.centroids[best]
        return best, (gap * gap).sum(1)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def summing(rivals: Tournament, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's vectors, the count and the component sums of each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(rivals.centroids)
        counts, sums = [0] * k, np.zeros((k, dims), dtype=object)
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"), dims)
                best, _ = rivals.winners(v)
                large = max(int(v.max()), -int(v.min())) > SMALL
                for c in np.unique(best):
                    own = v[best == c]
                    counts[c] += len(own)
                    sums[c] += (own.astype(object) if large else own).sum(0).astype(object)
        held = [c for c in range(k) if counts[c]]
        flat = pa.array([int(x) for c in held for x in sums[c]], pa.decimal128(38, 0))
        lists = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, dims), pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([counts[c] for c in held], pa.int64()), lists], names=["cluster", "n", "sums"])

    return run


def assigning(rivals: Tournament, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, far = rivals.winners(matrix(batch.column("v"), dims))
                longs = pa.array([int(x) if x < LONG else None for x in far], pa.int64()) if far.dtype == object else pa.array(far, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), longs], names=["vec_id", "cluster", "distance"])

    return run


def moved(table: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: the floor of each cluster's mean; an empty cluster's stays."""
    dims = len(centroids[0])
    parts = table.select("v").mapInArrow(summing(Tournament(centroids), dims), "cluster int, n bigint, sums array<decimal(38,0)>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("place", "part"))
    sums = each.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect()  # k * dims rows
    out = [list(c) for c in centroids]
    for r in sums:
        out[r.cluster][r.place] = int(r.total) // r.n
    return out


def starts(table: DataFrame, k: int, order: Callable[[Column], Column]) -> list[list[int]]:
    """The k vectors whose ids come first in ``order``."""
    first = table.select(order(F.col("vec_id")).alias("o"), "v").orderBy(F.col("o").asc_nulls_last(), "v").limit(k)
    return [list(r.v) for r in first.collect()]


def digest_order(prefix: str) -> Callable[[Column], Column]:
    return lambda vec_id: F.sha2(F.concat(F.lit(prefix), vec_id.cast("string")).cast("binary"), 256)


def cluster(vectors: DataFrame, *, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, start: str = "3:", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    table = staged(quantised(vectors, dims=dims, scale=scale, vec_id=vec_id, embedding=embedding), "bisector-vectors")
    centroids = starts(table, k, digest_order(start))
    kind = table.schema["vec_id"].dataType.simpleString()
    if not centroids:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    for _ in range(rounds):
        after = moved(table, centroids)
        if after == centroids:  # every further round would repeat this one
            break
        centroids = after
    found = staged(table.mapInArrow(assigning(Tournament(centroids), dims), f"vec_id {kind}, cluster int, distance bigint"), "bisector-clusters")
    sums = {r.cluster: r for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), (F.count("distance") == F.count(F.lit(1))).alias("known")).collect()}  # k rows
    fits = lambda x: x if x is not None and x < LONG else None
    own = {c: int(r.total) if r.known else None for c, r in sums.items()}
    whole = None if None in own.values() else sum(own.values())
    rows = [(c, fits(own[c]), fits(whole), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in own]
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
