"""Clustering of integer vectors around centroids, with a table of pivot distances.

The first centroids serve as fixed pivots.  Every vector's exact squared distance
to every pivot is stored once, beside the vector.  In each round the distances
between centroids and pivots bound those between vectors and centroids from
below, |d(v, p) - d(c, p)| <= d(v, c).  A vector's centroid of least bound is
measured first; only centroids whose bound does not exceed that distance get an
exact one, in 64-bit integers.  The bounds give way by ``SLACK`` of what rounding
could do, so no nearest centroid is lost, ties included.

Rounds are scans of the stored table: each task returns a count and component
sums for its clusters, and only these are shuffled.

Odd rows: vectors that are null, of other length, or with null or non-finite
components are left out.  Components are limited to +-``REACH`` after scaling, so
that squared distances fit 64 bits.  Repeated rows are vectors of their own; equal
seeds are taken in the order of their components.  Rows without an id are kept
and seed last.  With fewer vectors than clusters each is a centroid; without any
the result is empty.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REACH = 1 << 27
SLACK = 1e-12


def integer_vectors(table: DataFrame, id_col: str, column: str, size: int, scale: float) -> DataFrame:
    """(id, v, seed): whole numbers floor(scale * x) of the valid vectors."""
    inside = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(
        column,
        lambda x: F.least(
            F.greatest(F.floor(F.lit(scale) * x.cast("double")), F.lit(-REACH)), F.lit(REACH)
        ).cast("int"),
    )
    return table.filter((F.size(column) == size) & inside).select(
        F.col(id_col).alias("id"), whole.alias("v"),
        F.sha2(F.concat(F.lit("1:"), F.col(id_col).cast("string")), 256).alias("seed"),
    )


def first_centroids(vectors: DataFrame, count: int) -> np.ndarray:
    """The vectors of smallest seed; only seeds are compared in the first scan."""
    order = F.asc_nulls_last("seed")
    seeds = [r["seed"] for r in vectors.select("seed").orderBy(order).limit(count).collect()]
    if len(seeds) == count and seeds[-1] is not None:
        vectors = vectors.filter(F.col("seed") <= seeds[-1])
    rows = vectors.select("v", "seed").orderBy(order, "v").limit(count).collect()
    return np.array([r["v"] for r in rows], np.int64)


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    apart = vectors - point
    return np.einsum("ij,ij->i", apart, apart)


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(vectors), len(pivots)), np.int64)
    for k, pivot in enumerate(pivots):
        out[:, k] = squared(vectors, pivot)
    return out


def lower_bounds(to_pivots: np.ndarray, centroid_pivots: np.ndarray) -> np.ndarray:
    """Least possible distance of every vector to every centroid, rounding allowed for."""
    a, b = np.sqrt(to_pivots), np.sqrt(centroid_pivots)
    bound = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        one, other = a[:, k, None], b[None, :, k]
        np.maximum(bound, np.abs(one - other) - SLACK * (one + other), out=bound)
    return bound


def nearest(
    vectors: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, centroid_pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid, and how many were measured."""
    bound = lower_bounds(to_pivots, centroid_pivots)
    first = bound.argmin(axis=1)
    apart = vectors - centroids[first]
    best, who = np.einsum("ij,ij->i", apart, apart), first.copy()
    measured = np.ones(len(vectors), np.int32)
    for k, centroid in enumerate(centroids):
        rows = np.flatnonzero((first != k) & (bound[:, k] ** 2 <= best * (1 + SLACK)))
        if not len(rows):
            continue
        distance = squared(vectors[rows], centroid)
        better = (distance < best[rows]) | ((distance == best[rows]) & (k < who[rows]))
        best[rows[better]], who[rows[better]] = distance[better], k
        measured[rows] += 1
    return who, best, measured


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), kind))


def stored(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, p): vectors with their distances to the pivots."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                distances = pivot_distances(matrix(batch.column("v")), pivots)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("v"), lists(distances, pa.int64())], ["id", "v", "p"]
                )

    kind = vectors.schema["id"].dataType
    schema = T.StructType().add("id", kind).add("v", T.ArrayType(T.IntegerType())).add("p", T.ArrayType(T.LongType()))
    return vectors.select("id", "v").mapInArrow(measure, schema)


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Every centroid's vectors, averaged and rounded down; centroids without any stay."""
    between = pivot_distances(centroids, pivots)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(centroids), np.int64)
        sums = np.zeros(centroids.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column("v"))
                who, _, _ = nearest(vectors, matrix(batch.column("p")), centroids, between)
                counts += np.bincount(who, minlength=len(centroids))
                np.add.at(sums, who, vectors)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(counts[used]), lists(sums[used], pa.int64())],
                ["cluster", "n", "sums"],
            )

    parts = table.select("v", "p").mapInArrow(summed, "cluster int, n bigint, sums array<bigint>")
    totals = (
        parts.select("cluster", "n", F.posexplode("sums").alias("place", "part"))
        .groupBy("cluster", "place")
        .agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
        .collect()
    )
    out = centroids.copy()
    for r in totals:
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return out


def assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(id, cluster, distance, measured) of every vector."""
    between = pivot_distances(centroids, pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = nearest(matrix(batch.column("v")), matrix(batch.column("p")), centroids, between)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), *(pa.array(x, t) for x, t in zip(found, (pa.int32(), pa.int64(), pa.int32())))],
                    ["id", "cluster", "distance", "measured"],
                )

    kind = table.schema["id"].dataType
    schema = T.StructType().add("id", kind).add("cluster", "integer").add("distance", "long").add("measured", "integer")
    return table.mapInArrow(assign, schema)


def pivot_clusters(
    embeddings: DataFrame, keep, id_col: str = "vec_id", column: str = "embedding",
    size: int = 64, scale: float = 64.0, clusters: int = 16, rounds: int = 3,
) -> tuple[DataFrame, np.ndarray]:
    """Clusters of all valid vectors, and the final centroids.

    Rows: id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and
    n_measured, the exact distances the last assignment took.  What the driver
    holds is ``clusters`` vectors and their sums.  Sums of distances that do not
    fit 64 bits are null.
    """
    vectors = integer_vectors(embeddings, id_col, column, size, scale)
    pivots = first_centroids(vectors, clusters)
    if not len(pivots):
        empty = vectors.select(F.col("id").alias(id_col), F.lit(0).alias("cluster")).limit(0)
        numbers = [F.lit(0).cast("long").alias(n) for n in ("distance", "cluster_inertia", "inertia")]
        return empty.select("*", *numbers, F.lit("").alias("centroid_sha256"), F.lit(0).alias("n_measured")), pivots
    table = keep(stored(vectors, pivots), "pivot_table")
    centroids = pivots
    for _ in range(rounds):
        centroids = moved(table, centroids, pivots)
    rows = keep(assigned(table, centroids, pivots), "assigned")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    inertia = {r["cluster"]: int(r["total"]) for r in sums.collect()}

    def per_cluster(values: list) -> Column:
        return F.get(F.array(*values), F.col("cluster"))

    def fitting(value: int) -> Column:
        return F.lit(value if value < 1 << 63 else None).cast("long")

    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    out = rows.select(
        F.col("id").alias(id_col), "cluster", "distance",
        per_cluster([fitting(inertia.get(k, 0)) for k in range(len(centroids))]).alias("cluster_inertia"),
        fitting(sum(inertia.values())).alias("inertia"),
        per_cluster([F.lit(d) for d in digests]).alias("centroid_sha256"),
        F.col("measured").alias("n_measured"),
    )
    return out, centroids
