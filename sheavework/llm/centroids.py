"""Centroid clustering of whole-number vectors with a pivot table (LAESA): lower bounds first, exact distances for the rest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import narrow, settle

PIVOTS = 8
LARGEST = 1 << 27  # components beyond it could overflow a 64-bit squared distance
BATCH = 4096  # vectors whose bounds against all centroids are held at a time


def whole_vectors(vectors: DataFrame, dim: int, scale: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, parts): floor(scale * x) of the vectors with exactly ``dim`` components, none null or non-finite."""
    plain = narrow(vectors, id_column, vector_column).toDF("vec_id", "vec").where(F.col("vec").isNotNull() & (F.size("vec") == dim))
    plain = plain.withColumn("vec", F.transform("vec", lambda x: x.cast("double")))
    good = plain.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # As double first: a number too large for a long must not become one by saturation.
    return good.select("vec_id", F.transform("vec", lambda x: F.floor(x * scale)).alias("parts"), F.array_max(F.transform("vec", lambda x: F.abs(x * scale))).alias("_reach"))


def starting_centroids(whole: DataFrame, k: int, label: str) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``label:vec_id``, in that order; equal ids in the order of their components."""
    named = whole.where("vec_id is not null").withColumn("_key", F.sha2(F.concat(F.lit(f"{label}:"), F.col("vec_id").cast("string")), 256))
    first = named.orderBy("_key", "parts").limit(k).collect()  # k vectors
    return np.array([r["parts"] for r in first], np.int64)


def chosen_pivots(centroids: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Of the starting centroids, those with the largest summed distance to the pivots taken before; fixed for all rounds."""
    n = min(n, len(centroids))
    apart = ((centroids[:, None, :] - centroids[None, :, :]).astype(np.float64) ** 2).sum(axis=2) ** 0.5
    taken, total = [0], apart[0].copy()
    while len(taken) < n:
        total[taken] = -1.0
        taken.append(int(np.argmax(total)))
        total += apart[taken[-1]]
    return centroids[taken]


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` to those of ``b`` (or to one row), as whole numbers."""
    apart = a - b
    return np.einsum("ij,ij->i", apart, apart)


def nearest_centroids(vectors: np.ndarray, table: np.ndarray, centroids: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of each vector's nearest centroid, ties to the smaller number, and the exact distances computed.

    ``table`` and ``to_pivots`` hold the distances of vectors and centroids to the pivots. Their difference at any pivot is a
    lower bound of the distance between vector and centroid, lowered by far more than the rounding of the roots. The
    centroid with the lowest bound is measured first; then each centroid is measured for the vectors that its bound
    does not rule out. A bound that equals the best distance does not rule out, so ties are seen.
    """
    rows = np.arange(len(vectors))
    bounds = np.zeros((len(vectors), len(centroids)))
    for p in range(table.shape[1]):
        np.maximum(bounds, np.abs(table[:, p, None] - to_pivots[None, :, p]), out=bounds)
    bounds -= 1e-9 * (1.0 + table.max(axis=1, initial=0.0)[:, None] + to_pivots.max(initial=0.0))
    best = np.argmin(bounds, axis=1)
    distance = exact_distances(vectors, centroids[best])
    limit = np.sqrt(distance) * (1.0 + 1e-12)
    computed = len(vectors)
    first = best.copy()
    for c, centroid in enumerate(centroids):
        open_rows = rows[(bounds[:, c] <= limit) & (first != c)]
        if not len(open_rows):
            continue
        seen = exact_distances(vectors[open_rows], centroid)
        computed += len(open_rows)
        better = (seen < distance[open_rows]) | ((seen == distance[open_rows]) & (c < best[open_rows]))
        won = open_rows[better]
        best[won], distance[won] = c, seen[better]
        limit[won] = np.sqrt(distance[won]) * (1.0 + 1e-12)
    return best, distance, computed


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            yield batch.slice(start, BATCH)


def pivot_table(whole: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, parts, pivots): each vector with its distances to the pivots, computed once and read in every round."""
    n, dim = pivots.shape

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts_of(batches):
            vectors = _numbers(batch.column(1), dim)
            table = np.sqrt(np.stack([exact_distances(vectors, p) for p in pivots], axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), n).cast(pa.list_(pa.float64()))], names=["vec_id", "parts", "pivots"]
            )

    return whole.select("vec_id", "parts").mapInArrow(measure, "vec_id long, parts array<long>, pivots array<double>")


def _assign(batch: pa.RecordBatch, centroids: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    vectors = _numbers(batch.column(1), centroids.shape[1])
    return vectors, *nearest_centroids(vectors, _numbers(batch.column(2), to_pivots.shape[1]), centroids, to_pivots)


def _round_sums(stored: DataFrame, centroids: np.ndarray, to_pivots: np.ndarray) -> DataFrame:
    """(cluster, place, total, n): a task adds up the vectors of each centroid, so only tasks x centroids x dim numbers move."""
    k, dim = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)

        def told() -> pa.RecordBatch:
            some = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(some, dim)), pa.array(np.tile(np.arange(dim), len(some))), pa.array(sums[some].ravel()), pa.array(np.repeat(counts[some], dim))],
                names=["cluster", "place", "total", "n"],
            )

        for batch in _parts_of(batches):
            vectors, best, _, _ = _assign(batch, centroids, to_pivots)
            np.add.at(sums, best, vectors)
            counts += np.bincount(best, minlength=k)
            if counts.sum() > 1 << 34:  # times LARGEST this still fits 64 bits
                yield told()
                sums[:], counts[:] = 0, 0
        yield told()

    told = stored.mapInArrow(add, "cluster long, place long, total long, n long")
    return told.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def pivot_distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([exact_distances(points, p) for p in pivots], axis=1))


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, label: str = "2", pivots: int = PIVOTS,
             id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each usable vector, and the final centroids as rows of whole numbers.

    Vectors become floor(scale * x); those of another length than ``dim``, null ones and those that hold null or non-finite
    components take no part. The first centroids are ``starting_centroids``; each round assigns every vector to its nearest
    centroid by exact squared distance (ties: smaller number) and puts every non-empty centroid at the floor of the exact
    mean. Rows count as often as they come; a null id is assigned like others and never starts a centroid. Fewer than
    ``k`` usable ids give fewer centroids; without any, or for an empty table, the result is empty. Other columns are ignored.
    A component beyond +-2**27 after scaling raises an error, as squared distances would not fit 64 bits.

    Distances to a few fixed pivots are stored once beside the vectors. A round reads that table, bounds all centroids
    from below, measures those that are left, and brings sums per task, centroid and component together; ``k * dim`` numbers
    reach the driver. No rows are shuffled, so equal vectors, however many, are no hot key.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, dim, scale, id_column, vector_column)
    whole = settle(whole, "whole-vectors")
    empty = spark.createDataFrame([], "vec_id long, cluster int, distance long")
    reach = whole.agg(F.max("_reach")).first()[0]
    if reach is None:
        return empty, np.zeros((0, dim), np.int64)
    if reach >= LARGEST:
        raise ValueError(f"a component is {reach:g} after scaling; squared distances hold up to {LARGEST}")
    centroids = starting_centroids(whole, k, label)
    if not len(centroids):
        return empty, np.zeros((0, dim), np.int64)
    fixed = chosen_pivots(centroids, pivots)
    stored = settle(pivot_table(whole, fixed), "pivot-table")
    for _ in range(rounds):
        for cluster, members in _means(_round_sums(stored, centroids, pivot_distances(centroids, fixed))).items():
            centroids[cluster] = members
    to_pivots = pivot_distances(centroids, fixed)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts_of(batches):
            _, best, distance, _ = _assign(batch, centroids, to_pivots)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return settle(stored.mapInArrow(last, "vec_id long, cluster int, distance long"), "clusters"), centroids


def _means(sums: DataFrame) -> dict[int, list[int]]:
    """The floor of the exact mean of every component of every non-empty cluster: k * dim numbers."""
    means: dict[int, dict[int, int]] = {}
    for r in sums.collect():
        means.setdefault(r["cluster"], {})[r["place"]] = int(r["total"]) // r["n"]
    return {c: [parts[i] for i in range(len(parts))] for c, parts in means.items()}


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia (distances summed over the cluster and over all) and centroid_sha256 of the final
    centroid's components as decimal numbers joined by commas."""
    spark = assigned.sparkSession
    if not len(centroids):
        none = F.lit(None)
        return assigned.select("*", none.cast("long").alias("cluster_inertia"), none.cast("long").alias("inertia"), none.cast("string").alias("centroid_sha256"))
    digests = [(c, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for c, row in enumerate(centroids)]
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # one row a centroid
    total = sum(int(r["s"]) for r in sums)
    own = {r["cluster"]: int(r["s"]) for r in sums}
    table = spark.createDataFrame([(c, own.get(c, 0), total, d) for c, d in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
