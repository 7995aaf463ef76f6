"""A stored cell index: vectors as an inverted file on disk, partitioned by k-means cell, with its centroids beside them.

    index = StoredCells.build(vectors, path, dim=1024, cells=4096)
    index = StoredCells.open(spark, path)        # in another session
    index.add(more)                              # placed by the saved centroids, nothing is fitted again
    hits = index.search(queries, k=6, nprobe=32) # reads the folders of the probed cells only

Centroids are whole numbers: vectors are scaled and floored, means are floors of exact sums, distances are exact. So any
engine, and any order of the rows, comes to the same cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spread import first_n, settled
from .vectors import QUERY_BYTES, RunningBest, _matrix, _rank, _usable, _valid, hit_schema, in_passes

SCALE = 1 << 15  # unit vectors become numbers of 16 bits and a sign, exact in double precision up to a squared distance of 2**53
CENTROID_BYTES = 256 << 20  # every task holds all centroids
SCORES = 1 << 22  # distances held at a time
FILE_ROWS = 1 << 18  # rows of a cell that one file holds, about


def whole(matrix: np.ndarray) -> np.ndarray:
    """Scaled and floored, as doubles that hold whole numbers."""
    return np.floor(matrix * SCALE)


def nearest_cells(points: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each point by exact squared distance, nearest first, ties to the smaller number."""
    found = np.empty((len(points), n), np.int32)
    own = (centroids * centroids).sum(axis=1)
    step = max(1, SCORES // len(centroids))
    for start in range(0, len(points), step):
        distance = own[None, :] - 2.0 * (points[start : start + step] @ centroids.T)
        if n == 1:
            found[start : start + step, 0] = distance.argmin(axis=1)
        else:
            found[start : start + step] = np.argsort(distance, axis=1, kind="stable")[:, :n]
    return found


def fit_centroids(vectors: DataFrame, dim: int, cells: int, rounds: int) -> np.ndarray:
    """k-means over all vectors (chunk_id, embedding): starts at those with the smallest MD5 of their id, ``rounds`` passes.

    A pass is map-only up to sums per task, cell and component. Empty cells stay where they are.
    """
    if cells * dim * 8 > CENTROID_BYTES:
        raise ValueError(f"{cells} centroids of {dim} numbers do not fit {CENTROID_BYTES} bytes")
    first = vectors.orderBy(F.md5(F.col("chunk_id").cast("string").cast("binary")), "chunk_id").limit(cells).select("embedding").toArrow()
    centroids = whole(_matrix(first.column("embedding"), dim))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                points = whole(_matrix(batch.column("embedding"), dim))
                cell = nearest_cells(points, centroids, 1)[:, 0]
                np.add.at(sums, cell, points)
                counts += np.bincount(cell, minlength=len(centroids))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, dim)), pa.array(np.tile(np.arange(dim), len(some))), pa.array(sums[some].ravel().astype(np.int64)), pa.array(np.repeat(counts[some], dim))],
            names=["cell", "place", "total", "n"],
        )

    for _ in range(rounds):
        told = vectors.mapInArrow(add, "cell long, place long, total long, n long").groupBy("cell", "place")
        sums = told.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        moved = centroids.copy()
        for r in sums.toLocalIterator():  # cells x dim numbers
            moved[r["cell"], r["place"]] = int(r["total"]) // r["n"]
        centroids = moved
    return centroids


class StoredCells:
    """The index at ``root``: folders ``lists/cell=<n>`` of (chunk_id, embedding), and ``centroids``."""

    def __init__(self, spark: SparkSession, root: str, centroids: np.ndarray) -> None:
        self.spark, self.root, self.centroids = spark, root, centroids

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    @property
    def cells(self) -> int:
        return len(self.centroids)

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/lists")

    @classmethod
    def build(cls, vectors: DataFrame, root: str, dim: int, cells: int = 32, rounds: int = 4) -> StoredCells:
        """Fit on all vectors (chunk_id, embedding) and write the index; the first row of an id by its vector stays.

        Vectors of another size than ``dim`` are left out. With fewer vectors than ``cells`` there are fewer cells.
        """
        usable = _first_of_id(settled(_valid(vectors, dim, "chunk_id")))
        centroids = fit_centroids(usable, dim, cells, rounds)
        if not len(centroids):
            raise ValueError("no vector to build an index from")
        spark = vectors.sparkSession
        rows = [(c, [int(x) for x in row]) for c, row in enumerate(centroids)]
        spark.createDataFrame(rows, "cell int, parts array<long>").coalesce(1).write.parquet(f"{root}/centroids")
        index = cls(spark, root, centroids)
        index._write(usable)
        return index

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> StoredCells:
        table = spark.read.parquet(f"{root}/centroids").orderBy("cell").toArrow()
        return cls(spark, root, np.array(table.column("parts").to_pylist(), np.float64))

    def add(self, vectors: DataFrame) -> None:
        """Place further vectors by the saved centroids and append them; ids that are stored already are left out."""
        usable = _first_of_id(_valid(vectors, self.dim, "chunk_id"))
        self._write(usable.join(self.vectors.select("chunk_id"), "chunk_id", "left_anti"))

    def place(self, vectors: DataFrame) -> DataFrame:
        """(chunk_id, embedding, cell)."""
        sent, dim = self.spark.sparkContext.broadcast(self.centroids), self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = nearest_cells(whole(_matrix(batch.column("embedding"), dim)), sent.value, 1)[:, 0] if batch.num_rows else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

        chosen = vectors.select("chunk_id", "embedding")
        return chosen.mapInArrow(run, f"chunk_id {chosen.schema['chunk_id'].dataType.simpleString()}, embedding {chosen.schema['embedding'].dataType.simpleString()}, cell int")

    def _write(self, vectors: DataFrame) -> None:
        """A full cell is dealt out over several files; its parts come from a count per cell, one row each."""
        placed = settled(self.place(vectors))
        parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / FILE_ROWS).alias("_parts"))
        dealt = placed.join(F.broadcast(parts), "cell").withColumn("_part", F.pmod(F.xxhash64("chunk_id"), F.col("_parts")))
        dealt.repartition("cell", "_part").drop("_part", "_parts").write.mode("append").partitionBy("cell").parquet(f"{self.root}/lists")

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """(query_id, embedding, cells): the ``nprobe`` nearest cells of each query, nearest first."""
        sent, dim, n = self.spark.sparkContext.broadcast(self.centroids), self.dim, min(nprobe, self.cells)
        kind = queries.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = _usable(batch, dim)
                cells = nearest_cells(whole(_matrix(batch.column("embedding"), dim)), sent.value, n) if batch.num_rows else np.zeros((0, n), np.int32)
                listed = pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), n).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("embedding"), listed], names=["query_id", "embedding", "cells"])

        chosen = queries.select("query_id", "embedding")
        return chosen.mapInArrow(run, f"query_id {kind}, embedding {chosen.schema['embedding'].dataType.simpleString()}, cells array<int>")

    def search(self, queries: DataFrame, k: int = 5, nprobe: int = 8, query_bytes: int = QUERY_BYTES) -> DataFrame:
        """(query_id, rank, chunk_id, score) of the top ``k`` within the probed cells, scored exactly by inner product.

        Queries go to the lists in blocks of ``query_bytes``. A block reads only the folders of its cells (partitions are
        pruned by the probes) and scores a vector with the queries that probe its cell; no vector is shuffled. With
        ``nprobe`` = ``cells`` this is ``knn_exact``.
        """
        probed = self.probes(queries, nprobe)
        return _rank(in_passes(probed, 8 * self.dim + 4 * min(nprobe, self.cells), query_bytes, lambda block: self._pass(block, k)), k)

    def _pass(self, block: DataFrame, k: int) -> DataFrame:
        table, dim = block.toArrow(), self.dim
        id_type = table.schema.field("query_id").type
        names = np.array(table.column("query_id").to_pylist(), dtype=object)
        n = max((len(c) for c in table.column("cells").to_pylist()), default=1)
        cells = table.column("cells").combine_chunks().flatten().to_numpy().reshape(-1, n)
        order = np.argsort(cells.ravel(), kind="stable")
        asked, edges = order // n, np.searchsorted(cells.ravel()[order], np.arange(self.cells + 1))
        sent = self.spark.sparkContext.broadcast((names, _matrix(table.column("embedding"), dim), asked, edges))
        stored = self.vectors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, asked, edges = sent.value
            best = RunningBest(len(q), k)
            for batch in batches:
                cell = batch.column("cell").to_numpy()
                order = np.argsort(cell, kind="stable")
                cut = np.flatnonzero(np.diff(cell[order])) + 1
                for rows in np.split(order, cut) if len(cell) else ():
                    own = asked[edges[cell[rows[0]]] : edges[cell[rows[0]] + 1]]
                    if len(own):
                        best.take(batch.take(pa.array(rows)), q, own)
            yield from best.batches(names, id_type)

        # The comparison makes the side selective, so that the probed cells prune the folders before they are read.
        wanted = block.select(F.explode("cells").alias("cell")).where("cell >= 0").distinct()
        lists = stored.join(F.broadcast(wanted), "cell", "left_semi")
        return lists.select("chunk_id", "embedding", "cell").mapInArrow(run, hit_schema(stored, block))

    def sizes(self) -> DataFrame:
        """(cell, n) of the cells that hold vectors."""
        return self.vectors.groupBy("cell").agg(F.count("*").alias("n"))

    def pair_share(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """(scored, total): pairs of query and vector that a search looks at, and all pairs."""
        probes = self.probes(queries, nprobe).select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("q"))
        scored = probes.join(self.sizes(), "cell").agg(F.coalesce(F.sum(F.col("q") * F.col("n")), F.lit(0)).alias("scored"))
        usable = _valid(queries, self.dim, "query_id")
        total = self.vectors.agg(F.count("*").alias("v")).join(usable.agg(F.count("*").alias("q")), F.lit(True))
        return scored.join(total.select((F.col("v") * F.col("q")).alias("total")), F.lit(True))


def _first_of_id(vectors: DataFrame) -> DataFrame:
    return first_n(vectors, ["chunk_id"], [F.col("embedding")], 1, "_n").drop("_n")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(hits, wanted): how many of the exact hits (query_id, chunk_id) were found."""
    keys = ["query_id", "chunk_id"]
    met = exact.select(*keys).join(found.select(*keys, F.lit(1).alias("_hit")), keys, "left")
    return met.agg(F.count("_hit").alias("hits"), F.count("*").alias("wanted"))
