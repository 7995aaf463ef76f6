"""Nearest neighbours by shifted space-filling curves: Hilbert orders of projected vectors, windows, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.spread import number_rows
from .frames import narrow, settle

CURVES, AXES, BITS = 6, 8, 7
BLOCK = 2048  # rows of a curve that one group holds
FIT_ROWS = 10_000  # vectors, about, that the grid is fitted on
PROBES = 96  # queries, at most, whose exact neighbours set the window
RECALL = 0.96  # share of those neighbours that the windows must reach


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions along the Hilbert curve of points on a grid of ``2 ** bits`` cells per axis.

    Each bit plane, from the highest, turns or mirrors the lower bits of the axes as the curve does in that cell; then
    the planes are Gray-coded and the bits of all axes are laced into one number.
    """
    x = cells.astype(np.int64).T.copy()
    for high in range(bits - 1, 0, -1):
        low = (1 << high) - 1
        for axis in range(len(x)):
            up = (x[axis] >> high & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(up, low, 0)
            x[0] ^= swap
            x[axis] ^= swap
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for high in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> high & 1, (1 << high) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | (axis >> bit & 1)
    return key


class Curves:
    """Projections, grids and shifts of several curves, from a sample of vectors and a seed."""

    def __init__(self, sample: np.ndarray, dim: int, curves: int = CURVES, axes: int = AXES, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        axes = min(axes, dim)
        self.axes = [np.linalg.qr(rng.normal(size=(dim, axes)))[0] for _ in range(curves)]
        self.shifts = rng.uniform(size=(curves, axes))
        steps = np.linspace(0, 1, 65)
        self.grids = [np.quantile(sample @ a, steps, axis=0) if len(sample) else np.zeros((65, axes)) for a in self.axes]

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        """Each axis is spread evenly by the sample's quantiles, shifted, and cut into cells."""
        seen = vectors @ self.axes[curve]
        cells = np.empty(seen.shape, np.int64)
        for a in range(seen.shape[1]):
            even = np.interp(seen[:, a], self.grids[curve][:, a], np.linspace(0, 1, 65))
            cells[:, a] = np.minimum((even + self.shifts[curve, a]) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
        return hilbert_keys(cells)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vec) with the vectors as doubles; without those that are null, zero, of another size than most, or hold
    null or non-finite components."""
    plain = narrow(vectors, id_column, vector_column).toDF("vec_id", "vec").where("vec_id is not null and vec is not null")
    plain = plain.withColumn("vec", F.transform("vec", lambda x: x.cast("double") + F.lit(0.0)))
    good = plain.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0.0))
    size = good.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    return good.where(F.size("vec") == (size[0]["n"] if size else 0))


def _matrix(column: pa.Array | pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist() if isinstance(column, pa.Array) else column), np.float64).reshape(-1, dim)


def _nearest(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows in double precision, ties to the smaller id."""
    distance = np.sqrt(((vectors - query) ** 2).sum(axis=1))
    few = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1]) if len(distance) > k else np.arange(len(distance))
    best = few[np.lexsort((ids[few], distance[few]))][:k]
    return ids[best], distance[best]


def nearest_neighbours(vectors: DataFrame, query_modulus: int = 100, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest others found for each row whose id is divisible by ``query_modulus``.

    The score is the Euclidean distance in double precision on the vectors as given; ties go to the smaller id. Vectors that are
    null, zero, or hold null or non-finite components take no part, nor do those of another length than most. Equal vectors
    are one point of the index, with its k + 1 smallest ids, so copies of a vector fill no window; rows that repeat an id and
    a vector count once. With fewer than k others all are returned; an empty table gives an empty result.

    Each point has a place on every curve. A query looks at the points within a window of places on each curve; they lie in
    blocks of ``BLOCK`` places, each worked on by one group, which returns its nearest few. The window is fitted: the exact
    neighbours of at most ``PROBES`` queries are found in one pass over all points, and the window is the smallest that
    holds ``RECALL`` of them on some curve. Where projections say little about nearness, windows get long, and the work
    grows towards that of an exact search; recall is kept.
    """
    spark = vectors.sparkSession
    rows = settle(usable(vectors, id_column, vector_column).dropDuplicates(["vec_id", "vec"]), "vectors")
    first = Window.partitionBy("vec").orderBy("vec_id")
    ranked = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)

    def raw(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            packed = [np.array(v, np.float64).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["ids", "raw"])

    grouped = ranked.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("ids", "vec")
    points = settle(grouped.mapInArrow(raw, "ids array<long>, raw binary").select(F.get("ids", 0).alias("point"), "ids", "raw"), "points")
    count = points.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not count:
        return spark.createDataFrame([], out)
    dim = len(points.select("raw").first()["raw"]) // 8
    share = min(1.0, FIT_ROWS / count)
    sample = points.where(F.pmod(F.xxhash64("point", F.lit(5)), F.lit(1_000_000)) < max(1, int(share * 1_000_000))).orderBy("point").toPandas()
    curves = Curves(_matrix(sample["raw"], dim), dim)
    sent = spark.sparkContext.broadcast(curves)

    def keyed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch.column(1), dim)
            for curve in range(CURVES):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, curve, np.int32)), pa.array(sent.value.keys(matrix, curve)), batch.column(0)],
                    names=["curve", "key", "point"],
                )

    order = number_rows(points.select("point", "raw").mapInArrow(keyed, "curve int, key long, point long"), ["curve", "key", "point"], "_at")
    places = settle(order.select("curve", "point", (F.col("_at") - F.col("curve") * F.lit(count)).alias("place")), "places")

    asked = rows.where(F.pmod("vec_id", F.lit(query_modulus)) == 0).select(F.col("vec_id").alias("query_id"), "vec")
    wanted = asked.join(ranked.where("_r = 1").select("vec", F.col("vec_id").alias("point")), "vec").select("query_id", "point")
    wanted = settle(wanted, "queries")
    query_points = settle(wanted.select("point").distinct().join(points.select("point", "raw"), "point"), "query-points")
    window = _window(query_points, points, places, count, dim, k)

    spots = query_points.join(places, "point").withColumn("low", F.greatest(F.lit(0), F.floor((F.col("place") - window) / BLOCK)))
    spots = spots.withColumn("high", F.least(F.lit((count - 1) // BLOCK), F.floor((F.col("place") + window) / BLOCK)))
    spots = spots.select("curve", F.explode(F.sequence("low", "high")).alias("block"), "point", "place", "raw").toDF("q_curve", "q_block", "query", "q_place", "q_raw")
    members = points.select("point", "raw").join(places, "point").select("curve", F.floor(F.col("place") / BLOCK).alias("block"), "point", "place", "raw")

    def search(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            matrix, ids, at = _matrix(right["raw"], dim), right["point"].to_numpy(), right["place"].to_numpy()
            for query, place, vector in zip(left["query"], left["q_place"], _matrix(left["q_raw"], dim), strict=True):
                inside = np.abs(at - place) <= window
                names, distance = _nearest(vector, matrix[inside], ids[inside], k + 1)
                found += [(query, n, d) for n, d in zip(names.tolist(), distance.tolist(), strict=True)]
        return pd.DataFrame(found, columns=["query", "point", "score"])

    hits = spots.groupBy("q_curve", "q_block").cogroup(members.groupBy("curve", "block")).applyInPandas(search, "query long, point long, score double")
    nearest = Window.partitionBy("query").orderBy("score", "point")
    best = hits.distinct().withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= k + 1)
    named = best.join(points.select("point", "ids"), "point").select("query", F.explode("ids").alias("vec_id"), "score")
    lists = named.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("all"))
    # A point's ids and its neighbours' are at most (k + 1) ** 2; the first k + 1 are enough for every query at the point.
    lists = lists.select(F.col("query").alias("point"), F.slice("all", 1, k + 1).alias("all"))
    own = wanted.join(lists, "point").select("query_id", F.slice(F.filter("all", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("own"))
    return own.select("query_id", F.posexplode("own").alias("_p", "_x")).select("query_id", (F.col("_p") + 1).alias("rank"), "_x.vec_id", "_x.score")


def _window(query_points: DataFrame, points: DataFrame, places: DataFrame, count: int, dim: int, k: int) -> int:
    """Places to look at on either side, fitted on the exact neighbours of a few queries."""
    probes = query_points.orderBy(F.xxhash64("point", F.lit(9)), "point").limit(PROBES).toPandas()
    if not len(probes) or count <= BLOCK:
        return count
    names, matrix = probes["point"].tolist(), _matrix(probes["raw"], dim)

    def exact(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            if not batch.num_rows:
                continue
            vectors, ids = _matrix(batch.column(1), dim), batch.column(0).to_numpy()
            rows = [(q, n, d) for q, v in zip(names, matrix, strict=True) for n, d in zip(*(x.tolist() for x in _nearest(v, vectors, ids, k + 1)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["query", "point", "score"])

    near = points.select("point", "raw").mapInArrow(exact, "query long, point long, score double")
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy("score", "point"))).where(F.col("_r") <= k + 1)
    apart = best.where("query <> point").join(places, "point").join(places.toDF("curve", "query", "own"), ["curve", "query"])
    least = apart.groupBy("query", "point").agg(F.min(F.abs(F.col("place") - F.col("own"))).alias("gap"))
    gaps = np.sort([r["gap"] for r in least.select("gap").collect()])  # at most PROBES * k numbers
    return int(gaps[min(len(gaps) - 1, int(np.ceil(RECALL * len(gaps))))]) if len(gaps) else count
