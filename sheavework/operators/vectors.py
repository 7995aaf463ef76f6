"""Embedding hook, exact and approximate nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from ..functions import text, vectors
from ..session import scratch_path
from .spread import SALTS, first_n, kept, may_match, settled
from .workers import lean

SCORE_DIGITS = 6
MAX_CELLS = 65_536
QUERY_BYTES = 32 << 20
SCORES = 1 << 20  # scores that a task holds at a time
BLOCK_VECTORS = 4096
BLOCK_BYTES = 16 << 20  # vectors of one side that meet in one group
PLANNED_PASSES = 16


def blank_query_filter(queries: DataFrame, col: str = "query") -> DataFrame:
    return queries.where(text.not_blank(F.col(col)))


def _unit_counts(dim: int) -> Callable:
    """Words of a row to counts per bucket, of unit length. Each distinct word of an Arrow batch is hashed once."""

    @F.arrow_udf("array<float>")
    def counts(words: pa.Array) -> pa.Array:
        owner = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        coded = words.flatten().dictionary_encode()
        of_word = np.array([vectors.hashed_bucket(w, dim) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.int64)
        place = owner * dim + of_word[coded.indices.to_numpy(zero_copy_only=False)]
        found = np.bincount(place, minlength=len(words) * dim).reshape(-1, dim).astype(np.float64)
        unit = found / (np.sqrt((found * found).sum(axis=1, keepdims=True)) + vectors.NORM_EPSILON)
        flat = pa.array(unit.astype(np.float32).ravel())
        # A null text has null words and, as before, no vector.
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * dim, pa.int32()), flat, mask=words.is_null())

    return counts


def embed(df: DataFrame, text_col: str, dim: int, scorer: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
          batch_rows: int = 256) -> DataFrame:
    """Add ``embedding`` (unit length, ARRAY<FLOAT>) and ``error``.

    ``scorer`` is a factory that is called once per task and returns a function from a list of texts to
    an (n, dim) array. Without one, hashed term counts are used. A batch the scorer fails on, or a vector
    of another size, leaves the row in place with a NULL vector and the reason in ``error``.
    """
    if scorer is None:
        counted = _unit_counts(dim)(F.transform(text.words(F.col(text_col)), F.lower))
        return df.withColumn("embedding", counted).withColumn("error", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                part = batch.iloc[start : start + batch_rows].copy()
                try:
                    got = np.asarray(score(part[text_col].tolist()), dtype=np.float64)
                    if got.shape != (len(part), dim):
                        raise ValueError(f"expected shape {(len(part), dim)}, got {got.shape}")
                    unit = got / (np.linalg.norm(got, axis=1, keepdims=True) + vectors.NORM_EPSILON)
                    part["embedding"], part["error"] = list(unit.astype(np.float32)), None
                except Exception as problem:  # noqa: BLE001 - reported per row
                    part["embedding"], part["error"] = None, f"{type(problem).__name__}: {problem}"
                yield part

    schema = StructType([*df.schema.fields, StructField("embedding", ArrayType(FloatType())), StructField("error", StringType())])
    return df.mapInPandas(run, schema)


def check_dimension(df: DataFrame, dim: int) -> DataFrame:
    """Add ``error`` where the vector is missing or has another size than ``dim``."""
    size = F.size("embedding")
    return df.withColumn(
        "error",
        F.when(F.col("embedding").isNull(), F.lit("no vector"))
        .when(size != dim, F.format_string("size %d, expected %d", size, F.lit(dim))),
    )


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type) and not column.null_count:
        return np.asarray(column.to_numpy(), dtype=np.int64)
    return np.array(column.to_pylist(), dtype=object)


def _top_k(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indexes of the k best of every row; equal scores in the order of the columns."""
    n = scores.shape[1]
    if n > k:
        limit = np.partition(scores, n - k, axis=1)[:, n - k]
        rows, cols = np.nonzero(scores >= limit[:, None])
    else:
        rows, cols = np.nonzero(np.ones_like(scores, dtype=bool))
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(scores.shape[0]))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], cols[keep]


def _rank(best: DataFrame, k: int) -> DataFrame:
    ranked = first_n(best, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)
    return ranked.select("query_id", "rank", "chunk_id", "score")


def _usable(batch, dim: int):
    """The rows of an Arrow batch or table whose vector has ``dim`` numbers."""
    fits = pc.equal(pc.list_value_length(batch.column("embedding")), dim)
    return batch.filter(pc.fill_null(fits, False))


def _valid(df: DataFrame, dim: int, *cols: str) -> DataFrame:
    """Rows with a vector of ``dim`` numbers. A filter on the column would be pushed below a computed
    embedding and make it be computed twice; the rows are dropped in Arrow batches instead."""
    chosen = df.select(*cols, "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _usable(batch, dim)

    return chosen.mapInArrow(run, chosen.schema)


class RunningBest:
    """The k best hits of every query seen so far; equal scores by chunk id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.chunk: np.ndarray | None = None

    def take(self, batch: pa.RecordBatch | pa.Table, matrix: np.ndarray, own: np.ndarray | None = None, at_once: int = SCORES) -> None:
        """Score the vectors of an Arrow batch (chunk_id, embedding) for every row of ``matrix``, or the rows ``own`` of it.

        At most SCORES scores are held at a time, or those of ``at_once`` queries with a few vectors, however large both sides are.
        """
        batch = batch.take(pc.sort_indices(batch.column("chunk_id"), null_placement="at_start"))
        ids, points = _ids(batch.column("chunk_id")), _matrix(batch.column("embedding"), matrix.shape[1])
        if self.chunk is None:
            self.chunk = np.empty(self.score.shape, ids.dtype)
        elif self.chunk.dtype != ids.dtype:
            self.chunk, ids = self.chunk.astype(object), ids.astype(object)
        own = np.arange(len(matrix)) if own is None else own
        for first in range(0, len(ids), BLOCK_VECTORS):
            some, block = ids[first : first + BLOCK_VECTORS], points[first : first + BLOCK_VECTORS]
            step = max(1, min(at_once, SCORES // len(block)))
            for start in range(0, len(own), step):
                self._add(own[start : start + step], some, matrix[own[start : start + step]] @ block.T)

    def _add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        floor = self.score[rows, -1]
        # Rounding moves a score by half a digit, so what is further below the k-th best cannot reach it.
        near = scores >= (floor - 10.0**-SCORE_DIGITS - 1e-9 * np.abs(floor))[:, None]
        if np.count_nonzero(near) > 4 * self.k * len(rows):
            scores = np.round(scores, SCORE_DIGITS)
            at, col = _top_k(scores, self.k)
            found = scores[at, col]
        else:
            at, col = np.nonzero(near)
            found = np.round(scores[at, col], SCORE_DIGITS)
        better = found >= floor[at]
        if better.any():
            self._merge(rows, at[better], ids[col[better]], found[better])

    def _merge(self, rows: np.ndarray, at: np.ndarray, chunk: np.ndarray, score: np.ndarray) -> None:
        met = np.unique(at)
        kept = self.score[rows[met]]
        held, place = np.nonzero(kept > -np.inf)
        query = np.concatenate([met[held], at])
        chunk = np.concatenate([self.chunk[rows[met[held]], place], chunk])
        score = np.concatenate([kept[held, place], score])
        order = np.lexsort((chunk, -score, query))
        query, chunk, score = query[order], chunk[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = place < self.k
        self.score[rows[query[best]], place[best]] = score[best]
        self.chunk[rows[query[best]], place[best]] = chunk[best]

    def batches(self, names: np.ndarray, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """(query_id, chunk_id, score), those of some queries at a time."""
        for start in range(0, len(self.score) if self.chunk is not None else 0, BLOCK_VECTORS):
            some = slice(start, start + BLOCK_VECTORS)
            query, place = np.nonzero(self.score[some] > -np.inf)
            if len(query):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[some][query].tolist(), id_type), pa.array(self.chunk[some][query, place].tolist()), pa.array(self.score[some][query, place])],
                    names=["query_id", "chunk_id", "score"],
                )


def hit_schema(corpus: DataFrame, queries: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {corpus.schema['chunk_id'].dataType.simpleString()}, score double"


def _knn_pass(corpus: DataFrame, queries: DataFrame, k: int, dim: int, at_once: int) -> DataFrame:
    """Map-only scoring against one broadcast of queries, ``at_once`` of them at a time; only tasks x queries x k rows are shuffled."""
    table = queries.select("query_id", "embedding").toArrow()
    ids, matrix = table.column("query_id").combine_chunks(), _matrix(table.column("embedding"), dim)
    shared = corpus.sparkSession.sparkContext.broadcast((np.array(ids.to_pylist(), dtype=object), matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        best = RunningBest(len(q), k)
        for batch in batches:
            batch = _usable(batch, dim)
            if batch.num_rows and len(q):
                best.take(batch, q, at_once=at_once)
        yield from best.batches(names, ids.type)

    return corpus.mapInArrow(lean(run), hit_schema(corpus, queries))


def in_passes(queries: DataFrame, width: int, block_bytes: int, each: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``each`` over blocks of the queries, a block holding about ``block_bytes`` at ``width`` bytes a query.

    The queries are settled first, so what computes them runs once. A few blocks become one plan; the results of many
    are written to the shared folder block by block, so that neither the plan nor the broadcasts pile up.
    """
    stored = settled(queries)
    blocks = max(1, -(-stored.count() * width // block_bytes))
    if blocks == 1:
        return each(stored)
    dealt = stored.withColumn("_pass", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    parts = [(lambda p: each(dealt.where(F.col("_pass") == p).drop("_pass"))) for p in range(blocks)]
    if blocks <= PLANNED_PASSES:
        return reduce(DataFrame.unionByName, [part(p) for p, part in enumerate(parts)])
    path = scratch_path(queries.sparkSession, "passes")
    for p, part in enumerate(parts):
        part(p).write.parquet(f"{path}/pass={p}")
    return queries.sparkSession.read.parquet(path).drop("pass")


def _knn_blocks(corpus: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """Blocked scoring of two distributed sides that share a ``cell``.

    Each side is cut into ``c_blocks`` and ``q_blocks`` blocks per cell (columns of both sides); every pair of
    blocks is one group, so a group's size does not depend on how full a cell is.
    """
    left = (
        corpus.withColumn("c_block", F.pmod(F.xxhash64("chunk_id"), F.col("c_blocks")).cast("int"))
        .withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        .select("cell", "c_block", "q_block", "chunk_id", "embedding")
    )
    right = (
        queries.withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.col("q_blocks")).cast("int"))
        .withColumn("c_block", F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)))
        # Renamed columns keep the two sides apart when one table is searched with its own vectors.
        .select(*[F.col(c).alias(c) for c in ("cell", "c_block", "q_block", "query_id", "embedding")])
    )
    keys = ["cell", "c_block", "q_block"]
    query_type, chunk_type = queries.schema["query_id"].dataType, corpus.schema["chunk_id"].dataType

    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        c, q = _usable(c, dim), _usable(q, dim)
        best = RunningBest(q.num_rows, k)
        if c.num_rows and q.num_rows:
            best.take(c, _matrix(q.column("embedding"), dim))
        query_ids = q.column("query_id")
        fields = pa.schema([("query_id", query_ids.type), ("chunk_id", c.column("chunk_id").type), ("score", pa.float64())])
        found = best.batches(np.array(query_ids.to_pylist(), dtype=object), query_ids.type)
        return pa.Table.from_batches([b.cast(fields) for b in found], fields)

    schema = f"query_id {query_type.simpleString()}, chunk_id {chunk_type.simpleString()}, score double"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def knn_exact(corpus: DataFrame, queries: DataFrame, k: int = 5, dim: int = 1024, query_bytes: int = QUERY_BYTES,
              pass_bytes: int = QUERY_BYTES) -> DataFrame:
    """Top ``k`` by inner product: (query_id, rank, chunk_id, score); equal scores by chunk id.

    ``corpus(chunk_id, embedding)``, ``queries(query_id, embedding)``, unit vectors of ``dim``; vectors of
    another size are left out (see ``check_dimension``). Queries are computed once, sent to the corpus ``pass_bytes`` at a time and
    scored in blocks of ``query_bytes`` at most; the corpus is read in place, once per pass, and never copied or shuffled. With more than
    one pass give a stored corpus, or its vectors are computed again for every pass.
    """
    corpus = corpus.select("chunk_id", "embedding")
    at_once = max(1, query_bytes // (8 * dim))

    def scored(block: DataFrame) -> DataFrame:
        # The block is stored, so the JVM drops misfits; a second Python step beside the embedding would be a second worker for every task.
        return _knn_pass(corpus, block.where(F.size("embedding") == dim), k, dim, at_once)

    return _rank(in_passes(queries.select("query_id", "embedding"), 8 * dim, max(query_bytes, pass_bytes), scored), k)


def hydrate_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add text, source and page; hits of unknown chunks are dropped.

    The chunk table is cut down to the chunks that were hit before it is shuffled. The hits of one chunk are divided by a salt, and its
    text goes to the salts that occur: once for a chunk that is hit once, however many queries hit another.
    """
    # k rows per query, read several times below; scoring them again would read the corpus again.
    hits = settled(hits.withColumn("_salt", F.pmod(F.xxhash64("query_id", "rank"), F.lit(SALTS))))
    ids = hits.select(F.col("chunk_id").cast(chunks.schema["chunk_id"].dataType).alias("chunk_id")).distinct()
    stored = may_match(chunks.select("chunk_id", "text", "source", "page"), ids, ["chunk_id"])
    texts = stored.join(hits.select("chunk_id", "_salt").distinct(), "chunk_id")
    return hits.join(texts, ["chunk_id", "_salt"]).select(
        "query_id", "rank", "chunk_id", "text", "source", "page", "score"
    )


class CellIndex:
    """Vectors divided into k-means cells; a query is scored against its ``nprobe`` nearest cells only."""

    def __init__(self, vectors_by_cell: DataFrame, centroids: np.ndarray):
        self.vectors = vectors_by_cell
        self.centroids = centroids

    @property
    def cells(self) -> int:
        return len(self.centroids)

    def probe(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """One row per query and cell to look into."""
        shared = queries.sparkSession.sparkContext.broadcast(self.centroids)
        nprobe = min(nprobe, self.cells)

        @F.pandas_udf("array<int>")
        def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            c = shared.value
            for batch in batches:
                m = np.stack(batch.to_numpy()).astype(np.float64) if len(batch) else np.zeros((0, c.shape[1]))
                distance = (c * c).sum(axis=1)[None, :] - 2.0 * (m @ c.T)
                yield pd.Series(list(np.argsort(distance, axis=1, kind="stable")[:, :nprobe].astype(np.int32)))

        return queries.withColumn("cell", F.explode(nearest("embedding")))


def build_cells(corpus: DataFrame, dim: int, cells: int = 32, seed: int = 42) -> CellIndex:
    """Fit the centroids on all vectors and put every vector into its cell."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = _valid(corpus, dim, "chunk_id")
    with_vector = usable.withColumn("features", array_to_vector("embedding"))
    train = kept(with_vector.select("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(train)
    train.unpersist()
    centroids = np.array(model.clusterCenters(), dtype=np.float64)
    placed = model.transform(with_vector).select("chunk_id", "embedding", F.col("prediction").alias("cell"))
    return CellIndex(placed, centroids)


def knn_approx(index: CellIndex, queries: DataFrame, k: int = 5, nprobe: int = 8, block_rows: int | None = None) -> DataFrame:
    """Top ``k`` within the probed cells, scored exactly. With ``nprobe`` = number of cells this is ``knn_exact``.

    Both sides meet in blocks of ``block_rows`` vectors, BLOCK_BYTES by default; the larger they are, the fewer copies are shuffled.
    """
    dim = index.centroids.shape[1]
    block_rows = block_rows or max(1, BLOCK_BYTES // (8 * dim))
    probes = index.probe(_valid(queries, dim, "query_id"), nprobe)

    def blocks(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(out))

    if index.cells > MAX_CELLS:
        raise ValueError(f"{index.cells} cells, at most {MAX_CELLS}")
    # One row per cell, so no more than MAX_CELLS small rows.
    counts = F.broadcast(blocks(index.vectors, "c_blocks").join(blocks(probes, "q_blocks"), "cell"))
    return _rank(_knn_blocks(index.vectors.join(counts, "cell"), probes.join(counts, "cell"), k, dim), k)


def scored_pair_share(index: CellIndex, queries: DataFrame, nprobe: int) -> DataFrame:
    """Share of all (query, vector) pairs that the probes look at; report it beside the recall."""
    dim = index.centroids.shape[1]
    probes = index.probe(_valid(queries, dim, "query_id"), nprobe).groupBy("cell").agg(F.count("*").alias("q"))
    sizes = index.vectors.groupBy("cell").agg(F.count("*").alias("n"))
    scored = probes.join(sizes, "cell").agg(F.sum(F.col("q") * F.col("n")).alias("scored"))
    return scored.select("scored", (F.col("scored") / F.lit(float(max(1, index.vectors.count() * queries.count())))).alias("share"))
