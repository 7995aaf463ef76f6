"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import catalog, vectors
from ..operators.cells import StoredCells, recall
from ..session import scratch_path
from . import inputs as I
from .inputs import DIM, sql, words_sql
from .registry import register

K = 10


def _corpus(spark, sf):
    return I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _as_queries(spark, sf):
    return I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


@register("embed", sql("SELECT chunk_id, array_to_string(list_transform(embedding, lambda x: round(x * 1000)::INT), ',') AS vector FROM chunk_vectors", "chunk_vectors"))
def embed(spark, sf):
    shown = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("int"))
    return I.chunk_vectors(spark, sf).select("chunk_id", F.array_join(shown, ",").alias("vector"))


def _length_scorer():
    """Stand-in for a model: a few counts of the text."""
    import numpy as np

    return lambda texts: np.array([[len(t), t.count(" "), t.count("e"), 1.0] for t in texts])


@register("embed_with_scorer", sql("""SELECT chunk_id, array_to_string(list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)) * 10000)::INT), ',') AS vector
    FROM (SELECT chunk_id, [length(preview), length(preview) - length(replace(preview, ' ', '')), length(preview) - length(replace(preview, 'e', '')), 1]::DOUBLE[] AS v FROM chunks)""", "chunks"))
def embed_with_scorer(spark, sf):
    scored = vectors.embed(I.doc_chunks(spark, sf).select("chunk_id", "preview"), "preview", 4, _length_scorer)
    shown = F.transform("embedding", lambda x: F.round(x.cast("double") * 10000).cast("int"))
    return scored.select("chunk_id", F.array_join(shown, ",").alias("vector"))


@register("l2_normalize", """SELECT vec_id, unnest(range(len(u)))::INT AS i, round(unnest(u), 6) AS x FROM (
    SELECT vec_id, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-9)) AS u FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS v FROM embeddings))""")
def l2_normalize(spark, sf):
    scaled = I.table(spark, sf, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)))
    return scored_rows(scaled.select("vec_id", V.l2_normalize(F.col("v")).alias("u")))


def scored_rows(df):
    return df.select("vec_id", F.posexplode("u").alias("i", "x")).withColumn("x", F.round("x", 6))


KNN_SQL = f"""SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings c)) WHERE rank <= {K}"""


@register("knn_exact", KNN_SQL)
def knn_exact(spark, sf):
    return vectors.knn_exact(_corpus(spark, sf), _as_queries(spark, sf), K, DIM)


@register("knn_exact_blocks", KNN_SQL)
def knn_exact_blocks(spark, sf):
    """The same with queries in blocks of a hundred, as they come when they are too many to be sent at once."""
    return vectors.knn_exact(_corpus(spark, sf), _as_queries(spark, sf), K, DIM, query_bytes=100 * 8 * DIM)


@register("knn_approx_all_cells", KNN_SQL)
def knn_approx_all_cells(spark, sf):
    """With every cell probed the approximate search is exact."""
    index = vectors.build_cells(_corpus(spark, sf), DIM, cells=16)
    return vectors.knn_approx(index, _as_queries(spark, sf), K, nprobe=16)


CELLS, PROBES, ROUNDS = 32, 8, 4


def cells_sql(final: str) -> str:
    """The cells of the stored index: whole-number k-means written out round by round, then the probes and the hits."""
    apart = "list_sum(list_transform(list_zip(a.q, b.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e, list_transform(embedding, lambda x: floor(x::DOUBLE * 32768)::BIGINT) AS q FROM embeddings),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS cell, q FROM v ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT {CELLS})"""]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(a.q) AS q, min_by(cell, ({apart}, cell)) AS cell FROM v a, c{r} b GROUP BY vec_id)")
        if r < ROUNDS:
            parts.append(f"""m{r} AS (SELECT cell, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS q FROM (SELECT cell, i, sum(x) AS s, count(*) AS n
                FROM (SELECT cell, unnest(q) AS x, unnest(range(len(q))) AS i FROM a{r}) GROUP BY cell, i) GROUP BY cell),
                c{r + 1} AS MATERIALIZED (SELECT cell, coalesce(m{r}.q, c{r}.q) AS q FROM c{r} LEFT JOIN m{r} USING (cell))""")
    parts.append(f"""probes AS MATERIALIZED (SELECT vec_id, cell FROM (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY {apart}, cell) AS n FROM v a, c{ROUNDS} b) WHERE n <= {PROBES}),
        pairs AS (SELECT p.vec_id AS query_id, x.vec_id AS chunk_id, round(list_inner_product(y.e, z.e), 6) AS score FROM probes p JOIN a{ROUNDS} x ON x.cell = p.cell JOIN v y ON y.vec_id = p.vec_id JOIN v z ON z.vec_id = x.vec_id),
        found AS (SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pairs) WHERE rank <= {K})""")
    return "WITH " + ",\n".join(parts) + "\n" + final


def stored_cells(spark, sf) -> StoredCells:
    """The index of the table, built once per session and data folder, opened again for every query."""
    root = I.written(spark, sf, "cells", lambda path: StoredCells.build(_corpus(spark, sf), path, DIM, CELLS, ROUNDS))
    return StoredCells.open(spark, root)


@register("knn_approx", cells_sql("SELECT * FROM found"))
def knn_approx(spark, sf):
    return stored_cells(spark, sf).search(_as_queries(spark, sf), K, PROBES)


@register("knn_approx_recall", cells_sql(f"""SELECT hits, wanted, scored, total FROM (SELECT count(f.chunk_id) AS hits, count(*) AS wanted FROM ({KNN_SQL}) e LEFT JOIN found f ON f.query_id = e.query_id AND f.chunk_id = e.chunk_id),
    (SELECT count(*) AS scored FROM pairs), (SELECT count(*) * count(*) AS total FROM v)"""))
def knn_approx_recall(spark, sf):
    """Exact hits that were found, and pairs that were looked at."""
    index, queries = stored_cells(spark, sf), _as_queries(spark, sf)
    met = recall(index.search(queries, K, PROBES), vectors.knn_exact(_corpus(spark, sf), queries, K, DIM))
    return met.join(index.pair_share(queries, PROBES), F.lit(True))


@register("knn_index_add", KNN_SQL)
def knn_index_add(spark, sf):
    """Half of the vectors are indexed; then all come, the known ones turned round, which changes nothing. Every cell is probed."""
    corpus, root = _corpus(spark, sf), scratch_path(spark, "cells")
    half = F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == 0
    StoredCells.build(corpus.where(half), root, DIM, CELLS, ROUNDS)
    known = corpus.where(half).withColumn("embedding", F.transform("embedding", lambda x: -x))
    StoredCells.open(spark, root).add(corpus.where(~half).unionByName(known))
    return StoredCells.open(spark, root).search(_as_queries(spark, sf), K, CELLS)


TEXT_HITS = """hits AS (SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.query_id, c.chunk_id, round(list_inner_product(q.embedding, c.embedding), 6) AS score FROM query_vectors q, chunk_vectors c)) WHERE rank <= 6),
    hydrated AS (SELECT h.query_id, h.rank, h.chunk_id, c.text, c.source, c.page, h.score FROM hits h JOIN chunks c ON c.chunk_id = h.chunk_id)"""


def query_vectors_sql(source: str) -> str:
    return f"""query_vectors AS (SELECT query_id, list_transform(v, lambda x: (x / (sqrt(list_inner_product(v, v)) + 1e-9))::FLOAT)::DOUBLE[] AS embedding FROM (
        SELECT query_id, list_transform(range({DIM}), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS v FROM (
        SELECT query_id, list_transform({words_sql('query')}, lambda w: ('0x' || substr(md5(lower(w)), 1, 4))::INT % {DIM}) AS b FROM {source}
        WHERE regexp_matches(query, '{I.NOT_WS}'))))"""


def hits_sql(final: str, source: str = "text_queries", *needed: str, corpus: str = "chunk_vectors") -> str:
    head = sql("", corpus, source, *needed)
    return f"{head.rstrip()},\n{query_vectors_sql(source)},\n{TEXT_HITS.replace('chunk_vectors', corpus)}\n{final}"


def text_hits(spark, sf, queries, k: int = 6, embedded: str = "preview"):
    asked = vectors.embed(vectors.blank_query_filter(queries), "query", DIM)
    return vectors.knn_exact(I.text_base(spark, sf, embedded)["vectors"], asked.select("query_id", "embedding"), k, DIM)


@register("search_text", hits_sql("SELECT query_id, rank, chunk_id, score FROM hits"))
def search_text(spark, sf):
    return text_hits(spark, sf, I.text_queries(spark, sf))


@register("hydrate_hits", hits_sql("SELECT * FROM hydrated"))
def hydrate_hits(spark, sf):
    return vectors.hydrate_hits(search_text(spark, sf), I.text_base(spark, sf)["chunks"])


@register("blank_query_filter", sql(f"SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '{I.NOT_WS}') AND role = 'user'"))
def blank_query_filter(spark, sf):
    blanked = I.table(spark, sf, "conversations").withColumn("query", F.when(F.col("role") == "user", F.col("text")).otherwise(F.lit("  \t")))
    return vectors.blank_query_filter(blanked).select("conv_id", "turn")


@register("similarity_from_distance", """SELECT vec_id, round(1 - distance, 6) AS score, round(1 - euclid * euclid / 2, 6) AS score_of_euclid
    FROM (SELECT vec_id, 1 - list_inner_product(e, f) AS distance, sqrt(list_sum(list_transform(range(1, 65), lambda i: (e[i] - f[i]) ** 2))) AS euclid
          FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_reverse(embedding)::DOUBLE[] AS f FROM embeddings))""")
def similarity_from_distance(spark, sf):
    pair = I.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"),
                                                    F.reverse("embedding").cast("array<double>").alias("f"))
    difference = F.zip_with("e", "f", lambda x, y: x - y)
    measured = pair.select("vec_id", (1 - V.dot(F.col("e"), F.col("f"))).alias("distance"), V.norm(difference).alias("euclid"))
    return measured.select(
        "vec_id", F.round(V.similarity_from_distance(F.col("distance")), 6).alias("score"),
        F.round(V.similarity_from_euclidean(F.col("euclid")), 6).alias("score_of_euclid"),
    )


@register("cosine_similarity", """SELECT vec_id, round(list_inner_product(e, f) / ((sqrt(list_inner_product(e, e)) + 1e-9) * (sqrt(list_inner_product(f, f)) + 1e-9)), 6) AS cosine
    FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e, list_reverse(embedding)::DOUBLE[] AS f FROM embeddings)""")
def cosine_similarity(spark, sf):
    pair = I.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("e"),
                                                    F.reverse("embedding").cast("array<double>").alias("f"))
    return pair.select("vec_id", F.round(V.cosine_similarity(F.col("e"), F.col("f")), 6).alias("cosine"))


@register("check_dimension", """SELECT vec_id, CASE WHEN label = 0 THEN 'no vector' WHEN label = 1 THEN 'size 63, expected 64' END AS error FROM embeddings""")
def check_dimension(spark, sf):
    """Some labels lose their vector or its last number."""
    damaged = F.when(F.col("label") == 0, None).when(F.col("label") == 1, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return vectors.check_dimension(I.table(spark, sf, "embeddings").withColumn("embedding", damaged), DIM).select("vec_id", "error")


@register("upsert_chunks", sql("""SELECT chunk_id, source, coalesce(o.page, n.page) AS page, coalesce(o.text, n.text) AS text FROM
    (SELECT chunk_id, source, page, text FROM chunks WHERE kind = 'text') o FULL JOIN (SELECT chunk_id, source, -1 AS page, preview AS text FROM chunks) n USING (chunk_id, source)""", "chunks"))
def upsert_chunks(spark, sf):
    """The chunks of text files are stored; all chunks come again, twice, with other content."""
    chunks = I.doc_chunks(spark, sf)
    current = chunks.where("kind = 'text'").select("chunk_id", "source", "page", "text")
    again = chunks.select("chunk_id", "source", F.lit(-1).alias("page"), F.col("preview").alias("text"))
    later = chunks.select("chunk_id", "source", F.lit(-2).alias("page"), F.lit("later").alias("text"))
    return catalog.upsert_chunks(current, again.unionByName(later), [F.col("page").desc()])
