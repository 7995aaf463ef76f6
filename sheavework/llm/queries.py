"""Registered queries of the operators, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, counting, exact, language, near, neighbours, packing, passages, pieces, prefixes, private, sharding, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(call: Query) -> Query:
    QUERIES[call.__name__] = call
    return call


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir), words=4, percent=80)


@query
def op2_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


ORACLES["op2_exact_duplicates"] = r"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)
"""


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(documents(spark, sf_dir), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.private_spans(documents(spark, sf_dir))


def word_bpe(path: str | None = None) -> Callable[[], Callable]:
    """A factory for ``packing``: the encoder of a tokenizers file, by default that of the public vocabulary."""

    def load() -> Callable:
        import public_tokenizers

        return bpe.WordEncoder(path or public_tokenizers.path("word_bpe_49k.json")).encode

    return load


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), word_bpe(), end_id=1, room=4096)


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted_languages(documents(spark, sf_dir), modulus=4, rest=2)


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), modulus=5, rest=0)


@query
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), query_modulus=100, k=10)


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = counting.byte_level_pieces(public_tokenizers.path("byte_bpe_50k.json"))
    return counting.token_counts(documents(spark, sf_dir), vocabulary)


@query
def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digests(pieces.encoded(documents(spark, sf_dir), path), path)


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, final = centroids.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, rounds=5, dim=64, scale=256, label="2")
    return centroids.with_inertia(assigned, final)


def clusters_sql(k: int, rounds: int, dim: int, scale: int, label: str) -> str:
    """The rounds written out one after the other, every vector against every centroid."""
    parts = [f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{label}:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL) ORDER BY h, v LIMIT {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT n, vec_id, kept.v, c, list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
            FROM (SELECT row_number() OVER () AS n, * FROM kept) kept, c{r}) GROUP BY n, vec_id, v)""")
        if r < rounds:
            parts.append(f"""m{r} AS (SELECT c, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS v FROM (SELECT c, i, sum(x) AS s, count(*) AS n
                FROM (SELECT c, unnest(v) AS x, unnest(range({dim})) AS i FROM a{r}) GROUP BY c, i) GROUP BY c),
                c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
        SELECT vec_id, a.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c USING (c)"""


ORACLES["op11_centroids"] = clusters_sql(40, 5, 64, 256, "2")


@query
def op12_substring_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.without_repeats(documents(spark, sf_dir), width=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLES["op12_substring_repeats"] = r"""
WITH lists AS (SELECT row_number() OVER () AS n, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
spelled AS (SELECT n, doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM lists),
framed AS (SELECT n, doc_id, word, pos, CASE WHEN count(*) OVER ahead = 13 THEN string_agg(word, ' ') OVER ahead END AS frame
  FROM spelled WINDOW ahead AS (PARTITION BY n ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
judged AS (SELECT n, doc_id, word, pos, frame IS NOT NULL AND min(doc_id) OVER (PARTITION BY frame) < doc_id AS again FROM framed),
marked AS (SELECT n, word, pos, bool_or(again) OVER (PARTITION BY n ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM judged)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM lists LEFT JOIN (SELECT n, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY n) USING (n)
"""


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), group=5, heads=9).drop("n_ends")


#: crc32 is not a function of the engine; it is worked out bit by bit.
CRC32_SQL = """list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len({0}) + 1), lambda i: ascii(({0})[i])::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, step: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))"""

ORACLES["op13_prefix_trie"] = f"""
WITH said AS (SELECT conv_id, coalesce(text, '') AS text, octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '') AS turn_text, turn FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha) - 1 AS turn_no, sha, n_bytes
  FROM (SELECT conv_id, turn, sha256(turn_text) AS sha, octet_length(encode(text)) AS n_bytes FROM said)),
ids AS (SELECT conv_id, conv_id - (((conv_id % 5) + 5) % 5) AS base, xor({CRC32_SQL.format("conv_id::VARCHAR")}, 4294967295::BIGINT) % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (SELECT i.conv_id, 0 AS part, t.turn_no, t.sha, t.n_bytes FROM ids i JOIN turns t ON t.conv_id = i.base AND t.turn_no < i.h
  UNION ALL SELECT i.conv_id, 1, t.turn_no, t.sha, t.n_bytes FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.turn_no >= i.h),
lists AS (SELECT conv_id, coalesce(shas, []) AS shas, coalesce(sizes, []) AS sizes FROM ids LEFT JOIN (
  SELECT conv_id, list(sha ORDER BY part, turn_no) AS shas, list(n_bytes ORDER BY part, turn_no) AS sizes FROM parts GROUP BY conv_id) USING (conv_id)),
steps AS (SELECT conv_id, d AS depth, array_to_string(shas[1:d], '') AS key, CASE WHEN d > 0 THEN array_to_string(shas[1:d - 1], '') END AS parent_key,
    CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS n_bytes, d = len(shas) AS ends FROM (SELECT *, unnest(range(len(shas) + 1)) AS d FROM lists)),
nodes AS (SELECT key, depth, any_value(parent_key) AS parent_key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n_bytes) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM steps GROUP BY key, depth),
kids AS (SELECT parent_key AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent_key),
known AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (key)),
sums AS (SELECT a.key, sum(k.own) AS saved_tokens, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves FROM known k
  JOIN (SELECT key AS below, unnest(list_transform(range(depth + 1), lambda d: substr(key, 1, 64 * d))) AS key FROM known) a ON a.below = k.key GROUP BY a.key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM known n JOIN sums s USING (key) LEFT JOIN nodes p ON p.key = n.parent_key
"""
