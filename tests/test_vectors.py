import weakref

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheavework.operators import catalog, vectors, workers
from sheavework.operators.cells import StoredCells, nearest_cells, recall

DIM = 8


def make(spark, n, seed, name, copies=0):
    rnd = np.random.default_rng(seed)
    m = rnd.normal(size=(n, DIM))
    if copies:
        m[:copies] = m[0]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m = m.astype(np.float32)
    df = spark.createDataFrame([(f"{name}{i:05d}", [float(x) for x in v]) for i, v in enumerate(m)], f"{'query_id' if name == 'q' else 'chunk_id'} string, embedding array<float>")
    return df, m.astype(np.float64)


def brute(c, q, k):
    out = []
    for i, v in enumerate(q):
        scores = np.round(c @ v, 6)
        order = sorted(range(len(c)), key=lambda j: (-scores[j], j))[:k]
        out += [(f"q{i:05d}", r, f"c{j:05d}") for r, j in enumerate(order, 1)]
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r["rank"], r.chunk_id) for r in df.collect())


@pytest.mark.parametrize("copies", [0, 200])
def test_all_ways_equal_brute_force(spark, copies):
    # A third of the corpus may be one and the same vector: ties go by chunk id.
    (corpus, c), (queries, q) = make(spark, 600, 1, "c", copies), make(spark, 50, 2, "q")
    want = brute(c, q, 5)
    corpus = corpus.repartition(6)
    assert rows(vectors.knn_exact(corpus, queries, 5, DIM)) == want
    assert rows(vectors.knn_exact(corpus, queries, 5, DIM, query_bytes=7 * 8 * DIM)) == want  # more blocks than one plan takes
    index = vectors.build_cells(corpus, DIM, cells=7)
    assert rows(vectors.knn_approx(index, queries, 5, nprobe=7, block_rows=50)) == want


def test_fewer_vectors_than_k_and_wrong_sizes(spark):
    corpus, c = make(spark, 3, 1, "c")
    bad = spark.createDataFrame([("bad", [1.0, 2.0]), ("none", None)], corpus.schema)
    queries, q = make(spark, 4, 2, "q")
    for size in (1 << 20, 8 * DIM):
        got = vectors.knn_exact(corpus.unionByName(bad), queries, 5, DIM, query_bytes=size)
        assert rows(got) == brute(c, q, 5)
    errors = {r.chunk_id: r.error for r in vectors.check_dimension(corpus.unionByName(bad), DIM).collect()}
    assert errors["bad"] == "size 2, expected 8" and errors["none"] == "no vector" and errors["c00000"] is None


def test_approximate_prunes(spark):
    (corpus, c), (queries, q) = make(spark, 2000, 1, "c"), make(spark, 50, 2, "q")
    index = vectors.build_cells(corpus, DIM, cells=32)
    got, want = set(rows(vectors.knn_approx(index, queries, 10, nprobe=8))), brute(c, q, 10)
    found = {(a, b) for a, _, b in got} & {(a, b) for a, _, b in want}
    assert len(found) / len(want) >= 0.55
    assert vectors.scored_pair_share(index, queries, 8).first().share <= 0.40


@pytest.mark.parametrize("size", [1 << 25, 20 * 8 * DIM])
def test_stored_cells(spark, tmp_path, size):
    (corpus, c), (queries, q) = make(spark, 600, 1, "c", 200), make(spark, 50, 2, "q")
    bad = spark.createDataFrame([("bad", [1.0, 2.0]), ("none", None), ("c00007", [0.0] * DIM)], corpus.schema)
    first, root = corpus.where("chunk_id < 'c00400'"), str(tmp_path / "cells")
    built = StoredCells.build(first.repartition(3), root, DIM, cells=7)
    assert rows(built.search(queries, 5, nprobe=7, query_bytes=size)) == brute(c[:400], q, 5)
    index = StoredCells.open(spark, root)
    assert (index.centroids == built.centroids).all()
    index.add(corpus.where("chunk_id > 'c00350'").unionByName(bad))
    index.add(corpus)
    again = StoredCells.open(spark, root)
    assert again.vectors.count() == 600 and (again.centroids == built.centroids).all()
    assert rows(again.search(queries.unionByName(bad.selectExpr("chunk_id AS query_id", "embedding").limit(2)), 5, nprobe=70, query_bytes=size)) == brute(c, q, 5)
    found = again.search(queries, 5, nprobe=2, query_bytes=size)
    near = nearest_cells(np.floor(q * 32768), again.centroids, 2)
    place = nearest_cells(np.floor(c * 32768), again.centroids, 1)[:, 0]
    pairs = [(f"q{i:05d}", f"c{j:05d}") for i in range(50) for j in range(600) if place[j] in near[i]]
    assert {(a, b) for a, _, b in rows(found)} <= set(pairs)
    assert tuple(again.pair_share(queries, 2).first()) == (len(pairs), 50 * 600)
    exact = vectors.knn_exact(corpus, queries, 5, DIM)
    met = recall(found, exact).first()
    assert met.wanted == 250 and met.hits == len({(a, b) for a, _, b in rows(found)} & {(a, b) for a, _, b in brute(c, q, 5)})


def test_probes_prune_the_folders(spark, tmp_path):
    corpus, _ = make(spark, 300, 1, "c")
    index = StoredCells.build(corpus, str(tmp_path / "cells"), DIM, cells=9)
    plan = index.search(corpus.limit(2).withColumnRenamed("chunk_id", "query_id"), 3, nprobe=1)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan


def test_queries_are_scored_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def scorer():
        def score(texts):
            calls.add(len(texts))
            return np.array([[float(len(t) + 1), *[float(ord(c)) for c in t[: DIM - 1].ljust(DIM - 1)]] for t in texts])

        return score

    asked = spark.range(40).selectExpr("cast(id AS string) AS query_id", "concat('text ', id) AS t")
    corpus, _ = make(spark, 100, 1, "c")
    queries = vectors.embed(asked, "t", DIM, scorer)
    assert vectors.knn_exact(corpus, queries, 3, DIM, query_bytes=9 * 8 * DIM).count() == 120
    assert calls.value == 40


def test_embed(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, "c")], "i int, t string")
    got = {r.i: r for r in vectors.embed(df, "t", 16).collect()}
    assert abs(np.linalg.norm(got[1].embedding) - 1) < 1e-6 and np.linalg.norm(got[2].embedding) == 0
    assert sorted(x for x in got[1].embedding if x) == pytest.approx(sorted([2 / 5**0.5, 1 / 5**0.5]), abs=1e-6)

    def failing():
        def score(texts):
            if "c" in texts:
                raise RuntimeError("no model")
            return np.ones((len(texts), 16))

        return score

    got = {r.i: r for r in vectors.embed(df, "t", 16, failing, batch_rows=1).collect()}
    assert got[1].error is None and got[3].embedding is None and "no model" in got[3].error
    wrong = vectors.embed(df, "t", 3, failing, batch_rows=1).collect()
    assert all(r.embedding is None and r.error for r in wrong)


def test_hydrate_hot_chunk(spark):
    hits = spark.range(3000).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id"))).alias("chunk_id"), F.lit(0.5).alias("score"))
    chunks = spark.createDataFrame([("hot", "t", "s", 1), ("c1", "u", "s", None)], "chunk_id string, text string, source string, page int")
    got = vectors.hydrate_hits(hits, chunks)
    assert got.count() == 1001 and got.where("query_id = 1").first().text == "u"


def test_insert_or_ignore(spark):
    schema = "chunk_id string, source string, page int, text string"
    current = spark.createDataFrame([("a", "s", 1, "old")], schema)
    batch = spark.createDataFrame([("a", "s", 1, "new"), ("b", "s", 2, "second"), ("b", "s", 1, "first")], schema)
    once = catalog.upsert_chunks(current, batch, [F.col("page")])
    assert sorted(map(tuple, once.collect())) == [("a", "s", 1, "old"), ("b", "s", 1, "first")]
    assert sorted(map(tuple, catalog.upsert_chunks(once, batch, [F.col("page")]).collect())) == sorted(map(tuple, once.collect()))


def test_scores_are_held_in_bounded_blocks(spark, monkeypatch):
    # Many equal scores, more vectors than a block and more queries than are scored at once.
    import pyarrow as pa

    rng = np.random.default_rng(5)
    c, q = rng.integers(-2, 3, (700, 4)).astype(np.float64), rng.integers(-2, 3, (300, 4)).astype(np.float64)
    monkeypatch.setattr(vectors, "BLOCK_VECTORS", 64)
    monkeypatch.setattr(vectors, "SCORES", 1000)
    held = []
    add = vectors.RunningBest._add
    monkeypatch.setattr(vectors.RunningBest, "_add", lambda self, rows, ids, scores: (held.append(scores.size), add(self, rows, ids, scores)))
    best = vectors.RunningBest(len(q), 5)
    for part in np.array_split(rng.permutation(len(c)), 3):
        best.take(pa.RecordBatch.from_arrays([pa.array(part), pa.array(c[part].tolist())], names=["chunk_id", "embedding"]), q)
    got = [(r["query_id"], r["chunk_id"], r["score"]) for b in best.batches(np.arange(len(q)).astype(object), pa.int64()) for r in b.to_pylist()]
    scores = q @ c.T
    assert got == [(i, j, scores[i, j]) for i in range(len(q)) for j in sorted(range(len(c)), key=lambda j: (-scores[i, j], j))[:5]]
    assert max(held) <= 1000


def test_small_blocks_of_queries_share_a_pass(spark, monkeypatch):
    (corpus, c), (queries, q) = make(spark, 300, 1, "c"), make(spark, 50, 2, "q")
    passes = []
    once = vectors._knn_pass
    monkeypatch.setattr(vectors, "_knn_pass", lambda *a: (passes.append(1), once(*a))[1])
    assert rows(vectors.knn_exact(corpus, queries, 5, DIM, query_bytes=7 * 8 * DIM)) == brute(c, q, 5)
    assert len(passes) == 1
    few = vectors.knn_exact(corpus, queries, 5, DIM, query_bytes=8 * DIM, pass_bytes=2 * 8 * DIM)  # more passes than one plan takes
    assert rows(few) == brute(c, q, 5) and len(passes) == 26


def test_few_copies_of_a_side_are_sent(spark, monkeypatch):
    (corpus, c), (queries, q) = make(spark, 300, 1, "c"), make(spark, 9000, 2, "q")
    made = []
    blocks = vectors._knn_blocks
    monkeypatch.setattr(vectors, "_knn_blocks", lambda *a: (made.append(a[0]), blocks(*a))[1])
    vectors.knn_approx(vectors.build_cells(corpus, DIM, cells=2), queries, 5, nprobe=2)
    assert {r.q_blocks for r in made[0].select("q_blocks").distinct().collect()} == {1}


def test_queries_are_embedded_in_one_python_step(spark, monkeypatch):
    # Two steps would be two Python workers for every task, which wait beside the executor for the rest of the run.
    corpus, c = make(spark, 30, 1, "c")
    texts = spark.createDataFrame([("q00000", "a b a"), ("q00001", None), ("q00002", "c d")], "query_id string, query string")
    asked = vectors.embed(texts, "query", DIM)
    seen, store = [], vectors.settled
    monkeypatch.setattr(vectors, "settled", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or store(df))
    got = rows(vectors.knn_exact(corpus, asked, 3, DIM))
    assert len(seen) == 1 and "ArrowEvalPython" in seen[0] and "MapInArrow" not in seen[0]
    held = {r.query_id: r.embedding for r in asked.where("query is not null").collect()}
    assert got == sorted((q, rank, chunk) for i, (q, v) in enumerate(held.items()) for _, rank, chunk in brute(c, [np.array(v, dtype=np.float64)], 3))


def test_a_worker_gives_back_after_its_last_batch(monkeypatch):
    seen, held = [], []

    class Big:
        pass

    def run(batches):
        big = Big()
        held.append(weakref.ref(big))
        for b in batches:
            yield b + 10

    monkeypatch.setattr(workers, "give_back", lambda: seen.append(held[0]() is None))
    assert list(workers.lean(run)(iter([1, 2]))) == [11, 12] and seen == [True]


def test_texts_go_only_where_hits_are(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"text {i}", "s", i) for i in range(400)] + [("c7", "again", "s", 0), (None, "none", "s", 0)], "chunk_id string, text string, source string, page int")
    held = [(i, 1, f"c{i}", 0.5) for i in range(90)] + [(1000 + i, 2, "c7", 0.25) for i in range(500)] + [(5000, 1, "gone", 0.1), (5001, 1, None, 0.1)]
    hits = spark.createDataFrame(held, "query_id int, rank int, chunk_id string, score double")
    got = vectors.hydrate_hits(hits, chunks)
    texts = {}
    for r in chunks.collect():
        texts.setdefault(r.chunk_id, []).append((r.text, r.source, r.page))
    want = sorted((q, n, c, *t, s) for q, n, c, s in held if c for t in texts.get(c, []))
    assert sorted(map(tuple, got.collect())) == want
    # No text is repeated for every salt.
    assert "explode(sequence" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.columns == ["query_id", "rank", "chunk_id", "text", "source", "page", "score"]


def test_a_word_is_hashed_once_a_batch(spark, monkeypatch):
    import hashlib

    import pyarrow as pa

    seen, hashed = [], vectors.vectors.hashed_bucket
    monkeypatch.setattr(vectors.vectors, "hashed_bucket", lambda word, dim: seen.append(word) or hashed(word, dim))
    got = vectors._unit_counts(8).func(pa.array([["a", "b", "a"], None, [], ["ünï", "a"]]))
    assert sorted(seen) == sorted([b"a", b"b", "ünï".encode()]) and got[1].as_py() is None and got[2].as_py() == [0.0] * 8
    want = np.zeros(8)
    for w in ("a", "b", "a"):
        want[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 8] += 1
    assert got[0].as_py() == pytest.approx(list(want / np.linalg.norm(want)), abs=1e-6)
