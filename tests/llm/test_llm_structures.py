"""Centroids, repeated passages and the prefix trie against brute force, with every odd case."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from decimal import Decimal
from math import floor

import numpy as np
import pytest

from sheavework.llm import bulk, centroids, passages, prefixes
from sheavework.llm.frames import settle


def vector_table(spark, rows):
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return made.selectExpr("vec_id", "embedding", "1 AS parts", "2 AS PIVOTS", "3 AS cluster", "4 AS Embedding2").repartition(3)


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, [floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    centres = [v for _, _, v in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), n, v) for n, (i, v) in enumerate(kept) if i is not None)][:k]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[place(v)[1]].append(v)
        for j, members in groups.items():
            centres[j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    return [(i, place(v)[1], place(v)[0]) for i, v in kept], centres


@pytest.mark.parametrize("n, k", [(300, 40), (25, 40), (1, 3)])
def test_clusters_against_brute_force(spark, n, k):
    rng = random.Random(n)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.uniform(-2, 2)]) for _ in range(4)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(n // 3)] + [(None, rows[0][1]), (2000, None), (2001, [1.0]), (2002, [None, 1.0, 2.0, 3.0]), (2003, [float("nan"), 0.0, 0.0, 0.0]),
             (2004, [float("inf"), 0.0, 0.0, 0.0]), (2005, []), (2006, [0.0] * 4), (2006, [0.0] * 4), (2007, [1.0] * 5)]
    want, centres = brute_clusters(rows, k, 5, 4)
    assigned, final = centroids.clusters(vector_table(spark, rows), k=k, rounds=5, dim=4)
    told = centroids.with_inertia(assigned, final).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in told), key=repr) == sorted(want, key=repr)
    assert final.tolist() == centres
    for r in told:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.inertia == sum(d for _, _, d in want)


def test_clusters_of_nothing_and_too_large_numbers(spark):
    assigned, final = centroids.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>"), dim=4)
    assert centroids.with_inertia(assigned, final).collect() == []
    with pytest.raises(ValueError, match="after scaling"):
        centroids.clusters(spark.createDataFrame([(1, [1e300] * 4)], "vec_id long, embedding array<double>"), dim=4)


def test_bounds_rule_out_only_farther_centroids():
    rng = np.random.default_rng(1)
    centres = rng.integers(-500, 500, (40, 8))
    vectors = centres[rng.integers(0, 40, 3000)] + rng.integers(-20, 21, (3000, 8))
    fixed = centroids.chosen_pivots(centres)
    best, distance, computed = centroids.nearest_centroids(vectors, centroids.pivot_distances(vectors, fixed), centres, centroids.pivot_distances(centres, fixed))
    every = ((vectors[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert computed < 0.2 * every.size


def doc_table(spark, rows, parts=5):
    made = spark.createDataFrame(rows, "doc_id long, text string")
    return made.selectExpr("doc_id", "text", "1 AS chunk", "2 AS TEXT2", "3 AS hits", "4 AS n_words").repartition(parts)


def brute_repeats(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    rank = [float("inf") if i is None else i for i, _ in rows]
    first = {}
    for r, w in zip(rank, words, strict=True):
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            first[key] = min(r, first.get(key, r))
    found = []
    for (i, _), r, w in zip(rows, rank, words, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < r:
                gone[s : s + width] = [True] * width
        found.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return found


@pytest.mark.parametrize("width, chunk_bytes, bucket_bytes", [(13, 1 << 21, 1 << 24), (13, 400, 2000), (2, 300, 900), (1, 300, 900), (6, 300, 1500)])
def test_repeats_against_brute_force(spark, monkeypatch, width, chunk_bytes, bucket_bytes):
    monkeypatch.setattr(passages, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(passages, "BUCKET_BYTES", bucket_bytes)
    rng = random.Random(width)
    passage = [f"p{i}" for i in range(30)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "ab cd  é\x0bx"), (None, " ".join(passage)), (None, " ".join(passage)), (7, " ".join(passage)), (7, " ".join(passage)),
            (8, "x " * 300), (9, "x " * 12), (10, "x " * 13), (11, "y " * 5000 + " ".join(passage)), (12, " ".join(passage[:12]))]
    for i in range(120):
        words = [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 40))]
        if i % 3 == 0:
            a = rng.randint(0, 25)
            words[3:3] = passage[a : a + rng.randint(3, 30)]
        if i % 5 == 0:
            words += (rows[-1][1] or "").split()
        rows.append((rng.randint(13, 90), rng.choice([" ", "\n", " \t"]).join(words)))
    got = passages.without_repeats(doc_table(spark, rows), width).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == sorted(brute_repeats(rows, width), key=repr)
    assert all(sum(x.n for x in r.repeats) == r.n_removed and all(a.first + a.n < b.first for a, b in zip(r.repeats, r.repeats[1:], strict=False)) for r in got)


def test_answers_to_chunks_are_a_bit_for_each_window(spark, monkeypatch):
    monkeypatch.setattr(passages, "CHUNK_BYTES", 400)
    rows = [(i, " ".join(f"w{j}" for j in range(100))) for i in range(6)]
    chunks = settle(passages.chunks_of(doc_table(spark, rows).select("doc_id", "text")), "chunks")
    sent = settle(passages.probes(chunks, 7, 3), "probes")
    anchors = passages.shared_anchors(sent)
    framed = settle(passages.frames(chunks, anchors, 7, 13, 3), "frames")
    owners = passages.first_owners(framed)
    for asked, size, answers in ((sent, "length(probes) / 4", anchors), (framed, "length(a) / 8", owners)):
        least = {(r.chunk, r.bucket): -(-int(r.n) // 8) for r in asked.selectExpr("chunk", "bucket", f"{size} AS n").collect()}
        told = answers.collect()
        assert told and all(len(r.bits) == least[r.chunk, r.bucket] for r in told)


def test_long_texts_and_bytes_are_whole(monkeypatch):
    hasher = bulk.Hasher()
    text = " ".join(f"wort{i % 977}" for i in range(4000)).encode()
    raw = [np.array([3, 4], np.int64).tobytes(), np.array([len(text)] * 2, np.int64).tobytes(), passages.zstandard.ZstdCompressor().compress(text * 2)]
    whole = passages.Chunk(*raw, hasher).words
    monkeypatch.setattr(bulk, "BATCH_BYTES", 100)
    assert (passages.Chunk(*raw, hasher).words == whole).all() and (whole[:4000] == whole[4000:]).all() and len(np.unique(whole)) == 977


def turn_table(spark, rows, parts=4):
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return made.selectExpr("conv_id", "turn", "role", "text", "1 AS depth", "2 AS k1", "3 AS TURN_NO", "4 AS size").repartition(parts)


def brute_trie(rows, group=5, heads=9):
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    plain = defaultdict(list)
    for c, n, r, t in rows:
        if c is not None:
            plain[c].append((n is not None, n or 0, digest(r or "", t or ""), (r or "", t or "")))
    plain = {c: [x[3] for x in sorted(v)] for c, v in plain.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % heads
        made = plain.get(c - c % group, [])[:h] + own[h:]
        for d in range(len(made) + 1):
            members[tuple(made[:d])].append(c)
        ends[tuple(made)].append(c)
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        own = (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += not kids[node]
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], sha(ends[n])) for n, m in members.items()]


def found_trie(df):
    return [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()]


@pytest.mark.parametrize("width, stretch, matrix, block", [(16, 1 << 14, 1 << 15, 1 << 13), (2, 4, 7, 3), (3, 12, 1000, 8192)])
def test_trie_against_brute_force(spark, monkeypatch, width, stretch, matrix, block):
    for name, value in (("WIDTH", width), ("STRETCH", stretch), ("MATRIX_ROWS", matrix), ("IDS_IN_BLOCK", block)):
        monkeypatch.setattr(prefixes, name, value)
    rng = random.Random(width)
    rows = [(None, 1, "user", "lost"), (-7, 1, "user", "negative"), (-10, 2, None, None), (-10, None, "user", None), (-10, None, None, "x"), (3, 1, "user", "alone")]
    for c in range(5, 90):
        for t in range(rng.choice([1, 2, 3, 9, 12])):
            rows.append((c, t if rng.random() < 0.9 else 0, rng.choice(["user", "bot"]), rng.choice(["hello", "hé", "", "what is it", f"own {c}"]) if t > 2 else "common"))
    rows += [(200 + c, t, "user", "same") for c in range(60) for t in range(10)]
    rows += [(c, t, "user", f"long {t // 7}") for c in (300, 305, 306) for t in range(120)]
    rows += rows[10:14]
    assert sorted(found_trie(prefixes.prefix_trie(turn_table(spark, rows))), key=repr) == sorted(brute_trie(rows), key=repr)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixes.prefix_trie(empty).collect() == []
    assert prefixes.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], empty.schema)).collect() == []
    rows = [(c, 0, "user", "x") for c in range(1, 100) if zlib.crc32(str(c).encode()) % 9 and c % 5]
    assert found_trie(prefixes.prefix_trie(turn_table(spark, rows))) == brute_trie(rows)


def test_means_are_floors_of_exact_sums(spark):
    sums = spark.createDataFrame([(0, 0, Decimal(-7), 2), (0, 1, Decimal(7), 2), (0, 2, Decimal(3 * 10**19), 3 * 10**18)], "cluster long, place long, total decimal(38,0), n long")
    assert centroids._means(sums) == {0: [-4, 3, 10]}


def test_workers_give_memory_back(monkeypatch):
    """Memory goes back once the rows have left and what a task held is gone."""
    import weakref

    import numpy as np

    from sheavework.llm import bulk

    held, seen = [], []
    monkeypatch.setattr(bulk, "give_back", lambda: seen.append(held[0]() is None))

    def run(batches):
        model = np.zeros(10)
        held.append(weakref.ref(model))
        for batch in batches:
            yield batch + len(model)

    assert list(bulk.lean(run)(iter([1, 2]))) == [11, 12]
    assert seen == [True]
    monkeypatch.undo()
    bulk.give_back()
