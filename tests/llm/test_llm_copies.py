"""Exact copies, near copies and shards on small tables with every odd case."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from sheavework.llm import exact, near, sharding

ODD = [
    (1, "one two  three four five six"), (2, "one two three\tfour five six"), (3, None), (4, ""), (5, " \n"), (6, "x"), (6, "x"),
    (None, "x"), (None, "lonely text without an id"), (7, "ONE TWO three four five six"), (8, "é " * 3000), (9, "é " * 2999 + "é"),
    (10, "a b c"), (11, "a  b c"), (12, "a b"),
]


def table(spark, rows, parts=5):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS sid", "2 AS TEXT_SHA256", "3 AS _run", "4 AS n", "5 AS value").repartition(parts)


def test_exact_copies(spark):
    got = {(r.doc_id, r.text_sha256): r for r in exact.exact_duplicates(table(spark, ODD)).collect()}
    groups = defaultdict(list)
    for i, t in ODD:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert len(got) == len({(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in ODD})
    for plain, ids in groups.items():
        digest = hashlib.sha256(plain.encode()).hexdigest()
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            row = got[i, digest]
            assert (row.keep_id, row.group_size, row.kept) == (keep, len(ids), i == keep)


def test_merge_rounds_keep_the_smallest(spark):
    rng = random.Random(3)
    rows = [(f"{rng.randint(0, 9)}", 1, 1, rng.randint(0, 99), rng.randint(0, 1000), 1) for _ in range(400)]
    leaves = spark.createDataFrame(rows, "text_sha256 string, _bytes int, _second long, _run int, keep_id long, group_size long")
    got = {r.text_sha256: (r.keep_id, r.group_size) for r in exact.merge_rounds(leaves, 100).collect()}
    want = {d: (min(r[4] for r in rows if r[0] == d), sum(r[0] == d for r in rows)) for d in {r[0] for r in rows}}
    assert got == want


def test_first_of_each_keeps_rows_as_they_are(spark):
    docs = table(spark, ODD)
    kept = exact.first_of_each(docs)
    assert kept.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert texts.count((6, "x")) == 1 and (2, "one two three\tfour five six") not in texts and (1, "one two  three four five six") in texts


@pytest.mark.parametrize("operator", [exact.exact_duplicates, near.near_duplicates, sharding.sharded])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                label[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_near_copies_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(rng.choice([3, 12, 60, 150]))] for _ in range(8)]
    passage = [f"p{i}" for i in range(40)]
    rows = list(ODD)
    for i in range(260):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], [f"n{rng.randint(0, 30)}"], [words[at], "extra"]])
            words = words or ["w"]
        if i % 5 == 0:
            words = passage + words[: rng.randint(0, 30)]
        rows.append((100 + i, " ".join(words)))
    monkeypatch.setattr(near, "COLD", 4)  # long lists in a small table
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near.near_duplicates(table(spark, rows), 4, 80).collect()]
    assert sorted(got, key=repr) == sorted(brute_components(rows, 4, 80), key=repr)


def test_one_of_each_near_copy(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = table(spark, [(5, words), (3, words + " more"), (9, "other"), (None, words)])
    assert sorted((r.doc_id is None, r.doc_id) for r in near.one_of_each(docs).select("doc_id").collect() if r.doc_id) == [(False, 3), (False, 9)]


def test_union_estimate_is_exact_for_small_sets():
    raw = lambda s: np.array(sorted(s), np.uint32).tobytes()
    assert near.union_estimate([raw({1, 2, 3}), raw(set())], [raw({2, 3, 4}), raw({1})]).tolist() == [0.5, 0.0]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 24, 97, 1000])
def test_permutation_and_its_inverse(n):
    numbers = np.arange(n)
    spot = sharding.permuted(numbers, n, 7)
    assert sorted(spot.tolist()) == numbers.tolist()
    assert sharding.permuted(spot, n, 7, back=True).tolist() == numbers.tolist()
    shard, slot = sharding.place_of(numbers, n, 24, 7)
    assert sharding.row_at(shard, slot, n, 24, 7).tolist() == numbers.tolist()


def test_shards(spark):
    rows = ODD + [(i, "t" * (i % 7)) for i in range(50, 200)]
    got = sharding.sharded(table(spark, rows), shards=24).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = {(r.doc_id, r.row_no): (r.shard, r.slot) for r in sharding.sharded(table(spark, rows, 2), shards=24).collect()}
    assert all(again[r.doc_id, r.row_no] == (r.shard, r.slot) for r in got)
    sizes = {r.doc_id: r["size"] for r in got}
    assert sizes[3] == 8 and sizes[8] == 8 + 3 * 3000


@pytest.mark.parametrize("cold, rare, step", [(4, 3, 1), (4, 32, 8), (32, 32, 8)])
def test_copies_that_are_barely_unlike(spark, monkeypatch, cold, rare, step):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(220):
        words = list(base)
        for _ in range(rng.choice([2, 3, 4, 5, 5, 6])):
            at = rng.randrange(120)
            words[at] = rng.choice([f"own{i}-{at}", f"some{rng.randint(0, 8)}"])
        if i % 6 == 0:  # a family with the same differences
            words[10:16] = [f"f{i % 4}-{k}" for k in range(6)]
        if i % 9 == 0:  # only deletions
            words = [w for w in base if rng.random() > 0.04]
        rows.append((i, " ".join(words)))
    for name, value in (("COLD", cold), ("RARE", rare), ("STEP", step)):
        monkeypatch.setattr(near, name, value)
    asked = []
    within = near._within_groups

    def counted(*given):
        found = within(*given)
        asked.append(found.count())
        return found

    monkeypatch.setattr(near, "_within_groups", counted)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near.near_duplicates(table(spark, rows), 4, 80).collect()]
    want = brute_components(rows, 4, 80)
    assert sorted(got) == sorted(want)
    assert len({c for _, _, c in want}) > 30 and asked[0] < 0.35 * len(rows) ** 2 / 2


def test_sets_get_different_numbers(spark):
    rows = [(1, 3, 7, 7), (2, 3, 7, 8), (3, 3, 7, 7), (4, 0, 0, 0)]
    got = {r.doc_id: r.sid for r in near.with_set_ids(spark.createDataFrame(rows, "doc_id long, n long, h1 long, h2 long")).collect()}
    assert got[1] == got[3] != got[2]
