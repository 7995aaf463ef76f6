"""Models and searches: held-out accuracy, exactness and the odd cases; the pipeline end to end."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sheavework.llm import language, neighbours, toxicity

SYLLABLES = {"aa": "tha ren ist ond ely", "bb": "öch keit üng sch ver", "cc": "ción ará ñoz que dad"}


def sentence(rng, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def languages(rng, n):
    return [(i, sentence(rng, lang, rng.randint(3, 60)), lang) for i in range(n) for lang in [rng.choice(sorted(SYLLABLES))]]


def test_languages(spark):
    rows = languages(random.Random(1), 240)
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "123 %%% 4", "cc"), (903, "tharen", None), (None, "kein öchkeit", "bb"), (904, "öchkeit " * 9000, None)]
    odd += [(905, "".join(chr(0x4E00 + i) for i in range(400)), None), (906, "öch 😀😀 keit", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS LANG_PRED").repartition(4)
    got = {r.doc_id: r for r in language.predicted_languages(docs).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (900, 901, 902))
    assert got[904].lang_pred == "bb" and got[905].rejected and not any(got[i].rejected for i, _, _ in rows)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.predicted_languages(docs).collect()] == [("und", 0.0)]
    assert language.predicted_languages(docs.limit(0)).collect() == []


def test_rare_languages_beyond_the_broadcast(spark):
    """With few grams in the broadcast the whole model is in tables: a small language beside large ones stays, all values are the same."""
    rng = random.Random(3)
    rows = [*languages(rng, 150), (500, "qua wix zuf qua", "dd"), (501, None, "aa"), (502, "12", "bb"), (503, "漢字 qua 😀", None), (503, "漢字 qua 😀", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    whole, tables = language.fit(docs), language.fit(docs, max_grams=50)
    tables.parts = 3
    assert tables.languages == whole.languages == ["aa", "bb", "cc", "dd"] and tables.limits == pytest.approx(whole.limits)
    one, two = (sorted(language.scored(docs, m, "doc_id").collect()) for m in (whole, tables))
    assert [(r.doc_id, r.lang_pred, r.rejected) for r in one] == [(r.doc_id, r.lang_pred, r.rejected) for r in two]
    for a, b in zip(one, two, strict=True):
        assert b.score == pytest.approx(a.score) and b.entropy == (None if a.entropy is None else pytest.approx(a.entropy))


def test_every_language_has_a_limit(spark):
    """Limits come from all rows, also of a language with few rows beside many others and of one that no row is recognised as."""
    rng = random.Random(5)
    many = spark.range(30_000).selectExpr("id AS doc_id", "'aa' AS lang", "'tharen istond ely ren' AS text")
    few = [(100_000 + i, "bb", sentence(rng, "bb", 20)) for i in range(3)] + [(200_000, "zz", "tharen istond ely ren")]
    docs = many.unionByName(spark.createDataFrame(few, "doc_id long, lang string, text string"))
    model = language.fit(docs)
    assert model.languages == ["aa", "bb", "zz"] and np.isfinite(model.limits).all()
    junk = spark.createDataFrame([(1, "öqxjzvwk ñkqzx öwqkjv " * 5)], "doc_id long, text string")
    assert [r.rejected for r in language.scored(junk, model, "doc_id").collect()] == [True]


def test_probabilities_sum_to_one():
    text = language.plain_letters("the thing that they thought there, then the other")
    keys, counts = np.unique(language.grams([text])[0], return_counts=True)
    points = sorted({ord(c) for c in text})
    model = language.KneserNey(keys, counts, len(points))
    for context in ("the", " th", "zzz"):
        high = sum(ord(c) << (16 * (3 - k)) for k, c in enumerate(context))
        assert model.probability(np.array([high | p for p in points], np.uint64)).sum() == pytest.approx(1)


def model_of(texts_by_language):
    plain = {lang: [language.plain_letters(t) for t in texts] for lang, texts in texts_by_language.items()}
    return {lang: np.unique(language.grams(texts)[0], return_counts=True) for lang, texts in plain.items()}


def brute_probability(texts, context, character, alphabet):
    """Interpolated Kneser-Ney by its definition, from the texts themselves."""
    grams_of = lambda n: [t[i - n + 1 : i + 1] for t in ("  " + language.plain_letters(x) for x in texts) for i in range(3, len(t))]
    counts = {}
    for g in grams_of(4):
        counts[g] = counts.get(g, 0) + 1
    tables = [counts]
    for _ in range(3):
        below = {}
        for g in tables[-1]:
            below[g[1:]] = below.get(g[1:], 0) + 1
        tables.append(below)
    result = 1 / alphabet
    for table, length in zip(reversed(tables), range(4), strict=True):
        once, twice = (sum(n == k for n in table.values()) for k in (1, 2))
        discount = once / (once + 2 * twice) if once and twice else 0.5
        ctx = context[len(context) - length :]
        total = sum(n for g, n in table.items() if g[:-1] == ctx)
        if total:
            kinds = sum(g[:-1] == ctx for g in table)
            result = (max(table.get(ctx + character, 0) - discount, 0) + discount * kinds * result) / total
    return result


def test_lookup_is_kneser_ney():
    """Against the definition, for seen and unseen grams and contexts of each language, and as a distribution behind every context."""
    rng = random.Random(2)
    texts = {lang: [sentence(rng, lang, 12) for _ in range(6)] for lang in ("aa", "bb")}
    model = language._gram_arrays(model_of(texts))
    lookup = model.lookup()
    points = sorted({c for ts in texts.values() for t in ts for c in language.plain_letters(t)})
    asked = ["tha", " th", "öch", "hth", "zzz", "qöc", "  t", "nöt"]
    for context in asked:
        high = sum(ord(c) << (16 * (3 - k)) for k, c in enumerate(context))
        keys = np.array([high | ord(c) for c in [*points, "漢"]], np.uint64)
        logs = lookup.sums(keys, np.arange(len(keys)), len(keys))
        assert np.exp(logs).sum(axis=0) == pytest.approx(1, abs=1e-5)
        for k, lang in enumerate(model.languages):
            want = [brute_probability(texts[lang], context, c, len(points) + 1) for c in [*points, "漢"]]
            assert np.exp(logs[:, k]) == pytest.approx(want, rel=1e-4)
    own = language.plain_letters("fremde wörter zwischen that ond")
    keys, owner = language.grams([own])
    assert lookup.entropies([own]) == pytest.approx(-lookup.sums(keys, owner, 1) / len(keys))


def test_limits_come_from_unseen_texts(spark, monkeypatch):
    """Two folds by text: a text and its copies are never scored by a model that has seen them."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, "aa", sentence(rng, "aa", 6)) for i in range(60)], "doc_id long, lang string, text string")
    model = language.fit(docs.unionByName(docs))
    folds = docs.selectExpr("*", "cast(pmod(xxhash64(text), 2) AS int) AS fold").collect()
    entropies = []
    for fold in (0, 1):
        half = language._gram_arrays(model_of({"aa": [r.text for r in folds if r.fold != fold] * 2}))
        entropies += half.lookup().entropies([language.plain_letters(r.text) for r in folds if r.fold == fold])[:, 0].tolist()
    assert model.limits[0] == pytest.approx(max(entropies) + language.REJECT_MARGIN)


def subsequences(s, t, decay):
    """The kernel by its definition: every pair of equal subsequences of three, weighted by what they span."""
    total = 0.0
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            for k in range(j + 1, len(s)):
                for a in range(len(t)):
                    for b in range(a + 1, len(t)):
                        for c in range(b + 1, len(t)):
                            if (s[i], s[j], s[k]) == (t[a], t[b], t[c]):
                                total += decay ** (k - i + 1 + c - a + 1)
    return total


def test_subsequence_kernel():
    marks, strings = [b"idiot", b"moron"], [b"idiot", b"idxiot", b"morn", b"abcdefg", b"iiddt"]
    got = toxicity.SubsequenceKernel(marks).of_strings(strings)
    decay = float(toxicity.DECAY)
    for s, row in zip(strings, got, strict=True):
        for m, value in zip(marks, row, strict=True):
            own = (subsequences(s, s, decay) * subsequences(m, m, decay)) ** 0.5
            assert value == pytest.approx((subsequences(s, m, decay) / own) ** toxicity.SHARPNESS, abs=1e-5)


def test_toxicity(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(300):
        text = sentence(rng, "aa", rng.randint(5, 40))
        toxic = i % 4 == 0
        if toxic:
            text += f" {rng.choice(['clown', 'moron', 'idiot'])} {sentence(rng, 'aa', 4)}"
        docs.append((i, text))
        labels.append((i, int(toxic)))
    extra = [(1000, "you i.d.i.o.t there"), (1001, "a m o r o n tha"), (1002, None), (1003, ""), (1004, "idioxt " + "tharen " * 4000), (1005, "tharen istond"), (None, "clown")]
    labels += [(1, 7), (2, None), (5000, 1)]
    got = toxicity.toxicity(
        spark.createDataFrame(docs + extra, "doc_id long, text string").selectExpr("*", "1 AS toxic", "2 AS score"), spark.createDataFrame(labels, "doc_id long, toxic int")
    ).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(docs) + len(extra) and all(r.predicted == int(r.score >= 0.5) for r in got)
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i].held_out for i in held) and np.mean([by[i].predicted == (i % 4 == 0) for i in held]) > 0.95
    assert by[1000].predicted and by[1001].predicted and by[None].predicted and not by[1005].predicted and by[1002].score == by[1003].score < 0.5


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(0 <= r.score < 0.5 for r in toxicity.toxicity(docs, labels).collect())
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_hilbert_neighbours_are_one_step_apart():
    for axes, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
        keys = neighbours.hilbert_keys(grid, bits)
        walk = grid[np.argsort(keys)]
        assert sorted(keys.tolist()) == list(range(len(grid))) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def exact_neighbours(rows, modulus, k):
    ids = np.array([i for i, _ in rows])
    matrix = np.array([v for _, v in rows])
    for i, v in rows:
        if i % modulus == 0:
            d = np.sqrt(((matrix - v) ** 2).sum(axis=1))
            own = [(d[j], int(ids[j])) for j in range(len(ids)) if ids[j] != i]
            yield i, sorted(own)[:k]


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(900)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(300)]
    odd = [(2000, None), (2001, [0.0] * 6), (2002, [1.0] * 5 + [float("nan")]), (2003, [1.0] * 5 + [None]), (2004, [1.0] * 3), (None, [1.0] * 6), rows[0]]
    docs = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS point", "2 AS place").repartition(4)
    monkeypatch.setattr(neighbours, "BLOCK", 128)
    got = {}
    for r in neighbours.nearest_neighbours(docs, 50, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = dict(exact_neighbours(rows, 50, 5))
    hits = sum(len({v for _, v, _ in got[q]} & {v for _, v in own}) for q, own in want.items())
    assert set(got) == set(want) and hits >= 0.9 * 5 * len(want)
    assert all([r for r, _, _ in sorted(own)] == [1, 2, 3, 4, 5] and all(s == sorted(x[2] for x in own)[i] for i, (_, _, s) in enumerate(sorted(own))) for own in got.values())
    assert [v for _, v, _ in sorted(got[1000])] == [1001, 1002, 1003, 1004, 1005]


def test_neighbours_of_few(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest_neighbours(docs, 100, 10).collect()] == [(0, 1, 1)]
    assert neighbours.nearest_neighbours(docs.limit(0), 100, 10).collect() == []


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, t, lang, f"s{i % 3}", len(t)) for i, t, lang in languages(rng, 60)]
    text = sentence(rng, "aa", 80)
    rows += [(100, text, "aa", "s", 1), (101, text, "aa", "s", 1), (102, text + " more", "aa", "s", 1), (103, "%% 12", "aa", "s", 1), (104, None, None, None, None)]
    rows += [(105, sentence(rng, "bb", 30) + " ahi.70@mail2.example.com", "bb", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["language"]) == {r[0] for r in rows} - {103, 104}
    assert set(kept["language"]) - set(kept["exact"]) >= {101} and 102 not in kept["near"] and {100, 105} <= set(kept["near"])
    assert kept["private"][105].endswith("[EMAIL]") and "@" not in kept["private"][105]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept["private"])


def test_stages_take_odd_tables(spark):
    """An empty table, rows that repeat, ids and texts that are null, and columns with the names that operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, sid long, _row long, TEXT_SHA256 string, centre int, fold int"
    extra = (1, 2, "x", 3, 4)
    rows = [(i, t, lang, "s", len(t), *extra) for i, t, lang in languages(random.Random(8), 40)]
    rows += [rows[3], rows[3], (None, rows[5][1], "aa", "s", 1, *extra), (70, None, "bb", "s", None, *extra), (71, "", None, None, 0, *extra), (72, "öchkeit " * 3000, "bb", "s", 9, *extra)]
    for made in ([], rows):
        docs = spark.createDataFrame(made, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.settle(stage(spark, docs, ""), "odd")
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "sid", "_row", "TEXT_SHA256", "centre", "fold"]
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert len(packed) >= 30 and sum(r.doc_id == rows[3][0] for r in packed) == 1


def test_pipeline_stages_hold_few_whole_texts_in_an_arrow_batch(spark, monkeypatch):
    for module, work in ((corpus_pipeline.language, "recognised"), (corpus_pipeline.near, "one_of_each"), (corpus_pipeline.packing, "packed_documents")):
        monkeypatch.setattr(module, work, lambda docs, *args, **more: docs)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "en", "one text")], "doc_id long, lang string, text string")
    try:
        for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_near_copies, corpus_pipeline.pack_sequences):
            spark.conf.unset(name)
            stage(spark, docs, "")
            assert int(spark.conf.get(name)) == corpus_pipeline.BATCH_BYTES
        texts = spark.range(0, 3000, 1, 1).selectExpr("repeat('ab', 2000) AS text")
        sizes = texts.mapInArrow(lambda batches: (b.select([]).append_column("n", pa.array([b.nbytes] * b.num_rows)) for b in batches), "n long")
        assert sizes.agg({"n": "max"}).first()[0] < 2 * corpus_pipeline.BATCH_BYTES
    finally:
        spark.conf.set(name, before)
