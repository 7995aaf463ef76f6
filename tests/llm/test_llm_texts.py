"""Personal data, packing, token counts and pieces against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sheavework.llm import bpe, counting, packing, pieces, private

public = pytest.importorskip("public_tokenizers")


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def n_digits(text):
    return sum(c in "0123456789" for c in text)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= n_digits(m) <= 19 and luhn(m)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= n_digits(m) <= 15),
]


def test_personal_data_against_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "a@b.c_d@e.f ..@x.y 😀 me@ex.am.ple", "4130383451285691, 4130-3834-5128-5691 +1 (386) 555-3733", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4"]
    texts += ["a" * 50_000 + "@", "1 2 " * 3000, "a@b.c " * 500, "+1" + " " * 5000, "a@b" + ".c" * 9000]
    texts += ["".join(rng.choice("a1.@+ -0(9é😀_") for _ in range(rng.randint(1, 50))) for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS _email_hits").repartition(4)
    for row in private.private_spans(docs).collect():
        found, counts = [], []
        for kind, pattern, valid in BASE:
            own = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, texts[row.doc_id] or "") if valid(m.group())]
            found += own
            counts.append(len(own))
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(counts)
        assert row.base_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert row.spans.split(",")[: len(found)] == (found or row.spans.split(",")[:0])


def test_checksums_and_context(spark):
    docs = spark.createDataFrame([(1, "IBAN DE89 3704 0044 0532 0130 00, amex card 378282246310005"), (2, "no 378282246310005 DE88370400440532013000")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in private.private_spans(docs).collect()}
    assert got == {1: "iban:5:32,short_card:44:59", 2: ""}


IBAN_, AMEX = "DE89370400440532013000", "378282246310005"


def test_added_kinds_beside_other_characters(spark):
    """A number ends where its length ends, whatever follows; one that starts inside a run is found too."""
    cases = [f"{IBAN_} {x}" for x in ("Bank", "BIC", "I am", "2024", "GB82 WEST 1234 5698 7654 32 UP")] + [f"AT11 {IBAN_}", f"{IBAN_}x", f"{IBAN_}1", "QQ41 1111 2222 3333 A B"]
    cases += [f"é card {AMEX} 12/27", f"card 12 {AMEX}", f"card {AMEX}1", f"{AMEX} 12/27", "card 3782 822463 10005 1227", "card 30569309025904 1", "card " + "1 " * 2000]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {cases[r.doc_id]: [x for x in r.spans.split(",") if x.startswith(("iban", "short"))] for r in private.private_spans(docs).collect()}
    assert [got[x] for x in cases[:4]] == [["iban:0:22"]] * 4 and got[cases[4]] == ["iban:0:22", "iban:23:50"]
    assert got[cases[5]] == ["iban:5:27"] and got[cases[6]] == got[cases[7]] == []
    assert [got[x] for x in cases[9:15]] == [["short_card:7:22"], ["short_card:8:23"], [], [], ["short_card:5:22"], ["short_card:5:19"]]
    clean = [r.text for r in private.redacted(docs.where("doc_id in (0, 4, 9)").orderBy("doc_id")).collect()]
    assert sorted(clean) == sorted(["[IBAN] Bank", "[IBAN] [IBAN] UP", "é card [SHORT_CARD] 12/27"])


def test_redaction(spark):
    docs = spark.createDataFrame([("x é a@b.c y +49 30 1234567", 1), (None, 2), ("plain", 3)], "text string, _row int")
    assert {r["_row"]: r["text"] for r in private.redacted(docs).collect()} == {1: "x é [EMAIL] y [PHONE]", 2: None, 3: "plain"}


@pytest.fixture(scope="module")
def encoder():
    return bpe.WordEncoder(public.path("word_bpe_49k.json"))


def test_word_encoder_equals_the_tokenizer(encoder):
    rng = random.Random(2)
    texts = ["", "it's don't I'll x's's ''s \"'s 'same 're're", "ΑΣ Σ", "<|endoftext|> hi", "日本 é", "a\x1cb\x85c", "12 3a4'd5", "a" * 3000, "İ ǅ ﬁ ½²"]
    texts += ["".join(rng.choice("ab'sltdrevm \n1é́Σ.\"!ß中İ½_-") for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("rows", [[], [(1, None)], [(i, "x" * (i * 37 % 260)) for i in range(300)] + [(7, "x" * 1000), (7, "x" * 1000), (None, "x")]])
def test_packing(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS _position")
    load = lambda: lambda texts: [np.arange(len(t)) for t in texts]
    got = packing.packed_documents(docs, load, end_id=1, room=100).collect()
    spots = defaultdict(list)
    for r in got:
        spots[r.sequence_id].append((r.offset, r.length))
    for own in spots.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0 and sum(n for _, n in own) <= 100
    sizes = [len(t or "") + 1 for _, t in rows]
    assert sum(r.length for r in got) == sum(sizes) and len(got) == sum(-(-s // 100) for s in sizes)
    assert len(spots) <= max(1, -(-sum(sizes) // 100)) * 1.05 + 1
    for r in got:
        if r.doc_id == 1 and rows == [(1, None)]:
            assert r.ids_crc32 == zlib.crc32(np.array([1], "<u4").tobytes())


def test_best_fit_takes_the_smallest_gap():
    assert packing.best_fit_rounds({7: 1, 6: 1, 3: 1}, 10) == [(7, 0, 1, 0, 0), (6, 0, 1, 1, 0), (3, 0, 1, 0, 7)]


def longest_match(text, vocabulary):
    total = 0
    for word in re.findall(rb"[^\x20\x09-\x0D]+", text.encode()):
        word, at, n = b" " + word, 0, 0
        while at < len(word):
            size = next((s for s in range(len(word) - at, 0, -1) if word[at : at + s] in vocabulary), 0)
            if not size:
                n = 1
                break
            at, n = at + size, n + 1
        total += n
    return total


def test_token_counts_against_brute_force(spark):
    vocabulary = {b" a", b" ab", b"b", b"bcd", b"abcdx", b"c", b" ", b"d", b" abcdz"}
    rng = random.Random(4)
    texts = [None, "", " \n "] + ["".join(rng.choice("abcdxyz ") for _ in range(rng.randint(0, 14))) for _ in range(1500)] + ["abcd" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS n_tokens")
    for row in counting.token_counts(docs, sorted(vocabulary)).collect():
        assert row.n_tokens == longest_match(texts[row.doc_id] or "", vocabulary)


def test_pieces_score_and_round_trip(spark):
    path = public.path("piece_bpe_32k.model")
    lattice = pieces.Lattice(pieces.Vocabulary.load(path))
    scores = dict(zip(lattice.v.pieces, lattice.v.scores, strict=True))
    rng = random.Random(6)
    texts = ["".join(rng.choice("abthe  é日😀\n") for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["", None, "x" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS ids")
    encoded = pieces.encoded(docs, path, chunk=20)  # most texts go through the scan
    got = {r.doc_id: r for r in encoded.collect()}
    back = {r.doc_id: r.text for r in pieces.decoded(encoded, path).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        seen = pieces.marked(text or "")
        best = [0.0] + [-1e30] * len(seen)
        for p in range(1, len(seen) + 1):
            for k in range(1, min(lattice.longest, p) + 1):
                value = scores.get(seen[p - k : p], lattice.loss if k == 1 else None)
                if value is not None:
                    best[p] = max(best[p], best[p - k] + value)
        assert got[i].score == pytest.approx(best[-1]) and back[i] == (text or "")


def test_scan_is_the_product():
    rng = np.random.default_rng(0)
    each = rng.normal(size=(7, 3, 3))
    step, want = each[0], [each[0]]
    for m in each[1:]:
        step = (step[:, :, None] + m[None]).max(axis=1)
        want.append(step)
    assert np.allclose(pieces.scan(each), want)
