import re

from pyspark.sql import functions as F

from sheavework.functions import names, text
from sheavework.operators import chunks


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


PIECES = ["a", "Bb", "é", "\U0001f600", "1", ".", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ",
          " ", " ", "　", "​", "﻿"]


def texts(n=300, seed=7):
    import random

    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + ["", " ", "\x1d", "x"]


def test_split_strip_blank_like_python(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "i int, t string")
    got = df.select("i", "t", text.words(F.col("t")).alias("w"), text.strip(F.col("t")).alias("s"), text.not_blank(F.col("t")).alias("b"),
                    text.single_spaced(F.col("t")).alias("j"), text.word_windows(F.col("t"), 3).alias("c")).collect()
    for r in got:
        words = r.t.split()
        assert r.w == words
        assert r.s == r.t.strip()
        assert r.b == bool(r.t.strip())
        assert r.j == " ".join(words)
        assert r.c == [" ".join(words[i : i + 3]) for i in range(0, len(words), 3)]


def test_window_counts(spark):
    for n, expected in [(0, 0), (1, 1), (299, 1), (300, 1), (301, 2), (600, 2), (20_000, 67)]:
        got = one(spark, lambda c: text.word_windows(c, 300), " ".join(f"w{i}" for i in range(n)))
        assert len(got) == expected
        assert " ".join(got).split() == [f"w{i}" for i in range(n)]


def test_chunk_id_and_preview(spark):
    import hashlib

    body = "word " * 310
    df = spark.createDataFrame([("a.txt", "text", 1, None, body), ("b.pdf", "pdf", 4, None, body), ("c.xlsx", "xlsx", 1, "S 1", body), ("d.csv", "csv", 1, None, " ")],
                               "source string, kind string, page int, sheet string, text string")
    got = {(r.source, r.chunk_no): r for r in chunks.text_chunks(df).collect()}
    assert len(got) == 6
    for source, tag in [("a.txt", "raw"), ("b.pdf", "4"), ("c.xlsx", "S 1-xlsx")]:
        words = body.split()
        for i in (0, 1):
            chunk = " ".join(words[i * 300 : (i + 1) * 300])
            row = got[source, i]
            assert row.text == chunk and row.chars == len(chunk) and row.preview == chunk[:160]
            assert row.chunk_id == hashlib.sha1(f"{source}-{tag}-{i}-{len(chunk)}".encode()).hexdigest()


def test_paragraph_chunks_equal_joined_text(spark):
    import random

    rnd = random.Random(3)
    rows, expected = [], {}
    for source, n in [("hot.docx", 3000), ("a.docx", 3), ("b.docx", 1)]:
        parts = [(" ".join(f"{source[0]}{i}_{j}" for j in range(rnd.choice([0, 1, 2, 7, 40, 900 if i % 500 == 0 else 5])))) for i in range(n)]
        rows += [(source, i, p) for i, p in enumerate(parts)]
        words = " ".join(parts).split()
        expected[source] = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    df = spark.createDataFrame(rows, "source string, para_no int, text string").repartition(7)
    got: dict = {}
    for r in chunks.chunk_paragraphs(df, 50).orderBy("source", "chunk_no").collect():
        assert r.chunk_no == len(got.setdefault(r.source, []))
        got[r.source].append(r.text)
    assert got == {s: c for s, c in expected.items() if c}
    joined = chunks.join_paragraphs(df, 100).orderBy("source", "part_no").collect()
    whole = " ".join(r.text for r in joined if r.source == "hot.docx")
    assert whole.split() == " ".join(r[2] for r in rows if r[0] == "hot.docx").split()


def test_headings(spark):
    paragraphs = [("a", 0, "Heading", " One "), ("a", 1, "heading 2", "Two"), ("a", 2, "HEADING 10", "Ten"), ("a", 3, "Heading 1", " \t"), ("a", 4, "Title", "No")]
    df = spark.createDataFrame(paragraphs, "source string, para_no int, style string, text string")
    got = chunks.headings_from_styles(df).orderBy("para_no").collect()
    assert [(r.page, r.level, r.heading) for r in got] == [(1, 1, "One"), (1, 2, "Two"), (1, 10, "Ten")]

    # Four words: sizes 10 10 16 16, so the upper median is 16 and no line reaches 20; without the last word it is 10.
    words = [("a", 1, 0, 5.2, 10.0, "x"), ("a", 1, 1, 5.9, 10.0, "y"), ("a", 1, 2, 30.0, 16.0, "Big"), ("a", 1, 3, 30.4, 16.0, "Line")]
    words += [(s, 2, w, t, z, x) for s, _, w, t, z, x in words[:3]] + [("a", 3, 0, 1.0, 0.0, "none"), ("a", 4, 0, 1.0, None, "none")]
    words += [("a", 5, 0, 1.0, 10.0, "a"), ("a", 5, 1, 1.0, 10.0, "b"), ("a", 5, 2, 9.0, 25.0, "H"), ("a", 5, 3, 9.0, None, "h")]
    df = spark.createDataFrame(words, "source string, page int, word_no int, top double, size double, text string")
    got = chunks.headings_from_font_size(df).orderBy("page").collect()
    assert [(r.page, r.level, r.heading) for r in got] == [(2, 1, "Big"), (5, 2, "H h")]


def test_headings_that_cannot_be_broadcast_shuffle_few_words(spark, monkeypatch):
    """Lines of many headings are sent to the words as bits, so that words of other lines stay where they are."""
    df = spark.range(40000).selectExpr("concat('d', id div 400) AS source", "CAST(id div 200 % 2 AS int) AS page", "CAST(id % 200 AS int) AS word_no",
                                       "CAST(id % 200 div 8 AS double) AS top", "CASE WHEN id % 200 < 8 THEN 20.0D ELSE 10.0D END AS size", "concat('w', id) AS text")
    whole = sorted(map(tuple, chunks.headings_from_font_size(df).collect()))
    passed, may_match = [], chunks.may_match

    def counted(big, small, on):
        few = may_match(big, small, on)
        passed.append(few.count())
        return few

    monkeypatch.setattr(chunks, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(chunks, "may_match", counted)
    assert sorted(map(tuple, chunks.headings_from_font_size(df).collect())) == whole and len(whole) == 200
    assert len(passed) == 1 and 1600 <= passed[0] < 8000


def test_names(spark):
    plain = {"Ab c-d.1": "ab_c_d_1", "Größe (m²)": "größe__m²_", "x_y": "x_y", "日本 1": "日本_1", "a/b\\c'd\"e": "a_b_c_d_e"}
    for given, wanted in plain.items():
        assert one(spark, names.normalize_name, given) == wanted
    kinds = {"a.PDF": "pdf", "b.docx": "docx", "c.csv": "csv", "d.xlsx": "xlsx", "e.xls": "xls", "f.md": "text", "g.TXT": "text", "h.bin": "other", "pdf": "other"}
    for name, kind in kinds.items():
        assert one(spark, names.file_kind, name) == kind


def test_readable_bytes(spark):
    shown = {0: "0.0 B", 1: "1.0 B", 1023: "1023.0 B", 1024: "1.0 KB", 1536: "1.5 KB", 1 << 20: "1.0 MB", (1 << 20) - 1: "1024.0 KB"}
    shown |= {5 << 30: "5.0 GB", 1 << 40: "1.0 TB", 626 * (1 << 40) + (1 << 38): "626.2 TB", 1 << 52: "4096.0 TB"}
    for n, wanted in shown.items():
        assert one(spark, text.readable_bytes, n, "long") == wanted


def test_title_case(spark):
    for s in ["user", "tool_call", "mc donald's", "aB-cD 1x", ""]:
        assert one(spark, text.title_case, s) == s.title()


def test_csv_line(spark):
    import csv
    import io

    for values in [["a", "b"], ['say "x"', "1,2", "l\nm"], ["", None, "z"], [""]]:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(["" if v is None else v for v in values])
        assert one(spark, text.csv_line, values, "array<string>") == out.getvalue()


def test_whitespace_class_is_pythons():
    import sys

    python = {c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()}
    assert {c for c in python if not re.match(r"[\s\x1c-\x1f]", c)} == set()


def test_sizes_of_lines_are_stored_by_columns(spark, monkeypatch):
    """Lines and pages are summed up from stored columns; only the marked lines are checkpointed as rows."""
    df = spark.createDataFrame([("a", 1, i, 5.0 + 9 * (i // 2), 20.0 if i < 2 else 10.0, f"w{i}") for i in range(8)], "source string, page int, word_no int, top double, size double, text string")
    seen, settled = [], chunks.settled
    monkeypatch.setattr(chunks, "settled", lambda df: seen.append(df.columns) or settled(df))
    assert [(r.heading, r.level, r.first_word) for r in chunks.headings_from_font_size(df).collect()] == [("w0 w1", 1, 0)]
    assert seen == [["source", "page", "line", "first_word", "level"]]
