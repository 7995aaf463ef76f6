import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheavework.operators import catalog, search
from sheavework.operators.rows import Wanted, _names, first_rows, rows_of_queries
from sheavework.operators.spread import fits_broadcast, number_rows, number_within, running_offset, salted_join

TABLES = "table_name string, source string, page int, sheet string, created_at int"
COLUMNS = "table_name string, source string, sheet string, col_ordinal int, column_name string, parent string"


@pytest.fixture(scope="module")
def base(spark):
    tables = spark.createDataFrame([("star_part", "star.xlsx", None, "part", 1), ("star_nation", "star.xlsx", 3, "nation", 2), ("zz", "other.csv", None, "csv", 3)], TABLES)
    columns = spark.createDataFrame([("star_part", "star.xlsx", "part", 1, "p_name", None), ("star_part", "star.xlsx", "part", 2, "ring", "grp"),
                                     ("star_nation", "star.xlsx", "nation", 1, "n_name", None), ("zz", "other.csv", "csv", 1, "100%_x", "")], COLUMNS)
    values = [("star_part", i, [f"a{i}", "Ring%\\'" if i > 4 else None]) for i in range(9)] + [("star_nation", i, [f"x NAME{i}" if i > 5 else "y"]) for i in range(9)]
    values += [("zz", i, [f"v{i}"]) for i in range(2)]
    rows = spark.createDataFrame(values, "table_name string, row_no long, values array<string>")
    return tables, columns, rows


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def test_scores_and_order(spark, base):
    tables, columns, _ = base
    q = queries(spark, "NAME name n_na", "ring part", "nothing here", " ", "100%_x", "%", "star.xlsx")
    got = {(r.query_id, r.table_name): r.score for r in search.score_tables(q, tables, columns).collect()}
    assert got == {(0, "star_part"): 2, (0, "star_nation"): 3, (1, "star_part"): 2, (4, "zz"): 1, (5, "zz"): 1}
    assert (6, "star_part") in {(r.query_id, r.table_name) for r in search.score_tables(q, tables, columns, "all").collect()}
    first = search.top_k_tables(q, tables, columns, 1).where("query_id = 0").first()
    best = search.top_k_tables(q, tables, columns, 1, order="score").where("query_id = 0").first()
    assert (first.table_name, best.table_name) == ("star_part", "star_nation")


@pytest.mark.parametrize("postings", [64, 1])
def test_best_tables_equal_a_full_ranking(spark, postings):
    rnd = random.Random(3)
    words = ["common", "often", "rare", "odd", "x1", "x2", "x3", "none"]
    held = {f"t{i:03d}": ["common", *[w for w in words[1:-1] if rnd.random() < (0.5 if w == "often" else 0.08)]] for i in range(150)}
    tables = spark.createDataFrame([(t, "s", None, "h", rnd.randint(0, 9)) for t in held], TABLES)
    columns = spark.createDataFrame([(t, "s", "h", i, w, None) for t, ws in held.items() for i, w in enumerate(ws)], COLUMNS)
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6))) for _ in range(60)] + ["none", ""]
    order = {r.table_name: (r.created_at, r.table_name) for r in tables.collect()}
    want = set()
    for q, text in enumerate(texts):
        scores = {t: sum(w in ws for w in text.split()) for t, ws in held.items()}
        best = sorted((t for t, s in scores.items() if s), key=lambda t: (-scores[t], order[t]))[:4]
        want |= {(q, rank, t) for rank, t in enumerate(best, 1)}
    got = search.top_k_by_score(queries(spark, *texts), tables, columns, 4, postings=postings).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_samples(spark, base):
    tables, columns, rows = base
    q = queries(spark, "ring% part", "name6 name", "nation", "p_name ring%\\'")
    chosen = search.top_k_tables(q, tables, columns)
    got = {}
    for r in search.sample_rows(q, chosen, rows).orderBy("query_id", "table_name", "row_no").collect():
        got.setdefault((r.query_id, r.table_name), []).append((r.row_no, r.matched))
    assert got[0, "star_part"] == [(5, True), (6, True), (7, True)]
    assert got[1, "star_nation"] == [(6, True), (7, True), (8, True)]
    assert got[1, "star_part"] == [(0, False), (1, False), (2, False)]
    assert got[2, "star_nation"] == [(0, False), (1, False), (2, False)]
    assert got[3, "star_part"] == [(5, True), (6, True), (7, True)]
    text = search.search_context(queries(spark, "nation"), tables, columns, rows).first().structured
    assert text == "star_nation (cols: n_name) from star.xlsx p3\ny\ny\ny"


def test_row_matches_equal_brute_force_in_every_way(spark):
    rnd = random.Random(5)
    letters = "ab%_é"
    data = [(f"t{i % 3}", i // 3, ["".join(rnd.choice(letters + " ") for _ in range(rnd.randint(0, 12))) for _ in range(3)] + [None]) for i in range(300)]
    rows = spark.createDataFrame(data, "table_name string, row_no long, values array<string>")
    wanted = sorted({(rnd.randint(0, 9), f"t{rnd.randint(0, 2)}", "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 5)))) for _ in range(120)})
    want = sorted({(q, t, n) for t, n, values in data for q, table, tok in wanted if table == t and any(tok in (v or "").lower() for v in values)})
    asked = spark.createDataFrame(wanted, "query_id int, table_name string, token string")
    for limit in (1 << 20, 900):
        got = rows_of_queries(rows, asked, limit)
        assert sorted(map(tuple, got.collect())) == want
    assert rows_of_queries(rows, asked.limit(0)).collect() == []
    import re

    def like(tok, v):
        return re.search(re.escape(tok).replace("%", ".*").replace("_", "."), v or "", re.S) is not None

    want = sorted({(t, n, tok) for t, n, values in data for _, table, tok in wanted if table == t and any(v is not None and like(tok, v.lower()) for v in values)})
    assert sorted(map(tuple, search._match_patterns(rows, asked.select("table_name", "token")).collect())) == want


@pytest.mark.parametrize("ordered", [True, False])
@pytest.mark.parametrize("limit", [1 << 20, 900])
def test_first_rows_in_one_scan(spark, ordered, limit):
    rnd = random.Random(7)
    data = [(f"t{i % 3}", i // 3, ["".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 9))), None, f"N{i}"]) for i in range(600)]
    held = {(t, n): "\n".join(v for v in values if v is not None).lower() for t, n, values in data}
    wanted = sorted({(f"t{rnd.randint(0, 2)}", rnd.choice(["a", "b", "ab", "ba", "abc", "n1", "n12", "n599", "aaa", "zz", "bbb"])) for _ in range(40)})
    rows = spark.createDataFrame(data if ordered else rnd.sample(data, len(data)), "table_name string, row_no long, values array<string>").coalesce(1)
    found = first_rows(rows, spark.createDataFrame(wanted, "table_name string, token string"), 4, limit).collect()
    seen = {}
    for r in found:
        assert all(t in held[r.table_name, r.row_no] for t in r.tokens) and r["values"] == [v for t, n, v in data if (t, n) == (r.table_name, r.row_no)][0]
        for t in r.tokens:
            seen.setdefault((r.table_name, t), set()).add(r.row_no)
    for table, token in wanted:
        first = sorted(n for (t, n), text in held.items() if t == table and token in text)[:4]
        assert sorted(seen.get((table, token), ()))[:4] == first
        assert {r.row_no for r in found if r.table_name == table} >= set(range(4))
    if ordered and limit > 900:
        assert all(len(n) <= 4 for n in seen.values())  # one task, in order: nothing beyond the first n


def test_row_search_shuffles_no_rows(spark, base):
    tables, columns, rows = base
    q = queries(spark, "ring% part", "name6 name")
    chosen = search.top_k_tables(q, tables, columns)
    plan = search.match_rows(q, chosen, rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("MapInArrow") == 1


def test_resources(spark, base):
    tables, columns, _ = base
    sheets = spark.createDataFrame([("star.xlsx", "part", 0, 9)], "source string, sheet string, n_cols int, n_rows int")
    got = {r.table: r for r in search.resources_for_query(queries(spark, "star"), tables, columns, sheets).collect()}
    assert got["star_part"].columns == ["p_name", "grp ▸ ring"] and (got["star_part"].n_cols, got["star_part"].n_rows) == (2, 9)
    assert (got["star_nation"].n_cols, got["star_nation"].n_rows) == (1, 0)


def test_text_resources(spark):
    hits = spark.createDataFrame([(1, 1, "a.pdf", 2), (1, 2, "a.PDF#x", None), (1, 3, "w.docx", 1), (1, 4, "t.txt", 1), (1, 7, "a.pdf", 1)], "query_id int, rank int, source string, page int")
    heads = [("a.pdf", 2, 2, f"h{i}", i) for i in range(5)] + [("a.pdf", 2, 1, "top", 9), ("a.PDF", 1, 1, "first", 0)] + [("w.docx", 1, i % 2 + 1, f"w{i}", i) for i in range(9)]
    headings = spark.createDataFrame(heads, "source string, page int, level int, heading string, heading_no long")
    got = {r["rank"]: (r.document, r.page, r.headings) for r in search.text_resources(hits, headings).collect()}
    assert got == {1: ("a.pdf", 2, ["top", "h0", "h1"]), 2: ("a.PDF", None, ["first"]), 3: ("w.docx", 1, ["w0", "w2", "w4", "w6", "w8"]), 4: ("t.txt", 1, [])}


def test_inventory(spark):
    sheets = spark.createDataFrame([("b.xlsx", f"s{i:04d}", 1, i) for i in range(2500)] + [("a.xlsx", "x", 2, 3)], "source string, sheet string, n_cols int, n_rows int")
    blocks = catalog.inventory_blocks(sheets, 100)

    def report(key):
        return "\n".join(r.text for r in blocks.where(F.col("report_key") == key).orderBy("block_no").collect())

    b = "b.xlsx — sheets:\n" + "\n".join(f"- s{i:04d} (1 cols × {i} rows)" for i in range(2500))
    assert report("b.xlsx") == b
    assert report("*") == "a.xlsx — sheets:\n- x (2 cols × 3 rows)\n\n" + b
    q = queries(spark, 'columns of "a.xlsx"', 'FIELDS of "c.xls"?', "all sheets", "hello")
    keys = {r.query_id: r.report_key for r in search.route_inventory(q).collect()}
    assert keys == {0: "a.xlsx", 1: "c.xls", 2: "*", 3: None}
    got = {}
    for r in search.inventories(q, blocks).orderBy("report_key", "block_no").collect():
        got.setdefault(r.report_key, []).append(r.text)
    assert got["a.xlsx"] == ["a.xlsx — sheets:\n- x (2 cols × 3 rows)"] and got["c.xls"] == ["c.xls — sheets: (none)"] and "\n".join(got["*"]) == report("*") and len(got) == 3
    empty = catalog.inventory_blocks(sheets.limit(0))
    assert {r.report_key: r.text for r in search.inventories(q, empty).collect()}["*"] == "(no sheets recorded)"
    snippets = spark.createDataFrame([(0, "snippet")], "query_id int, structured string")
    hits = spark.createDataFrame([(2, 1, "c", "s", 1, "t", 0.5)], "query_id int, rank int, chunk_id string, source string, page int, text string, score double")
    both = {r.query_id: (r.report_key, r.structured, len(r.hits or [])) for r in search.retrieve(hits, snippets, q).collect()}
    assert both == {0: ("a.xlsx", "snippet", 0), 1: ("c.xls", None, 0), 2: ("*", None, 1), 3: (None, None, 0)}


def test_schema_report(spark):
    columns = spark.createDataFrame([("a", "s", i, f"c{i}", "p" if i == 2 else None) for i in range(1, 11)], "source string, sheet string, col_ordinal int, column_name string, parent string")
    report = catalog.sheet_schema_report(columns).first().report
    assert report.split("\n")[:3] == ["a / s: 10 columns", " 1. c1", " 2. p ▸ c2"] and report.endswith("\n10. c10")
    assert catalog.column_display(columns).where("col_ordinal = 2").first().display == "02. p ▸ c2"


def test_upserts_are_idempotent(spark):
    schema = "source string, sheet string, n_cols int, n_rows int"
    current = spark.createDataFrame([("a", "s", 1, 1), ("a", "t", 1, 1)], schema)
    batch = spark.createDataFrame([("a", "s", 2, 2), ("b", "s", 3, 3)], schema)
    once = catalog.upsert_sheets(current, batch)
    twice = catalog.upsert_sheets(once, batch)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", "s", 2, 2), ("a", "t", 1, 1), ("b", "s", 3, 3)]
    assert catalog.duplicate_keys(twice, catalog.SHEET_KEY).count() == 0


def test_purge(spark):
    tables = {"docs": spark.createDataFrame([("a.xlsx", 1), ("b.txt", 2)], "source string, n int"), "chunks": spark.createDataFrame([("a.xlsx#S", "c1"), ("b.txt", "c2")], "source string, chunk_id string")}
    left = catalog.purge(tables, spark.createDataFrame([("a.xlsx",)], "source string"))
    assert [r.source for r in left["docs"].collect()] == ["b.txt"] and [r.chunk_id for r in left["chunks"].collect()] == ["c2"]
    vectors = spark.createDataFrame([("c1", 1), ("c2", 2)], "chunk_id string, v int")
    assert [r.v for r in catalog.purge_vectors(vectors, left["chunks"]).collect()] == [2]
    assert all(df.count() == 0 for df in catalog.purge(tables).values())


def test_skewed_helpers(spark):
    # One key holds nine tenths of the rows.
    df = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id", F.lit(2).alias("v"))
    small = df.select("k").distinct().withColumn("w", F.length("k"))
    joined = salted_join(df, small, ["k"], ["id"])
    assert joined.count() == 20_000 and joined.columns == ["k", "id", "v", "w"]
    assert salted_join(df, small.where("k = 'hot'"), ["k"], ["id"], "left_anti").count() == 2_000
    off = running_offset(df, ["k"], "id", "v", "off", block=500)
    hot = [r.off for r in off.where("k = 'hot'").orderBy("id").collect()]
    assert hot == [2 * i for i in range(18_000)]
    numbered = number_rows(df.repartition(5), ["k", "id"], "pos").orderBy("k", "id").collect()
    assert [r.pos for r in numbered] == list(range(20_000))
    within = number_within(df, ["k"], ["id"], "n").where("k = 'hot'").orderBy("id").collect()
    assert [r.n for r in within] == list(range(18_000))
    assert fits_broadcast(df, 20_000) and not fits_broadcast(df, 19_999) and not fits_broadcast(df, 20_000, 1000)


def test_a_task_holds_the_tokens_of_the_tables_it_meets():
    names, tokens = [f"t{i:02d}" for i in range(20) for _ in range(3000)], [f"token{i // 2}" for _ in range(20) for i in range(3000)]
    pairs = pa.table({"table_name": names, "token": tokens})
    tracemalloc.start()
    try:
        known, places = Wanted(pairs).of("t03")
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert known == [f"token{i}" for i in range(1500)] and places.tolist() == [9000 + 2 * i for i in range(1501)]
    assert most < 1_500_000  # 10 MB when all twenty tables were held


def test_table_names_reach_the_rows_without_python_workers(spark):
    names = _names(spark.range(1), pa.table({"table_name": ["b", "a", "b"], "token": ["x", "y", "z"]}))
    assert "Python" not in names._jdf.queryExecution().toRdd().toDebugString()
    assert sorted(r.table_name for r in names.collect()) == ["a", "b"]


def test_first_rows_are_stored_in_few_files(spark, base, monkeypatch):
    tables, columns, rows = base
    q = queries(spark, "ring% part", "name6 name")
    seen, store = [], search.settled
    monkeypatch.setattr(search, "settled", lambda df: seen.append(store(df)) or seen[-1])
    search.sample_rows(q, search.top_k_tables(q, tables, columns), rows.repartition(40)).collect()
    stored = [df for df in seen if "values" in df.columns]
    assert [df.rdd.getNumPartitions() < 40 for df in stored] == [True]
