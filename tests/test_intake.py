"""Ingest as one write per run: counts, repeated and changed input, single parts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sheavework.operators import tables
from sheavework.operators.intake import OUTPUTS, Decoded, Store, _one_writer_per_output
from sheavework.operators.spread import measured_join, settled

CELLS = "source string, kind string, sheet string, page int, table_no int, row_no long, col_no int, value string"


def cells(spark, grids):
    rows = [(*key, r, c, v) for key, grid in grids.items() for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, CELLS)


BOOK = ("b.xlsx", "xlsx", "S", None, 1)
CSV = ("c.csv", "csv", None, None, 1)


def decoded(spark, made, text="one two three", heads=("Top",), **more):
    files = spark.createDataFrame([("b.xlsx", "xlsx", 10), ("c.csv", "csv", 20), ("t.txt", "text", 30), ("w.docx", "docx", 40)], "source string, kind string, bytes long")
    pages = spark.createDataFrame([("t.txt", "text", 1, text)], "source string, kind string, page int, text string")
    paragraphs = spark.createDataFrame([("w.docx", i, "Heading 2", h) for i, h in enumerate(heads)] + [("w.docx", 9, "Normal", "body text")], "source string, para_no int, style string, text string")
    return Decoded(files=files, pages=pages, paragraphs=paragraphs, cells=cells(spark, made), **more)


def shown(df, *columns):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*columns).collect())


def counts(report):
    return {r.output: r.n_rows for r in report.collect()}


def test_two_runs_and_a_changed_table(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    grids = {BOOK: [["g", "g"], ["x", "y"], ["1", "2"], ["3", None]], CSV: [["a", "b"], ['say "q"', "1,5"]]}
    extra = {"two_row_sheets": spark.createDataFrame([("b.xlsx", "S")], "source string, label string"),
             "grids": spark.createDataFrame([BOOK, CSV, ("b.xlsx", "xlsx", "E", None, 2), ("w.docx", "docx", None, None, 1)], "source string, kind string, sheet string, page int, table_no int")}
    report = store.ingest(decoded(spark, grids, **extra), 0, dim=8)
    assert counts(report) == {"chunks": 4, "rows": 3, "tables": 3, "sheets": 3, "columns": 5, "headings": 1, "documents": 4}
    assert shown(store.rows(), "table_name", "row_no", "values") == [("b_s", 0, ("1", "2")), ("b_s", 1, ("3", None)), ("c", 0, ('say "q"', "1,5"))]
    assert shown(store.columns(), "table_name", "col_ordinal", "column_name", F.coalesce("parent", F.lit("-"))) == [
        ("b_e", 1, "_empty", "-"), ("b_s", 1, "x", "g"), ("b_s", 2, "y", "g"), ("c", 1, "a", "-"), ("c", 2, "b", "-")]
    assert shown(store.sheets(), "source", "sheet", "n_cols", "n_rows") == [("b.xlsx", "E", 0, 0), ("b.xlsx", "S", 2, 2), ("c.csv", "csv", 2, 1)]
    assert shown(store.documents(), "source", "sheet_count", "table_count") == [("b.xlsx", 2, 2), ("c.csv", 1, 1), ("t.txt", 0, 0), ("w.docx", 0, 0)]
    ids = {r.chunk_id: r for r in store.chunks().collect()}
    csv_text = 'a,b "say ""q""","1,5"'
    assert ids[hashlib.sha1(f"c.csv-csv-0-{len(csv_text)}".encode()).hexdigest()].text == csv_text
    book = "g,g x,y 1,2 3,"
    assert ids[hashlib.sha1(f"b.xlsx-S-xlsx-0-{len(book)}".encode()).hexdigest()].source == "b.xlsx#S"
    assert ids[hashlib.sha1(b"w.docx-docx-0-13").hexdigest()].text == "Top body text"
    assert all(len(r.embedding) == 8 and r.error is None for r in store.vectors().collect())

    again = counts(store.ingest(decoded(spark, grids, **extra), 1, dim=8))
    assert again == {"chunks": 0, "rows": 0, "tables": 0, "sheets": 0, "columns": 0, "headings": 0, "documents": 4}
    before = {name: getattr(store, name)().count() for name in ("chunks", "rows", "tables", "sheets", "columns", "headings", "documents")}
    assert before == {"chunks": 4, "rows": 3, "tables": 3, "sheets": 3, "columns": 5, "headings": 1, "documents": 4}

    # The csv has other rows now, the text as many characters as before, the Word file other headings.
    grids[CSV] = [["a", "b"], ["7", "8"], ["9", "10"]]
    changed = counts(store.ingest(decoded(spark, grids, text="ONE two three", heads=("Top", "More"), **extra), 2, dim=8))
    assert changed == {"chunks": 2, "rows": 2, "tables": 1, "sheets": 1, "columns": 2, "headings": 2, "documents": 4}
    assert shown(store.rows().where("table_name = 'c'"), "row_no", "values") == [(0, ("7", "8")), (1, ("9", "10"))]
    assert shown(store.headings(), "source", "heading", "level") == [("w.docx", "More", 2), ("w.docx", "Top", 2)]
    assert shown(store.sheets().where("source = 'c.csv'"), "n_rows") == [(2,)]
    # A run that is repeated under its number leaves the same.
    assert counts(store.ingest(decoded(spark, grids, text="ONE two three", heads=("Top", "More"), **extra), 2, dim=8)) == changed
    assert store.rows().count() == 4 and store.chunks().count() == 6 and store.documents().count() == 4


def test_parts_may_be_missing_and_failing_models_are_told(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    files = spark.createDataFrame([("t.txt", "text", 1)], "source string, kind string, bytes long")
    assert counts(store.ingest(Decoded(files=files), 0)) == {"documents": 1}
    assert store.chunks().count() == store.rows().count() == store.headings().count() == 0

    def failing():
        def score(texts):
            raise RuntimeError("no model")

        return score

    pages = spark.createDataFrame([("t.txt", "text", 1, "x"), ("u.txt", "text", 1, " ")], "source string, kind string, page int, text string")
    assert counts(store.ingest(Decoded(files=files, pages=pages), 1, 8, failing)) == {"chunks": 1, "documents": 1}
    row = store.vectors().first()
    assert row.embedding is None and "no model" in row.error


@pytest.mark.parametrize("laid_out", [True, False])
def test_rows_with_holes(spark, laid_out):
    from sheavework.operators import tables

    data = [("a.csv", "csv", None, None, 1, r, c, f"{r}.{c}") for r in range(300) for c in range(5) if (r + c) % 7 and (r % 11 or c)]
    data += [("a.csv", "csv", None, None, 1, 3, 3, "later"), ("z.pdf", "pdf", None, 2, 1, 0, 2, None), ("z.pdf", "pdf", None, 3, 1, 0, 0, "p")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r.label, r.row_no): r["values"] for r in tables.cells_to_rows(spark.createDataFrame(data, CELLS).repartition(3), laid_out).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for source, _, _, page, no, r, c, v in sorted(data, key=lambda x: (x[0], x[5], x[6], x[7] or "")):
        row = want.setdefault(("csv" if source == "a.csv" else f"pdf_p{page}_t{no}", r), [])
        row += [None] * (c + 1 - len(row))
        row[c] = v
    assert got == want


def test_rows_travel_in_pieces(spark):
    """Cells that follow each other in a row are one record of the shuffle; cells that share a place still leave the last by value."""
    import pyarrow as pa

    lines = [(*CSV, r, c, f"{r}.{c}") for r in range(100) for c in range(6)]
    batch = pa.RecordBatch.from_pylist([dict(zip([*tables.GRID, "row_no", "col_no", "value"], (CSV[1], CSV[0], *CSV[2:], *line[5:]), strict=True)) for line in lines])
    batch = batch.set_column(2, "sheet", batch.column(2).cast(pa.string())).set_column(3, "page", batch.column(3).cast(pa.int32()))
    pieces = list(tables._pieces([batch.slice(0, 301), batch.slice(301)]))
    assert [p.num_rows for p in pieces] == [51, 50]
    rows = [r for b in tables._gather([pa.concat_batches(pieces)]) for r in b.to_pylist()]
    assert [(r["row_no"], r["values"]) for r in rows] == [(r, [f"{r}.{c}" for c in range(6)]) for r in range(100)]
    data = [(*CSV, 0, 2, "c"), (*CSV, 0, 0, None), (*CSV, 0, 0, "a"), (*CSV, 1, 0, "z"), (*CSV, 0, 0, "B"), (*CSV, 1, 0, None), (*CSV, 0, 2, None)]
    got = tables.cells_to_rows(spark.createDataFrame(data, CELLS).repartition(3)).select("row_no", "values").collect()
    assert sorted((r.row_no, r["values"]) for r in got) == [(0, ["a", None, "c"]), (1, ["z"])]


def test_rows_stay_where_headers_are_few(spark):
    rows = settled(tables.cells_to_rows(cells(spark, {CSV: [["a", "b"], ["1", "2"], ["3", "4"]]})))
    headers = settled(tables.header_info(rows))
    body = tables.body_rows(rows, headers, measured_join)
    assert "Exchange hashpartitioning" not in body._jdf.queryExecution().executedPlan().toString()
    assert shown(body, "row_no", "values") == shown(tables.body_rows(rows, headers), "row_no", "values") == [(0, ("1", "2")), (1, ("3", "4"))]


def test_a_run_is_written_unsorted_and_leaves_settings(spark, tmp_path):
    """Rows are not sorted by output before they are written."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    with _one_writer_per_output(spark):
        assert int(spark.conf.get(name)) >= len(OUTPUTS)
    assert spark.conf.get(name) == before


@pytest.mark.parametrize("torn", [False, True])
def test_rows_that_come_whole_are_not_shuffled(spark, tmp_path, monkeypatch, torn):
    """Only rows whose cells came apart are gathered; gaps, late first columns and cells that share a place are as ever."""
    data = [(*CSV, r, c, f"{r}.{c}") for r in range(300) for c in range(5) if (r + c) % 7 and (r % 11 or c)]
    data += [("z.pdf", "pdf", None, 2, 1, 0, 2, None), ("z.pdf", "pdf", None, 3, 1, 0, 0, "p"), ("z.pdf", "pdf", None, 3, 1, 0, 0, "q")]
    data += [(*CSV, 3, 3, "later"), (*CSV, 5, 1, None), (*CSV, 7, 9, "far")] if torn else []
    gathered, rows_of = [], tables._rows_of
    monkeypatch.setattr(tables, "_rows_of", lambda pieces, *a: gathered.append(pieces.select("row_no").distinct().count()) or rows_of(pieces, *a))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        df = spark.createDataFrame(data, CELLS).coalesce(1)
        got = shown(tables.stored_rows(df, str(tmp_path / "grid")), *tables.ROW[:-1], "values")
        assert gathered == ([3] if torn else [])
        assert got == shown(tables.cells_to_rows(df), *tables.ROW[:-1], "values") and len(got) == 302
        monkeypatch.setattr(tables, "fits_broadcast", lambda df: False)  # many torn rows
        assert shown(tables.stored_rows(df, str(tmp_path / "again")), *tables.ROW[:-1], "values") == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sizes_of_books_are_summed_unsorted(spark):
    """A maximum of texts over all cells would be a sort of all cells by source."""
    import re

    from sheavework.plans.intake import decoded as of_tables

    plan = of_tables(spark, "/root/testdata/sf0.001").files._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"HashAggregate\(keys=\[source#\d+, kind#\d+\], functions=\[partial_sum", plan)


def test_tables_that_come_first_are_not_compared(spark, tmp_path, monkeypatch):
    """Nothing is stored in a first run, so no row of it is hashed; in the next one those of the tables that come again are."""
    from sheavework.operators import intake

    seen, digests = [], intake._digests
    monkeypatch.setattr(intake, "_digests", lambda df, keys, of: seen.append((of, df.count())) or digests(df, keys, of))
    store = Store(spark, str(tmp_path / "store"))
    grids = {BOOK: [["x", "y"], ["1", "2"], ["3", None]], CSV: [["a", "b"], ["5", "6"]]}
    met = []
    for run, some in enumerate(({BOOK: grids[BOOK]}, grids)):
        seen.clear()
        store.ingest(decoded(spark, some), run, dim=8)
        met.append([n for of, n in seen if of == ["row_no", "values"]])
    assert met == [[0, 0], [2, 2]] and store.rows().count() == 3
