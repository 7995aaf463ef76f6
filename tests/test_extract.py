"""Extraction of whole tables: no table, column or row is left out."""

import pyarrow.parquet as pq

import __spark_entry__ as entry


def test_every_column_of_every_table(spark):
    cells = entry.queries()["extract_all_columns"](spark, entry.SMOKE_DIR).collect()
    seen = {(c.source, c.row_no, c.column_name): c.value for c in cells}
    size = 0
    for name in ("region", "nation", "customer", "supplier", "part", "orders"):
        table = pq.read_table(f"{entry.SMOKE_DIR}/{name}.parquet")
        size += table.num_rows * table.num_columns
        for column in table.column_names:
            value, got = table[column][0].as_py(), seen[(f"{name}.parquet", 0, column)]
            assert got == (f"{value:.2f}" if isinstance(value, float) else str(value))
    assert len(cells) == len(seen) == size and not any(c.error for c in cells)


def test_files_leave_in_frames_of_bounded_size(spark, tmp_path, monkeypatch):
    # Two row groups, a whole-number column with a hole in the second one only.
    import pyarrow as pa

    from sheavework.plans import documents
    from sheavework.sources import files

    table = pa.table({"k": list(range(10_000)), "v": [1] * 9_999 + [None], "s": [None, *["x"] * 9_999]})
    pq.write_table(table, tmp_path / "a.parquet", row_group_size=7_000)
    frames = list(documents._all_parquet_cells()("a.parquet", (tmp_path / "a.parquet").read_bytes()))
    assert max(map(len, frames)) == 3 * documents.CELL_ROWS and sum(map(len, frames)) == 30_000
    schema = "row_no BIGINT, col_no INT, column_name STRING, value STRING"
    got = files.extract(files.scan_corpus(spark, str(tmp_path), "a.parquet"), documents._all_parquet_cells, schema).collect()
    want = [(i, c, n, None if v is None else f"{v:.2f}" if n == "v" else str(v)) for c, n in enumerate(table.column_names) for i, v in enumerate(table[n].to_pylist())]
    assert sorted((r.row_no, r.col_no, r.column_name, r.value) for r in got) == sorted(want, key=lambda w: w[:2])

    def failing():
        def decode(name, content):
            import pandas as pd

            yield pd.DataFrame({"value": ["first"]})
            raise ValueError("torn")

        return decode

    torn = files.extract(files.scan_corpus(spark, str(tmp_path), "a.parquet"), failing, "value STRING").collect()
    assert [(r.value, r.error) for r in torn] == [("first", None), (None, "ValueError: torn")]
