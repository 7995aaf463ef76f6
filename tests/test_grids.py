from pyspark.sql import functions as F

from sheavework.operators import tables
from sheavework.sources import sinks

SCHEMA = "source string, kind string, sheet string, page int, table_no int, row_no int, col_no int, value string"


def grid(spark, rows, source="a.xlsx", kind="xlsx", sheet="S", page=None, table_no=1):
    cells = [(source, kind, sheet, page, table_no, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)]
    return tables.cells_to_rows(spark.createDataFrame(cells, SCHEMA))


def stored(rows, **kw):
    headers = tables.header_info(rows, **kw)
    body = tables.body_rows(rows, headers)
    h = headers.first()
    return h, [r["values"] for r in body.orderBy("row_no").collect()], headers, body


def test_plain_header(spark):
    h, body, headers, data = stored(grid(spark, [["a", "b"], ["1", None], ["3", "4"]]))
    assert h["names"] == ["a", "b"] and not h.repaired and h.table_name == "a_s"
    assert body == [["1", None], ["3", "4"]]
    s = tables.sheet_stats(headers, data).first()
    assert (s.n_cols, s.n_rows, s.raw_n_rows) == (2, 2, 2)


def test_repair(spark):
    # 2 of 3 unnamed: names from the second row below, then the first, then a number.
    h, body, headers, data = stored(grid(spark, [["x", None, "Unnamed: 2"], ["1", "one", ""], ["2", "", " "], ["7", "8", "9"]]))
    assert h["names"] == ["2", "one", "col_3"] and h.repaired
    assert body == [["7", "8", "9"]]
    s = tables.sheet_stats(headers, data).first()
    assert (s.n_rows, s.raw_n_rows) == (1, 3)
    # 1 of 3 is below the share, 3 of 5 reaches it.
    assert not stored(grid(spark, [["x", "y", None], ["1", "2", "3"]]))[0].repaired
    assert stored(grid(spark, [["x", "y", None, "", "unnamed"], ["1", "2", "3", "4", "5"]]))[0].repaired
    # One row below the header: it alone is taken. None: nothing is taken and the old name stays.
    h, body, _, _ = stored(grid(spark, [[None, ""], [" p ", None]]))
    assert h["names"] == ["p", "Unnamed: 1"] and body == []
    h, body, _, _ = stored(grid(spark, [[None]]))
    assert h["names"] == ["Unnamed: 0"] and body == []


def test_pdf_header(spark):
    h, body, _, _ = stored(grid(spark, [["a", " "], ["1", "2"]], "r.pdf", "pdf", None, 3, 2))
    assert h["names"] == ["0", "1"] and body == [["a", " "], ["1", "2"]] and h.label == "pdf_p3_t2" and h.table_name == "r_p3_t2"
    h, body, _, _ = stored(grid(spark, [["a", "b"], ["1", "2"]], "r.pdf", "pdf", None, 3, 2))
    assert h["names"] == ["a", "b"] and body == [["1", "2"]]
    h, body, _, _ = stored(grid(spark, [["a", ""], ["1", "2"]], "r.docx", "docx", None, None, 4))
    assert h["names"] == ["a", ""] and body == [["1", "2"]] and h.label == "docx_table_4"


def test_two_header_rows(spark):
    rows = grid(spark, [["g", " g2 ", "", None], ["a", "", " ", None], ["1", "2", "3", "4"]])
    h, body, headers, _ = stored(rows, hierarchy_kinds=("xlsx",))
    # A blank name does not fall through to the row above; it is numbered once it is stripped.
    assert h["names"] == ["a", "g2", "col_3", "col_4"]
    assert h["parents"] == ["g", "g2", None, None] and body == [["1", "2", "3", "4"]]


def test_ragged_rows_and_duplicate_names(spark, tmp_path):
    cells = [("a.csv", "csv", None, None, 1, 0, c, v) for c, v in enumerate(["n", "n", "m"])]
    cells += [("a.csv", "csv", None, None, 1, 1, 0, "1"), ("a.csv", "csv", None, None, 1, 1, 2, "3")]
    rows = tables.cells_to_rows(spark.createDataFrame(cells, SCHEMA))
    headers = tables.header_info(rows)
    body, columns = tables.body_rows(rows, headers), tables.column_catalog(headers)
    assert body.first()["values"] == ["1", None, "3"]
    view = tables.wide_view(body, columns, "a")
    assert view.columns == ["n", "n_2", "m"] and view.first() == ("1", None, "3")
    again = sinks.materialize(body, columns, "a", str(tmp_path / "a"))
    assert again.collect() == view.collect()


def test_types(spark):
    data = [["true", "1", "1.5", "2024-01-01", "x", "", "-3"], ["FALSE", "+2", "1e3", "1999-12-31", "1", None, ".5"]]
    body = spark.createDataFrame([("s", "l", v) for v in data], "source string, label string, values array<string>")
    got = {r.col_ordinal: r.type for r in tables.infer_column_types(body).collect()}
    assert got == {1: "BOOLEAN", 2: "INTEGER", 3: "DOUBLE", 4: "DATE", 5: "VARCHAR", 7: "DOUBLE"}


def test_csv_text_is_as_read(spark):
    rows = grid(spark, [["x", None, None], ["1", 'q"', "a,b"], ["2", "", None]])
    headers = tables.header_info(rows)
    text = tables.head_as_csv_text(rows, headers).first().text
    assert text == 'x,Unnamed: 1,Unnamed: 2\n1,"q""","a,b"\n2,,\n'
    long = grid(spark, [["h"]] + [[str(i)] for i in range(100)], "b.csv", "csv", None)
    assert tables.head_as_csv_text(long, tables.header_info(long)).first().text == "h\n" + "".join(f"{i}\n" for i in range(50))


def test_dominant_table_is_spread(spark):
    big = spark.range(20_000).select(F.lit("a.xlsx").alias("source"), F.lit("S").alias("label"), F.lit("a_s").alias("table_name"), F.lit("xlsx").alias("kind"),
                                     F.lit(1).alias("table_no"), F.lit(None).cast("int").alias("page"), F.col("id").alias("row_no"), F.array(F.col("id").cast("string")).alias("values"))
    headers = tables.header_info(big)
    assert tables.body_rows(big, headers).count() == 19_999
