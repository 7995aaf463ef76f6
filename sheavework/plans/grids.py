"""Queries over cell grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import tables
from ..session import scratch_path
from ..sources import sinks
from . import inputs as I
from .inputs import sql
from .registry import register

ALL = None


def _values(col: str = "values"):
    return F.array_join(F.transform(col, lambda v: F.coalesce(v, F.lit("<null>"))), "|").alias("row_values")


_ROW = "string_agg(coalesce(value, '<null>'), '|' ORDER BY col_no) AS row_values"


@register("cells_to_tables", sql(f"SELECT source, label, table_name, row_no, {_ROW} FROM named GROUP BY ALL", "named"))
def cells_to_tables(spark, sf):
    return tables.cells_to_rows(I.cells(spark, sf)).select("source", "label", "table_name", "row_no", _values())


@register("table_names", sql("SELECT DISTINCT source, label, page, table_name FROM named", "named"))
def table_names(spark, sf):
    return tables.name_tables(I.cells(spark, sf)).select("source", "label", "page", "table_name").distinct()


@register("has_header", sql("SELECT source, label, table_name, coalesce(bool_and(r0 IS NOT NULL AND regexp_matches(r0, '" + I.NOT_WS + "')), false) AS has_header FROM heads GROUP BY ALL", "heads"))
def has_header(spark, sf):
    return tables.has_header(tables.cells_to_rows(I.cells(spark, sf)))


@register("promote_header", sql("SELECT source, label, has_header, col_no, read_name AS name FROM read", "read"))
def promote_header(spark, sf):
    headers = tables.header_info(tables.cells_to_rows(I.cells(spark, sf)))
    return headers.select("source", "label", "has_header", F.posexplode("read_names").alias("col_no", "name"))


@register("repair_unnamed_headers", sql("SELECT source, label, repaired, taken, string_agg(name, '|' ORDER BY col_no) AS names FROM cols GROUP BY ALL", "cols"))
def repair_unnamed_headers(spark, sf):
    headers = tables.header_info(tables.cells_to_rows(I.cells(spark, sf)))
    return headers.select("source", "label", "repaired", F.col("taken_rows").alias("taken"), F.array_join("names", "|").alias("names"))


@register("body_rows", sql(f"SELECT source, label, table_name, row_no, {_ROW} FROM body GROUP BY ALL", "body"))
def body_rows(spark, sf):
    return I.stored(spark, sf, ALL)["body"].select("source", "label", "table_name", "row_no", _values())


@register("header_hierarchy", sql(f"""SELECT table_name, source, label AS sheet, col_no + 1 AS col_ordinal,
    coalesce(nullif({I.strip_sql("coalesce(nullif(r1, ''), nullif(r0, ''), '')")}, ''), 'col_' || (col_no + 1)) AS column_name, nullif({I.strip_sql("coalesce(r0, '')")}, '') AS parent FROM heads""", "heads"))
def header_hierarchy(spark, sf):
    return tables.header_hierarchy(tables.cells_to_rows(I.cells(spark, sf)))


@register("drop_empty_tables", sql("""SELECT source, kind, label, table_name, n_rows::BIGINT AS n_rows, (n_rows > 0)::INT * width AS n_columns, CASE WHEN n_rows = 0 THEN '_empty' END AS only_column FROM (
    SELECT source, kind, label, table_name, grid_rows AS n_rows, width FROM tabs UNION ALL SELECT 'broken.xlsx', 'xlsx', 'blank', 'broken_blank', 0, 0)""", "tabs"))
def drop_empty_tables(spark, sf):
    """All grids that were met: of those without a cell the sheet stays, as a table of one column that no one named."""
    rows = tables.cells_to_rows(I.cells(spark, sf))
    listed = tables.drop_empty_tables(I.grid_list(spark), rows)
    headers = tables.header_info(rows)
    every = headers.unionByName(tables.empty_headers(listed, headers))
    columns = tables.column_catalog(every).groupBy("table_name").agg(F.max(F.when(F.col("column_name") == tables.EMPTY_COLUMN, F.col("column_name"))).alias("only_column"))
    widths = every.select("table_name", F.col("width").alias("n_columns"))
    return listed.select("source", "kind", "label", "table_name", "n_rows").join(widths, "table_name").join(columns, "table_name")


@register("sheet_stats", sql("SELECT source, label AS sheet, width AS n_cols, grid_rows - taken AS n_rows, grid_rows - header_rows AS raw_n_rows FROM tabs", "tabs"))
def sheet_stats(spark, sf):
    return I.stored(spark, sf, ALL)["sheets"]


@register("column_catalog", sql("SELECT table_name, source, label AS sheet, col_no + 1 AS col_ordinal, name AS column_name, NULL::VARCHAR AS parent FROM cols", "cols"))
def column_catalog(spark, sf):
    return I.stored(spark, sf, ALL)["columns"]


@register("table_info", sql("SELECT col_no + 1 AS col_ordinal, name AS column_name FROM star_cols WHERE table_name = 'star_part'", "star_cols"))
def table_info(spark, sf):
    return tables.table_info(I.stored(spark, sf)["columns"], "star_part")


_TYPES = """CASE WHEN bool_and(regexp_matches(value, '^(?i:true|false)$')) THEN 'BOOLEAN' WHEN bool_and(regexp_matches(value, '^[+-]?[0-9]+$')) THEN 'INTEGER'
    WHEN bool_and(regexp_matches(value, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')) THEN 'DOUBLE'
    WHEN bool_and(regexp_matches(value, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')) THEN 'DATE' ELSE 'VARCHAR' END"""


@register("infer_column_types", sql(f"SELECT source, label, col_no + 1 AS col_ordinal, {_TYPES} AS type FROM body WHERE coalesce(value, '') <> '' GROUP BY ALL", "body"))
def infer_column_types(spark, sf):
    return tables.infer_column_types(I.stored(spark, sf, ALL)["body"])


@register("infer_order_types", f"""SELECT 'orders' AS source, 'csv' AS label, i + 1 AS col_ordinal, {_TYPES} AS type FROM (
    SELECT unnest(range(5)) AS i, unnest([o_orderkey::VARCHAR, strftime(o_orderdate, '%Y-%m-%d'), round(o_totalprice)::BIGINT || '.5', (o_orderkey % 2 = 0)::VARCHAR, o_orderpriority]) AS value FROM orders) GROUP BY i""")
def infer_order_types(spark, sf):
    values = F.array(
        F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.concat(F.round("o_totalprice").cast("bigint").cast("string"), F.lit(".5")),
        (F.col("o_orderkey") % 2 == 0).cast("string"), F.col("o_orderpriority"),
    )
    body = I.table(spark, sf, "orders").select(F.lit("orders").alias("source"), F.lit("csv").alias("label"), values.alias("values"))
    return tables.infer_column_types(body)


_CSV = "CASE WHEN regexp_matches({0}, '[\",\r\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


HEAD_TEXTS = f"""SELECT t.source, t.label, t.kind, t.table_name, h.line || chr(10) || coalesce(string_agg(r.line, chr(10) ORDER BY r.row_no) || chr(10), '') AS text
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY table_no, label) AS rk FROM tabs WHERE kind IN ('csv', 'xlsx', 'xls')) WHERE rk <= 3) t
    JOIN (SELECT source, label, string_agg({_CSV.format('read_name')}, ',' ORDER BY col_no) AS line FROM read GROUP BY ALL) h ON h.source = t.source AND h.label = t.label
    LEFT JOIN (SELECT source, label, row_no, string_agg({_CSV.format("coalesce(value, '')")}, ',' ORDER BY col_no) AS line FROM named GROUP BY ALL) r
      ON r.source = t.source AND r.label = t.label AND r.row_no >= t.header_rows AND r.row_no < t.header_rows + CASE WHEN t.kind = 'csv' THEN 50 ELSE 30 END
    GROUP BY t.source, t.label, t.kind, t.table_name, h.line"""


@register("head_as_csv_text", sql(HEAD_TEXTS, "tabs", "read", "named"))
def head_as_csv_text(spark, sf):
    s = I.stored(spark, sf, ALL)
    return tables.head_as_csv_text(s["rows"], s["headers"])


@register("materialize", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_type, p_size::VARCHAR AS p_size, p_retailprice::DECIMAL(15, 2)::VARCHAR AS p_retailprice FROM part")
def materialize(spark, sf):
    s = I.stored(spark, sf)
    return sinks.materialize(s["body"], s["columns"], "star_part", scratch_path(spark, "star_part"))


@register("csv_lines", f"SELECT page_id, {_CSV.format('url')} || ',' || {_CSV.format('html')} AS line FROM pages")
def csv_lines(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", text.csv_line(F.array("url", "html")).alias("line"))
