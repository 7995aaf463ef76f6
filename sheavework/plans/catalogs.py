"""Queries over catalog tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, chunks
from . import inputs as I
from .documents import STYLE_HEADINGS
from .inputs import sql
from .registry import register


@register("upsert_documents", sql("""SELECT f.source, CASE WHEN l.doc_id IS NULL THEN kind WHEN quality = 1 THEN 'good' ELSE 'poor' END AS kind,
    CASE WHEN l.doc_id IS NULL THEN n_chars ELSE 1000 + n_chars END AS bytes, 0 AS sheet_count, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS table_count
    FROM files f LEFT JOIN labels l USING (doc_id)""", "files"))
def upsert_documents(spark, sf):
    """Labelled documents are ingested again, twice in one batch."""
    files = I.files(spark, sf)
    current = files.select("source", "kind", F.col("n_chars").alias("bytes"), F.lit(0).alias("sheet_count"), F.lit(0).alias("table_count"),
                           F.lit(0).cast("timestamp").alias("ingested_at"))
    labelled = files.join(I.table(spark, sf, "labels"), "doc_id").select(
        "source", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("kind"), (F.col("n_chars") + 1000).alias("bytes"),
        F.lit(0).alias("sheet_count"), F.lit(1).alias("table_count"))
    batch = labelled.withColumn("seen", F.lit(2)).unionByName(labelled.withColumn("kind", F.lit("old")).withColumn("seen", F.lit(1)))
    return catalog.upsert_documents(current, batch, [F.col("seen").desc()]).drop("ingested_at")


@register("upsert_sheets", sql("""SELECT source, sheet, coalesce(n.n_cols, o.n_cols) AS n_cols, coalesce(n.n_rows, o.n_rows) AS n_rows FROM sheet_catalog o FULL JOIN
    (SELECT 'BUILDING.xlsx' AS source, 'nation_' || s_nationkey AS sheet, 3 AS n_cols, count(*) AS n_rows FROM supplier GROUP BY s_nationkey) n USING (source, sheet)""", "sheet_catalog"))
def upsert_sheets(spark, sf):
    batch = I.table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").cast("int").alias("n_rows")).select(
        F.lit("BUILDING.xlsx").alias("source"), F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("sheet"),
        F.lit(3).alias("n_cols"), "n_rows")
    return catalog.upsert_sheets(I.sheet_catalog(spark, sf), batch)


@register("upsert_columns", sql("""SELECT source, sheet, col_ordinal, column_name, parent FROM (SELECT *, row_number() OVER (PARTITION BY source, sheet, col_ordinal ORDER BY seen_at DESC, parent DESC NULLS LAST) AS n
    FROM (SELECT * FROM column_entries UNION ALL SELECT 'order_' || o_orderkey || '.xlsx', 'lines', 1, o_orderpriority, o_orderstatus, '' FROM orders)) WHERE n = 1""", "column_entries"))
def upsert_columns(spark, sf):
    """Orders have a first column; line items overwrite it, and each other, by date."""
    current = I.table(spark, sf, "orders").select(
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit(".xlsx")).alias("source"), F.lit("lines").alias("sheet"),
        F.lit(1).alias("col_ordinal"), F.col("o_orderpriority").alias("column_name"), F.col("o_orderstatus").alias("parent"))
    return catalog.upsert_columns(current, I.column_entries(spark, sf), [F.col("seen_at").desc(), F.col("parent").desc_nulls_last()])


@register("duplicate_keys", sql("SELECT source, sheet, col_ordinal, count(*) AS n FROM column_entries GROUP BY ALL HAVING count(*) > 1", "column_entries"))
def duplicate_keys(spark, sf):
    return catalog.duplicate_keys(I.column_entries(spark, sf), catalog.COLUMN_KEY)


@register("add_headings", sql("", "paragraphs").rstrip() + f""",
    h AS ({STYLE_HEADINGS}), fr AS (SELECT 'page_' || page_id || '.docx' AS source FROM pages WHERE html LIKE '%lang="fr"%')
    SELECT source, page, level, heading FROM h WHERE source NOT IN (SELECT source FROM fr)
    UNION ALL SELECT source, page, 2, upper(heading) FROM h WHERE source IN (SELECT source FROM fr)""")
def add_headings(spark, sf):
    """The headings of French pages come again."""
    found = chunks.headings_from_styles(I.paragraphs(spark, sf)).select("source", "page", "level", "heading")
    french = I.table(spark, sf, "pages").where(F.col("html").contains('lang="fr"')).select(F.format_string("page_%d.docx", "page_id").alias("source"))
    batch = found.join(french, "source", "left_semi").select("source", "page", F.lit(2).alias("level"), F.upper("heading").alias("heading"))
    return catalog.add_headings(found, batch)


@register("register_tables", """SELECT coalesce(a.table_name, b.table_name) AS table_name, coalesce(b.source, a.source) AS source, coalesce(b.sheet, a.sheet) AS sheet, NULL::INT AS page,
    CASE WHEN b.table_name IS NULL THEN 1 ELSE 2 END AS created_at FROM
    (SELECT lower(replace(c_name, '#', '_')) AS table_name, 'customers.xlsx' AS source, c_mktsegment AS sheet FROM customer) a
    FULL JOIN (SELECT DISTINCT 'customer_' || lpad(o_custkey::VARCHAR, 9, '0') AS table_name, 'orders.csv' AS source, 'csv' AS sheet FROM orders) b ON a.table_name = b.table_name""")
def register_tables(spark, sf):
    """One table per customer; customers with orders are registered again, once per order."""
    from ..functions.names import normalize_name

    page = F.lit(None).cast("int").alias("page")
    current = I.table(spark, sf, "customer").select(
        normalize_name(F.col("c_name")).alias("table_name"), F.lit("customers.xlsx").alias("source"), page, F.col("c_mktsegment").alias("sheet"), F.lit(1).alias("created_at"))
    batch = I.table(spark, sf, "orders").select(
        normalize_name(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).alias("table_name"), F.lit("orders.csv").alias("source"), page, F.lit("csv").alias("sheet"))
    return catalog.register_tables(current, batch, F.lit(2), [F.col("source")])


@register("document_rollup", sql("""SELECT source, kind, bytes, coalesce(s, 0) AS sheet_count, coalesce(t, 0) AS table_count FROM (SELECT source, max(lang) AS kind, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY source)
    LEFT JOIN (SELECT source, count(DISTINCT lang) AS s, count(*) AS t FROM documents JOIN labels USING (doc_id) GROUP BY source) USING (source)"""))
def document_rollup(spark, sf):
    """Sources as files, their languages as sheets, their labelled documents as tables."""
    docs = I.table(spark, sf, "documents")
    files = docs.groupBy("source").agg(F.max("lang").alias("kind"), F.sum("n_chars").alias("bytes"))
    tables = docs.join(I.table(spark, sf, "labels"), "doc_id").select("source", F.col("lang").alias("sheet"))
    return catalog.document_rollup(files, tables)


@register("list_documents", sql("""SELECT source, kind, n_chars AS bytes, 0 AS sheet_count, 0 AS table_count,
    strftime(TIMESTAMP '2024-01-01' + to_seconds(doc_id * 37), '%Y-%m-%d %H:%M') AS ingested FROM files""", "files"))
def list_documents(spark, sf):
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id * 37)")
    documents = I.files(spark, sf).select("source", "kind", F.col("n_chars").alias("bytes"), F.lit(0).alias("sheet_count"), F.lit(0).alias("table_count"), at.alias("ingested_at"))
    return catalog.list_documents(documents)


@register("purge", sql("""SELECT 'chunks' AS what, source, count(*) AS n FROM chunks WHERE source NOT IN (SELECT source FROM files JOIN labels USING (doc_id) WHERE toxic = 1) GROUP BY source
    UNION ALL SELECT 'documents', source, 1 FROM files WHERE source NOT IN (SELECT source FROM files JOIN labels USING (doc_id) WHERE toxic = 1)""", "chunks", "files"))
def purge(spark, sf):
    """Toxic documents leave the documents and the chunks."""
    files = I.files(spark, sf)
    toxic = files.join(I.table(spark, sf, "labels").where("toxic = 1"), "doc_id").select("source")
    left = catalog.purge({"chunks": I.doc_chunks(spark, sf), "documents": files.drop("text")}, toxic)
    counted = [df.groupBy("source").agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "source", "n") for name, df in left.items()]
    return counted[0].unionByName(counted[1])


@register("list_sheets", sql("SELECT source, sheet, n_cols, n_rows FROM sheet_catalog", "sheet_catalog"))
def list_sheets(spark, sf):
    return catalog.list_sheets(I.sheet_catalog(spark, sf))


REPORT_LINES = """SELECT source, 0 AS part, NULL AS sheet, source || ' — sheets:' AS line FROM (SELECT DISTINCT source FROM sheet_catalog)
    UNION ALL SELECT source, 1, sheet, '- ' || sheet || ' (' || n_cols || ' cols × ' || n_rows || ' rows)' FROM sheet_catalog"""


@register("sheets_report", sql(REPORT_LINES, "sheet_catalog"))
def sheets_report(spark, sf):
    return catalog.sheets_report(I.sheet_catalog(spark, sf))


@register("sheets_report_of_sources", sql("""SELECT source, 0 AS part, NULL AS sheet, source || ' — sheets:' || CASE WHEN source IN (SELECT source FROM sheet_catalog) THEN '' ELSE ' (none)' END AS line
    FROM (SELECT DISTINCT p_type || '.xlsx' AS source FROM part UNION SELECT DISTINCT source FROM sheet_catalog)
    UNION ALL SELECT source, 1, sheet, '- ' || sheet || ' (' || n_cols || ' cols × ' || n_rows || ' rows)' FROM sheet_catalog""", "sheet_catalog"))
def sheets_report_of_sources(spark, sf):
    sheets = I.sheet_catalog(spark, sf)
    asked = I.table(spark, sf, "part").select(F.concat("p_type", F.lit(".xlsx")).alias("source")).unionByName(sheets.select("source"))
    return catalog.sheets_report(sheets, asked)


INVENTORY_BLOCKS = f"""lines AS ({REPORT_LINES}), placed AS (SELECT *, row_number() OVER (ORDER BY source, part, sheet) - 1 AS pos, row_number() OVER (PARTITION BY source ORDER BY part, sheet) - 1 AS pos_in FROM lines),
    blocks AS (SELECT '*' AS report_key, pos // 20 AS block_no, string_agg(CASE WHEN part = 0 AND pos > 0 THEN chr(10) || line ELSE line END, chr(10) ORDER BY pos) AS text FROM placed GROUP BY ALL
    UNION ALL SELECT source, pos_in // 20, string_agg(line, chr(10) ORDER BY pos_in) FROM placed GROUP BY ALL)"""


@register("inventory_blocks", sql("", "sheet_catalog").rstrip() + f",\n{INVENTORY_BLOCKS}\nSELECT * FROM blocks")
def inventory_blocks(spark, sf):
    return catalog.inventory_blocks(I.sheet_catalog(spark, sf), 20)


@register("sheet_schema_report", sql("""SELECT source, sheet, source || ' / ' || sheet || ': ' || count(*) || ' columns' || chr(10) ||
    string_agg(printf('%2d. %s', col_ordinal, coalesce(parent || ' ▸ ', '') || column_name), chr(10) ORDER BY col_ordinal) AS report FROM column_catalog GROUP BY source, sheet""", "column_catalog"))
def sheet_schema_report(spark, sf):
    return catalog.sheet_schema_report(I.column_catalog(spark, sf))


@register("sheet_schema_report_of_orders", sql("""SELECT source, 'lines' AS sheet, coalesce(report, source || ' / lines: (no columns recorded)') AS report FROM (SELECT 'order_' || o_orderkey || '.xlsx' AS source FROM orders) LEFT JOIN (
    SELECT source, source || ' / ' || sheet || ': ' || count(*) || ' columns' || chr(10) || string_agg(printf('%2d. %s', col_ordinal, coalesce(parent || ' ▸ ', '') || column_name), chr(10) ORDER BY col_ordinal) AS report
    FROM column_catalog GROUP BY source, sheet) USING (source)""", "column_catalog"))
def sheet_schema_report_of_orders(spark, sf):
    asked = I.table(spark, sf, "orders").select(F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit(".xlsx")).alias("source"), F.lit("lines").alias("sheet"))
    return catalog.sheet_schema_report(I.column_catalog(spark, sf), asked)


@register("column_display", sql("SELECT source, sheet, col_ordinal, printf('%02d. %s', col_ordinal, coalesce(parent || ' ▸ ', '') || column_name) AS display FROM column_catalog", "column_catalog"))
def column_display(spark, sf):
    return catalog.column_display(I.column_catalog(spark, sf))


@register("distinct_sources", sql("SELECT DISTINCT source FROM column_catalog", "column_catalog"))
def distinct_sources(spark, sf):
    return catalog.distinct_sources(I.column_catalog(spark, sf))
