"""Queries over files, texts and headings."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..functions import names, text
from ..operators import chunks, tables
from ..session import scratch_path
from ..sources import files, ranges, sinks
from . import inputs as I
from .inputs import NOT_WS, sql, strip_sql
from .registry import register


@register("scan_corpus", """SELECT source || '_' || (doc_id // 200) AS folder, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS length,
    sha256(string_agg(coalesce(text, '') || chr(1), '' ORDER BY doc_id)) AS digest, true AS complete FROM documents GROUP BY folder""")
def scan_corpus(spark, sf):
    """Whole texts written as files, those of a source in steps of 200 ids to a file, and scanned."""
    path = scratch_path(spark, "corpus")
    folder = F.concat_ws("_", "source", F.floor(F.col("doc_id") / 200).cast("string"))
    texts = I.table(spark, sf, "documents").select(folder.alias("name"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    dealt = texts.repartition("name").sortWithinPartitions("name", "doc_id").drop("doc_id")
    # Tasks move their own files into place; the driver would move all of them one by one.
    dealt.write.option("lineSep", "\u0001").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("name").text(path)
    found = files.scan_corpus(spark, path, "*.txt")
    name = F.url_decode(F.regexp_extract("path", "name=([^/]+)/", 1)).alias("folder")
    return found.select(name, "length", F.sha2("content", 256).alias("digest"), (F.length("content") == F.col("length")).alias("complete"))


_WHOLE = [(rel, cols) for rel, _, cols in I._SHEETS]
_DATES = ("o_orderdate",)


def _value_sql(c: str) -> str:
    return f"{c}::DECIMAL(15, 2)::VARCHAR" if c in I.AMOUNTS else f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if c in _DATES else f"{c}::VARCHAR"


CELL_ROWS = 4096  # rows of a file that the decoder holds as cells at a time


def _all_parquet_cells():
    """Decoder for the test tables themselves: every column of a Parquet file as cells, amounts with two decimals, missing values as null."""
    import pyarrow.parquet as pq

    def as_text(column: pd.Series) -> pd.Series:
        if column.dtype.kind == "f":
            shown = column.map(lambda v: f"{round(v, 2) + 0.0:.2f}")
        else:
            shown = column.dt.strftime("%Y-%m-%d %H:%M:%S") if column.dtype.kind == "M" else column.astype(str)
        return shown.astype(object).where(column.notna(), None)

    def decode(name: str, content: bytes) -> Iterator[pd.DataFrame]:
        file = pq.ParquetFile(io.BytesIO(content))
        holed = {c for batch in file.iter_batches() for c, column in zip(batch.schema.names, batch.columns) if column.null_count}
        start = 0
        for batch in file.iter_batches(CELL_ROWS):
            frame = batch.to_pandas()
            # Whole numbers with missing ones among them are doubles all through the file.
            frame = frame.astype({c: "float64" for c in holed if frame[c].dtype.kind in "iu"})
            places = {c: i for i, c in enumerate(frame.columns)}
            out = frame.apply(as_text).set_axis(range(start, start + len(frame))).reset_index(names="row_no").melt(id_vars="row_no", var_name="column_name")
            out["col_no"] = out["column_name"].map(places)
            start += len(frame)
            yield out[["row_no", "col_no", "column_name", "value"]]

    return decode


_CELLS_SQL = " UNION ALL ".join(
    f"SELECT '{rel}.parquet' AS source, {cols[0]}::BIGINT AS row_no, unnest(range({len(cols)})) AS col_no, unnest({cols}) AS column_name, "
    f"unnest([{', '.join(map(_value_sql, cols))}]) AS value, NULL::VARCHAR AS error FROM {rel}" for rel, cols in _WHOLE)  # fmt: skip


@register("extract", _CELLS_SQL)
def extract(spark, sf):
    """The six tables of the star with all their columns, a file at a time."""
    found = files.scan_corpus(spark, sf, "{%s}.parquet" % ",".join(rel for rel, _ in _WHOLE))
    return files.extract(found, _all_parquet_cells, "row_no BIGINT, col_no INT, column_name STRING, value STRING")


@register("extract_all_columns", _CELLS_SQL)
def extract_all_columns(spark, sf):
    return extract(spark, sf)


def _shown(column):
    """A column of the test tables as text: amounts with two decimals, dates with their time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if pa.types.is_floating(column.type):
        return pc.round(column, 2).cast(pa.decimal128(15, 2)).cast(pa.string())
    if pa.types.is_timestamp(column.type):
        return pc.strftime(column.cast(pa.timestamp("s"), safe=False), "%Y-%m-%d %H:%M:%S")
    return column.cast(pa.string())


def _range_cells():
    return ranges.ParquetCells(_shown)


@register("extract_ranges", _CELLS_SQL)
def extract_ranges(spark, sf):
    """The same cells, by row groups and batches: no file and no row group is held whole."""
    found = files.scan_corpus(spark, sf, "{%s}.parquet" % ",".join(rel for rel, _ in _WHOLE))
    return ranges.extract_ranges(ranges.plan_ranges(found, _range_cells), _range_cells, "row_no BIGINT, col_no INT, column_name STRING, value STRING")


@register("extract_text_ranges", """SELECT doc_id, n_chars, md5(text) AS digest FROM (SELECT doc_id, length(text) AS n_chars, text FROM (
    SELECT doc_id, replace(replace(coalesce(text, ''), chr(13), ' '), chr(10), ' ') AS text FROM documents))""")
def extract_text_ranges(spark, sf):
    """All texts as the lines of a few files, which are read again in ranges of 64 kB."""
    path = scratch_path(spark, "lines")
    flat = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    I.table(spark, sf, "documents").select(F.concat_ws("\t", F.col("doc_id").cast("string"), flat).alias("value")).write.text(path)
    plan = ranges.plan_ranges(files.scan_corpus(spark, path, "*.txt"), _small_ranges)
    lines = ranges.extract_ranges(plan, _small_ranges, "line_start BIGINT, text STRING")
    text = F.expr("substring(text, locate('\t', text) + 1)")
    return lines.select(F.substring_index("text", "\t", 1).cast("bigint").alias("doc_id"), F.char_length(text).cast("bigint").alias("n_chars"), F.md5(F.encode(text, "utf-8")).alias("digest"))


def _small_ranges():
    return ranges.TextLines(64 << 10)


@register("route_by_kind", f"""SELECT p_partkey, name, {I.KIND_SQL.format('name')} AS kind FROM (SELECT p_partkey, p_name ||
    ['.PDF', '.docx', '.csv', '.Xlsx', '.xls', '.md', '.TXT', '.bin'][p_size % 8 + 1] AS name FROM part)""")  # fmt: skip
def route_by_kind(spark, sf):
    ext = F.expr("element_at(array('.PDF', '.docx', '.csv', '.Xlsx', '.xls', '.md', '.TXT', '.bin'), p_size % 8 + 1)")
    named = I.table(spark, sf, "part").select("p_partkey", F.concat("p_name", ext).alias("name"))
    return files.route_by_kind(named)


@register("read_csv_text", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_orderpriority, 'said \"' || o_custkey || '\",\n' AS note, '' AS empty FROM orders")
def read_csv_text(spark, sf):
    path = scratch_path(spark, "csv")
    note = F.concat(F.lit('said "'), F.col("o_custkey").cast("string"), F.lit('",\n'))
    source = I.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", note.alias("note"), F.lit("").alias("empty"))
    source.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_csv_text(spark, path, multi_line=True)


@register("read_text_lossy", sql("SELECT source, kind, octet_length(encode(text)) + 2 AS bytes, text FROM files WHERE kind IN ('text', 'other')", "files"))
def read_text_lossy(spark, sf):
    """Documents with two bytes that are no UTF-8 put into them."""
    raw = F.concat(F.encode(F.substring("text", 1, 10), "utf-8"), F.expr("X'FF'"), F.encode(F.expr("substring(text, 11)"), "utf-8"), F.expr("X'C3'"))
    return files.read_text_lossy(I.files(spark, sf).select(F.col("source").alias("name"), raw.alias("content")))


@register("readable_bytes", """SELECT o_orderkey, CASE WHEN n < 1024.0 THEN printf('%.1f B', n) WHEN n < 1048576.0 THEN printf('%.1f KB', n / 1024)
    WHEN n < 1073741824.0 THEN printf('%.1f MB', n / 1048576) WHEN n < 1099511627776.0 THEN printf('%.1f GB', n / 1073741824) ELSE printf('%.1f TB', n / 1099511627776) END AS size
    FROM (SELECT o_orderkey, (o_orderkey + 1.0) * (1::BIGINT << (o_orderkey % 5 * 9)::INT) AS n FROM orders)""")  # fmt: skip
def readable_bytes(spark, sf):
    n = (F.col("o_orderkey") + 1) * F.expr("shiftleft(1L, cast(o_orderkey % 5 * 9 as int))")
    return I.table(spark, sf, "orders").select("o_orderkey", text.readable_bytes(n).alias("size"))


@register("sha1_hex", "SELECT p_partkey, sha1(p_name || '-' || p_brand) AS digest FROM part")
def sha1_hex(spark, sf):
    return I.table(spark, sf, "part").select("p_partkey", F.sha1(F.concat_ws("-", "p_name", "p_brand")).alias("digest"))


@register("all_text", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders")
def all_text(spark, sf):
    return tables.all_text(I.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"))


@register("normalize_name", f"SELECT page_id, {I.norm_name_sql('url')} AS name FROM pages")
def normalize_name(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", names.normalize_name(F.col("url")).alias("name"))


@register("chunk_words", sql("SELECT source, kind, page, chunk_no, text FROM chunks", "chunks"))
def chunk_words(spark, sf):
    return chunks.chunk_words(I.docs(spark, sf))


@register("chunk_words_of_tables", sql("""SELECT source, i AS chunk_no, array_to_string(ws[i * 200 + 1 : (i + 1) * 200], ' ') AS text
    FROM (SELECT *, unnest(range((len(ws) + 199) // 200)) AS i FROM docs)""", "docs"))
def chunk_words_of_tables(spark, sf):
    return chunks.chunk_words(I.docs(spark, sf).select("source", "text"), text.TABLE_WINDOW)


@register("chunk_id", sql("SELECT source, chunk_no, chunk_id FROM chunks", "chunks"))
def chunk_id(spark, sf):
    return I.doc_chunks(spark, sf).select("source", "chunk_no", "chunk_id")


@register("preview", sql("SELECT source, chunk_no, chars, preview FROM chunks", "chunks"))
def preview(spark, sf):
    return I.doc_chunks(spark, sf).select("source", "chunk_no", "chars", "preview")


@register("skip_blank", sql(f"SELECT source, para_no, text FROM paragraphs WHERE regexp_matches(text, '{NOT_WS}')", "paragraphs"))
def skip_blank(spark, sf):
    return chunks.skip_blank(I.paragraphs(spark, sf)).select("source", "para_no", "text")


@register("join_paragraphs", sql(f"""SELECT source, para_no // 16 AS part_no, string_agg(text, ' ' ORDER BY para_no) AS text FROM paragraphs
    WHERE regexp_matches(text, '{NOT_WS}') GROUP BY ALL""", "paragraphs"))
def join_paragraphs(spark, sf):
    return chunks.join_paragraphs(I.paragraphs(spark, sf), part_rows=16)


@register("chunk_paragraphs", sql(f"""SELECT source, i AS chunk_no, array_to_string(ws[i * 300 + 1 : (i + 1) * 300], ' ') AS text FROM (
    SELECT *, unnest(range((len(ws) + 299) // 300)) AS i FROM (SELECT source, {I.words_sql("string_agg(text, ' ' ORDER BY para_no)")} AS ws
    FROM paragraphs WHERE regexp_matches(text, '{NOT_WS}') GROUP BY source))""", "paragraphs"))
def chunk_paragraphs(spark, sf):
    return chunks.chunk_paragraphs(I.paragraphs(spark, sf))


STYLE_HEADINGS = f"""SELECT source, 1 AS page, CASE style WHEN 'Heading 1' THEN 1 ELSE 1 END AS level, {strip_sql('text')} AS heading, para_no
    FROM paragraphs WHERE lower(style) LIKE 'heading%' AND regexp_matches(text, '{NOT_WS}')"""


@register("headings_from_styles", sql(f"""SELECT source, 1 AS page, coalesce(TRY_CAST(regexp_replace(style, '[^0-9]', '', 'g') AS INT), 1) AS level,
    {strip_sql('text')} AS heading, para_no FROM (SELECT source, para_no, text, CASE WHEN style = 'Normal' THEN 'HEADING ' || (para_no % 3 + 1) ELSE style END AS style FROM paragraphs)
    WHERE lower(style) LIKE 'heading%' AND regexp_matches(text, '{NOT_WS}')""", "paragraphs"))
def headings_from_styles(spark, sf):
    """Body paragraphs become headings of level 1 to 3, so that all levels occur."""
    leveled = F.when(F.col("style") == "Normal", F.concat(F.lit("HEADING "), (F.col("para_no") % 3 + 1).cast("string"))).otherwise(F.col("style"))
    return chunks.headings_from_styles(I.paragraphs(spark, sf).withColumn("style", leveled))


FONT_HEADINGS = f"""SELECT source, page, CASE WHEN avg_size >= median * 1.6 THEN 1 ELSE 2 END AS level, {strip_sql('heading')} AS heading, first_word
    FROM (SELECT source, page, top::INT AS line, avg(coalesce(size, 0)) AS avg_size, string_agg(text, ' ' ORDER BY word_no) AS heading, min(word_no) AS first_word
          FROM (SELECT * REPLACE (floor(top) AS top) FROM words) GROUP BY ALL)
    JOIN (SELECT source, page, list_sort(list(size))[count(*) // 2 + 1] AS median FROM words WHERE size > 0 GROUP BY ALL) USING (source, page)
    WHERE avg_size >= median * 1.25 AND {strip_sql('heading')} <> ''"""


@register("headings_from_font_size", sql(FONT_HEADINGS, "words"))
def headings_from_font_size(spark, sf):
    return chunks.headings_from_font_size(I.words(spark, sf))


@register("ingest_text", sql("""SELECT kind, count(DISTINCT source) AS n_documents, count(*) AS n_chunks, sum(chars)::BIGINT AS n_chars, count(DISTINCT chunk_id) AS n_ids FROM chunks GROUP BY kind""", "chunks"))
def ingest_text(spark, sf):
    """The ingest report: documents, chunks and characters per kind."""
    by_source = I.chunk_vectors(spark, sf).groupBy("kind", "source").agg(
        F.count("*").alias("n"), F.sum("chars").alias("chars"), F.countDistinct("chunk_id").alias("ids"))
    return by_source.groupBy("kind").agg(
        F.count("*").alias("n_documents"), F.sum("n").alias("n_chunks"), F.sum("chars").alias("n_chars"), F.sum("ids").alias("n_ids")
    )


@register("export_text", "SELECT replace(p_type, ' ', '_') AS name, 'Feature: ' || p_name AS value FROM part")
def export_text(spark, sf):
    path = scratch_path(spark, "texts")
    source = I.table(spark, sf, "part").select(F.col("p_type").alias("feature"), F.concat(F.lit("Feature: "), F.col("p_name")).alias("text"))
    sinks.export_text(source, path)
    return spark.read.text(path).select("name", "value")
