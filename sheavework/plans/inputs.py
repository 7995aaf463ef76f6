"""Inputs of the operators, derived from the given tables, and the same derivations as SQL.

Every derivation covers its whole tables. ``sql(final, *names)`` puts the named derivations, and those they
need, in front of a final SELECT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, text
from ..operators import chunks, tables, vectors
from ..operators.spread import measured_join, salted_join, settled
from ..session import scratch_path

DIM = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


# ---------------------------------------------------------------- SQL twins

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)


def words_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{WS}+'), lambda w: w <> '')"


def strip_sql(expr: str) -> str:
    return rf"regexp_replace({expr}, '^{WS}+|{WS}+\z', '', 'g')"


def norm_name_sql(expr: str) -> str:
    return rf"regexp_replace(lower({expr}), '[^\p{{L}}\p{{N}}_]', '_', 'g')"


KIND_SQL = """CASE WHEN lower({0}) LIKE '%.pdf' THEN 'pdf' WHEN lower({0}) LIKE '%.docx' THEN 'docx'
 WHEN lower({0}) LIKE '%.csv' THEN 'csv' WHEN lower({0}) LIKE '%.xlsx' THEN 'xlsx' WHEN lower({0}) LIKE '%.xls' THEN 'xls'
 WHEN lower({0}) LIKE '%.md' OR lower({0}) LIKE '%.txt' THEN 'text' ELSE 'other' END"""

_SHEETS = [
    # Workbook sheets: table, key and all its columns.
    ("region", "r_regionkey", ["r_regionkey", "r_name"]),
    ("nation", "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]),
    ("customer", "c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    ("supplier", "s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    ("part", "p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    ("orders", "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
]
AMOUNTS = ("c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice")  # printed with two decimals, as engines print doubles differently


def _grid(source, kind, sheet, page, table_no, relation, row_no, columns, header_rows) -> dict:
    """One grid: ``columns`` are value expressions valid in both engines, ``header_rows`` lists of text or None."""
    return dict(source=source, kind=kind, sheet=sheet, page=page, table_no=table_no, relation=relation, row_no=row_no,
                columns=columns, header_rows=header_rows)


def _as_text(cols: list[str]) -> list[str]:
    return [f"CAST(CAST({c} AS DECIMAL(15, 2)) AS STRING)" if c in AMOUNTS else f"CAST({c} AS STRING)" for c in cols]


def grids() -> list[dict]:
    out = [
        _grid("star.xlsx", "xlsx", rel, None, i, rel, f"{key} + 1", _as_text(cols), [cols])
        for i, (rel, key, cols) in enumerate(_SHEETS, start=1)
    ]
    part = _as_text(_SHEETS[4][2][:5])
    nation = _as_text(_SHEETS[1][2])
    blank5, blank3 = ["", None, " ", "", ""], ["", "", None]
    # Header rows that lost their names: 3 of 5, 2 of 3 and 1 of 3 columns unnamed.
    out += [
        _grid("broken.xlsx", "xlsx", "three of five", None, 1, "part", "p_partkey + 3", part,
              [["p_partkey", "p_name", "", None, "Unnamed: 4"], blank5, ["p_partkey", "p_name", " p_brand ", "p_type", ""]]),
        _grid("broken.xlsx", "xlsx", "two of three", None, 2, "nation", "n_nationkey + 3", nation,
              [["n_nationkey", "Unnamed: 1", "unnamed"], blank3, ["n_nationkey", "n_name", "n_regionkey"]]),
        _grid("broken.xlsx", "xlsx", "one of three", None, 3, "nation", "n_nationkey + 3", nation,
              [["n_nationkey", "n_name", ""], blank3, ["a", "b", "c"]]),
        _grid("broken.xlsx", "xls", "top rows", None, 4, "region", "r_regionkey + 2", _as_text(_SHEETS[0][2]),
              [["", ""], ["r_regionkey", "r_name"]]),
        # Two header rows: group and name.
        _grid("nested.xlsx", "xlsx", "part", None, 1, "part", "p_partkey + 2", part,
              [["part", " part ", "attr", "", "  "], ["p_partkey", "p_name", "", "p_type ", "p_size"]]),
        _grid("supplier.csv", "csv", None, None, 1, "supplier", "s_suppkey + 1", _as_text(_SHEETS[3][2]), [_SHEETS[3][2]]),
        _grid("memo.docx", "docx", None, None, 1, "region", "r_regionkey + 1", _as_text(_SHEETS[0][2]), [_SHEETS[0][2]]),
        _grid("memo.docx", "docx", None, None, 2, "customer", "c_custkey + 1", ["c_mktsegment", "c_name"], [["segment", ""]]),
        _grid("report.pdf", "pdf", None, 2, 1, "supplier", "s_suppkey + 1", ["s_name"], [["s_name"]]),
        _grid("report.pdf", "pdf", None, 3, 1, "nation", "n_nationkey + 1", nation, [["n_nationkey", " ", "n_regionkey"]]),
        _grid("report.pdf", "pdf", None, 3, 2, "part", "p_partkey + 1", ["p_type", "p_brand"], [["p_type", None]]),
    ]
    return out


# Grids without a single cell: a sheet, which is a table all the same, and a Word and a pdf grid, which are none.
EMPTY_GRIDS = [("broken.xlsx", "xlsx", "blank", None, 5), ("memo.docx", "docx", None, None, 3), ("report.pdf", "pdf", None, 4, 1)]
TWO_ROW_SHEETS = [("nested.xlsx", "part")]


def grid_list(spark: SparkSession) -> DataFrame:
    """(source, kind, sheet, page, table_no) of every grid, also of those without a cell."""
    met = [(g["source"], g["kind"], g["sheet"], g["page"], g["table_no"]) for g in grids()]
    return spark.createDataFrame(met + EMPTY_GRIDS, "source string, kind string, sheet string, page int, table_no int")


def _lit(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _grid_select(g: dict, engine: str) -> str:
    """SELECTs of the header cells and the data cells of a grid."""
    head = f"{_lit(g['source'])} AS source, {_lit(g['kind'])} AS kind, CAST({_lit(g['sheet'])} AS STRING) AS sheet, " \
           f"CAST({'NULL' if g['page'] is None else g['page']} AS INT) AS page, {g['table_no']} AS table_no"  # fmt: skip
    parts = []
    for r, row in enumerate(g["header_rows"]):
        cells = ", ".join(f"({c}, CAST({_lit(v)} AS STRING))" for c, v in enumerate(row))
        parts.append(f"SELECT {head}, CAST({r} AS BIGINT) AS row_no, h.col_no, h.value FROM (VALUES {cells}) AS h(col_no, value)")
    n = len(g["columns"])
    if engine == "spark":
        stack = ", ".join(f"{c}, {v}" for c, v in enumerate(g["columns"]))
        parts.append(f"SELECT {head}, CAST({g['row_no']} AS BIGINT) AS row_no, stack({n}, {stack}) AS (col_no, value) FROM {{{g['relation']}}}")
    else:
        values = ", ".join(g["columns"])
        parts.append(
            f"SELECT {head}, CAST({g['row_no']} AS BIGINT) AS row_no, unnest(range({n})) AS col_no, unnest([{values}]) AS value FROM {g['relation']}"
        )
    return " UNION ALL ".join(parts)


def cells(spark: SparkSession, sf: str, only: str | None = None) -> DataFrame:
    """Cell grids of a workbook of whole tables, and of damaged, nested, csv, Word and pdf variants."""
    chosen = [g for g in grids() if only in (None, g["source"])]
    relations = {g["relation"]: table(spark, sf, g["relation"]) for g in chosen}
    union = " UNION ALL ".join(_grid_select(g, "spark") for g in chosen)
    return spark.sql(union, **relations)


def cells_sql(only: str | None = None) -> str:
    return " UNION ALL ".join(_grid_select(g, "duckdb") for g in grids() if only in (None, g["source"]))


def stored(spark: SparkSession, sf: str, only: str | None = "star.xlsx") -> dict[str, DataFrame]:
    """Rows, headers, body, column catalog, sheet catalog and table catalog of the grids."""
    return catalogs_of(tables.cells_to_rows(cells(spark, sf, only)))


def catalogs_of(rows: DataFrame, stored: bool = False) -> dict[str, DataFrame]:
    """Headers, body and catalogs of grid rows; those that are stored are read for their headers at once."""
    headers = settled(tables.header_info(rows)) if stored else tables.header_info(rows)
    body = tables.body_rows(rows, headers, measured_join if stored else salted_join)
    columns = tables.column_catalog(headers)
    # Tables are created in the order of their numbers.
    catalog = headers.select(
        "table_name", "source", "page", F.col("label").alias("sheet"), F.col("table_no").cast("bigint").alias("created_at")
    )
    return {"rows": rows, "headers": headers, "body": body, "columns": columns, "tables": catalog,
            "sheets": tables.sheet_stats(headers, body)}


_WRITTEN: dict[tuple[str, str], str] = {}


def written(spark: SparkSession, sf: str, name: str, write: Callable[[str], object]) -> str:
    """The folder that ``write`` fills, once per session and data folder."""
    key = (spark.sparkContext.applicationId, f"{sf}#{name}")
    if key not in _WRITTEN:
        root = scratch_path(spark, name)
        write(root)
        _WRITTEN[key] = root
    return _WRITTEN[key]


def knowledge_base(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The workbook of whole tables as stored tables: rows, column, sheet and table catalogs as Parquet.

    Ingest writes them once per session and data folder to the shared folder; retrieval reads them. Rows are
    laid out by ranges of table and row number, so that a scan for some tables skips the files of the
    others and a dominant table is spread over many files.
    """

    def write(root: str) -> None:
        tables.cells_to_rows(cells(spark, sf, "star.xlsx")).write.parquet(f"{root}/grid")
        made = catalogs_of(spark.read.parquet(f"{root}/grid"), stored=True)
        made["body"].repartitionByRange("table_name", "row_no").sortWithinPartitions("table_name", "row_no").write.parquet(f"{root}/rows")
        sheets = tables.sheet_stats(made["headers"], spark.read.parquet(f"{root}/rows"))
        for name, df in {"columns": made["columns"], "tables": made["tables"], "sheets": sheets}.items():
            df.write.parquet(f"{root}/{name}")

    root = written(spark, sf, "kb", write)
    found = {name: spark.read.parquet(f"{root}/{name}") for name in ("rows", "columns", "sheets", "tables")}
    return {**found, "body": found["rows"]}


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files; the kind goes with the language."""
    ext = F.expr("CASE lang WHEN 'de' THEN '.PDF' WHEN 'es' THEN '.docx' WHEN 'fr' THEN '.md' ELSE '.txt' END")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), ext)
    return documents(spark, sf).select(
        "doc_id", name.alias("source"), names.file_kind(name).alias("kind"),
        F.when(F.col("lang") == "de", (F.col("doc_id") % 3 + 1).cast("int")).otherwise(1).alias("page"),
        "n_chars", "text",
    )


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("source", "kind", "page", "text")


def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.text_chunks(docs(spark, sf))


def chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.embed(doc_chunks(spark, sf), "preview", DIM)


def text_base(spark: SparkSession, sf: str, embedded: str = "preview") -> dict[str, DataFrame]:
    """Chunks of the documents and vectors of their column ``embedded`` as stored tables, written once per session and data folder."""

    def write(root: str) -> None:
        source = stored_chunks.select("chunk_id", F.col(embedded).alias("of"))
        vectors.embed(source, "of", DIM).select("chunk_id", "embedding").write.parquet(root)

    stored_chunks = spark.read.parquet(written(spark, sf, "text", lambda root: doc_chunks(spark, sf).write.parquet(root)))
    return {"chunks": stored_chunks, "vectors": spark.read.parquet(written(spark, sf, f"text_{embedded}", write))}


def text_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("query"))


def table_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts, and a lookup for every part."""
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("query_id"),
        F.concat_ws(" ", F.lit("Part"), "p_name", "p_brand").alias("query"),
    )
    return text_queries(spark, sf).unionByName(parts)


def inventory_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One question per supplier, with and without a workbook's name."""
    query = F.expr(
        """CASE s_nationkey % 4 WHEN 0 THEN concat('Which columns has "star.xlsx" for ', s_name)
           WHEN 1 THEN concat('List every Worksheet near ', s_name) WHEN 2 THEN concat(s_name, ' balance')
           ELSE concat('headers: ', s_name, '.xls') END"""
    )
    return table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("query_id"), query.alias("query"))


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the documents on pages of 400, eight to a line; odd documents have two heading lines per page."""
    each = documents(spark, sf).select("doc_id", F.posexplode(text.words(F.col("text"))).alias("pos", "text"))
    on_page = F.col("pos") % 400
    line = F.floor(on_page / 8)
    size = F.expr("CASE WHEN pos % 17 = 16 THEN NULL WHEN doc_id % 2 = 1 AND pos % 400 < 8 THEN 16.0D "
                  "WHEN doc_id % 2 = 1 AND pos % 400 < 16 THEN 13.0D ELSE 10.0D END")  # fmt: skip
    return each.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source"),
        (F.floor(F.col("pos") / 400) + 1).cast("int").alias("page"),
        on_page.alias("word_no"), (line * 12 + 0.5).cast("double").alias("top"), size.alias("size"), "text",
    )


# Fixed value: the opening tags whose text becomes a paragraph.
PARAGRAPH_TAGS = "<(h1|title|p)>"


def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    # Cut before every opening tag; a paragraph ends at its closing tag or at the next cut, and inner tags are taken out.
    cut = F.split(F.regexp_replace(html, PARAGRAPH_TAGS, "\u0001$1\u0002"), "\u0001")
    body = lambda x: F.split_part(F.substring_index(x, "\u0002", -1), F.concat(F.lit("</"), tag(x), F.lit(">")), F.lit(1))
    tag = lambda x: F.substring_index(x, "\u0002", 1)
    both = F.transform(F.slice(cut, F.lit(2), F.size(cut)), lambda x: F.struct(tag(x).alias("tag"), F.regexp_replace(body(x), "<[^>]*>", "").alias("text")))
    style = F.expr("CASE p.tag WHEN 'h1' THEN 'Heading 1' WHEN 'title' THEN 'heading' ELSE 'Normal' END")
    return (
        table(spark, sf, "pages")
        .select("page_id", F.posexplode(both).alias("para_no", "p"))
        .select(F.format_string("page_%d.docx", "page_id").alias("source"), "para_no", style.alias("style"), F.col("p.text").alias("text"))
    )


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    conv = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    sid = F.concat(F.lit("sess_"), F.col("conv_id").cast("string"))
    return conv.select(
        sid.alias("session_id"), F.concat(F.lit("Chat "), F.col("conv_id").cast("string")).alias("title"),
        F.lit("user").alias("user"), (F.lit(1704067200) + F.col("conv_id") * 60).alias("created_at"),
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("sess_"), F.col("conv_id").cast("string")).alias("session_id"),
        (F.col("turn") + 1).alias("msg_no"), "role", F.col("text").alias("content"),
        (F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")).alias("created_at"),
    )


def chat_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The opening message of every conversation as a query."""
    conv = table(spark, sf, "conversations").where("turn = 0")
    sid = F.concat(F.lit("sess_"), F.col("conv_id").cast("string"))
    return conv.select(sid.alias("query_id"), sid.alias("session_id"), F.col("text").alias("query"))


def turn_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every session's opening message, asked again at its end; some ask for the sheets of a workbook or of all."""
    conv = table(spark, sf, "conversations").where("turn = 0")
    sid = F.concat(F.lit("sess_"), F.col("conv_id").cast("string"))
    more = F.expr("""CASE conv_id % 4 WHEN 0 THEN ' Which columns has "BUILDING.xlsx"?' WHEN 1 THEN ' List every worksheet.' WHEN 2 THEN ' Fields of (none).xls' ELSE '' END""")
    return conv.select(
        F.concat(F.lit("turn_"), F.col("conv_id").cast("string")).alias("query_id"), sid.alias("session_id"), F.concat("text", more).alias("query"),
        (F.lit(1704067200) + F.col("conv_id") * 60 + 1000).alias("created_at"),
    )


def sheet_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A workbook per market segment with a sheet per nation."""
    return (
        table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").cast("int").alias("n_rows"))
        .select(F.concat("c_mktsegment", F.lit(".xlsx")).alias("source"),
                F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("sheet"),
                F.lit(4).alias("n_cols"), "n_rows")
    )


def column_entries(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet per order with a column per line item; line numbers may come twice."""
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("order_"), F.col("l_orderkey").cast("string"), F.lit(".xlsx")).alias("source"),
        F.lit("lines").alias("sheet"), F.col("l_linenumber").alias("col_ordinal"),
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("column_name"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("parent"),
        F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(":"), F.lpad(F.col("l_partkey").cast("string"), 12, "0")).alias("seen_at"),
    )


def column_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The same with one entry per line number."""
    one = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").alias("l_partkey"), F.max("l_returnflag").alias("flag"))
    return one.select(
        F.concat(F.lit("order_"), F.col("l_orderkey").cast("string"), F.lit(".xlsx")).alias("source"),
        F.lit("lines").alias("sheet"), F.col("l_linenumber").alias("col_ordinal"),
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("column_name"),
        F.when(F.col("flag") != "N", F.col("flag")).alias("parent"),
    )


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "files": ((), f"""SELECT doc_id, source, {KIND_SQL.format('source')} AS kind, page, n_chars, text FROM (
        SELECT doc_id, 'doc_' || doc_id || CASE lang WHEN 'de' THEN '.PDF' WHEN 'es' THEN '.docx' WHEN 'fr' THEN '.md' ELSE '.txt' END AS source,
        CASE WHEN lang = 'de' THEN doc_id % 3 + 1 ELSE 1 END AS page, n_chars, text FROM documents)"""),
    "docs": (("files",), f"SELECT *, {words_sql('text')} AS ws FROM files"),
    "chunks": (("docs",), """SELECT *, length(text) AS chars, substr(text, 1, 160) AS preview,
        sha1(source || '-' || CASE kind WHEN 'pdf' THEN page::VARCHAR WHEN 'docx' THEN 'docx' ELSE 'raw' END || '-' || chunk_no || '-' || length(text)) AS chunk_id
        FROM (SELECT source, kind, page, doc_id, i AS chunk_no, array_to_string(ws[i * 300 + 1 : (i + 1) * 300], ' ') AS text
              FROM (SELECT *, unnest(range((len(ws) + 299) // 300)) AS i FROM docs))"""),
    "chunk_terms": (("chunks",), f"""SELECT *, list_transform({words_sql('preview')}, lambda w: ('0x' || substr(md5(lower(w)), 1, 4))::INT % {DIM}) AS buckets FROM chunks"""),
    "chunk_counts": (("chunk_terms",), f"SELECT *, list_transform(range({DIM}), lambda i: len(list_filter(buckets, lambda b: b = i))::DOUBLE) AS v FROM chunk_terms"),
    "chunk_vectors": (("chunk_counts",), """SELECT *, list_transform(v, lambda x: (x / (sqrt(list_inner_product(v, v)) + 1e-9))::FLOAT)::DOUBLE[] AS embedding FROM chunk_counts"""),
    "whole_terms": (("chunks",), f"""SELECT *, list_transform({words_sql('text')}, lambda w: ('0x' || substr(md5(lower(w)), 1, 4))::INT % {DIM}) AS buckets FROM chunks"""),
    "whole_counts": (("whole_terms",), f"SELECT *, list_transform(range({DIM}), lambda i: len(list_filter(buckets, lambda b: b = i))::DOUBLE) AS v FROM whole_terms"),
    "whole_vectors": (("whole_counts",), """SELECT *, list_transform(v, lambda x: (x / (sqrt(list_inner_product(v, v)) + 1e-9))::FLOAT)::DOUBLE[] AS embedding FROM whole_counts"""),
    "text_queries": ((), "SELECT 'b' || item_id AS query_id, text AS query FROM benchmark"),
    "table_queries": (("text_queries",), "SELECT * FROM text_queries UNION ALL SELECT 'p' || p_partkey, 'Part ' || p_name || ' ' || p_brand FROM part"),
    "inventory_queries": ((), """SELECT 's' || s_suppkey AS query_id, CASE s_nationkey % 4 WHEN 0 THEN 'Which columns has "star.xlsx" for ' || s_name
        WHEN 1 THEN 'List every Worksheet near ' || s_name WHEN 2 THEN s_name || ' balance' ELSE 'headers: ' || s_name || '.xls' END AS query FROM supplier"""),
    "words": ((), f"""SELECT 'doc_' || doc_id || '.pdf' AS source, pos // 400 + 1 AS page, pos % 400 AS word_no, (pos % 400 // 8) * 12 + 0.5 AS top,
        CASE WHEN pos % 17 = 16 THEN NULL WHEN doc_id % 2 = 1 AND pos % 400 < 8 THEN 16.0 WHEN doc_id % 2 = 1 AND pos % 400 < 16 THEN 13.0 ELSE 10.0 END::DOUBLE AS size, text
        FROM (SELECT doc_id, unnest(ws) AS text, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, {words_sql('text')} AS ws FROM documents))"""),
    "paragraphs": ((), f"""SELECT 'page_' || page_id || '.docx' AS source, para_no, CASE tag WHEN 'h1' THEN 'Heading 1' WHEN 'title' THEN 'heading' ELSE 'Normal' END AS style, text
        FROM (SELECT page_id, para_no, tag, regexp_replace(split_part(split_part(part, chr(2), -1), '</' || tag || '>', 1), '<[^>]*>', '', 'g') AS text FROM (
        SELECT page_id, para_no, part, split_part(part, chr(2), 1) AS tag FROM (
        SELECT page_id, unnest(range(len(parts) - 1)) AS para_no, unnest(parts[2:]) AS part FROM (
        SELECT page_id, string_split(regexp_replace(html, '{PARAGRAPH_TAGS}', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM pages))))"""),
    "sessions": ((), "SELECT DISTINCT 'sess_' || conv_id AS session_id, 'Chat ' || conv_id AS title, 'user' AS \"user\", 1704067200 + conv_id * 60 AS created_at FROM conversations"),
    "messages": ((), "SELECT 'sess_' || conv_id AS session_id, turn + 1 AS msg_no, role, text AS content, 1704067200 + conv_id * 60 + turn AS created_at FROM conversations"),
    "chat_queries": ((), "SELECT 'sess_' || conv_id AS query_id, 'sess_' || conv_id AS session_id, text AS query FROM conversations WHERE turn = 0"),
    "turn_queries": ((), """SELECT 'turn_' || conv_id AS query_id, 'sess_' || conv_id AS session_id, text || CASE conv_id % 4 WHEN 0 THEN ' Which columns has "BUILDING.xlsx"?'
        WHEN 1 THEN ' List every worksheet.' WHEN 2 THEN ' Fields of (none).xls' ELSE '' END AS query FROM conversations WHERE turn = 0"""),
    "sheet_catalog": ((), "SELECT c_mktsegment || '.xlsx' AS source, 'nation_' || c_nationkey AS sheet, 4 AS n_cols, count(*) AS n_rows FROM customer GROUP BY c_mktsegment, c_nationkey"),
    "column_entries": ((), """SELECT 'order_' || l_orderkey || '.xlsx' AS source, 'lines' AS sheet, l_linenumber AS col_ordinal, 'part_' || l_partkey AS column_name,
        CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS parent, strftime(l_shipdate, '%Y-%m-%d') || ':' || lpad(l_partkey::VARCHAR, 12, '0') AS seen_at FROM lineitem"""),
    "column_catalog": ((), """SELECT 'order_' || l_orderkey || '.xlsx' AS source, 'lines' AS sheet, l_linenumber AS col_ordinal, 'part_' || max(l_partkey) AS column_name,
        CASE WHEN max(l_returnflag) <> 'N' THEN max(l_returnflag) END AS parent FROM lineitem GROUP BY l_orderkey, l_linenumber"""),
    # The grids: all of them, or the workbook of whole tables.
    "cells": ((), cells_sql()),
    "star_cells": ((), cells_sql("star.xlsx")),
}


def _grid_ctes(prefix: str, cells_name: str) -> None:
    """SQL statement of naming, header rules and catalogs over a cell table."""
    named = f"""SELECT *, CASE kind WHEN 'csv' THEN 'csv' WHEN 'docx' THEN 'docx_table_' || table_no WHEN 'pdf' THEN 'pdf_p' || page || '_t' || table_no ELSE sheet END AS label,
        {norm_name_sql("replace(source, '.' || kind, '') || CASE kind WHEN 'csv' THEN '' WHEN 'docx' THEN '_table_' || table_no WHEN 'pdf' THEN '_p' || page || '_t' || table_no ELSE '_' || sheet END")} AS table_name
        FROM {cells_name}"""
    filled = f"r0 IS NOT NULL AND regexp_matches(r0, '{NOT_WS}')"
    CTES.update({
        f"{prefix}named": ((cells_name,), named),
        f"{prefix}heads": ((f"{prefix}named",), f"""SELECT *, bool_and({filled}) OVER (PARTITION BY source, label) OR kind <> 'pdf' AS has_header,
            max(col_no + 1) OVER (PARTITION BY source, label) AS width, max(n) OVER (PARTITION BY source, label) AS grid_rows
            FROM (SELECT source, label, kind, page, table_no, table_name, col_no, max(value) FILTER (row_no = 0) AS r0, max(value) FILTER (row_no = 1) AS r1, max(value) FILTER (row_no = 2) AS r2,
                  max(row_no) + 1 AS n FROM {prefix}named GROUP BY ALL)"""),
        f"{prefix}read": ((f"{prefix}heads",), """SELECT *, CASE WHEN NOT has_header THEN col_no::VARCHAR WHEN kind IN ('csv', 'xlsx', 'xls') AND coalesce(r0, '') = '' THEN 'Unnamed: ' || col_no
            ELSE coalesce(r0, '_col') END AS read_name, CASE WHEN has_header THEN 1 ELSE 0 END AS header_rows FROM """ + f"{prefix}heads"),
        f"{prefix}cols": ((f"{prefix}read",), f"""SELECT *, CASE WHEN NOT repaired THEN read_name WHEN picked = '' THEN 'col_' || (col_no + 1) ELSE picked END AS name,
            header_rows + CASE WHEN repaired THEN least(2, grid_rows - header_rows) ELSE 0 END AS taken
            FROM (SELECT *, avg(CASE WHEN lower(read_name) LIKE 'unnamed%' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY source, label) >= 0.6 AS repaired,
                  {strip_sql("coalesce(nullif(CASE WHEN has_header THEN r2 ELSE r1 END, ''), nullif(CASE WHEN has_header THEN r1 ELSE r0 END, ''), read_name)")} AS picked FROM {prefix}read)"""),
        f"{prefix}tabs": ((f"{prefix}cols",), f"SELECT DISTINCT source, label, kind, page, table_no, table_name, has_header, repaired, width, header_rows, taken, grid_rows FROM {prefix}cols"),
        f"{prefix}body": ((f"{prefix}named", f"{prefix}tabs"), f"""SELECT n.source, n.label, n.table_name, n.row_no - t.taken AS row_no, n.col_no, n.value
            FROM {prefix}named n JOIN {prefix}tabs t ON n.source = t.source AND n.label = t.label WHERE n.row_no >= t.taken"""),
    })


_grid_ctes("", "cells")
_grid_ctes("star_", "star_cells")


def sql(final: str, *needed: str) -> str:
    """``final`` with the derivations it needs in front."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            add(dep)
        order.append(name)

    for name in needed:
        add(name)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + final
