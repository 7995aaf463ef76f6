"""Queries of keyword search over the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, chunks, search, vectors
from ..operators.spread import settled
from . import inputs as I
from .catalogs import INVENTORY_BLOCKS
from .documents import FONT_HEADINGS, STYLE_HEADINGS
from .inputs import sql, words_sql
from .nearest import hits_sql, text_hits
from .registry import register


def _tokens_cte(source: str) -> str:
    return f"tokens AS (SELECT query_id, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM (SELECT query_id, {words_sql('lower(query)')} AS ws FROM {source}))"


_NAMES = """names AS (SELECT table_name, lower(table_name) AS name FROM star_tabs UNION ALL SELECT table_name, lower(name) FROM star_cols),
    names_all AS (SELECT * FROM names UNION ALL SELECT table_name, lower(source) FROM star_tabs UNION ALL SELECT table_name, lower(label) FROM star_tabs)"""
_SCORES = """scores AS (SELECT query_id, table_name, sum(n)::BIGINT AS score FROM (SELECT query_id, token, count(*) AS n FROM tokens GROUP BY ALL)
    JOIN (SELECT DISTINCT t.token, n.table_name FROM (SELECT DISTINCT token FROM tokens) t, {0} n WHERE contains(n.name, t.token)) USING (token) GROUP BY ALL)"""
_CHOSEN = """chosen AS (SELECT query_id, rank, table_name FROM (SELECT s.query_id, s.table_name, row_number() OVER (PARTITION BY s.query_id ORDER BY t.table_no, s.table_name) AS rank
    FROM scores s JOIN star_tabs t USING (table_name)) WHERE rank <= {0})"""
_ROWS = "row_texts AS (SELECT table_name, row_no, lower(string_agg(value, chr(10) ORDER BY col_no)) AS row_text, string_agg(coalesce(value, ''), chr(9) ORDER BY col_no) AS line FROM star_body GROUP BY ALL)"
_MATCHED = """asked AS (SELECT DISTINCT query_id, table_name, token FROM tokens JOIN chosen USING (query_id)),
    found AS (SELECT p.table_name, r.row_no, p.token FROM (SELECT DISTINCT table_name, token FROM asked) p JOIN row_texts r ON p.table_name = r.table_name AND contains(r.row_text, p.token)),
    matched AS (SELECT DISTINCT query_id, table_name, row_no FROM asked JOIN found USING (table_name, token))"""
_SAMPLED = """best AS (SELECT query_id, table_name, row_no FROM (SELECT *, row_number() OVER (PARTITION BY query_id, table_name ORDER BY row_no) AS n FROM matched) WHERE n <= 3),
    sampled AS (SELECT query_id, table_name, row_no, true AS matched FROM best UNION ALL
    SELECT c.query_id, c.table_name, r.row_no, false FROM chosen c JOIN row_texts r ON r.table_name = c.table_name AND r.row_no < 3 WHERE (c.query_id, c.table_name) NOT IN (SELECT (query_id, table_name) FROM best))"""
_SNIPPETS = """snippets AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS structured FROM (SELECT c.query_id, c.rank,
    c.table_name || ' (cols: ' || h.cols || ') from ' || t.source || chr(10) || s.lines AS block
    FROM chosen c JOIN star_tabs t ON t.table_name = c.table_name JOIN (SELECT table_name, string_agg(name, ', ' ORDER BY col_no) FILTER (col_no < 10) AS cols FROM star_cols GROUP BY table_name) h ON h.table_name = c.table_name
    JOIN (SELECT query_id, table_name, string_agg(line, chr(10) ORDER BY row_no) AS lines FROM sampled JOIN row_texts USING (table_name, row_no) GROUP BY ALL) s ON s.query_id = c.query_id AND s.table_name = c.table_name) GROUP BY query_id)"""


def lookup_sql(final: str, source: str, k: int, *more: str, scope: str = "names") -> str:
    head = sql("", *STORED, source).rstrip()
    return head + ",\n" + lookup_steps(source, k, *more, scope=scope) + "\n" + final


STORED = ("star_tabs", "star_cols", "star_body")


def lookup_steps(source: str, k: int, *more: str, scope: str = "names") -> str:
    return ",\n".join([_tokens_cte(source), _NAMES, _SCORES.format(scope), _CHOSEN.format(k), _ROWS, *more])


def stored(spark, sf):
    return I.knowledge_base(spark, sf)


@register("tokenize_query", sql("", "table_queries").rstrip() + f",\n{_tokens_cte('table_queries')}\nSELECT query_id, pos, token FROM tokens")
def tokenize_query(spark, sf):
    return search.tokenize_query(I.table_queries(spark, sf))


@register("score_tables", lookup_sql("SELECT * FROM scores", "table_queries", 5))
def score_tables(spark, sf):
    s = stored(spark, sf)
    return search.score_tables(I.table_queries(spark, sf), s["tables"], s["columns"])


@register("score_tables_all", lookup_sql("SELECT * FROM scores", "table_queries", 5, scope="names_all"))
def score_tables_all(spark, sf):
    s = stored(spark, sf)
    return search.score_tables(I.table_queries(spark, sf), s["tables"], s["columns"], scope="all")


@register("top_k_tables", lookup_sql("SELECT * FROM chosen", "table_queries", 3))
def top_k_tables(spark, sf):
    s = stored(spark, sf)
    return search.top_k_tables(I.table_queries(spark, sf), s["tables"], s["columns"], 3)


@register("top_k_tables_by_score", lookup_sql("""SELECT query_id, rank, table_name FROM (SELECT s.query_id, s.table_name, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, t.table_no, s.table_name) AS rank
    FROM scores s JOIN star_tabs t USING (table_name)) WHERE rank <= 3""", "table_queries", 3))
def top_k_tables_by_score(spark, sf):
    s = stored(spark, sf)
    return search.top_k_tables(I.table_queries(spark, sf), s["tables"], s["columns"], 3, order="score")


@register("match_rows", lookup_sql("SELECT query_id, table_name, count(*) AS n_rows, min(row_no) AS first_row, max(row_no) AS last_row FROM matched GROUP BY ALL", "text_queries", 5, _MATCHED))
def match_rows(spark, sf):
    s, queries = stored(spark, sf), I.text_queries(spark, sf)
    chosen = settled(search.top_k_tables(queries, s["tables"], s["columns"], 5))
    matched = search.match_rows(queries, chosen, s["body"])
    return matched.groupBy("query_id", "table_name").agg(F.count("*").alias("n_rows"), F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"))


@register("sample_rows", lookup_sql("SELECT query_id, table_name, row_no, matched, line FROM sampled JOIN row_texts USING (table_name, row_no)", "table_queries", 5, _MATCHED, _SAMPLED))
def sample_rows(spark, sf):
    s, queries = stored(spark, sf), I.table_queries(spark, sf)
    chosen = settled(search.top_k_tables(queries, s["tables"], s["columns"], 5))
    picked = search.sample_rows(queries, chosen, s["body"])
    line = F.array_join(F.transform("values", lambda v: F.coalesce(v, F.lit(""))), "\t")
    return picked.select("query_id", "table_name", "row_no", "matched", line.alias("line"))


@register("render_snippets", lookup_sql("SELECT * FROM snippets", "table_queries", 3, _MATCHED, _SAMPLED, _SNIPPETS))
def render_snippets(spark, sf):
    s = stored(spark, sf)
    return search.search_context(I.table_queries(spark, sf), s["tables"], s["columns"], s["body"], 3)


@register("resources_for_query", lookup_sql("""SELECT c.query_id, c.rank, t.source AS document, t.label AS sheet, t.table_name AS "table", t.width AS n_cols, t.grid_rows - t.taken AS n_rows,
    (SELECT string_agg(name, ', ' ORDER BY col_no) FROM star_cols k WHERE k.table_name = t.table_name AND k.col_no < 50) AS columns FROM chosen c JOIN star_tabs t ON t.table_name = c.table_name""", "table_queries", 6, scope="names_all"))
def resources_for_query(spark, sf):
    s = stored(spark, sf)
    found = search.resources_for_query(I.table_queries(spark, sf), s["tables"], s["columns"], s["sheets"], 6)
    return found.withColumn("columns", F.array_join("columns", ", "))


_RESOURCE_ROWS = """r AS (SELECT query_id, rank, split_part(source, '#', 1) AS document, page FROM hydrated WHERE rank <= 6)"""


@register("text_resources", hits_sql(f""", words AS ({I.CTES['words'][1]}), paragraphs AS ({I.CTES['paragraphs'][1]}),
    headings AS (SELECT regexp_replace(source, '[.]pdf$', '.PDF') AS source, page, level, heading, first_word AS heading_no FROM ({FONT_HEADINGS})
                 UNION ALL SELECT replace(source, 'page_', 'doc_'), page, level, heading, para_no FROM ({STYLE_HEADINGS})),
    {_RESOURCE_ROWS},
    by_page AS (SELECT source, page, string_agg(heading, ' | ' ORDER BY n) AS headings FROM (SELECT *, row_number() OVER (PARTITION BY source, page ORDER BY level, heading_no) AS n FROM headings) WHERE n <= 3 GROUP BY ALL),
    by_source AS (SELECT source, string_agg(heading, ' | ' ORDER BY n) AS headings FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY level, heading_no) AS n FROM headings) WHERE n <= 5 GROUP BY ALL)
    SELECT r.query_id, r.rank, r.document, r.page, coalesce(CASE WHEN lower(r.document) LIKE '%.pdf' THEN p.headings WHEN lower(r.document) LIKE '%.docx' THEN s.headings END, '') AS headings
    FROM r LEFT JOIN by_page p ON p.source = r.document AND p.page = r.page LEFT JOIN by_source s ON s.source = r.document""".replace(", words AS", "\n, words AS", 1)))
def text_resources(spark, sf):
    """Headings of documents by font size, and of Word documents that share the pages' numbers by style."""
    hits = vectors.hydrate_hits(text_hits(spark, sf, I.text_queries(spark, sf)), I.text_base(spark, sf)["chunks"])
    pdf = chunks.headings_from_font_size(I.words(spark, sf)).select(
        F.regexp_replace("source", "[.]pdf$", ".PDF").alias("source"), "page", "level", "heading", F.col("first_word").cast("long").alias("heading_no"))
    docx = chunks.headings_from_styles(I.paragraphs(spark, sf)).select(
        F.replace("source", F.lit("page_"), F.lit("doc_")).alias("source"), "page", "level", "heading", F.col("para_no").cast("long").alias("heading_no"))
    return search.text_resources(hits, pdf.unionByName(docx)).withColumn("headings", F.array_join("headings", " | "))


_ROUTED = r"""routed AS (SELECT query_id, regexp_matches(lower(query), 'sheet|worksheet|schema|columns|headers|fields') AS wants_inventory,
    nullif(regexp_extract(query, '([A-Za-z0-9._ ()-]+\.xlsx?)', 1), '') AS book FROM inventory_queries)"""


@register("sheet_intent", sql("", "inventory_queries").rstrip() + f",\n{_ROUTED}\nSELECT query_id, wants_inventory FROM routed")
def sheet_intent(spark, sf):
    return I.inventory_queries(spark, sf).select("query_id", search.sheet_intent(F.col("query")).alias("wants_inventory"))


@register("extract_workbook_name", sql("", "inventory_queries").rstrip() + f",\n{_ROUTED}\nSELECT query_id, book FROM routed")
def extract_workbook_name(spark, sf):
    return I.inventory_queries(spark, sf).select("query_id", search.extract_workbook_name(F.col("query")).alias("book"))


@register("route_inventory", sql("", "inventory_queries", "sheet_catalog").rstrip() + f""",\n{_ROUTED},\n{INVENTORY_BLOCKS}
    SELECT query_id, wants_inventory, CASE WHEN wants_inventory THEN book END AS workbook, report_key, CASE WHEN wants_inventory THEN coalesce(block_no, 0) END AS block_no,
    coalesce(text, report_key || ' — sheets: (none)') AS text FROM (SELECT *, CASE WHEN wants_inventory THEN coalesce(book, '*') END AS report_key FROM routed) q LEFT JOIN blocks USING (report_key)""")
def route_inventory(spark, sf):
    """Every query with the inventory that it asks for, a row for each of its blocks."""
    blocks = catalog.inventory_blocks(I.sheet_catalog(spark, sf), 20)
    return search.inventory_for_queries(I.inventory_queries(spark, sf), blocks)


@register("inventories", sql("", "inventory_queries", "sheet_catalog").rstrip() + f""",\n{_ROUTED},\n{INVENTORY_BLOCKS}
    SELECT report_key, coalesce(block_no, 0) AS block_no, coalesce(text, report_key || ' — sheets: (none)') AS text
    FROM (SELECT DISTINCT coalesce(book, '*') AS report_key FROM routed WHERE wants_inventory) q LEFT JOIN blocks USING (report_key)""")
def inventories(spark, sf):
    """The texts that the keys stand for, each once."""
    return search.inventories(I.inventory_queries(spark, sf), catalog.inventory_blocks(I.sheet_catalog(spark, sf), 20))


@register("retrieve", hits_sql(", " + lookup_steps("turn_queries", 3, _MATCHED, _SAMPLED, _SNIPPETS) + r"""
    SELECT q.query_id, coalesce(h.chunk_ids, '') AS chunk_ids, coalesce(s.structured, '') AS structured,
      CASE WHEN regexp_matches(lower(q.query), 'sheet|worksheet|schema|columns|headers|fields') THEN coalesce(nullif(regexp_extract(q.query, '([A-Za-z0-9._ ()-]+\.xlsx?)', 1), ''), '*') END AS report_key
    FROM turn_queries q LEFT JOIN (SELECT query_id, string_agg(chunk_id, ',' ORDER BY rank) AS chunk_ids FROM hydrated GROUP BY query_id) h USING (query_id) LEFT JOIN snippets s USING (query_id)""", "turn_queries", *STORED))
def retrieve(spark, sf):
    """Hits, snippets and the key of the inventory for every question of a session."""
    s, queries = stored(spark, sf), I.turn_queries(spark, sf)
    hits = vectors.hydrate_hits(text_hits(spark, sf, queries), I.text_base(spark, sf)["chunks"])
    snippets = search.search_context(queries, s["tables"], s["columns"], s["body"], 3)
    both = search.retrieve(hits, snippets, queries)
    ids = F.array_join(F.transform("hits", lambda h: h["chunk_id"]), ",")
    return both.select("query_id", F.coalesce(ids, F.lit("")).alias("chunk_ids"), F.coalesce("structured", F.lit("")).alias("structured"), "report_key")


@register("resources", hits_sql(", " + lookup_steps("text_queries", 6, scope="names_all") + f""", {_RESOURCE_ROWS},
    structured AS (SELECT c.query_id, string_agg(c.rank || ' ' || t.source || ' ' || t.label || ' ' || t.width || 'x' || (t.grid_rows - t.taken), '; ' ORDER BY c.rank) AS structured FROM chosen c JOIN star_tabs t ON t.table_name = c.table_name GROUP BY c.query_id),
    texts AS (SELECT query_id, string_agg(rank || ' ' || document || ' p' || page, '; ' ORDER BY rank) AS texts FROM r GROUP BY query_id)
    SELECT q.query_id, coalesce(structured, '') AS structured, coalesce(texts, '') AS texts FROM text_queries q LEFT JOIN structured USING (query_id) LEFT JOIN texts USING (query_id)""", "text_queries", *STORED))
def resources(spark, sf):
    """Tables and texts that were used for a query, as one row; documents of kinds that have no headings."""
    s, queries = stored(spark, sf), I.text_queries(spark, sf)
    hits = vectors.hydrate_hits(text_hits(spark, sf, queries), I.text_base(spark, sf)["chunks"])
    headings = spark.createDataFrame([], "source string, page int, level int, heading string, heading_no long")
    both = search.resources(queries, search.resources_for_query(queries, s["tables"], s["columns"], s["sheets"], 6), search.text_resources(hits, headings))
    table = lambda x: F.format_string("%d %s %s %dx%d", x["rank"], x["document"], x["sheet"], x["n_cols"], x["n_rows"])
    text = lambda x: F.concat_ws(" ", x["rank"].cast("string"), x["document"], F.concat(F.lit("p"), x["page"].cast("string")))
    return both.select("query_id", F.array_join(F.transform("structured", table), "; ").alias("structured"), F.array_join(F.transform("text", text), "; ").alias("texts"))
