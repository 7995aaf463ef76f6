"""Keyword search over table names, column names and cells, for a table of queries (query_id, query).

Tokens are matched as substrings. Instead of comparing every token with every text, a text is spread into
its distinct pieces of one to three characters and joined with the tokens on their first (up to) three
characters; the join condition then tests the full token. Every token is matched once, however many
queries hold it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .catalog import NO_SHEETS, column_label
from .rows import first_rows, rows_of_queries
from .spread import BROADCAST_BYTES, first_n, salted_join, settled

GRAM = 3


def tokenize_query(queries: DataFrame) -> DataFrame:
    """(query_id, pos, token), lower case, duplicates kept."""
    return queries.select("query_id", F.posexplode(text.words(F.lower("query"))).alias("pos", "token"))


def distinct_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.select("token").distinct()


def _grams(col: Column, lengths: Iterable[int] = range(1, GRAM + 1)) -> Column:
    """Distinct pieces of the given lengths (and, at the end of the text, some shorter ones).

    A look-ahead yields the pieces that start at each character in one linear walk; shorter ones are
    their beginnings.
    """
    longest = max(lengths)
    starts = F.array_distinct(F.regexp_extract_all(col, F.lit(f"(?s)(?=(.{{1,{longest}}}))"), F.lit(1)))
    shorter = [n for n in sorted(lengths) if n < longest]
    if not shorter:
        return starts
    heads = F.transform(starts, lambda g: F.array(*[F.substring(g, 1, n) for n in shorter], g))
    return F.array_distinct(F.flatten(heads))


def _with_key(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("gram", F.substring("token", 1, GRAM))


def match_names(names: DataFrame, tokens: DataFrame) -> DataFrame:
    """Distinct (table_name, token) where the token occurs in one of the table's ``name`` texts.

    Short tokens may occur in a large share of all names; the names of such a piece are divided by salt.
    """
    spread = names.select("table_name", F.lower("name").alias("name")).distinct()
    pieces = spread.withColumn("gram", F.explode(_grams(F.col("name"))))
    pairs = salted_join(pieces, _with_key(distinct_tokens(tokens)), ["gram"], ["table_name", "name"])
    return pairs.where(F.contains("name", F.col("token"))).select("table_name", "token").distinct()


def table_names(tables: DataFrame, columns: DataFrame, scope: str = "name+columns") -> DataFrame:
    """The texts a table is found by: its name and column names, with ``scope="all"`` source and sheet too."""
    texts = [tables.select("table_name", F.col("table_name").alias("name")), columns.select("table_name", F.col("column_name").alias("name"))]
    if scope == "all":
        texts += [tables.select("table_name", F.col(c).alias("name")) for c in ("source", "sheet")]
    elif scope != "name+columns":
        raise ValueError(f"unknown scope {scope!r}")
    out = texts[0]
    for more in texts[1:]:
        out = out.unionByName(more)
    return out.where(F.col("name").isNotNull())


def score_tables(queries: DataFrame, tables: DataFrame, columns: DataFrame, scope: str = "name+columns") -> DataFrame:
    """(query_id, table_name, score): number of tokens, duplicates counted, found in the table's texts."""
    tokens = tokenize_query(queries)
    counted = tokens.groupBy("query_id", "token").agg(F.count("*").alias("n"))
    matches = match_names(table_names(tables, columns, scope), tokens)
    return (
        salted_join(counted, matches, ["token"], ["query_id"])
        .groupBy("query_id", "table_name")
        .agg(F.sum("n").alias("score"))
    )


def top_k_tables(queries: DataFrame, tables: DataFrame, columns: DataFrame, k: int = 5, scope: str = "name+columns",
                 order: str = "catalog") -> DataFrame:
    """(query_id, rank, table_name) of the first ``k`` tables with a hit.

    In catalog order only the first ``k`` tables of every token can be among the first ``k`` of a query, so
    the matches are cut per token before they meet the queries. ``order="score"`` ranks by score first (``top_k_by_score``).
    """
    placed = tables.select("table_name", "created_at")
    by_catalog = [F.col("created_at"), F.col("table_name")]
    if order == "score":
        return top_k_by_score(queries, tables, columns, k, scope)
    if order != "catalog":
        raise ValueError(f"unknown order {order!r}")
    tokens = tokenize_query(queries)
    matches = match_names(table_names(tables, columns, scope), tokens).join(placed, "table_name")
    cut = first_n(matches, ["token"], by_catalog, k, "_n").drop("_n")
    asked = tokens.select("query_id", "token").distinct()
    found = salted_join(asked, cut, ["token"], ["query_id"]).select("query_id", "table_name", "created_at").distinct()
    return first_n(found, ["query_id"], by_catalog, k).select("query_id", "rank", "table_name")


def _classes(tables: DataFrame, matches: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Tables that hold the same tokens score alike: (class_id, tokens) of each such class, and its first ``k`` tables as
    (class_id, table_name, created_at). No others of it can be among the first ``k`` of any query."""
    held = matches.groupBy("table_name").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    signed = settled(held.withColumn("class_id", F.sha2(F.to_json("tokens"), 256)).join(tables.select("table_name", "created_at"), "table_name"))
    members = first_n(signed.select("class_id", "table_name", "created_at"), ["class_id"], [F.col("created_at"), F.col("table_name")], k, "_n").drop("_n")
    return settled(signed.groupBy("class_id").agg(F.first("tokens").alias("tokens"))), settled(members)


def top_k_by_score(queries: DataFrame, tables: DataFrame, columns: DataFrame, k: int = 5, scope: str = "name+columns", postings: int = 64) -> DataFrame:
    """(query_id, rank, table_name) of the ``k`` tables that hold most tokens of a query, duplicates counted, ties in catalog order.

    A query looks at the classes of tables under its rarest tokens first, up to about ``postings`` times ``k`` of them. A table that holds none of
    these can reach the weight of the other tokens at most; a query whose k-th score is above that bound is done, the others go
    on with sixteen times as many. So a token that most tables hold costs a query nothing while rarer ones decide.
    """
    spark = queries.sparkSession
    tokens = tokenize_query(queries)
    classes, members = _classes(tables, match_names(table_names(tables, columns, scope), tokens), k)
    lists = settled(classes.select("class_id", F.explode("tokens").alias("token")))
    sizes = lists.groupBy("token").agg(F.count("*").alias("size"))
    known = salted_join(tokens.groupBy("query_id", "token").agg(F.count("*").alias("n")), sizes, ["token"], ["query_id"])
    w = Window.partitionBy("query_id").orderBy("size", "token")
    weighed = known.withColumn("reach", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w))
    open_tokens = settled(weighed)
    found, budget = None, postings * k
    while not open_tokens.isEmpty():
        near = (F.col("reach") <= budget) | (F.col("place") == 1)
        bound = open_tokens.groupBy("query_id").agg(
            F.sum(F.when(near, 0).otherwise(F.col("n"))).alias("bound"), F.map_from_entries(F.collect_list(F.struct("token", "n"))).alias("weights")
        )
        met = salted_join(open_tokens.where(near).select("query_id", "token"), lists, ["token"], ["query_id"]).select("query_id", "class_id").distinct()
        scored = salted_join(met, classes, ["class_id"], ["query_id"]).join(bound, "query_id")
        score = F.aggregate("tokens", F.lit(0).cast("long"), lambda total, t: total + F.coalesce(F.element_at(F.col("weights"), t), F.lit(0)))
        scored = scored.select("query_id", "class_id", "bound", score.alias("score"))
        best = first_n(salted_join(scored, members, ["class_id"], ["query_id"]), ["query_id"], [F.col("score").desc(), F.col("created_at"), F.col("table_name")], k)
        best = settled(best.select("query_id", "rank", "table_name", "score", "bound"))
        sure = best.groupBy("query_id").agg(F.max("bound").alias("bound"), F.count("*").alias("c"), F.min("score").alias("least"))
        done = sure.where((F.col("bound") == 0) | ((F.col("c") == k) & (F.col("least") > F.col("bound")))).select("query_id")
        part = best.join(done, "query_id", "left_semi").select("query_id", "rank", "table_name")
        found = part if found is None else found.unionByName(part)
        open_tokens = settled(open_tokens.join(done, "query_id", "left_anti"))
        budget *= 16
    kind = queries.schema["query_id"].dataType.simpleString()
    return found if found is not None else spark.createDataFrame([], f"query_id {kind}, rank int, table_name string")


def _match_patterns(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows with a cell that is LIKE ``%token%``. Cells and patterns meet on the pattern's first literal characters.

    A pattern of wildcards only fits every cell that is long enough, which is then its result.
    """
    cells = rows.select("table_name", "row_no", F.explode("values").alias("v")).where(F.col("v").isNotNull())
    cells = cells.select("table_name", "row_no", F.lower("v").alias("cell"))
    literal = F.regexp_extract("token", "([^%_]+)", 1)
    patterns = wanted.select("table_name", "token").distinct().withColumn("gram", F.substring(literal, 1, GRAM))
    like = F.expr("cell LIKE concat('%', token, '%') ESCAPE '\\u0001'")
    pieces = cells.withColumn("gram", F.explode(_grams(F.col("cell"))))
    met = salted_join(pieces, patterns.where("gram <> ''"), ["table_name", "gram"], ["row_no"]).where(like)
    open_ended = patterns.where("gram = ''").withColumn("least", F.char_length(F.replace("token", F.lit("%"), F.lit("")))).drop("gram")
    fit = salted_join(cells, open_ended, ["table_name"], ["row_no"]).where(F.char_length("cell") >= F.col("least"))
    columns = ["table_name", "row_no", "token"]
    return met.select(*columns).unionByName(fit.select(*columns)).distinct()


def _asked(queries: DataFrame, chosen: DataFrame) -> DataFrame:
    """(query_id, table_name, token), distinct."""
    tokens = tokenize_query(queries).select("query_id", "token").distinct()
    return tokens.join(chosen.select("query_id", "table_name"), "query_id")


def match_rows(queries: DataFrame, chosen: DataFrame, rows: DataFrame, wildcards: bool = False, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, table_name, row_no) of all rows of the chosen tables with a cell that holds a token of the query.

    The rows are read once for every ``limit`` bytes of wanted tokens, in place. With ``wildcards`` the characters
    ``%`` and ``_`` of a token act as in LIKE, and pieces of cells are joined with the patterns instead.
    """
    asked = _asked(queries, chosen)
    if not wildcards:
        return rows_of_queries(rows, asked, limit)
    joined = salted_join(_match_patterns(rows, asked.select("table_name", "token")), asked, ["table_name", "token"], ["row_no"])
    return joined.select("query_id", "table_name", "row_no").distinct()


def sample_rows(queries: DataFrame, chosen: DataFrame, rows: DataFrame, n: int = 3, wildcards: bool = False, limit: int = BROADCAST_BYTES) -> DataFrame:
    """First ``n`` matching rows per query and chosen table, or the table's first ``n`` rows if none matches.

    The first ``n`` rows of a query are among the first ``n`` rows of each of its tokens and those of the table. One scan
    finds them, with their values, and only they are shuffled.
    """
    # Read several times below; small beside the rows.
    asked = settled(_asked(queries, chosen))
    wanted = asked.select("table_name", "token").distinct()
    if wildcards:
        per_token = settled(first_n(_match_patterns(rows, wanted), ["table_name", "token"], [F.col("row_no")], n, "_n").drop("_n"))
        needed = per_token.select("table_name", "row_no").unionByName(rows.where(F.col("row_no") < n).select("table_name", "row_no")).distinct()
        found = settled(rows.join(needed, ["table_name", "row_no"], "left_semi").select("table_name", "row_no", "values"))
    else:
        # Dealt out, so that not every task of the scan, with each part of what is wanted, stores a file of a few rows.
        found = settled(first_rows(rows, wanted, n, limit).repartition("table_name", "row_no"))
        each = found.select("table_name", "row_no", F.explode("tokens").alias("token"))
        per_token = first_n(each, ["table_name", "token"], [F.col("row_no")], n, "_n").drop("_n")
    matched = (
        salted_join(asked, per_token, ["table_name", "token"], ["query_id"])
        .select("query_id", "table_name", "row_no").distinct()
    )
    best = settled(first_n(matched, ["query_id", "table_name"], [F.col("row_no")], n).drop("rank"))
    pairs = chosen.select("query_id", "table_name")
    rest = pairs.join(best.select("query_id", "table_name").distinct(), ["query_id", "table_name"], "left_anti")
    values = found.select("table_name", "row_no", "values").dropDuplicates(["table_name", "row_no"])
    head = values.where(F.col("row_no") < n).select("table_name", "row_no")
    fallback = salted_join(rest, head, ["table_name"], ["query_id"])
    picked = best.withColumn("matched", F.lit(True)).unionByName(fallback.withColumn("matched", F.lit(False)))
    return salted_join(picked, values, ["table_name", "row_no"], ["query_id"]).select(
        "query_id", "table_name", "row_no", "matched", "values"
    )


def column_lists(columns: DataFrame, limit: int, label: Column | None = None) -> DataFrame:
    """First ``limit`` column names (or labels) per table, and the number of columns."""
    shown = F.col("column_name") if label is None else label
    entry = F.when(F.col("col_ordinal") <= limit, F.struct(F.col("col_ordinal"), shown.alias("name")))
    listed = columns.groupBy("table_name").agg(F.array_sort(F.collect_list(entry)).alias("c"), F.count("*").alias("n_columns"))
    return listed.select("table_name", F.transform("c", lambda x: x["name"]).alias("columns"), "n_columns")


def render_snippets(chosen: DataFrame, samples: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(query_id, structured): per table a header line and the sample rows, tables set apart by a blank line."""
    lists = column_lists(columns, 10)
    page = F.when(F.col("page") > 0, F.concat(F.lit(" p"), F.col("page").cast("string"))).otherwise("")
    header = F.concat(
        F.col("table_name"), F.lit(" (cols: "), F.array_join("columns", ", "), F.lit(") from "), F.col("source"), page
    )
    headers = tables.join(lists, "table_name").select("table_name", header.alias("header"))
    line = F.array_join(F.transform("values", lambda v: F.coalesce(v, F.lit(""))), "\t")
    sampled = samples.groupBy("query_id", "table_name").agg(
        F.array_sort(F.collect_list(F.struct("row_no", line.alias("line")))).alias("rows")
    )
    blocks = salted_join(chosen, headers, ["table_name"], ["query_id"]).join(sampled, ["query_id", "table_name"], "left")
    lines = F.transform(F.coalesce("rows", F.array().cast("array<struct<row_no:bigint,line:string>>")), lambda r: r["line"])
    block = F.array_join(F.concat(F.array("header"), lines), "\n")
    texts = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    return texts.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("structured"))


def search_context(queries: DataFrame, tables: DataFrame, columns: DataFrame, rows: DataFrame, k: int = 5, n: int = 3) -> DataFrame:
    """Snippets of the first ``k`` matching tables per query, with ``n`` sample rows each."""
    # Several joins read the choice, which is small: k rows per query.
    chosen = settled(top_k_tables(queries, tables, columns, k))
    return render_snippets(chosen, sample_rows(queries, chosen, rows, n), tables, columns)


def resources_for_query(queries: DataFrame, tables: DataFrame, columns: DataFrame, sheets: DataFrame, k: int = 5,
                        labels: int = 50) -> DataFrame:
    """(query_id, rank, document, sheet, table, n_cols, n_rows, columns) of the first ``k`` matching tables."""
    chosen = top_k_tables(queries, tables, columns, k, scope="all")
    known = (
        tables.join(sheets.select("source", "sheet", "n_cols", "n_rows"), ["source", "sheet"], "left")
        .join(column_lists(columns, labels, column_label()), "table_name", "left")
        .select(
            "table_name",
            F.col("source").alias("document"),
            "sheet",
            F.col("table_name").alias("table"),
            F.coalesce(F.nullif("n_cols", F.lit(0)), F.coalesce("n_columns", F.lit(0)).cast("int")).alias("n_cols"),
            F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
            F.coalesce("columns", F.array().cast("array<string>")).alias("columns"),
        )
    )
    return salted_join(chosen, known, ["table_name"], ["query_id"]).drop("table_name")


def text_resources(hits: DataFrame, headings: DataFrame, first_hits: int = 6, pdf_headings: int = 3, docx_headings: int = 5) -> DataFrame:
    """(query_id, rank, document, page, headings) for the first hits of every query.

    A pdf shows the first headings of the hit's page, a Word document those of the whole document, by level
    and then in the order of ``heading_no``.
    """
    document = F.substring_index("source", "#", 1)
    # Three branches read the hits, which are few per query.
    top = settled(hits.where(F.col("rank") <= first_hits).select("query_id", "rank", document.alias("document"), "page"))
    suffix = F.lower("document")
    order = [F.col("level"), F.col("heading_no")]

    def lists(kept: DataFrame, keys: list[str]) -> DataFrame:
        found = F.array_sort(F.collect_list(F.struct("_n", "heading")))
        return kept.groupBy(*keys).agg(F.transform(found, lambda h: h["heading"]).alias("headings"))

    by_page = lists(first_n(headings, ["source", "page"], order, pdf_headings, "_n"), ["source", "page"])
    by_source = lists(first_n(headings, ["source"], order, docx_headings, "_n"), ["source"])
    pdf = top.where(suffix.endswith(".pdf")).withColumn("look_at", F.coalesce(F.nullif("page", F.lit(0)), F.lit(1)))
    pdf = salted_join(pdf, by_page.withColumnsRenamed({"source": "document", "page": "look_at"}), ["document", "look_at"], ["query_id", "rank"], "left")
    docx = top.where(suffix.endswith(".docx"))
    docx = salted_join(docx, by_source.withColumnRenamed("source", "document"), ["document"], ["query_id", "rank"], "left")
    other = top.where(~suffix.endswith(".pdf") & ~suffix.endswith(".docx")).withColumn("headings", F.lit(None).cast("array<string>"))
    columns = ["query_id", "rank", "document", "page", F.coalesce("headings", F.array().cast("array<string>")).alias("headings")]
    return pdf.select(*columns).unionByName(docx.select(*columns)).unionByName(other.select(*columns))


def resources(queries: DataFrame, structured: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, structured, text): the tables of ``resources_for_query`` and the texts of ``text_resources`` as two lists in rank order, a row for
    each query, also where nothing was found."""

    def listed(found: DataFrame, name: str) -> DataFrame:
        entry = F.struct("rank", *[c for c in found.columns if c not in ("query_id", "rank")])
        return found.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias(name))

    both = queries.select("query_id").join(listed(structured, "structured"), "query_id", "left").join(listed(texts, "text"), "query_id", "left")
    return both.select("query_id", *[F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c) for c in ("structured", "text")])


# Words that ask for the sheet inventory, and the form of a workbook name in a query.
INVENTORY_WORDS = "sheet|worksheet|schema|columns|headers|fields"
WORKBOOK_PATTERN = r"([A-Za-z0-9._ ()-]+\.xlsx?)"


def sheet_intent(query: Column) -> Column:
    return F.lower(query).rlike(INVENTORY_WORDS)


def extract_workbook_name(query: Column) -> Column:
    return F.nullif(F.regexp_extract(query, WORKBOOK_PATTERN, 1), F.lit(""))


def route_inventory(queries: DataFrame) -> DataFrame:
    """(query_id, wants_inventory, workbook, report_key): which inventory a query asks for, ``*`` being all."""
    wants, book = sheet_intent(F.col("query")), extract_workbook_name(F.col("query"))
    key = F.when(wants, F.coalesce(book, F.lit("*")))
    return queries.select("query_id", wants.alias("wants_inventory"), F.when(wants, book).alias("workbook"), key.alias("report_key"))


INVENTORY_TITLE = "Sheet inventory:"


def inventories(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """(report_key, block_no, text): each inventory that some query asks for, once, in blocks; queries name it by ``report_key`` of
    ``route_inventory``.

    A workbook without sheets has one "(none)" block, and with an empty catalog the report of all is one fixed line.
    """
    asked = route_inventory(queries).where("report_key is not null").select("report_key").distinct()
    # Few keys with many blocks: the blocks of one are divided by salt.
    held = salted_join(blocks, asked, ["report_key"], ["block_no"]).select("report_key", "block_no", "text")
    missing = asked.join(blocks.select("report_key").distinct(), "report_key", "left_anti")
    none = F.when(F.col("report_key") == "*", F.lit(NO_SHEETS)).otherwise(F.concat(F.col("report_key"), F.lit(" — sheets: (none)")))
    return held.unionByName(missing.select("report_key", F.lit(0).alias("block_no"), none.alias("text")))


def inventory_for_queries(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, wants_inventory, workbook, report_key, block_no, text): ``route_inventory`` with the blocks of each query's inventory, a row
    for each; queries that ask for none have one row without a block."""
    # Read by both sides of the join; a row per query.
    routed = settled(queries.select("query_id", "query"))
    texts = inventories(routed, blocks)
    return salted_join(route_inventory(routed), texts, ["report_key"], ["query_id"], "left").select(
        "query_id", "wants_inventory", "workbook", "report_key", "block_no", "text"
    )


def retrieve(hits: DataFrame, snippets: DataFrame, queries: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(query_id, hits, structured): text hits in rank order and table snippets of every query that has any.

    With ``queries`` every query has a row, and ``report_key`` names the inventory that belongs to its structured part; with
    ``found`` (``resources``) also the tables and texts that were used, as ``resources``.
    """
    entry = F.struct("rank", "chunk_id", "source", "page", "text", "score")
    text_hits = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("hits"))
    both = text_hits.join(snippets, "query_id", "full_outer").select("query_id", "hits", "structured")
    if queries is not None:
        both = route_inventory(queries).select("query_id", "report_key").join(both, "query_id", "left")
    if found is not None:
        both = both.join(found.select("query_id", F.struct("structured", "text").alias("resources")), "query_id", "left")
    return both
