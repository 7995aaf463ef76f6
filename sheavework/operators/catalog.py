"""Catalog tables: upserts, roll-ups, listings, reports and purging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spread import latest_per_key, number_rows, salted_join

# Keys of the catalog tables.
DOCUMENT_KEY = ["source"]
SHEET_KEY = ["source", "sheet"]
COLUMN_KEY = ["source", "sheet", "col_ordinal"]
TABLE_KEY = ["table_name"]
CHUNK_KEY = ["chunk_id"]


def upsert(current: DataFrame, batch: DataFrame, keys: Sequence[str], batch_order: Sequence[Column] = ()) -> DataFrame:
    """Current rows with those of the batch put over them; within the batch the first by ``batch_order`` wins.

    One pass: each task keeps a single row per key before anything is shuffled. Without an order a batch that repeats a key is refused,
    as any of its rows might win.
    """
    if not batch_order and not duplicate_keys(batch, keys).isEmpty():
        raise ValueError(f"the batch repeats a key {list(keys)}; give it an order")
    both = current.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = [F.col("_new").desc(), *batch_order]
    return latest_per_key(both, keys, order).select(*current.columns)


def upsert_documents(current: DataFrame, batch: DataFrame, batch_order: Sequence[Column] = ()) -> DataFrame:
    """By source; ``ingested_at`` becomes now unless the batch brings its own."""
    if "ingested_at" not in batch.columns:
        batch = batch.withColumn("ingested_at", F.current_timestamp())
    return upsert(current, batch, DOCUMENT_KEY, batch_order)


def upsert_sheets(current: DataFrame, batch: DataFrame, batch_order: Sequence[Column] = ()) -> DataFrame:
    return upsert(current, batch, SHEET_KEY, batch_order)


def upsert_columns(current: DataFrame, batch: DataFrame, batch_order: Sequence[Column] = ()) -> DataFrame:
    return upsert(current, batch, COLUMN_KEY, batch_order)


def new_chunks(current: DataFrame, batch: DataFrame, batch_order: Sequence[Column] = ()) -> DataFrame:
    """The rows of the batch to append: the first per chunk id whose id is not stored yet."""
    first = latest_per_key(batch, CHUNK_KEY, list(batch_order) or [F.col("source"), F.col("page")])
    return first.join(current.select("chunk_id"), "chunk_id", "left_anti")


def upsert_chunks(current: DataFrame, batch: DataFrame, batch_order: Sequence[Column] = ()) -> DataFrame:
    """Insert or ignore: the first row that was written under an id stays."""
    return current.unionByName(new_chunks(current, batch, batch_order).select(*current.columns))


def register_tables(current: DataFrame, batch: DataFrame, created_at: Column | None = None, batch_order: Sequence[Column] = ()) -> DataFrame:
    """Put tables into the catalog under their names, created now unless a time is given."""
    stamped = batch.withColumn("created_at", created_at if created_at is not None else F.current_timestamp())
    return upsert(current, stamped, TABLE_KEY, batch_order)


def add_headings(current: DataFrame, batch: DataFrame, spread_by: Sequence[str] = ("page", "heading")) -> DataFrame:
    """Append headings; those of a source that comes again are replaced."""
    again = batch.select("source").distinct()
    return salted_join(current, again, ["source"], spread_by, "left_anti").unionByName(batch.select(*current.columns))


def document_rollup(files: DataFrame, tables: DataFrame) -> DataFrame:
    """(source, kind, bytes, sheet_count, table_count) per file from the registered tables."""
    counts = (
        tables.groupBy("source", "sheet").agg(F.count("*").alias("n"))
        .groupBy("source").agg(F.count("sheet").alias("sheets"), F.sum("n").alias("tables"))
    )
    return files.join(counts, "source", "left").select(
        "source", "kind", "bytes",
        F.coalesce("sheets", F.lit(0)).cast("int").alias("sheet_count"),
        F.coalesce("tables", F.lit(0)).cast("int").alias("table_count"),
    )


def list_documents(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.col("ingested_at").desc(), "source").select(
        "source", "kind", "bytes", "sheet_count", "table_count",
        F.date_format("ingested_at", "yyyy-MM-dd HH:mm").alias("ingested"),
    )


def list_sheets(sheets: DataFrame, source: str | None = None) -> DataFrame:
    wanted = sheets if source is None else sheets.where(F.col("source") == source)
    return wanted.select("source", "sheet", "n_cols", "n_rows").orderBy("source", "sheet")


def sheet_line() -> Column:
    return F.format_string("- %s (%d cols × %d rows)", F.col("sheet"), F.col("n_cols"), F.col("n_rows"))


def source_line() -> Column:
    return F.concat(F.col("source"), F.lit(" — sheets:"))


NO_SHEETS = "(no sheets recorded)"


def sheets_report(sheets: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Lines of the inventory text: (source, line_no, line), a header and one line per sheet.

    The text of a source is its lines in order. ``sources`` asks for certain sources; those without sheets
    have a single "(none)" line. The report stays a table of lines, since one text of everything would
    have to be built in one place.
    """
    if sources is not None:
        asked = sources.select("source").distinct()
        sheets = salted_join(sheets, asked, ["source"], ["sheet"], "left_semi")
        missing = asked.join(sheets.select("source").distinct(), "source", "left_anti").select(
            "source", F.lit(0).alias("part"), F.lit(None).cast("string").alias("sheet"),
            F.concat(F.col("source"), F.lit(" — sheets: (none)")).alias("line"),
        )
    headers = sheets.select("source").distinct().select(
        "source", F.lit(0).alias("part"), F.lit(None).cast("string").alias("sheet"), source_line().alias("line")
    )
    body = sheets.select("source", F.lit(1).alias("part"), "sheet", sheet_line().alias("line"))
    lines = headers.unionByName(body)
    if sources is not None:
        lines = lines.unionByName(missing)
    return lines


def inventory_blocks(sheets: DataFrame, block_lines: int = 500) -> DataFrame:
    """The inventory text in blocks of at most about ``block_lines`` lines: (report_key, block_no, text).

    ``report_key`` is a source, or ``*`` for the report of all sources. Joining the blocks of a key in the
    order of ``block_no`` gives its text; block 0 of a source starts with its header line.
    """
    lines = sheets_report(sheets)
    numbered = number_rows(lines, ["source", "part", "sheet"], "position")
    firsts = numbered.groupBy("source").agg(F.min("position").alias("first"))
    placed = salted_join(numbered, firsts, ["source"], ["position"])
    everything = placed.select(
        F.lit("*").alias("report_key"),
        F.floor(F.col("position") / block_lines).cast("int").alias("block_no"),
        "position",
        # Sources are set apart by an empty line.
        F.when((F.col("part") == 0) & (F.col("position") > 0), F.concat(F.lit("\n"), F.col("line"))).otherwise(F.col("line")).alias("line"),
    )
    single = placed.select(
        F.col("source").alias("report_key"),
        F.floor((F.col("position") - F.col("first")) / block_lines).cast("int").alias("block_no"),
        "position",
        "line",
    )
    ordered = F.array_sort(F.collect_list(F.struct("position", "line")))
    return everything.unionByName(single).groupBy("report_key", "block_no").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text")
    )


def column_label() -> Column:
    """``parent ▸ name``, or the name alone."""
    has_parent = F.coalesce(F.col("parent"), F.lit("")) != ""
    return F.when(has_parent, F.concat(F.col("parent"), F.lit(" ▸ "), F.col("column_name"))).otherwise(F.col("column_name"))


def sheet_schema_report(columns: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(source, sheet, report): a count line and one line per column. A group is the columns of one sheet."""
    lines = F.array_sort(F.collect_list(F.struct("col_ordinal", F.format_string("%2d. %s", F.col("col_ordinal"), column_label()).alias("line"))))
    per_sheet = columns.groupBy("source", "sheet").agg(lines.alias("lines"))
    title = F.concat(F.col("source"), F.lit(" / "), F.col("sheet"), F.lit(": "))
    count_line = F.concat(title, F.size("lines").cast("string"), F.lit(" columns"))
    text = F.array_join(F.concat(F.array(count_line), F.transform("lines", lambda x: x["line"])), "\n")
    if asked is None:
        return per_sheet.select("source", "sheet", text.alias("report"))
    none = F.concat(title, F.lit("(no columns recorded)"))
    return asked.select("source", "sheet").distinct().join(per_sheet, ["source", "sheet"], "left").select(
        "source", "sheet", F.when(F.col("lines").isNull(), none).otherwise(text).alias("report")
    )


def column_display(columns: DataFrame) -> DataFrame:
    """(source, sheet, col_ordinal, display) with the ordinal in two digits."""
    shown = F.format_string("%02d. %s", F.col("col_ordinal"), column_label())
    return columns.select("source", "sheet", "col_ordinal", shown.alias("display")).orderBy("source", "sheet", "col_ordinal")


def distinct_sources(sheets: DataFrame) -> DataFrame:
    return sheets.select("source").distinct().orderBy("source")


def purge(tables: dict[str, DataFrame], sources: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables without the rows of the given sources, or empty. ``name#sheet`` belongs to ``name``."""
    if sources is None:
        return {name: df.where(F.lit(False)) for name, df in tables.items()}
    gone = sources.select(F.col("source").alias("_gone")).distinct()
    out = {}
    for name, df in tables.items():
        owner = df.withColumn("_gone", F.substring_index("source", "#", 1))
        spread = [c for c in df.columns if c != "source" and not df.schema[c].dataType.simpleString().startswith("map")]
        out[name] = salted_join(owner, gone, ["_gone"], spread or ["source"], "left_anti").drop("_gone")
    return out


def purge_vectors(vectors: DataFrame, purged_chunks: DataFrame) -> DataFrame:
    """Vectors whose chunk is still there."""
    return vectors.join(purged_chunks.select("chunk_id"), "chunk_id", "left_semi")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty for a sound catalog table."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
