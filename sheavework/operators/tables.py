"""Cell grids to all-text tables with a catalog of sheets and columns.

Input ``cells(source, kind, sheet, page, table_no, row_no, col_no, value)``, one row per cell, ``row_no``
and ``col_no`` from 0. A table is known by (source, label). Rows keep their values as an array; column
names live in the column catalog only, so that any header is allowed and rows stay narrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import names, text
from .spread import first_n, fits_broadcast, measured_join, salted_join, settled

KEY = ["source", "label"]
GRID = ["kind", "source", "sheet", "page", "table_no"]
ROW = [*KEY, "kind", "page", "table_no", "table_name", "row_no", "values"]

# Share of unnamed headers from which a header is rebuilt, and the name of the only
# column of a table without columns.
UNNAMED_SHARE = 0.6
EMPTY_COLUMN = "_empty"


def name_tables(grids: DataFrame) -> DataFrame:
    """Add ``label`` (sheet label) and ``table_name`` from kind, source, sheet, page and table number."""
    kind, source, sheet, page, table_no = (F.col(c) for c in GRID)
    return grids.withColumn("label", names.sheet_label(kind, sheet, page, table_no)).withColumn(
        "table_name", names.table_name_for(kind, source, sheet, page, table_no)
    )


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Where a value differs from the one before; nulls are alike. The first place counts as a change."""
    codes = column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.append(True, codes[1:] != codes[:-1])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells that follow each other in a row as one piece of it, so that a row travels with few copies of its key."""
    for batch in batches:
        if batch.num_rows:
            cells = pa.Table.from_batches([batch])
            starts = np.flatnonzero(np.logical_or.reduce([_changes(cells.column(c)) for c in [*GRID, "row_no"]]))
            offsets = pa.array(np.append(starts, batch.num_rows), pa.int32())
            keys = batch.select([*GRID, "row_no"]).take(pa.array(starts))
            lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("col_no", "value")]
            yield pa.RecordBatch.from_arrays([*keys.columns, *lists], names=[*GRID, "row_no", "col_nos", "cells"])


def _gather(batches: Iterator[pa.RecordBatch], from_first: bool = False) -> Iterator[pa.RecordBatch]:
    """Pieces, sorted by row, to rows. The last row of a batch waits for the next one.

    With ``from_first`` values begin at the lowest column that a row has here, and ``first`` tells which it is.
    """
    carry = None

    def solved(pieces: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        sizes = pieces.column("col_nos").combine_chunks().value_lengths().to_numpy()
        place = pieces.column("col_nos").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        values = pieces.column("cells").combine_chunks().flatten()
        cells = np.add.reduceat(sizes, starts)  # of each row; a piece has one at least
        firsts = np.cumsum(cells) - cells
        low = np.minimum.reduceat(place, firsts) if from_first else np.zeros(len(firsts), np.int64)
        offsets = np.append(0, np.cumsum(np.maximum.reduceat(place, firsts) + 1 - low))
        place += np.repeat(offsets[:-1] - low, cells)
        source = np.full(offsets[-1], -1)
        if np.bincount(place, minlength=offsets[-1]).max() > 1:  # the last by value stays
            at = pa.table({"place": place, "value": values})
            order = pc.sort_indices(at, [("place", "ascending"), ("value", "ascending")], null_placement="at_start").to_numpy()
            source[place[order]] = order
        else:
            source[place] = np.arange(len(place))
        values = values.take(pa.array(source, mask=source < 0))
        rows = pieces.select([*GRID, "row_no"]).take(pa.array(starts)).combine_chunks().to_batches()[0]
        made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        if from_first:
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(low, pa.int32()), made], names=[*GRID, "row_no", "first", "values"])
        return pa.RecordBatch.from_arrays([*rows.columns, made], names=[*GRID, "row_no", "values"])

    for batch in batches:
        if not batch.num_rows:
            continue
        pieces = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
        starts = np.flatnonzero(np.logical_or.reduce([_changes(pieces.column(c)) for c in [*GRID, "row_no"]]))
        carry = pieces.slice(starts[-1])
        if len(starts) > 1:
            yield solved(pieces.slice(0, starts[-1]), starts[:-1])
    if carry is not None:
        yield solved(carry, np.zeros(1, np.int64))


def cells_to_rows(cells: DataFrame, laid_out: bool = False) -> DataFrame:
    """Grid rows (source, label, kind, page, table_no, table_name, row_no, values). A group is one grid row.

    Cells that follow each other in a row are put together where they are read; these pieces are dealt out and sorted by row, and rows are
    cut out of the sorted stream. Cells that a row lacks are null, of cells that share a place the last by value stays. With
    ``laid_out`` the rows come in ranges of grid and row number, which reads the cells once more to find the ranges.
    Names are made per row, after the cells have been gathered.
    """
    chosen = cells.select(*GRID, "row_no", "col_no", "value")
    lists = [StructField("col_nos", ArrayType(chosen.schema["col_no"].dataType)), StructField("cells", ArrayType(StringType()))]
    return _rows_of(chosen.mapInArrow(_pieces, StructType([*_key_fields(chosen), *lists])), laid_out)


def _key_fields(df: DataFrame) -> list[StructField]:
    return [StructField(c, df.schema[c].dataType) for c in (*GRID, "row_no")]


def _rows_of(pieces: DataFrame, laid_out: bool = False) -> DataFrame:
    dealt = pieces.repartitionByRange(*GRID, "row_no") if laid_out else pieces.repartition(*GRID, "row_no")
    rows = dealt.sortWithinPartitions(*GRID, "row_no").mapInArrow(_gather, StructType([*_key_fields(pieces), StructField("values", ArrayType(StringType()))]))
    return name_tables(rows).select(*ROW)


def stored_rows(cells: DataFrame, path: str) -> DataFrame:
    """The rows of ``cells_to_rows``, stored below ``path``. ``cells`` are read once.

    Cells that follow each other in a task are put together and written where they are read. A row whose cells all came so is whole; only
    the hashes of the rows are shuffled to see which are not, and only those are gathered from their pieces. A few of them, such as headers
    that come cell by cell, are left out of the whole rows where these are read; with many, all rows are written once more.
    """
    spark = cells.sparkSession
    chosen = cells.select(*GRID, "row_no", "col_no", "value")
    schema = StructType([*_key_fields(chosen), StructField("first", IntegerType()), StructField("values", ArrayType(StringType()))])
    made = name_tables(chosen.mapInArrow(lambda batches: _gather(_pieces(batches), from_first=True), schema))
    made.withColumn("_row", F.xxhash64(*GRID, "row_no")).write.parquet(f"{path}/pieces")
    pieces = spark.read.parquet(f"{path}/pieces")
    torn = settled(pieces.groupBy("_row").agg(F.count("*").alias("n")).where("n > 1").select("_row"))
    values = F.when(F.col("first") == 0, F.col("values")).otherwise(F.concat(F.array_repeat(F.lit(None).cast("string"), F.col("first")), F.col("values")))
    if torn.isEmpty():
        return pieces.withColumn("values", values).select(*ROW)
    whole = measured_join(pieces, torn, ["_row"], ["row_no"], "left_anti").withColumn("values", values).select(*ROW)
    places = F.transform("values", lambda v, i: F.col("first") + i)
    rest = measured_join(pieces, torn, ["_row"], ["row_no"], "left_semi").select(*GRID, "row_no", places.alias("col_nos"), F.col("values").alias("cells"))
    if fits_broadcast(torn):
        _rows_of(rest).write.parquet(f"{path}/rest")
        return whole.unionByName(spark.read.parquet(f"{path}/rest"))
    whole.unionByName(_rows_of(rest)).write.parquet(f"{path}/rows")
    return spark.read.parquet(f"{path}/rows")


def has_header(rows: DataFrame) -> DataFrame:
    """Per table: is every cell of grid row 0 filled?"""
    filled = F.forall("values", lambda v: v.isNotNull() & text.not_blank(v))
    return rows.where(F.col("row_no") == 0).select(*KEY, "table_name", filled.alias("has_header"))


def header_info(rows: DataFrame, hierarchy_kinds: tuple[str, ...] = (), two_row_sheets: DataFrame | None = None) -> DataFrame:
    """One row per table: final column names, parents and how many grid rows the header takes.

    Only grid rows 0 to 2 are read. A pdf grid has a header if row 0 is filled, every other kind always
    has one; a missing spreadsheet or csv header is ``Unnamed: i``, a grid without header is numbered. If at
    least 60 % of the names start with "unnamed" (or have the ``_c<i>`` form of Spark's csv reader) they are
    rebuilt from the two rows below, which then leave the data. For the sheets listed in ``two_row_sheets``
    (source, label), and for all of the ``hierarchy_kinds``, the first two grid rows are parent and name.
    """
    top = (
        rows.where(F.col("row_no") <= 2)
        .groupBy(*KEY, "kind", "table_no", "table_name", "page")
        .agg(*[F.max(F.when(F.col("row_no") == i, F.col("values"))).alias(f"row{i}") for i in range(3)])
    )
    filled = F.coalesce(F.forall("row0", lambda v: v.isNotNull() & text.not_blank(v)), F.lit(False))
    top = top.withColumn("has_header", (F.col("kind") != "pdf") | filled)
    width = F.greatest(*[F.coalesce(F.size(F.col(f"row{i}")), F.lit(0)) for i in range(3)])
    top = top.withColumn("width", width)
    two_rows = F.col("kind").isin(*hierarchy_kinds) if hierarchy_kinds else F.lit(False)
    if two_row_sheets is not None:
        # One row per table on both sides.
        listed = two_row_sheets.select(*KEY).distinct().withColumn("_listed", F.lit(True))
        top = top.join(listed, KEY, "left")
        two_rows = two_rows | F.coalesce("_listed", F.lit(False))
    top = top.withColumn("two_rows", two_rows)

    def cell(row: Column, i: Column) -> Column:
        return F.coalesce(F.get(row, i), F.lit(""))

    def read_name(i: Column) -> Column:
        given = F.get(F.col("row0"), i)
        spreadsheet = F.col("kind").isin("csv", "xlsx", "xls") & (F.coalesce(given, F.lit("")) == "")
        return (
            F.when(~F.col("has_header"), i.cast("string"))
            .when(spreadsheet, F.concat(F.lit("Unnamed: "), i.cast("string")))
            .otherwise(F.coalesce(given, F.lit("_col")))
        )

    def picked(below: Column, above: Column, old: Column, i: Column) -> Column:
        empty = F.lit("")
        name = text.strip(F.coalesce(F.nullif(below, empty), F.nullif(above, empty), old))
        return F.when(name == "", F.concat(F.lit("col_"), (i + 1).cast("string"))).otherwise(name)

    index = F.when(F.col("width") > 0, F.sequence(F.lit(0), F.col("width") - 1)).otherwise(F.array().cast("array<int>"))
    top = top.withColumn("index", index).withColumn("read_names", F.transform("index", read_name))
    unnamed = F.size(F.filter("read_names", lambda n: F.lower(n).startswith("unnamed") | n.rlike(r"^_c\d+$")))
    repaired = (F.col("width") > 0) & (unnamed / F.greatest(F.col("width"), F.lit(1)) >= UNNAMED_SHARE) & ~F.col("two_rows")
    top = top.withColumn("repaired", repaired)

    first, second = F.when(F.col("has_header"), F.col("row1")).otherwise(F.col("row0")), F.when(
        F.col("has_header"), F.col("row2")).otherwise(F.col("row1"))
    top = top.withColumn("below1", first).withColumn("below2", second)
    rebuilt = F.transform("index", lambda i: picked(cell(F.col("below2"), i), cell(F.col("below1"), i), F.get(F.col("read_names"), i), i))
    nested = F.transform("index", lambda i: picked(cell(F.col("row1"), i), cell(F.col("row0"), i), F.lit(""), i))
    parents = F.transform("index", lambda i: F.nullif(text.strip(cell(F.col("row0"), i)), F.lit("")))
    no_parents = F.transform("index", lambda i: F.lit(None).cast("string"))
    names_col = F.when(F.col("two_rows"), nested).when(F.col("repaired"), rebuilt).otherwise(F.col("read_names"))
    taken = (
        F.when(F.col("two_rows"), F.lit(2))
        .otherwise(F.col("has_header").cast("int"))
        + F.when(F.col("repaired"), F.when(F.col("below1").isNull(), 0).when(F.col("below2").isNull(), 1).otherwise(2)).otherwise(0)
    )
    return top.select(
        *KEY, "kind", "table_no", "table_name", "page", "has_header", "repaired", "width", "read_names",
        names_col.alias("names"), F.when(F.col("two_rows"), parents).otherwise(no_parents).alias("parents"),
        F.col("has_header").cast("int").alias("header_rows"), taken.cast("int").alias("taken_rows"),
    )


def header_hierarchy(rows: DataFrame) -> DataFrame:
    """Column name and parent from the first two grid rows: (source, label, ordinal, column_name, parent)."""
    return column_catalog(header_info(rows, ("csv", "xlsx", "xls", "docx", "pdf")))


def body_rows(rows: DataFrame, headers: DataFrame, join: Callable[..., DataFrame] = salted_join) -> DataFrame:
    """Data rows under the header, numbered from 0. A dominant table is spread by its row numbers.

    With ``measured_join`` as ``join`` the rows stay where they are as long as the headers, which should be settled, fit a broadcast.
    """
    taken = headers.select(*KEY, "taken_rows")
    return (
        join(rows, taken, KEY, ["row_no"])
        .where(F.col("row_no") >= F.col("taken_rows"))
        .select(*KEY, "table_name", (F.col("row_no") - F.col("taken_rows")).cast("long").alias("row_no"), "values")
    )


def drop_empty_tables(grids: DataFrame, rows: DataFrame) -> DataFrame:
    """The grids that are tables: those with rows, and without rows all but Word and pdf grids, as (kind, source, sheet, page,
    table_no, label, table_name, n_rows). ``grids`` lists every grid that was met, also those without a cell."""
    filled = rows.groupBy(*KEY).agg(F.count("*").alias("n_rows"))
    named = name_tables(grids.select(*GRID).distinct()).join(filled, KEY, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return named.where((F.col("n_rows") > 0) | ~F.col("kind").isin("docx", "pdf")).select(*GRID, "label", "table_name", "n_rows")


def empty_headers(listed: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows like those of ``header_info`` for the tables of ``drop_empty_tables`` that have no rows: no column, no name."""
    none, names_type = F.lit(0), "array<string>"
    columns = {"has_header": F.lit(True), "repaired": F.lit(False), "width": none, "read_names": F.array().cast(names_type),
               "names": F.array().cast(names_type), "parents": F.array().cast(names_type), "header_rows": none, "taken_rows": none}
    return listed.where("n_rows = 0").withColumns(columns).select(*headers.columns)


def sheet_stats(headers: DataFrame, body: DataFrame) -> DataFrame:
    """(source, sheet, n_cols, n_rows, raw_n_rows): rows after and before header repair."""
    counts = body.groupBy(*KEY).agg(F.count("*").alias("n_rows"))
    n = F.coalesce(F.col("n_rows"), F.lit(0)).cast("int")
    return headers.join(counts, KEY, "left").select(
        "source",
        F.col("label").alias("sheet"),
        F.col("width").alias("n_cols"),
        n.alias("n_rows"),
        (n + F.col("taken_rows") - F.col("header_rows")).cast("int").alias("raw_n_rows"),
    )


def column_catalog(headers: DataFrame) -> DataFrame:
    """(table_name, source, sheet, col_ordinal from 1, column_name, parent); ``_empty`` for no columns."""
    named = F.arrays_zip(F.col("names"), F.col("parents"))
    sentinel = F.array(F.struct(F.lit(EMPTY_COLUMN).alias("names"), F.lit(None).cast("string").alias("parents")))
    return headers.select(
        "table_name",
        "source",
        F.col("label").alias("sheet"),
        F.posexplode(F.when(F.col("width") > 0, named).otherwise(sentinel)).alias("i", "c"),
    ).select(
        "table_name",
        "source",
        "sheet",
        (F.col("i") + 1).alias("col_ordinal"),
        F.col("c.names").alias("column_name"),
        F.col("c.parents").alias("parent"),
    )


def table_info(columns: DataFrame, table_name: str) -> DataFrame:
    return columns.where(F.col("table_name") == table_name).select("col_ordinal", "column_name").orderBy("col_ordinal")


def all_text(df: DataFrame) -> DataFrame:
    return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


# The texts that count as each type, tried in this order.
TYPE_PATTERNS = [
    ("BOOLEAN", r"^(?i:true|false)$"),
    ("INTEGER", r"^[+-]?[0-9]+$"),
    ("DOUBLE", r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"),
    ("DATE", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
]


def infer_column_types(body: DataFrame) -> DataFrame:
    """The narrowest type that all non-empty values of a column fit: (source, label, col_ordinal, type)."""
    value = F.col("value")
    cells = body.select(*KEY, F.posexplode("values").alias("i", "value")).where(F.coalesce(value, F.lit("")) != "")
    fits = cells.groupBy(*KEY, (F.col("i") + 1).alias("col_ordinal")).agg(
        *[F.bool_and(value.rlike(pattern)).alias(name) for name, pattern in TYPE_PATTERNS]
    )
    inferred = F.lit("VARCHAR")
    for name, _ in reversed(TYPE_PATTERNS):
        inferred = F.when(F.col(name), F.lit(name)).otherwise(inferred)
    return fits.select(*KEY, "col_ordinal", inferred.alias("type"))


def first_sheets(headers: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` sheets per source, by their position in the workbook."""
    return first_n(headers, ["source"], [F.col("table_no"), F.col("label")], n, "sheet_rank")


def head_as_csv_text(rows: DataFrame, headers: DataFrame, csv_rows: int = 50, sheet_rows: int = 30, sheets: int = 3) -> DataFrame:
    """Header and first rows of a table as CSV text: 50 rows of a csv file, 30 of each of the first 3 sheets.

    The text shows the table as it was read, before header repair.
    """
    chosen = first_sheets(headers.where(F.col("kind").isin("csv", "xlsx", "xls")), sheets)
    last = F.col("header_rows") + F.when(F.col("kind") == "csv", csv_rows).otherwise(sheet_rows)
    top = chosen.select(*KEY, "kind", "table_name", "read_names", "header_rows", last.alias("row_limit"))
    bound = max(csv_rows, sheet_rows)
    wanted = rows.where(F.col("row_no") <= bound).select(*KEY, "row_no", text.csv_line(F.col("values")).alias("line"))
    shown = (F.col("row_no") >= F.col("header_rows")) & (F.col("row_no") < F.col("row_limit"))
    lines = (
        top.join(wanted, KEY, "left")
        .groupBy(*KEY, "kind", "table_name", "read_names")
        .agg(F.array_sort(F.collect_list(F.when(shown, F.struct("row_no", "line")))).alias("rows"))
    )
    all_lines = F.concat(F.array(text.csv_line(F.col("read_names"))), F.transform("rows", lambda r: r["line"]))
    return lines.select(*KEY, "kind", "table_name", F.concat(F.array_join(all_lines, "\n"), F.lit("\n")).alias("text"))


def wide_view(rows: DataFrame, columns: DataFrame, table_name: str) -> DataFrame:
    """One stored table with its own column names. Reads the table's catalog entry, one row per column."""
    names_found = [r["column_name"] for r in table_info(columns, table_name).collect()]
    seen: dict[str, int] = {}
    labels = []
    for name in names_found:
        count = seen.get(name.lower(), 0)
        seen[name.lower()] = count + 1
        labels.append(name if count == 0 else f"{name}_{count + 1}")
    return rows.where(F.col("table_name") == table_name).select(
        *[F.get("values", F.lit(i)).alias(label) for i, label in enumerate(labels)]
    )
