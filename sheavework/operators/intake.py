"""Ingest: what was decoded from files becomes stored chunks with vectors, table rows, catalogs and headings.

    store = Store(spark, path)
    report = store.ingest(Decoded(files=files, pages=pages, cells=cells), run_no=0, dim=1024, scorer=load_my_model)
    hits = knn_exact(store.vectors(), queries, dim=1024)

A run is one write of all outputs, tagged and partitioned by output, below ``<root>/run=<r>``. What it wrote is counted while it is
written. Runs never change each other's files: readers take, of what several runs hold, the chunk that came first and the
table, headings and document that came last. A run that fails is repeated under its number and overwrites its own folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import AbstractContextManager
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from ..session import scratch_path, setting
from . import chunks, tables, vectors
from .catalog import document_rollup, new_chunks
from .spread import latest_per_key, measured_join, salted_join, settled

OUTPUTS = {
    "chunks": "chunk_id string, source string, page int, chunk_no int, chars int, preview string, text string, embedding array<float>, error string",
    "rows": "table_name string, source string, label string, row_no bigint, values array<string>",
    "tables": "table_name string, source string, page int, sheet string, created_at timestamp",
    "sheets": "table_name string, source string, sheet string, n_cols int, n_rows int, raw_n_rows int",
    "columns": "table_name string, source string, sheet string, col_ordinal int, column_name string, parent string",
    "headings": "source string, page int, level int, heading string, heading_no bigint",
    "documents": "source string, kind string, bytes bigint, sheet_count int, table_count int, ingested_at timestamp",
}


@dataclass(frozen=True)
class Decoded:
    """Tables of what was decoded; those that are None are left out.

    ``files`` (source, kind, bytes) lists every file. ``pages`` (source, kind, page, text) are page texts of pdf files and whole texts of
    others, ``paragraphs`` (source, para_no, style, text) those of Word files, ``words`` (source, page, word_no, top, size, text) those of
    pdf pages. ``cells`` are grids as in ``tables``; ``grids`` (kind, source, sheet, page, table_no) also lists grids without a cell, and
    ``two_row_sheets`` (source, label) those whose header has a row of groups above the names.
    """

    files: DataFrame
    pages: DataFrame | None = None
    paragraphs: DataFrame | None = None
    words: DataFrame | None = None
    cells: DataFrame | None = None
    grids: DataFrame | None = None
    two_row_sheets: DataFrame | None = None


def _one_writer_per_output(spark: SparkSession) -> AbstractContextManager:
    """A task holds a file open per output it meets; otherwise all rows would be sorted by output before they are written."""
    return setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(len(OUTPUTS)))


def _digests(df: DataFrame, keys: Sequence[str], of: Sequence[str | Column]) -> DataFrame:
    """Number of rows, their hashes' bits and sums of the hashes' parts per key, whatever the order of the rows."""
    seen = df.withColumn("_h", F.xxhash64(*of))
    # Whole numbers, as decimals of 64 bits are objects: the sums of parts of 22, 21 and 21 bits hold 2^41 rows of a key.
    parts = {"_s0": F.shiftrightunsigned("_h", 42), "_s1": F.shiftrightunsigned("_h", 21).bitwiseAND(F.lit((1 << 21) - 1)), "_s2": F.col("_h").bitwiseAND(F.lit((1 << 21) - 1))}
    return seen.groupBy(*keys).agg(F.count("*").alias("_n"), F.bit_xor("_h").alias("_x"), *[F.sum(part).alias(name) for name, part in parts.items()])


def _unchanged(batch: DataFrame, stored: DataFrame, keys: Sequence[str], of: Sequence[str | Column]) -> DataFrame:
    """Keys of the batch under which the same rows are stored."""
    both = [*keys, "_n", "_x", "_s0", "_s1", "_s2"]
    return _digests(batch, keys, of).join(_digests(stored, keys, of), both, "left_semi").select(*keys)


def table_chunks(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """The first rows of csv files and of the first sheets of workbooks as CSV text, in windows of 200 words.

    A workbook's chunks have ``source#sheet`` as their source; their ids are made from the file's own name.
    """
    shown = tables.head_as_csv_text(rows, headers).withColumn("tag", F.when(F.col("kind") == "csv", "csv").otherwise(F.concat_ws("-", "label", "kind")))
    windows = chunks.chunk_words(chunks.skip_blank(shown.select("source", "label", "kind", "tag", "text")), text.TABLE_WINDOW)
    made = chunks.identify_chunks(windows.withColumn("page", F.lit(1)))
    own = F.when(F.col("kind") == "csv", F.col("source")).otherwise(F.concat_ws("#", "source", "label"))
    return made.withColumn("source", own).drop("label", "kind", "tag")


def paragraph_chunks(paragraphs: DataFrame) -> DataFrame:
    windows = chunks.chunk_paragraphs(paragraphs).withColumns({"page": F.lit(1), "tag": F.lit("docx")})
    return chunks.identify_chunks(windows).drop("tag")


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    # ------------------------------------------------------------------ writing

    def ingest(self, decoded: Decoded, run_no: int, dim: int = 1024, scorer: Callable | None = None) -> DataFrame:
        """Store everything of ``decoded`` that is not stored yet, and report (output, n_rows, n_chars) of what was added.

        Chunks are embedded by their preview (``embed``). A chunk id that an earlier run stored is ignored; a table or a source's headings
        that come again replace the earlier ones, or, if they are the same, add nothing. Every file's document row is written anew.
        """
        earlier = self._all(before=run_no)
        parts = self._table_parts(decoded, earlier)
        parts["headings"] = self._headings(decoded, earlier)
        parts["documents"] = self._documents(decoded, parts.pop("listed"))
        parts["chunks"] = self._chunks(decoded, earlier, parts.pop("grid"), parts.pop("headers"), dim, scorer)
        seen, tagged = {}, []
        for name in OUTPUTS:
            if parts.get(name) is None:
                continue
            fields = StructType.fromDDL(OUTPUTS[name]).fields
            row = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
            seen[name] = Observation(name)
            counted = parts[name].observe(seen[name], F.count(F.lit(1)).alias("n"), F.sum(F.col("chars") if name == "chunks" else F.lit(None).cast("int")).alias("chars"))
            tagged.append(counted.select(F.lit(name).alias("output"), row.alias(name)))
        union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
        with _one_writer_per_output(self.spark):
            union.write.mode("overwrite").partitionBy("output").parquet(f"{self.root}/run={run_no}")
        report = [(name, found.get["n"], found.get["chars"]) for name, found in seen.items()]
        return self.spark.createDataFrame(report, "output string, n_rows long, n_chars long")

    def _table_parts(self, decoded: Decoded, earlier: DataFrame) -> dict[str, DataFrame | None]:
        if decoded.cells is None:
            return dict.fromkeys(("grid", "headers", "listed", "rows", "tables", "sheets", "columns"))
        # The grid rows are read by several branches; cells may come straight from a decoder, which must run once.
        grid = tables.stored_rows(decoded.cells, scratch_path(self.spark, "grid"))
        headers = settled(tables.header_info(grid, two_row_sheets=decoded.two_row_sheets))
        if decoded.grids is not None:
            headers = settled(headers.unionByName(tables.empty_headers(tables.drop_empty_tables(decoded.grids, grid), headers)))
        body = tables.body_rows(grid, headers, measured_join)
        stored = self._latest_tables(earlier)
        columns = tables.column_catalog(headers)
        again = settled(headers.select("table_name").distinct().join(stored, "table_name", "left_semi"))
        # Only rows of tables that come again are compared; where none does, the batch is not read for it.
        met = body.where(F.lit(False)) if again.isEmpty() else measured_join(body, again, ["table_name"], ["row_no"], "left_semi")
        same = _unchanged(met, self._of_table(earlier, "rows", stored), ["table_name"], ["row_no", "values"])
        if decoded.grids is not None:  # tables without rows
            same = same.unionByName(headers.where("width = 0").select("table_name").join(stored, "table_name", "left_semi"))
        named = _unchanged(columns, self._of_table(earlier, "columns", stored), ["table_name"], ["col_ordinal", "column_name", "parent"])
        same = settled(same.join(named, "table_name", "left_semi"))
        new = headers.join(same, "table_name", "left_anti")
        created = new.select("table_name", "source", "page", F.col("label").alias("sheet"), F.current_timestamp().alias("created_at"))
        # The grid's files hold their rows as they came, which stays where nothing is shuffled.
        kept = measured_join(body, same, ["table_name"], ["row_no"], "left_anti")
        sheets = tables.sheet_stats(new, body).join(new.select("source", F.col("label").alias("sheet"), "table_name"), ["source", "sheet"])
        catalog = headers.select("source", F.col("label").alias("sheet"))
        return {"grid": grid, "headers": headers, "listed": catalog, "rows": kept, "tables": created, "sheets": sheets,
                "columns": columns.join(same, "table_name", "left_anti")}

    def _headings(self, decoded: Decoded, earlier: DataFrame) -> DataFrame | None:
        found = []
        if decoded.paragraphs is not None:
            found.append(chunks.headings_from_styles(decoded.paragraphs).withColumnRenamed("para_no", "heading_no"))
        if decoded.words is not None:
            found.append(chunks.headings_from_font_size(decoded.words).withColumnRenamed("first_word", "heading_no"))
        if not found:
            return None
        batch = settled(reduce(DataFrame.unionByName, [f.select("source", F.col("page").cast("int").alias("page"), F.col("level").cast("int").alias("level"), "heading", F.col("heading_no").cast("bigint").alias("heading_no")) for f in found]))
        same = _unchanged(batch, self._latest_headings(earlier), ["source"], ["page", "level", "heading", "heading_no"])
        return salted_join(batch, same, ["source"], ["page", "heading"], "left_anti")

    @staticmethod
    def _documents(decoded: Decoded, catalog: DataFrame | None) -> DataFrame:
        if catalog is None:
            counted = decoded.files.withColumns({"sheet_count": F.lit(0), "table_count": F.lit(0)})
        else:
            counted = document_rollup(decoded.files, catalog)
        return counted.withColumn("ingested_at", F.current_timestamp())

    def _chunks(self, decoded: Decoded, earlier: DataFrame, grid: DataFrame | None, headers: DataFrame | None, dim: int, scorer: Callable | None) -> DataFrame | None:
        found = []
        if decoded.pages is not None:
            found.append(chunks.text_chunks(decoded.pages))
        if decoded.paragraphs is not None:
            found.append(paragraph_chunks(decoded.paragraphs))
        if grid is not None:
            found.append(table_chunks(grid, headers))
        if not found:
            return None
        columns = ["chunk_id", "source", "page", "chunk_no", "chars", "preview", "text"]
        batch = reduce(DataFrame.unionByName, [f.select(*columns) for f in found])
        fresh = new_chunks(self._output(earlier, "chunks"), batch, [F.col("text")])
        return vectors.embed(fresh.select(*columns), "preview", dim, scorer)

    # ------------------------------------------------------------------ reading

    def _all(self, before: int | None = None) -> DataFrame:
        """All outputs of all runs, or of those before one, as stored."""
        wide = ", ".join(f"{name} struct<{', '.join(':'.join(f.split(' ', 1)) for f in fields.split(', '))}>" for name, fields in OUTPUTS.items())
        schema = f"{wide}, run int, output string"
        try:
            found = self.spark.read.schema(schema).parquet(self.root)
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            found = self.spark.createDataFrame([], schema)
        return found if before is None else found.where(F.col("run") < before)

    @staticmethod
    def _output(runs: DataFrame, name: str) -> DataFrame:
        return runs.where(F.col("output") == name).select(f"{name}.*", "run")

    def _without_replaced(self, df: DataFrame, replaced: DataFrame, keys: Sequence[str], spread_by: Sequence[str]) -> DataFrame:
        """Rows of which a later run holds another version fall away; there are none as long as nothing came twice."""
        replaced = settled(replaced)
        if replaced.isEmpty():
            return df
        return measured_join(df, replaced, [*keys, "run"], spread_by, "left_anti")

    def _latest_tables(self, runs: DataFrame) -> DataFrame:
        return latest_per_key(self._output(runs, "tables"), ["table_name"], [F.col("run").desc(), F.col("source")])

    def _of_table(self, runs: DataFrame, name: str, latest: DataFrame) -> DataFrame:
        held = self._output(runs, "tables").select("table_name", "run").distinct()
        replaced = held.join(latest.select("table_name", "run"), ["table_name", "run"], "left_anti")
        return self._without_replaced(self._output(runs, name), replaced, ["table_name"], ["row_no"] if name == "rows" else ["source"]).drop("run")

    def _latest_headings(self, runs: DataFrame) -> DataFrame:
        found = self._output(runs, "headings")
        held = found.select("source", "run").distinct()
        last = held.groupBy("source").agg(F.max("run").alias("run"))
        return self._without_replaced(found, held.join(last, ["source", "run"], "left_anti"), ["source"], ["page", "heading"]).drop("run")

    def chunks(self) -> DataFrame:
        return self._output(self._all(), "chunks").drop("run", "embedding", "error")

    def vectors(self) -> DataFrame:
        """(chunk_id, embedding, error)."""
        return self._output(self._all(), "chunks").select("chunk_id", "embedding", "error")

    def tables(self) -> DataFrame:
        return self._latest_tables(self._all()).drop("run")

    def rows(self) -> DataFrame:
        return self._of_table(self._all(), "rows", self._latest_tables(self._all()))

    def sheets(self) -> DataFrame:
        return self._of_table(self._all(), "sheets", self._latest_tables(self._all()))

    def columns(self) -> DataFrame:
        return self._of_table(self._all(), "columns", self._latest_tables(self._all()))

    def headings(self) -> DataFrame:
        return self._latest_headings(self._all())

    def documents(self) -> DataFrame:
        return latest_per_key(self._output(self._all(), "documents"), ["source"], [F.col("run").desc()]).drop("run")
