"""Table names, sheet labels and file kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(col: Column) -> Column:
    """Lower case; every character that is no letter, no digit and no underscore becomes ``_``."""
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}_]", "_")


def file_kind(name: Column) -> Column:
    low = F.lower(name)
    kind = F.lit("other")
    # File suffixes and the kinds they stand for.
    suffixes = [(".txt", "text"), (".md", "text"), (".xls", "xls"), (".xlsx", "xlsx"),
                (".csv", "csv"), (".docx", "docx"), (".pdf", "pdf")]
    for suffix, label in suffixes:
        kind = F.when(low.endswith(suffix), F.lit(label)).otherwise(kind)
    return kind


def chunk_tag(kind: Column, page: Column, sheet: Column) -> Column:
    """The middle part of a chunk id: page number, document kind, or sheet and kind."""
    return (
        F.when(kind == "pdf", page.cast("string"))
        .when(kind.isin("docx", "csv"), kind)
        .when(kind.isin("xlsx", "xls"), F.concat_ws("-", sheet, kind))
        .otherwise(F.lit("raw"))
    )


def sheet_label(kind: Column, sheet: Column, page: Column, table_no: Column) -> Column:
    """``csv``, the sheet's own name, ``docx_table_i`` or ``pdf_pP_tT``."""
    return (
        F.when(kind == "csv", F.lit("csv"))
        .when(kind == "docx", F.concat(F.lit("docx_table_"), table_no.cast("string")))
        .when(kind == "pdf", F.concat(F.lit("pdf_p"), page.cast("string"), F.lit("_t"), table_no.cast("string")))
        .otherwise(sheet)
    )


def table_name_for(kind: Column, source: Column, sheet: Column, page: Column, table_no: Column) -> Column:
    base = F.when(kind.isin("csv", "xlsx", "xls", "docx", "pdf"), F.replace(source, F.concat(F.lit("."), kind), F.lit("")))
    base = F.coalesce(base, source)
    tail = (
        F.when(kind == "docx", F.concat(F.lit("_table_"), table_no.cast("string")))
        .when(kind == "pdf", F.concat(F.lit("_p"), page.cast("string"), F.lit("_t"), table_no.cast("string")))
        .when(kind.isin("xlsx", "xls"), F.concat(F.lit("_"), sheet))
        .otherwise(F.lit(""))
    )
    return normalize_name(F.concat(base, tail))
