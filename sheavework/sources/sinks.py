"""Writers for stored tables, conversations and generated texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.conversations import export_json, export_sessions
from ..operators.tables import wide_view


def materialize(rows: DataFrame, columns: DataFrame, table_name: str, path: str | None = None) -> DataFrame:
    """Write one stored table with its own columns, as Parquet at ``path`` or as a managed table; returns it."""
    view = wide_view(rows, columns, table_name)
    spark = rows.sparkSession
    if path:
        view.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    view.write.mode("overwrite").saveAsTable(table_name)
    return spark.table(table_name)


def export_session_json(asked: DataFrame, sessions: DataFrame, messages: DataFrame, path: str, part_messages: int = 1000) -> None:
    """One JSON object per session part with session and messages; parts carry their number and how many there are."""
    export_json(export_sessions(asked, sessions, messages, part_messages)).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def export_text(df: DataFrame, path: str, name: str = "feature", text: str = "text") -> None:
    """Texts in one folder per name, blanks in the name written as ``_``."""
    df.select(F.translate(F.col(name), " ", "_").alias("name"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("name").text(path)
