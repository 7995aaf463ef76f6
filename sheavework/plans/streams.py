"""Streaming queries: run to the end of the given tables, then read what was stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import ingest
from . import inputs as I
from .inputs import sql
from .registry import register


def _stream(spark, sf, name: str):
    """The table as a stream, be it one file or a folder of files: a stream takes a file only by a pattern."""
    schema = I.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


@register("stream_ingest", sql("SELECT chunk_id, source, page, chars, preview FROM chunks", "chunks"))
def stream_ingest(spark, sf):
    """All documents twice, as two runs: the second adds nothing."""
    table = scratch_path(spark, "chunks")
    for run in range(2):
        docs = _stream(spark, sf, "documents")
        ext = F.expr("CASE lang WHEN 'de' THEN '.PDF' WHEN 'es' THEN '.docx' WHEN 'fr' THEN '.md' ELSE '.txt' END")
        name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), ext)
        kind = I.names.file_kind(name).alias("kind")
        page = F.when(F.col("lang") == "de", (F.col("doc_id") % 3 + 1).cast("int")).otherwise(1).alias("page")
        ingest.stream_ingest(docs.select(name.alias("source"), kind, page, "text"), table, scratch_path(spark, "progress"), run_no=run).awaitTermination()
    return spark.read.parquet(table).select("chunk_id", "source", "page", "chars", "preview")


@register("stream_append_messages", sql("SELECT session_id, msg_no, role, content, created_at FROM messages", "messages"))
def stream_append_messages(spark, sf):
    table = scratch_path(spark, "messages")
    rows = _stream(spark, sf, "conversations").select(
        F.concat(F.lit("sess_"), F.col("conv_id").cast("string")).alias("session_id"), (F.col("turn") + 1).alias("msg_no"), "role",
        F.col("text").alias("content"), (F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")).alias("created_at"))
    ingest.stream_append_messages(rows, table, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(table)


@register("stream_catalog_upsert", """SELECT source, max_by(lang, doc_id) AS kind, max_by(n_chars, doc_id) AS bytes FROM documents GROUP BY source""")
def stream_catalog_upsert(spark, sf):
    """The last document of every source wins."""
    table = scratch_path(spark, "documents")
    entries = _stream(spark, sf, "documents").select("source", F.col("lang").alias("kind"), F.col("n_chars").alias("bytes"), "doc_id")
    ingest.stream_catalog_upsert(entries, table, scratch_path(spark, "progress"), ["source"], [F.col("doc_id").desc()]).awaitTermination()
    return ingest.current_catalog(spark, table, ["source"]).select("source", "kind", "bytes")
