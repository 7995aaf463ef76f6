"""Streams over tables that are one file or a folder of files."""

import pytest
from pyspark.sql import functions as F

from sheavework.plans import streams


@pytest.fixture
def tables(spark, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of"), "id").alias("text"), F.lit("en").alias("lang"),
                                  F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.col("id").cast("long").alias("n_chars"))
    talk = spark.range(30).select((F.col("id") % 7).alias("conv_id"), F.col("id").cast("int").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    for name, df in (("documents", docs), ("conversations", talk)):
        df.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_streams_read_folders(spark, tables):
    assert streams.stream_append_messages(spark, tables).count() == 30
    kept = {r.source: r.bytes for r in streams.stream_catalog_upsert(spark, tables).collect()}
    assert kept == {"s0": 39, "s1": 37, "s2": 38}
    assert streams.stream_ingest(spark, tables).count() == 40
