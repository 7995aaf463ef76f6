"""The pipeline from raw documents to packed sequences, stage by stage.

A stage takes (spark, docs, sf_dir) and returns rows with the columns of documents, the last one the packed pieces. Each
result is written and read again before the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheavework.llm import exact, language, near, packing, private
from sheavework.llm.frames import settle
from sheavework.llm.queries import word_bpe


BATCH_BYTES = 1 << 20  # of an Arrow batch, so that an executor and its Python workers do not hold thousands of whole texts at once


def _in_small_batches(spark: SparkSession) -> None:
    """For the rest of the session, as the rows of a stage are read after it has returned."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(min(BATCH_BYTES, int(spark.conf.get(name, None) or BATCH_BYTES))))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is recognised. A text without letters, or beyond what texts of its language show, goes; models learn
    from all rows with a language, so without any label every row goes. An empty table stays empty; repeated rows stay or go together."""
    _in_small_batches(spark)
    return language.recognised(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space apart: that with the smallest doc_id. Null texts count as empty; of rows that repeat id and text one
    stays; a row without doc_id stays only if no other has its text."""
    return exact.first_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more: that with the smallest doc_id. Texts without a
    word are linked with nothing; rows that share a doc_id stay or go together; a row without doc_id stays."""
    _in_small_batches(spark)
    return near.one_of_each(docs, words=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with personal data replaced in their texts, and ``n_chars`` counted anew. A null text stays null."""
    clean = private.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens. A null or empty text is its end token alone; repeated rows are packed
    as often as they come; an empty table gives no pieces."""
    _in_small_batches(spark)
    return packing.packed_documents(docs, word_bpe(), end_id=1, room=4096)


STAGES = [
    ("language", identify_language),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("private", redact_personal_data),
    ("packing", pack_sequences),
]

#: Models and tokenizers cannot be stated in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
