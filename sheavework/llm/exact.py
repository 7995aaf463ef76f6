"""Exact duplicates by a tree merge of digest runs; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import narrow, pack, settle, unpack

FAN_BITS = 3  # so many bits of the run number fall away in a round: eight runs merge into one
IDENTITY = ["text_sha256", "_bytes", "_second"]


def normalised(text: Column) -> Column:
    """Runs of space and \\x09 to \\x0D as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, _bytes, _second, _run) of every row. Each input partition is a run of the tree.

    Length and a second, independent hash belong to the identity, so that equal digests of different texts would be
    told apart.
    """
    plain = docs.select("doc_id", normalised(F.col("text")).alias("_plain"))
    return plain.select(
        "doc_id",
        F.sha2(F.col("_plain"), 256).alias("text_sha256"),
        F.octet_length("_plain").alias("_bytes"),
        F.xxhash64("_plain").alias("_second"),
        F.spark_partition_id().alias("_run"),
    )


def merge_rounds(leaves: DataFrame, runs: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """(identity, keep_id, group_size) from the leaves (identity, _run, keep_id, group_size), one round per ``fan_bits``.

    In a round the run number loses its lowest bits, and what the merged runs hold of a digest becomes one row with the
    smallest identifier and the summed size. A round deals its rows out by (run, digest): no task holds a whole run, and a
    digest arrives at most ``2 ** fan_bits`` times per merged run, however many copies it has.
    """
    level = leaves
    while runs > 1:
        level = (
            level.withColumn("_run", F.shiftright("_run", fan_bits))
            .groupBy(*IDENTITY, "_run")
            .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        )
        runs = -(-runs // (1 << fan_bits))
    return level.drop("_run")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each document of ``docs`` (doc_id, text).

    Texts are equal if they are the same after each run of white space has become one space; null counts as empty. The
    smallest doc_id of a group is its ``keep_id``; ``group_size`` counts rows. Rows that repeat both doc_id and text are one
    document and give one row. A null doc_id comes after all others: such a row is kept only if its group has no other
    id. An empty table gives an empty result; extra columns are ignored.

    The result goes down the tree again: each run learns the answer of its own digests, so a digest that a third of all
    rows share is spread over as many tasks as it has runs.
    """
    hashed = settle(digest_runs(narrow(docs, "doc_id", "text")), "digests")
    runs = (hashed.agg(F.max("_run")).first()[0] or 0) + 1
    documents = hashed.groupBy("doc_id", *IDENTITY, "_run").agg(F.count("*").alias("_rows"))
    leaves = documents.groupBy(*IDENTITY, "_run").agg(F.min("doc_id").alias("keep_id"), F.sum("_rows").alias("group_size"))
    leaves = settle(leaves, "leaves")
    root = merge_rounds(leaves, runs)
    answers = leaves.select(*IDENTITY, "_run").join(root, IDENTITY)
    own = documents.groupBy("doc_id", *IDENTITY).agg(F.min("_run").alias("_run"))
    return own.join(answers, [*IDENTITY, "_run"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they are; of rows that repeat id and text, one."""
    stay = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    marked = pack(docs, ["doc_id", "text"]).select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("_digest"), "_row")
    met = marked.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha")), "left_semi")
    return unpack(met.dropDuplicates(["doc_id", "_digest"]), docs)
