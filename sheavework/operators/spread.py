"""Joins, numberings and first-n filters that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root

SALTS = 16
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measured, not estimated: counts rows and text bytes, and stops reading after ``max_rows + 1`` rows."""
    width = F.lit(0).cast("long")
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{field.name}`")))), F.lit(0))
        else:
            width = width + 16
    seen = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("b")).first()
    return seen["n"] <= max_rows and (seen["b"] or 0) <= max_bytes


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Sequence[str], how: str = "inner",
                salts: int | None = None) -> DataFrame:
    """Equi-join in which the rows of one hot key of ``big`` are divided over ``salts`` partitions.

    ``spread_by`` names columns that tell the rows of one key apart; the salt is a hash of them, so a
    task that is run again after an executor loss computes the same one. ``small`` is repeated ``salts``
    times, so it should be the side with few rows per key. A side that turns out to be small is still
    broadcast by the optimiser under its own threshold.
    """
    salts = salts or min(SALTS, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def measured_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Sequence[str], how: str = "inner") -> DataFrame:
    """``salted_join``, or a broadcast of ``small`` where a count shows that it fits, so that ``big`` is not shuffled.

    ``small`` is read for the count, so it should be settled.
    """
    return big.join(F.broadcast(small), on, how) if fits_broadcast(small) else salted_join(big, small, on, spread_by, how)


FILTER_CELLS = 1 << 22  # 64-bit cells of a filter at most, 32 MB in all
BLOCK_CELLS = 256  # cells in a row of a filter


def may_match(big: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of ``big`` whose keys ``small`` may have: all that have a match, and about a thirtieth of the others.

    Only a bit for each hashed key of ``small`` is sent to ``big``, 32 bits a row up to ``FILTER_CELLS`` cells; more rows than those are
    good for (eight million) only let more pass. So a shuffle of the result grows with the matches. ``small`` is read twice, so it should
    be settled; keys must have one type on both sides.
    """
    cells = BLOCK_CELLS
    while 2 * cells < min(small.count(), 2 * FILTER_CELLS):
        cells *= 2
    key = F.xxhash64(*on)
    cell, bit = F.pmod(key, F.lit(cells)), F.shiftrightunsigned(key, 58).cast("int")
    block, place = F.floor(cell / BLOCK_CELLS), (cell % BLOCK_CELLS).cast("int")
    marks = small.select(block.alias("_block"), place.alias("_place"), bit.alias("_bit")).groupBy("_block", "_place").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    held = marks.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("_place", "_bits"))).alias("_held"))
    blocks = held.select("_block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK_CELLS - 1)), lambda i: F.coalesce(F.col("_held")[i], F.lit(0))).alias("_cells"))
    met = big.withColumns({"_block": block, "_place": place, "_bit": bit}).join(F.broadcast(blocks), "_block")
    return met.where(F.bit_get(F.element_at("_cells", F.col("_place") + 1), F.col("_bit")) == 1).select(*big.columns)


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key. The plan prunes to ``n`` per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_n(df, keys, order, 1, "_latest").drop("_latest")


def running_offset(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Exclusive running sum of ``value`` per key in the order of the whole-number column ``order``.

    Two levels: rows are summed per block of ``block`` order values (with partial sums before the
    shuffle), the block sums are accumulated per key, and the inner sum runs within one block. No task
    sees more than one block of a key, or one row per block.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    sums = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_block_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_block", F.coalesce(F.sum("_block_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.withColumn("_inner", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, [*keys, "_block"])
        .withColumn(out, (F.col("_start") + F.col("_inner")).cast("long"))
        .drop("_block", "_start", "_inner")
    )


def number_rows(df: DataFrame, order: Sequence[str], out: str = "position") -> DataFrame:
    """0-based position of every row in the global order, without a single-partition window.

    The range-sorted rows are checkpointed to the shared folder so that the positions and the counts
    of the ranges come from the same sort even if an executor is lost in between.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        df.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .checkpoint()
    )
    # One row per range: never more rows than shuffle partitions.
    counts = ordered.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        ordered.join(F.broadcast(starts), "_range")
        .withColumn(out, (F.col("_start") + F.col("_seq")).cast("long"))
        .drop("_range", "_seq", "_start")
    )


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """0-based position of every row among those of its key, from global positions."""
    numbered = number_rows(df, [*keys, *order], "_position")
    firsts = numbered.groupBy(*keys).agg(F.min("_position").alias("_first"))
    return (
        salted_join(numbered, firsts, keys, ["_position"])
        .withColumn(out, F.col("_position") - F.col("_first"))
        .drop("_position", "_first")
    )


def settled(df: DataFrame) -> DataFrame:
    """Checkpoint a frame that several branches of one plan read, so that it is computed once and survives losses."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """Keep a frame that several branches of one plan read; blocks that are lost are computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
