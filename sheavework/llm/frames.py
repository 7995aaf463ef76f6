"""Helpers on DataFrames for the operators: narrow inputs, settled tables, components of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spread import fits_broadcast, salted_join
from ..session import scratch_path


def _place(df: DataFrame, name: str) -> int:
    found = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not found:
        raise ValueError(f"column {name} is missing from {df.columns}")
    return found[0]


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, found by their exact spelling first; other columns may have any name, also a clashing one."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{_place(df, n)}").alias(n) for n in names])


def pack(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, and the whole row in one column ``_row``, so that no other column can clash."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{_place(df, n)}").alias(n) for n in names], F.struct(*plain.columns).alias("_row"))


def unpack(packed: DataFrame, like: DataFrame) -> DataFrame:
    """The rows of ``pack`` again, under the columns of ``like``."""
    return packed.select("_row.*").toDF(*like.columns)


def settle(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read again: computed once, and no executor's loss undoes it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame) -> DataFrame:
    """Marked for broadcast if a count of its rows and bytes shows that it is small; else as it is."""
    return F.broadcast(df) if fits_broadcast(df) else df


SALTS = 64


def spread_join(big: DataFrame, small: DataFrame, on: list[str], by: str) -> DataFrame:
    """Equi-join of ``big`` with ``small`` (one row per key) in which no key's rows meet in one task.

    The rows of a key are told apart by a salt of their column ``by``. Only keys with a salt that occurs are brought from
    ``small``, by a join that sees each pair of key and salt once; nothing is repeated for keys with few rows.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    told = salted.select(*on, "_salt").distinct().join(small, on)
    return salted.join(told, [*on, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a long, b long) is connected with.

    Alternates large-star and small-star steps, which halve the depth of the trees and end in a star per component.
    Only minima per node are aggregated, with partial sums before the shuffle, and the edges of a hub meet its minimum divided by
    salt; state is one row per edge, settled in the shared folder after each step. Self-loops and repeated edges do no harm.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_join(both, lowest, ["a"], ["b"], salts=8).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, lowest, ["a"], ["b"], salts=8).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = settle(small.select("e.*").where("a <> b").distinct(), "edges")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if sign == (seen["n"], seen["h"]):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        sign = (seen["n"], seen["h"])
