"""Shards by a Feistel permutation of global row numbers: a reproducible shuffle whose every place can be computed."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import number_rows
from . import bulk
from .frames import narrow, settle

ROUNDS = 6


def _sides(n: int) -> tuple[int, int]:
    """The smallest near-square rectangle of at least ``n`` cells, so that few numbers have to walk."""
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _turn(keys: np.ndarray, half: np.ndarray) -> np.ndarray:
    return bulk.mix(half.astype(np.uint64) + keys) >> np.uint64(1)


def permuted(numbers: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """A permutation of 0..n-1, or its inverse. A number that leaves the range goes through again until it is inside.

    The halves live in Z_a and Z_b with a * b >= n; each round adds a keyed hash of one half to the other.
    """
    a, b = _sides(n)
    keys = bulk.mix(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(seed % (1 << 63)) * np.uint64(ROUNDS))
    out = numbers.astype(np.int64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] // b, out[todo] % b
        for k in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2 == 0:
                left = (left + sign * (_turn(keys[k], right) % np.uint64(a)).astype(np.int64)) % a
            else:
                right = (right + sign * (_turn(keys[k], left) % np.uint64(b)).astype(np.int64)) % b
        out[todo] = left * b + right
        todo = todo[out[todo] >= n]
    return out


def place_of(numbers: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers."""
    spot = permuted(numbers, n, seed)
    return spot % shards, spot // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int) -> np.ndarray:
    """The row number that lies in a slot of a shard; the inverse of ``place_of``."""
    return permuted(slot * shards + shard, n, seed, back=True)


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def sharded(docs: DataFrame, shards: int = 24, seed: int = 20_260_001) -> DataFrame:
    """(doc_id, row_no, size, text_crc32, shard, slot) of each row of ``docs`` (doc_id, text).

    Rows are numbered in the order of (doc_id, checksum, size); rows that repeat all three keep the order in which they
    were read. A null doc_id comes first, a null text counts as empty. Row numbers go through the permutation; the spot
    modulo ``shards`` is the shard, the quotient the slot: shard counts differ by one at most and slots have no gap. The
    same table gives the same places on any cluster. An empty table gives an empty result; extra columns are ignored.

    Texts are read once and never shuffled; only ids and numbers are sorted, by range.
    """
    docs = narrow(docs, "doc_id", "text")
    checksum = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    light = settle(docs.select("doc_id", text_size(F.col("text")).alias("size"), checksum.alias("text_crc32")), "sizes")
    numbered = number_rows(light.withColumn("_read", F.monotonically_increasing_id()), ["doc_id", "text_crc32", "size", "_read"], "row_no")
    numbered = settle(numbered.drop("_read"), "numbered")
    n = numbered.count()

    @F.pandas_udf("shard int, slot long")
    def places(row_no: pd.Series) -> pd.DataFrame:
        shard, slot = place_of(row_no.to_numpy(), n, shards, seed)
        return pd.DataFrame({"shard": shard.astype("int32"), "slot": slot})

    placed = numbered.withColumn("_place", places("row_no"))
    return placed.select("doc_id", "row_no", "size", "text_crc32", "_place.shard", "_place.slot")
