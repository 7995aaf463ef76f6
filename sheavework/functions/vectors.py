"""Vector expressions in DOUBLE."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the term added to the norm so that a zero vector can be divided.
NORM_EPSILON = 1e-9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(vec: Column) -> Column:
    """v / (|v| + 1e-9). Pass a plain column: the norm is computed once as its own array and zipped on."""
    scale = F.array_repeat(norm(vec) + F.lit(NORM_EPSILON), F.size(vec))
    return F.zip_with(vec, scale, lambda x, n: x.cast("double") / n)


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(NORM_EPSILON)) * (norm(b) + F.lit(NORM_EPSILON)))


def similarity_from_distance(distance: Column) -> Column:
    """Score of a cosine distance."""
    return F.lit(1.0) - distance


def similarity_from_euclidean(distance: Column) -> Column:
    """The same score from the Euclidean distance of two unit vectors."""
    return F.lit(1.0) - distance * distance / F.lit(2.0)


def hashed_bucket(word: bytes, dim: int) -> int:
    """The bucket of a word in lower case, from the first 16 bits of its MD5: the same on every engine, without a model."""
    return int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:2]) % dim
