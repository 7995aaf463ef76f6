"""Numpy work on many texts at once: batches of texts, word spans, 64-bit hashes, ragged gathers.

All functions are pure and hold a few arrays of one batch; a batch is bounded by ``BATCH_BYTES`` of text (or one
text, if that is longer).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BATCH_BYTES = 1 << 20
SLICE_ROWS = 256  # rows of an Arrow batch that are Python objects at a time
_BASE = 0x9E3779B97F4A7C17 | 3  # odd and 3 modulo 4, so that powers of it spread over all bits
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_ORDERED = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of slices of a byte or code-point array, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            steps = np.full(n, _BASE, np.uint64)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)
            steps[1:] = np.uint64(_BASE_INVERSE)
            self.inverses = np.multiply.accumulate(steps)

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of a byte array, or of an array of code points, from which any slice's hash follows."""
        n = len(data)
        self._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        marks = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))[data] if data.dtype == np.uint8 else mix(data.astype(np.uint64) + np.uint64(1))
        np.cumsum(marks * self.powers[:n], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (sums[ends] - sums[starts]) * self.inverses[starts]
        return mix(raw ^ ((ends - starts).astype(np.uint64) * np.uint64(_ORDERED[0])))

    def slices(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.of(self.sums(data), starts, ends)


def combined(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several hashes in their order."""
    total = np.zeros(len(parts[0]), np.uint64)
    for part, factor in zip(parts, _ORDERED, strict=False):
        total += part * np.uint64(factor)
    return mix(total)


def text_batches(rows: Iterator[tuple], limit: int = BATCH_BYTES) -> Iterator[list[tuple]]:
    """Groups (…, text) tuples so that a group holds about ``limit`` characters of text."""
    held, size = [], 0
    for row in rows:
        n = len(row[-1]) if row[-1] is not None else 0
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held


def give_back() -> None:
    """Free memory that this process still holds goes back to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after whose last batch its worker, which waits for later tasks beside the executor, keeps no memory of this one."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


def slices_of(batches) -> Iterator:
    """Arrow record batches in slices of few rows, without a copy."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def rows_of(batches) -> Iterator[tuple]:
    """Plain tuples of Arrow record batches."""
    for part in slices_of(batches):
        yield from zip(*(column.to_pylist() for column in part.columns), strict=True)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by one space, and where each begins (with the end behind)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return data, begins


def words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the runs of bytes other than space and \\x09 to \\x0D."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return starts, ends, np.searchsorted(begins, starts, side="right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case, all other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def ragged(values: np.ndarray, offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates the slices ``values[offsets[p]:offsets[p + 1]]`` of all picks; returns them and their lengths."""
    sizes = offsets[picks + 1] - offsets[picks]
    total = int(sizes.sum())
    firsts = np.repeat(offsets[picks] - (np.cumsum(sizes) - sizes), sizes)
    return values[firsts + np.arange(total)], sizes
