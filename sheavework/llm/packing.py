"""Best-fit packing of documents into sequences, in bulk-synchronous rounds over ranks of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spread import number_rows
from . import bulk
from .frames import narrow, settle

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, load: Callable[[], Callable[[list[str]], list[np.ndarray]]], end_id: int, room: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's pieces of at most ``room`` tokens.

    ``load`` is called once per task and returns a function from texts to token ids; ``end_id`` closes every document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for group in bulk.text_batches(bulk.rows_of(batches)):
            rows = []
            for (doc_id, _), ids in zip(group, encode([t or "" for _, t in group]), strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), room)):
                    part = ids[start : start + room]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(bulk.lean(run), PIECES)


def best_fit_rounds(counts: dict[int, int], room: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset) of runs of equally long pieces, all of them placed.

    One round per length, longest first. The pieces of a length are ranked, and so are the gaps of a size; the smallest
    gap that is large enough takes the pieces, rank by rank, one per gap, so no two pieces want the same place. Then the
    gaps are updated and the rest of the pieces look again. What finds no gap opens sequences. The state is a list of
    gap sizes with runs of sequence numbers: at most ``room`` sizes and lengths, however many documents there are. A run
    may be split and used again by many lengths, so no such bound is shown for the number of runs.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # size: runs of sequences (first, number)
    sizes: list[int] = []
    placed, sequences = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                opened = -(-left // max(1, room // length))
                if room not in gaps:
                    insort(sizes, room)
                gaps[room].append((sequences, opened))
                sequences += opened
                continue
            gap = sizes[at]
            first, number = gaps[gap].pop()
            take = min(number, left)
            if take < number:
                gaps[gap].append((first + take, number - take))
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(at)
            placed.append((length, rank, take, first, room - gap))
            if gap > length:
                if gap - length not in gaps:
                    insort(sizes, gap - length)
                gaps[gap - length].append((first, take))
            rank, left = rank + take, left - take
    return placed


def packed(pieces: DataFrame, room: int) -> DataFrame:
    """``pieces`` (doc_id, piece, length and others) with ``sequence_id`` and ``offset``.

    Pieces are sorted by range of their length, longest first, which ranks those of a length; only the count of each of
    the at most ``room`` lengths goes to the driver, where the rounds deal ranks to sequences. The runs they give are
    bounded by ``room`` too and come back as a table that each piece finds its own run in. An empty table gives an
    empty result; pieces that repeat are placed as often as they come.
    """
    spark = pieces.sparkSession
    lengths = [r for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()]  # at most ``room`` rows
    counts = {int(r["length"]): int(r["n"]) for r in lengths}
    order = sorted(counts, reverse=True)
    begins = dict(zip(order, np.concatenate(([0], np.cumsum([counts[n] for n in order])))[:-1].tolist(), strict=True)) if order else {}
    runs = [(begins[length] + rank, number, sequence, offset) for length, rank, number, sequence, offset in best_fit_rounds(counts, room)]
    runs.sort()
    columns = [np.array(c, np.int64) for c in zip(*runs, strict=True)] if runs else [np.zeros(0, np.int64)] * 4
    sent = spark.sparkContext.broadcast(columns)

    @F.pandas_udf("sequence_id long, offset long")
    def place(position: pd.Series) -> pd.DataFrame:
        first, _, sequence, offset = sent.value
        spot = position.to_numpy()
        at = np.searchsorted(first, spot, side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + spot - first[at], "offset": offset[at]})

    ranked = number_rows(pieces.withColumn("_down", -F.col("length")).withColumn("_read", F.monotonically_increasing_id()), ["_down", "doc_id", "piece", "_read"], "_position")
    return ranked.withColumn("_place", place("_position")).select(*pieces.columns, "_place.sequence_id", "_place.offset")


def packed_documents(docs: DataFrame, load: Callable[[], Callable[[list[str]], list[np.ndarray]]], end_id: int = 1, room: int = 4096) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its closing token alone. Only documents longer than ``room`` are cut, into pieces of ``room``
    and a rest. Rows that repeat are packed as often as they come, a null doc_id too; extra columns are ignored.
    """
    return packed(settle(token_pieces(narrow(docs, "doc_id", "text"), load, end_id, room), "pieces"), room)
