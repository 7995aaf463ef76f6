"""Repeated passages: fixed blocks of the reference as anchors, probed by rolling windows, extended to maximal exact repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bulk
from .frames import narrow, settle

CHUNK_BYTES = 2 << 20  # text of one chunk, or a single longer document
BUCKET_BYTES = 16 << 20  # text whose window hashes meet in one group
LAST = (1 << 63) - 1  # stands for a null id: behind all others
_RES = (1 << 30) - 1
CHUNK = "chunk long, bytes long, ids binary, sizes binary, packed binary"


def chunks_of(docs: DataFrame) -> DataFrame:
    """(chunk, bytes, ids, sizes, packed): documents in groups of about ``CHUNK_BYTES``, their texts compressed, each group with a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=3)
        for group in bulk.text_batches(bulk.rows_of(batches), CHUNK_BYTES):
            raw = [(t or "").encode("utf-8", "surrogatepass") for _, t in group]
            ids = np.array([LAST if i is None else i for i, _ in group], np.int64)
            sizes = np.array([len(t) for t in raw], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([int(sizes.sum())]), *[pa.array([x], pa.binary()) for x in (ids.tobytes(), sizes.tobytes(), squeeze.compress(b"".join(raw)))]],
                names=["chunk", "bytes", "ids", "sizes", "packed"],
            )
            number += 1

    return docs.mapInArrow(run, CHUNK)


class Chunk:
    """The words of a chunk's documents as 64-bit hashes, one document after the other."""

    def __init__(self, ids: bytes, sizes: bytes, packed: bytes, hasher: bulk.Hasher) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        lengths = np.frombuffer(sizes, np.int64)
        data = zstandard.ZstdDecompressor().decompress(packed) if lengths.sum() else b""
        ends = np.cumsum(lengths)
        self.texts = [data[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        hashes, counts = [], np.zeros(len(self.texts), np.int64)
        for first, behind in self._groups(lengths):
            joined, begins = bulk.joined(self.texts[first:behind])
            starts, stops, owner = bulk.words(joined, begins)
            hashes.append(self._hashes(joined, starts, stops, hasher))
            counts[first:behind] = np.bincount(owner, minlength=behind - first)
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.offsets = np.concatenate(([0], np.cumsum(counts)))
        self.owner = np.repeat(np.arange(len(self.texts)), counts)

    @staticmethod
    def _groups(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
        first, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > bulk.BATCH_BYTES:
                yield first, i
                first, held = i, 0
            held += n
        if first < len(lengths):
            yield first, len(lengths)

    @staticmethod
    def _hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, hasher: bulk.Hasher) -> np.ndarray:
        """Of a very long text, a stretch of words at a time."""
        found, at = [], 0
        while at < len(starts):
            behind = max(at + 1, int(np.searchsorted(stops, starts[at] + bulk.BATCH_BYTES, side="right")))
            low = starts[at]
            found.append(hasher.slices(data[low : stops[behind - 1]], starts[at:behind] - low, stops[at:behind] - low))
            at = behind
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of ``width`` words begin, and their places within their documents."""
        n = len(self.words) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(n)
        at = at[self.owner[:n] == self.owner[width - 1 :]]
        return at, at - self.offsets[self.owner[at]]


class Rolling:
    """Hashes of runs of words by prefix sums over the words' hashes."""

    def __init__(self, words: np.ndarray, hasher: bulk.Hasher) -> None:
        self.words, self.hasher, self.sums = words, hasher, hasher.sums(words)

    def one(self, at: np.ndarray, width: int) -> np.ndarray:
        return self.hasher.of(self.sums, at, at + width)

    def two(self, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits, as two signed numbers."""
        other = self.hasher.of(self.hasher.sums(self.words ^ np.uint64(0x5851F42D4C957F2D)), at, at + width)
        return self.one(at, width).view(np.int64), other.view(np.int64)


def _spots(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 30 more bits of a hash as one number."""
    return ((hashes >> np.uint64(34)) % np.uint64(buckets)).astype(np.int64) << 30 | (hashes & np.uint64(_RES)).astype(np.int64)


def _packs(chunk: int, keys: np.ndarray, columns: list[np.ndarray], shift: int) -> Iterator[tuple]:
    """(bucket, chunk, bytes …) of sorted keys whose bits from ``shift`` on are the bucket."""
    bucket = keys >> shift
    edge = np.flatnonzero(np.diff(bucket)) + 1
    for start, stop in zip(np.append(0, edge).tolist(), np.append(edge, len(keys)).tolist(), strict=True):
        if stop > start:
            yield (int(bucket[start]), chunk, *[c[start:stop].tobytes() for c in columns])


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _chunks(batches: Iterator[pa.RecordBatch], hasher: bulk.Hasher) -> Iterator[tuple[Chunk, dict]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
            yield Chunk(row.pop("ids"), row.pop("sizes"), row.pop("packed"), hasher), row


def _probed(chunk: Chunk, rolling: Rolling, block: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a chunk's windows of ``block`` words begin, in the order of their probes; the distinct probes; and where the windows of each start."""
    at, _ = chunk.windows(block)
    spots = _spots(rolling.one(at, block), buckets)
    order = np.argsort(spots, kind="stable")
    at, spots = at[order], spots[order]
    first = np.flatnonzero(np.append(True, spots[1:] != spots[:-1])[: len(spots)])
    return at, spots[first], first


def probes(chunks: DataFrame, block: int, buckets: int) -> DataFrame:
    """(bucket, chunk, probes): a chunk's distinct rolling windows of ``block`` words, four bytes each.

    Thirty bits of the hash, one that says whether the window is a block of the index (it begins at a multiple of ``block``),
    and one that says whether documents with different ids in the chunk have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = bulk.Hasher()
        for chunk, row in _chunks(batches, hasher):
            at, keys, first = _probed(chunk, Rolling(chunk.words, hasher), block, buckets)
            if not len(at):
                continue
            ids, anchor = chunk.ids[chunk.owner[at]], (at - chunk.offsets[chunk.owner[at]]) % block == 0
            several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
            marks = np.logical_or.reduceat(anchor, first).astype(np.int64) << 30 | several.astype(np.int64) << 31
            rows = list(_packs(row["chunk"], keys, [((keys & _RES) | marks).astype("<u4")], 30))
            yield _batch(rows, [pa.int64(), pa.int64(), pa.binary()], ["bucket", "chunk", "probes"])

    return chunks.mapInArrow(run, "bucket long, chunk long, probes binary")


ANSWERS = "chunk long, bucket long, bits binary"


def _answered(table: pa.Table, wanted: np.ndarray, sizes: list[int]) -> pa.Table:
    """A bit for each entry of the packs that meet in a bucket, in the order in which their chunks sent them; packs without one that is wanted
    get no answer."""
    edges = np.concatenate(([0], np.cumsum(sizes))).tolist()
    ends = zip(*(table.column(c).to_pylist() for c in ("chunk", "bucket")), edges[:-1], edges[1:], strict=True)
    rows = [(chunk, bucket, np.packbits(wanted[a:b]).tobytes()) for chunk, bucket, a, b in ends if wanted[a:b].any()]
    return pa.Table.from_batches([_batch(rows, [pa.int64(), pa.int64(), pa.binary()], ["chunk", "bucket", "bits"])])


def _marked(answers: list[dict], bucket: np.ndarray) -> np.ndarray:
    """True for each entry of a chunk, of which ``bucket`` has the buckets in order, that an answer marks."""
    marked = np.zeros(len(bucket), bool)
    for answer in answers:
        first, behind = np.searchsorted(bucket, [answer["bucket"], answer["bucket"] + 1]).tolist()
        marked[first:behind] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=behind - first)
    return marked


def shared_anchors(sent: DataFrame) -> DataFrame:
    """(chunk, bucket, bits): for each chunk which of its probes meet a block of the index and occur in documents of different ids."""

    def run(table: pa.Table) -> pa.Table:
        packs = [np.frombuffer(p, "<u4") for p in table.column("probes").to_pylist()]
        seen = np.concatenate(packs)
        order = np.argsort(seen & np.uint32(_RES), kind="stable")
        seen = seen[order]
        first = np.flatnonzero(np.append(True, (seen[1:] ^ seen[:-1]) & np.uint32(_RES) != 0))
        marks = np.bitwise_or.reduceat(seen, first)
        sizes = np.diff(np.append(first, len(seen)))
        wanted = np.zeros(len(seen), bool)
        wanted[order] = np.repeat((marks >> np.uint32(30) & np.uint32(1) == 1) & ((sizes > 1) | (marks >> np.uint32(31) == 1)), sizes)
        return _answered(table, wanted, [len(p) for p in packs])

    return sent.groupBy("bucket").applyInArrow(run, ANSWERS)


def _met(chunks: DataFrame, answers: DataFrame, column: str) -> DataFrame:
    """Each chunk with what was answered to it; its parts together are no more than a bit for each of its own windows."""
    return chunks.join(answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(column)), "chunk", "left")


def _extended(chunk: Chunk, hits: list[dict], rolling: Rolling, block: int, width: int, buckets: int) -> np.ndarray:
    """Beginnings of the windows of ``width`` words around a hit, to both sides as far as the document goes."""
    if not hits:
        return np.zeros(0, np.int64)
    at, keys, first = _probed(chunk, rolling, block, buckets)
    hit = at[np.repeat(_marked(hits, keys >> 30), np.diff(np.append(first, len(at))))]
    near = np.zeros(len(chunk.words) + 1, np.int64)
    np.add.at(near, np.maximum(hit - (width - block), 0), 1)
    np.add.at(near, hit + 1, -1)
    begin, _ = chunk.windows(width)
    return begin[np.cumsum(near)[begin] > 0]


class Frames:
    """A chunk's windows of ``width`` words around hits, in the order of bucket and 128 bits of hash; equal ones stand together."""

    def __init__(self, chunk: Chunk, hits: list[dict], hasher: bulk.Hasher, block: int, width: int, buckets: int) -> None:
        rolling = Rolling(chunk.words, hasher)
        at = _extended(chunk, hits, rolling, block, width, buckets)
        a, b = rolling.two(at, width)
        bucket = (bulk.mix(a.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((b, a, bucket))
        self.at, a, b = at[order], a[order], b[order]
        self.ids = chunk.ids[chunk.owner[self.at]]
        self.first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(at)])
        # Of each distinct window: bucket, hash and the smallest id of this chunk.
        self.bucket, self.a, self.b = bucket[order][self.first], a[self.first], b[self.first]
        self.low = np.minimum.reduceat(self.ids, self.first) if len(at) else self.ids

    def repeated(self, found: list[dict]) -> np.ndarray:
        """Beginnings of the windows that a document with a smaller id has too, in another chunk (``found``) or in this one."""
        sizes = np.diff(np.append(self.first, len(self.at)))
        return self.at[np.repeat(_marked(found, self.bucket), sizes) | (self.ids > np.repeat(self.low, sizes))]


def frames(chunks: DataFrame, hits: DataFrame, block: int, width: int, buckets: int) -> DataFrame:
    """(bucket, chunk, frames): a chunk's distinct windows of ``width`` words around hits, each with 128 bits of hash and the smallest
    id that has it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = bulk.Hasher()
        for chunk, row in _chunks(batches, hasher):
            own = Frames(chunk, row["hits"] or [], hasher, block, width, buckets)
            if len(own.at):
                rows = list(_packs(row["chunk"], own.bucket, [own.a, own.b, own.low], 0))
                yield _batch(rows, [pa.int64(), pa.int64(), *[pa.binary()] * 3], ["bucket", "chunk", "a", "b", "low"])

    return _met(chunks, hits, "hits").mapInArrow(run, "bucket long, chunk long, a binary, b binary, low binary")


def first_owners(sent: DataFrame) -> DataFrame:
    """(chunk, bucket, bits): for each chunk which of its frames also stand in another chunk's document of a smaller id than all of its own."""

    def run(table: pa.Table) -> pa.Table:
        packs = [[np.frombuffer(p, np.int64) for p in table.column(c).to_pylist()] for c in ("a", "b", "low")]
        a, b, low = (np.concatenate(p) for p in packs)
        order = np.lexsort((b, a))
        a, b, ordered = a[order], b[order], low[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        least = np.repeat(np.minimum.reduceat(ordered, first), np.diff(np.append(first, len(a))))
        wanted = np.zeros(len(low), bool)
        wanted[order] = least < ordered
        return _answered(table, wanted, [len(p) for p in packs[0]])

    return sent.groupBy("bucket").applyInArrow(run, ANSWERS)


def _repeated(chunk: Chunk, hits: list[dict], found: list[dict], hasher: bulk.Hasher, block: int, width: int, buckets: int) -> np.ndarray:
    """True for each word that a repeat covers: windows that are confirmed, joined where they touch or overlap."""
    cover = np.zeros(len(chunk.words) + 1, np.int64)
    begin = Frames(chunk, hits, hasher, block, width, buckets).repeated(found)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + width, -1)
    return np.cumsum(cover)[:-1] > 0


def without_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, repeats, kept_text) of each row of ``docs`` (doc_id, text).

    A word is removed if it lies in a window of ``width`` words whose sequence also stands in a document with a smaller
    doc_id; what a document repeats only from itself stays. ``repeats`` holds the maximal runs of removed words as (first
    word, number of words), ``kept_text`` the others joined by one space. Words are runs of characters other than space
    and \\x09 to \\x0D. A null text counts as empty, texts shorter than the window lose nothing, a null doc_id comes after
    all others, and rows that share an id lose nothing to each other. An empty table gives an empty result; other
    columns are ignored.

    Every document is cut into blocks of half a window, (width + 1) // 2 words: any window holds one whole block of any
    document that it stands in. The blocks are the index, all rolling windows of a block's length the probes; both meet
    in buckets sized by the input. A probe that meets a block and occurs under different ids is an anchor, and all
    full windows around it are compared, each distinct one once per chunk of documents, for the smallest id that has
    it (128 bits of hash). A chunk sorts its windows alike each time, so what it is told of them is one bit for each. Confirmed windows that
    overlap make up the maximal repeats. A group of copies, however large,
    costs one entry per chunk; no pairs of documents are formed.
    """
    block = (width + 1) // 2
    chunks = settle(chunks_of(narrow(docs, "doc_id", "text")), "chunks")
    held = chunks.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, -(-held // BUCKET_BYTES))
    answers = settle(shared_anchors(probes(chunks, block, buckets)), "anchors")
    owners = settle(first_owners(frames(chunks, answers, block, width, buckets)), "owners")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = bulk.Hasher()
        for chunk, row in _chunks(batches, hasher):
            gone = _repeated(chunk, row["hits"] or [], row["found"] or [], hasher, block, width, buckets)
            rows = []
            for i, text in enumerate(chunk.texts):
                first, behind = chunk.offsets[i], chunk.offsets[i + 1]
                mine = gone[first:behind]
                edge = np.flatnonzero(np.diff(np.concatenate(([False], mine, [False])).astype(np.int8)))
                runs = [{"first": a, "n": b - a} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                words, kept, at = text.split(), [], 0  # bytes are split at the same characters
                for r in runs:
                    kept += words[at : r["first"]]
                    at = r["first"] + r["n"]
                kept = b" ".join(kept + words[at:] if at else words).decode("utf-8", "replace")
                doc_id = int(chunk.ids[i])
                rows.append((None if doc_id == LAST else doc_id, len(mine), int(mine.sum()), runs, kept))
            for start in range(0, len(rows), bulk.SLICE_ROWS):
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())])), pa.string()]
                yield _batch(rows[start : start + bulk.SLICE_ROWS], kinds, ["doc_id", "n_words", "n_removed", "repeats", "kept_text"])

    return _met(_met(chunks, answers, "hits"), owners, "found").mapInArrow(run, "doc_id long, n_words long, n_removed long, repeats array<struct<first: long, n: long>>, kept_text string")
