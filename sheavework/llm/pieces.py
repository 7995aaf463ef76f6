"""SentencePiece encoding as a max-plus parallel scan, and decoding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bulk
from .frames import narrow, settle
from .table import KeyTable

SPACE = "▁"
CHUNK = 32_768  # characters of a chunk; longer texts go through the scan
NONE = -1e30
WORD_BYTES = 48 << 20  # segmented words that a task keeps
CHUNKS_A_TASK = 64
UNKNOWN_LOSS = 10.0  # below the lowest score, for a character that no piece holds


@dataclass
class Vocabulary:
    """Pieces with scores, and the pieces that stand for single bytes."""

    pieces: list[str]
    scores: np.ndarray
    ids: np.ndarray
    byte_ids: np.ndarray
    decoded: list[bytes]

    @staticmethod
    def load(path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces, ids, byte_ids, decoded = [], [], np.full(256, -1), []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:-1], 16)] = i
                decoded.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                decoded.append(b"")
            else:
                pieces.append(piece)
                ids.append(i)
                decoded.append(piece.replace(SPACE, " ").encode())
        return Vocabulary(pieces, np.array([model.get_score(i) for i in ids]), np.array(ids), byte_ids, decoded)


def marked(text: str) -> str:
    """The text as pieces see it: spaces as marks, with one mark in front; an empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def scan(matrices: np.ndarray) -> np.ndarray:
    """All prefix products of max-plus matrices, in logarithmically many rounds; the product is associative."""
    out, step = matrices.copy(), 1
    while step < len(out):
        out[step:] = (out[:-step, :, :, None] + out[step:, None, :, :]).max(axis=2)
        step *= 2
    return out


class Lattice:
    """Best segmentations. A state at a boundary is how many characters the piece across it reaches beyond it."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.longest = max(map(len, vocabulary.pieces))
        self.hasher = bulk.Hasher()
        sizes = np.array([len(p) for p in vocabulary.pieces])
        ends = np.cumsum(sizes)
        data = np.frombuffer("".join(vocabulary.pieces).encode("utf-32-le"), np.uint32)
        self.table = KeyTable(self.hasher.slices(data, ends - sizes, ends))
        self.loss = float(vocabulary.scores.min()) - UNKNOWN_LOSS
        # No piece holds a mark behind another character, so none crosses into a word and words are independent.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in vocabulary.pieces)
        self._forget()

    def _forget(self) -> None:
        """No word is known: sorted hashes, the place of each, and ids, offsets and scores by place."""
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.offsets, self.scores = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0)

    def each_word(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all slices, their numbers per slice, and scores. A word is segmented when a task meets it first; what
        the task knows is dropped when it passes ``WORD_BYTES``."""
        hashes, first, which = np.unique(self.hasher.slices(points, starts, ends), return_index=True, return_inverse=True)
        if self.ids.nbytes + self.scores.nbytes * 4 > WORD_BYTES:
            self._forget()
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != hashes[inside]
        if new.any():
            ids, offsets, scores = self.words(points, starts[first[new]], ends[first[new]])
            self.known = np.insert(self.known, at[new], hashes[new])
            self.place = np.insert(self.place, at[new], len(self.scores) + np.arange(len(scores)))
            self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
            self.offsets = np.concatenate((self.offsets, self.offsets[-1] + offsets[1:]))
            self.scores = np.concatenate((self.scores, scores))
        places = self.place[np.searchsorted(self.known, hashes)][which]
        flat, sizes = bulk.ragged(self.ids, self.offsets, places)
        return flat, sizes, self.scores[places]

    def steps(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, longest) scores and piece numbers of the slices that end behind each position, by length; single
        characters that are no piece have the loss of bytes and number -1."""
        n = len(points)
        sums = self.hasher.sums(points)
        scores = np.full((n, self.longest), NONE)
        numbers = np.full((n, self.longest), -1, np.int64)
        for size in range(1, min(self.longest, n) + 1):
            starts = np.arange(n - size + 1)
            at = self.table.find(self.hasher.of(sums, starts, starts + size))
            numbers[size - 1 :, size - 1] = at
            scores[size - 1 :, size - 1] = np.where(at >= 0, self.v.scores[at], NONE)
        scores[:, 0] = np.where(numbers[:, 0] >= 0, scores[:, 0], self.loss)
        return scores, numbers

    def _row_steps(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``steps`` of equally long slices."""
        count, n = rows.shape
        reach = min(self.longest, n)
        sums = self.hasher.sums(rows.ravel())
        scores, numbers = np.full((count, n, reach), NONE), np.full((count, n, reach), -1, np.int64)
        for size in range(1, reach + 1):
            starts = (np.arange(count)[:, None] * n + np.arange(n - size + 1)).ravel()
            at = self.table.find(self.hasher.of(sums, starts, starts + size)).reshape(count, -1)
            numbers[:, size - 1 :, size - 1] = at
            scores[:, size - 1 :, size - 1] = np.where(at >= 0, self.v.scores[at], NONE)
        scores[:, :, 0] = np.where(numbers[:, :, 0] >= 0, scores[:, :, 0], self.loss)
        return scores, numbers

    def transfer(self, points: np.ndarray, length: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """The matrix of best scores of a chunk of ``length`` characters from each state before it to each state behind,
        and the ids that all paths have in common.

        ``points`` holds the chunk and up to ``longest - 1`` characters that follow. No piece crosses into a word, so what
        lies between the first and the last word of the chunk adds one score, and the same ids, to all paths.
        """
        bounds = self._bounds(points, length)
        if len(bounds):
            first, end = int(bounds[0]), int(bounds[-1])
            head = self._swept(points[:first], first, True)[:, :1]
            tail = self._swept(points[end:], length - end, last)[:1]
            ids, _, scores = self.each_word(points, bounds[:-1], bounds[1:])
            return np.maximum(head + tail + float(scores.sum()), NONE), ids
        return self._swept(points, length, last), np.zeros(0, np.int32)

    def _bounds(self, points: np.ndarray, length: int) -> np.ndarray:
        """Where words begin inside the chunk, if words are independent."""
        mark = points[:length] == ord(SPACE)
        return np.flatnonzero(mark[1:] & ~mark[:-1]) + 1 if self.by_word else np.zeros(0, np.int64)

    def _swept(self, points: np.ndarray, length: int, last: bool) -> np.ndarray:
        """``transfer`` position by position; all entries go side by side."""
        wide = self.longest
        scores, _ = self.steps(points)
        best = np.full((len(points) + wide, wide), NONE)
        for entry in range(min(wide, length + 1)):
            best[entry + wide - 1, entry] = 0.0
        # best[p + wide - 1] belongs to position p; positions before the chunk are NONE.
        for p in range(1, len(points) + 1):
            back = np.arange(1, wide + 1)
            if p > length:
                back = back[p - back < length]
                if not len(back):
                    break
            got = (best[p + wide - 1 - back] + scores[p - 1, back - 1][:, None]).max(axis=0)
            best[p + wide - 1] = np.maximum(best[p + wide - 1] if p < wide and p <= length else NONE, got)
        out = np.full((wide, wide), NONE)
        for exit_ in range(wide if not last else 1):
            if length + exit_ <= len(points):
                out[:, exit_] = best[length + exit_ + wide - 1]
        return out

    def trace(self, points: np.ndarray, length: int, entry: int, exit_: int, common: np.ndarray) -> np.ndarray:
        """Ids of the best path through a chunk between two fixed states; ``common`` are those between its first and last word."""
        bounds = self._bounds(points, length)
        if not len(bounds):
            return np.array(self.path_ids(self.segment(points, entry, length + exit_), points), np.int64)
        first, end = int(bounds[0]), int(bounds[-1])
        head = self.path_ids(self.segment(points, entry, first), points)
        tail = self.path_ids(self.segment(points[end:], 0, length - end + exit_), points[end:])
        return np.concatenate((np.array(head, np.int64), common, np.array(tail, np.int64)))

    def segment(self, points: np.ndarray, entry: int, target: int) -> list[int]:
        """Piece numbers (or minus the position behind, for a character in bytes) of the best path between two positions."""
        scores, numbers = self.steps(points[:target])
        best, back = np.full(target + 1, NONE), np.zeros(target + 1, np.int64)
        best[entry] = 0.0
        for p in range(entry + 1, target + 1):
            reach = min(self.longest, p - entry)
            got = best[p - reach : p][::-1] + scores[p - 1, :reach]
            k = int(got.argmax())
            best[p], back[p] = got[k], k + 1
        path, p = [], target
        while p > entry:
            number = int(numbers[p - 1, back[p] - 1])
            path.append(number if number >= 0 else -p)
            p -= int(back[p])
        return path[::-1]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best paths of many slices of code points, those of a length side by side: ids, offsets per slice, scores."""
        lengths = ends - starts
        parts, order, counts, totals = [], [], [], []
        for n in np.unique(lengths).tolist():
            picked = np.flatnonzero(lengths == n)
            for some in np.array_split(picked, max(1, len(picked) * n // 400_000)):
                rows = data[starts[some][:, None] + np.arange(n)]
                scores, numbers = self._row_steps(rows)
                best = np.full((len(some), n + 1), NONE)
                back = np.zeros((len(some), n + 1), np.int64)
                best[:, 0] = 0
                for p in range(1, n + 1):
                    reach = min(self.longest, p)
                    got = best[:, p - reach : p][:, ::-1] + scores[:, p - 1, :reach]
                    k = got.argmax(axis=1)
                    best[:, p], back[:, p] = got[np.arange(len(some)), k], k + 1
                at, ids, width = np.full(len(some), n), np.full((len(some), n), -2, np.int64), np.zeros(len(some), np.int64)
                live = np.arange(len(some))
                while len(live):
                    p = at[live]
                    ids[live, p - 1] = numbers[live, p - 1, back[live, p] - 1]
                    width[live] += 1
                    at[live] = p - back[live, p]
                    live = live[at[live] > 0]
                flat, sizes = self._ids(ids, rows, width)
                parts.append(flat), order.append(some), counts.append(sizes), totals.append(best[:, n])
        if not order:
            return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0)
        order, counts, flat, total = (np.concatenate(x) for x in (order, counts, parts, totals))
        begun = np.concatenate(([0], np.cumsum(counts)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids, sizes = bulk.ragged(flat, begun, place)
        return ids, np.concatenate(([0], np.cumsum(sizes))), total[place]

    def _ids(self, numbers: np.ndarray, rows: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary ids of rows of piece numbers (-2: nothing ends here, -1: a character in bytes)."""
        plain = numbers >= 0
        if not (numbers == -1).any():
            return self.v.ids[numbers[plain]], width
        row, _ = ends = np.nonzero(numbers != -2)
        number, point = numbers[ends], rows[ends]
        odd = number == -1
        # A character in bytes takes as many ids as UTF-8 takes bytes for it.
        sizes = np.where(odd, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), 1)
        at = np.cumsum(sizes) - sizes
        found = np.empty(int(sizes.sum()), np.int64)
        found[at[~odd]] = self.v.ids[number[~odd]]
        for p in np.unique(point[odd]).tolist():
            here = at[odd & (point == p)]
            for k, b in enumerate(chr(p).encode("utf-8", "surrogatepass")):
                found[here + k] = self.v.byte_ids[b]
        return found, np.bincount(row, weights=sizes, minlength=len(numbers)).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids and scores of whole texts. Each distinct word is segmented once, if words are independent."""
        seen = [marked(t) for t in texts]
        points = np.frombuffer("".join(seen).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.concatenate(([0], np.cumsum([len(t) for t in seen]))).astype(np.int64)
        cut = np.zeros(len(points), bool)
        cut[begins[:-1][begins[:-1] < len(points)]] = True
        if self.by_word:
            mark = points == ord(SPACE)
            cut[1:] |= mark[1:] & ~mark[:-1]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        flat, sizes, scores = self.each_word(points, starts, ends)
        owner = np.searchsorted(begins, starts, side="right") - 1
        per_text = np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)
        return np.split(flat, np.cumsum(per_text)[:-1]), np.bincount(owner, weights=scores, minlength=len(texts))

    def path_ids(self, path: list[int], points: np.ndarray) -> list[int]:
        out = []
        for number in path:
            if number >= 0:
                out.append(int(self.v.ids[number]))
            else:
                out += [int(self.v.byte_ids[b]) for b in chr(points[-number - 1]).encode("utf-8", "surrogatepass")]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids; the mark in front is taken off."""
        text = b"".join(map(self.v.decoded.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")
        return text.removeprefix(" ")


ENCODED = "key long, chunk int, ids array<int>, score double"


def encoded(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids, score) of each row of ``docs`` (doc_id, text): the segmentation of the highest summed piece score.

    A text of up to ``chunk`` characters is encoded in one go. A longer one is split into chunks; each yields the matrix of
    best scores between the states at its two boundaries, the matrices of a text are scanned, which fixes the state at every
    boundary, and then each chunk traces its own path back. So no task works through a giant text; only its ids meet again.
    Null and empty texts have no ids; of equally good segmentations any may come; repeated rows repeat; extra columns are ignored.
    """
    vocabulary = Vocabulary.load(path)
    chunk = max(chunk, *map(len, vocabulary.pieces))  # a piece reaches into the next chunk, never over it
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = narrow(docs, "doc_id", "text")
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(sent.value)
        for group in bulk.text_batches(bulk.rows_of(batches)):
            ids, scores = lattice.encode([t or "" for _, t in group])
            sizes = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            values = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in group], pa.int64()), column, pa.array(scores)], names=["doc_id", "ids", "score"])

    plain = short.mapInArrow(whole, "doc_id long, ids array<int>, score double")
    giant = settle(rows.where(F.length("text") > chunk).withColumn("key", F.monotonically_increasing_id()), "giants")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = max(map(len, sent.value.pieces))
        for key, text in bulk.rows_of(batches):
            seen = marked(text)
            for k, start in enumerate(range(0, len(seen), chunk)):
                ahead = seen[start : start + chunk + longest - 1]
                size = min(chunk, len(seen) - start)
                yield pa.RecordBatch.from_pydict({"key": [key], "chunk": pa.array([k], pa.int32()), "size": [size], "last": [start + chunk >= len(seen)], "part": [ahead]})

    chunks = settle(giant.select("key", "text").mapInArrow(cut, "key long, chunk int, size long, last boolean, part string"), "chunks")
    tasks = max(1, -(-chunks.count() // CHUNKS_A_TASK))
    chunks = chunks.repartition(tasks, "key", "chunk")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(sent.value)
        for key, k, size, last, part in bulk.rows_of(batches):
            points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            matrix, common = lattice.transfer(points, size, last)
            yield pa.RecordBatch.from_pydict({"key": [key], "chunk": pa.array([k], pa.int32()), "size": [size], "part": [part], "matrix": [matrix.tobytes()], "common": [common.tobytes()]})

    def states(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        wide = int(np.sqrt(len(frame["matrix"].iloc[0]) // 8))
        each = np.stack([np.frombuffer(m).reshape(wide, wide) for m in frame["matrix"]])
        best = scan(each)[:, 0, :]  # from state 0 before the first chunk to each state behind each chunk
        exits = np.zeros(len(each), np.int64)
        for k in range(len(each) - 2, -1, -1):
            exits[k] = int((best[k] + each[k + 1][:, exits[k + 1]]).argmax())
        return pd.DataFrame({"key": frame["key"], "chunk": frame["chunk"], "entry": np.append(0, exits[:-1]).astype("int32"), "exit": exits.astype("int32"), "score": best[-1, 0]})

    # What all paths of a chunk have in common is kept beside its matrix, so its words are segmented once.
    measured = settle(chunks.mapInArrow(matrices, "key long, chunk int, size long, part string, matrix binary, common binary"), "matrices")
    fixed = measured.select("key", "chunk", "matrix").groupBy("key").applyInPandas(states, "key long, chunk int, entry int, exit int, score double")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(sent.value)
        for key, k, size, part, common, entry, exit_, score in bulk.rows_of(batches):
            points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            ids = lattice.trace(points, size, entry, exit_, np.frombuffer(common, np.int32))
            yield pa.RecordBatch.from_pydict({"key": [key], "chunk": pa.array([k], pa.int32()), "ids": pa.array([ids.astype(np.int32)], pa.list_(pa.int32())), "score": [score]})

    paths = measured.join(fixed, ["key", "chunk"]).select("key", "chunk", "size", "part", "common", "entry", "exit", "score").mapInArrow(traced, ENCODED)
    met = paths.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("all"), F.first("score").alias("score"))
    long = giant.select("doc_id", "key").join(met, "key").select("doc_id", F.flatten("all.ids").alias("ids"), "score")
    return plain.unionByName(long)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""
    sent = tokens.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(sent.value)
        for batch in batches:
            texts = [lattice.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return narrow(tokens, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, text_crc32, score) of encoded rows; text_crc32 is that of the decoded text."""
    sent = tokens.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(sent.value.decoded, object)
        for batch in batches:
            values, offsets = batch.column(1).flatten().to_numpy(), batch.column(1).offsets.to_numpy()
            offsets = offsets - offsets[0]
            each = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            texts = [b"".join(table[x]).removeprefix(b" ") for x in each]
            columns = [batch.column(0), pa.array([len(x) for x in each], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64()), pa.array([zlib.crc32(t) for t in texts], pa.int64()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_ids", "ids_crc32", "text_crc32", "score"])

    return tokens.select("doc_id", "ids", "score").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text_crc32 long, score double")
