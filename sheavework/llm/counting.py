"""Token counts by a linear longest-match automaton: a trie with failure links and counts of popped tokens."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bulk
from .frames import narrow
from .table import KeyTable

NO_WAY = -1


@dataclass
class Automaton:
    """Edges as (node * 256 + byte) to node; per node where to go on when no edge fits, and how many tokens that pops."""

    edges: np.ndarray
    targets: np.ndarray
    failure: np.ndarray
    popped: np.ndarray

    @staticmethod
    def of(pieces: list[bytes]) -> Automaton:
        """The automaton of a vocabulary. A piece that begins a word starts with a space; others go on within one."""
        children: list[dict[int, int]] = [{}]
        token = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    token.append(False)
                node = children[node][byte]
            token[node] = node > 0
        failure, popped = [NO_WAY] * len(children), [0] * len(children)
        level = [0]
        while level:  # by depth, so that all shorter strings are done
            below = []
            for node in level:
                for byte, child in children[node].items():
                    below.append(child)
                    if token[child]:
                        failure[child], popped[child] = 0, 1
                        continue
                    back, count = failure[node], popped[node]
                    while back != NO_WAY and byte not in children[back]:
                        count += popped[back]
                        back = failure[back]
                    if back != NO_WAY:
                        failure[child], popped[child] = children[back][byte], count
            level = below
        edges = [(node * 256 + byte, child) for node, own in enumerate(children) for byte, child in own.items()]
        keys, targets = zip(*edges, strict=True) if edges else ((), ())
        return Automaton(np.array(keys, np.uint64), np.array(targets, np.int64), np.array(failure), np.array(popped))


class Counter:
    """Numbers of greedy longest-match tokens of words, all words of a batch side by side."""

    def __init__(self, automaton: Automaton) -> None:
        self.a = automaton
        self.table = KeyTable(automaton.edges)
        self.hasher = bulk.Hasher()

    def _step(self, node: np.ndarray, count: np.ndarray, byte: np.ndarray) -> None:
        """Moves every word by one byte; where no edge fits, tokens are popped until one does. A word that nothing fits is
        marked by node -1 and is one unknown token."""
        todo = np.flatnonzero(node >= 0)
        while len(todo):
            at = self.table.find((node[todo] * 256 + byte[todo]).astype(np.uint64))
            hit = at >= 0
            node[todo[hit]] = self.a.targets[at[hit]]
            todo = todo[~hit]
            count[todo] += self.a.popped[node[todo]]
            node[todo] = self.a.failure[node[todo]]
            todo = todo[node[todo] >= 0]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word, which is read as a space and its bytes."""
        order = np.argsort(starts - ends, kind="stable")  # longest first, so that the live ones are a prefix
        starts, lengths = starts[order], (ends - starts)[order]
        node, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        self._step(node, count, np.full(len(starts), 32, np.int64))
        for k in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths, -k, side="left"))
            self._step(node[:live], count[:live], data[starts[:live] + k].astype(np.int64))
        live = np.flatnonzero(node > 0)
        while len(live):
            count[live] += self.a.popped[node[live]]
            node[live] = self.a.failure[node[live]]
            live = live[node[live] > 0]
        count[node < 0] = 1
        out = np.empty(len(order), np.int64)
        out[order] = count
        return out

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and words of each text; each distinct word is counted once."""
        data, begins = bulk.joined([t.encode("utf-8", "surrogatepass") for t in texts])
        starts, ends, owner = bulk.words(data, begins)
        _, first, which = np.unique(self.hasher.slices(data, starts, ends), return_index=True, return_inverse=True)
        counts = self.words(data, starts[first], ends[first])[which]
        tokens = np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)
        return tokens, np.bincount(owner, minlength=len(texts))


def byte_level_pieces(path: str) -> list[bytes]:
    """The pieces of a byte-level tokenizers file as bytes, without special tokens and those that hold white space inside."""
    import json

    from .bpe import _byte_symbols

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["content"] for t in content.get("added_tokens", [])}
    back = {c: b for b, c in enumerate(_byte_symbols())}
    found = [bytes(back[c] for c in piece) for piece in content["model"]["vocab"] if piece not in special]
    return [p for p in found if not set(p[1:]) & {9, 10, 11, 12, 13, 32} and p[:1] not in b"\t\n\x0b\x0c\r"]


def token_counts(docs: DataFrame, pieces: list[bytes]) -> DataFrame:
    """(doc_id, n_tokens, n_words) of each row of ``docs`` (doc_id, text).

    Words are runs without space and \\x09 to \\x0D. Tokens are taken greedily, the longest piece first: the first of a word
    among the pieces that begin with a space, the others among the rest; a word that the vocabulary cannot spell is one token. No
    piece is built: the automaton adds up how many it leaves behind, in time proportional to the word. Null, empty
    and blank texts have none; repeated rows repeat; extra columns are ignored. The vocabulary bounds what is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Automaton.of(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for group in bulk.text_batches(bulk.rows_of(batches)):
            tokens, words = counter.texts([t or "" for _, t in group])
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in group], pa.int64()), pa.array(tokens), pa.array(words)], names=["doc_id", "n_tokens", "n_words"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_words long")
