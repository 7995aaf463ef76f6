"""Byte-pair encoding of many words at once: the token ids of whole texts for a vocabulary with word ends."""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from . import bulk

# Code points from here on go to the tokenizer itself; below, character classes are those of the Unicode categories.
PLAIN_LIMIT = 0x2C00
# White space of Unicode, and the endings that the vocabulary's pattern takes before all else.
SPACES = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F)
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
BLANK, LETTER, NUMBER, OTHER = range(4)


def _byte_symbols() -> list[str]:
    """The printable stand-ins of bytes: those that print stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in own)
    moved = {b: chr(256 + i) for i, b in enumerate(others)}
    return [chr(b) if b in own else moved[b] for b in range(256)]


def _highest(text: str) -> int:
    return int(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).max(initial=0))


class WordEncoder:
    """Token ids of texts as a tokenizers file (BPE with ``</w>``, lower case, white space dropped) gives them.

    Texts are cut into words in numpy; each distinct word of a batch is merged once, all words of a length together, by
    the lowest merge rank first. Texts with characters beyond ``PLAIN_LIMIT`` and a few others go to the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, symbols = model["vocab"], _byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.final = np.array([vocab[c + "</w>"] for c in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        size = 1 << 20
        slot, self.keys = self._slots(keys, size), np.full(size, -1, np.int64)
        self.rank, self.merged = np.full(size, 1 << 40, np.int64), np.zeros(size, np.int64)
        todo = np.arange(len(keys))
        while len(todo):  # open addressing: who finds its slot taken moves on by one
            free = self.keys[slot[todo]] < 0
            first = np.unique(slot[todo][free], return_index=True)[1]
            placed = todo[free][first]
            self.keys[slot[placed]], self.rank[slot[placed]], self.merged[slot[placed]] = keys[placed], placed, merged[placed]
            todo = np.setdiff1d(todo, placed)
            slot[todo] = (slot[todo] + 1) % size
        self.classes = np.full(PLAIN_LIMIT, OTHER, np.uint8)
        for cp in range(PLAIN_LIMIT):
            kind = unicodedata.category(chr(cp))[0]
            self.classes[cp] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
        self.classes[list(SPACES)] = BLANK
        self.hasher = bulk.Hasher()

    @staticmethod
    def _slots(keys: np.ndarray, size: int) -> np.ndarray:
        return (bulk.mix(keys.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each pair; a slot of another key stands for no merge."""
        size = len(self.keys)
        slot = self._slots(keys, size)
        found = self.keys[slot]
        wrong = np.flatnonzero((found != keys) & (found >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) % size
            found = self.keys[slot[wrong]]
            wrong = wrong[(found != keys[wrong]) & (found >= 0)]
        return slot

    def _merge(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges rows of symbols of one length; returns the ids in row order and how many each row has."""
        rows, length = ids.shape
        sizes = np.full(rows, length, np.int64)
        result = ids.copy()
        live = np.arange(rows)
        while len(live) and length > 1:
            slots = self._lookup((ids[:, :-1] * self.width + ids[:, 1:]).ravel()).reshape(len(live), length - 1)
            ranks = self.rank[slots]
            ranks[np.arange(length - 1) >= (sizes[live] - 1)[:, None]] = 1 << 41
            at = ranks.argmin(axis=1)
            row = np.arange(len(live))
            go = ranks[row, at] < (1 << 40)
            done = ~go
            result[live[done], :length] = ids[done]
            ids, live, at, slots = ids[go], live[go], at[go], slots[go]
            if not len(live):
                break
            row = np.arange(len(live))
            ids[row, at] = self.merged[slots[row, at]]
            cols = np.arange(length - 1)
            ids[:, :-1] = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
            sizes[live] -= 1
            length = max(int(sizes[live].max()), 1)
            ids = ids[:, :length]
        if len(live):
            result[live, : ids.shape[1]] = ids
        return result[np.arange(result.shape[1]) < sizes[:, None]], sizes

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte slices, one after the other, and the offsets of each slice's ids."""
        lengths = ends - starts
        order, parts, counts = [], [], []
        for n in np.unique(lengths):
            picked = np.flatnonzero(lengths == n)
            for some in np.array_split(picked, max(1, len(picked) * int(n) // 2_000_000)):
                raw = data[starts[some][:, None] + np.arange(n)]
                ids = self.inner[raw]
                ids[:, -1] = self.final[raw[:, -1]]
                flat, sizes = self._merge(ids)
                order.append(some), parts.append(flat), counts.append(sizes)
        if not order:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        order, counts, flat = np.concatenate(order), np.concatenate(counts), np.concatenate(parts)
        begun = np.concatenate(([0], np.cumsum(counts)))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        ids, sizes = bulk.ragged(flat, begun, back)
        return ids, np.concatenate(([0], np.cumsum(sizes)))

    def _spans(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of the vocabulary's pattern, in code points."""
        kind = self.classes[points]
        edge = np.ones(len(points) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        for at in np.flatnonzero((points[:-1] == 39) & edge[:-2] & (kind[1:] == LETTER)):
            behind = "".join(map(chr, points[at : at + 3]))
            ending = next((e for e in ENDINGS if behind.startswith(e)), None)
            if ending:
                edge[at + 1] = False
                edge[at + len(ending)] = True
        bounds = np.flatnonzero(edge)
        starts, ends = bounds[:-1], bounds[1:]
        word = kind[starts] != BLANK
        return starts[word], ends[word]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, special tokens neither added nor seen in it."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        parts = [unicodedata.normalize("NFC", t).lower() for t in texts]
        # A final sigma, a special token's beginning, and characters beyond the limit, before or after lowering.
        odd = [i for i, t in enumerate(texts) if not t.isascii() and ("Σ" in t or _highest(t) >= PLAIN_LIMIT or _highest(parts[i]) >= PLAIN_LIMIT) or "<|" in t]
        for i in odd:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.int64)
            parts[i] = ""
        text = " ".join([*parts, ""])
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in parts])))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(points):
            return out
        starts, ends = self._spans(points)
        owner = np.searchsorted(begins, starts, side="right") - 1
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800)
        place = np.concatenate(([0], np.cumsum(width)))
        starts, ends = place[starts], place[ends]
        _, first, which = np.unique(self.hasher.slices(data, starts, ends), return_index=True, return_inverse=True)
        ids, offsets = self.encode_words(data, starts[first], ends[first])
        flat, sizes = bulk.ragged(ids, offsets, which)
        per_text = np.bincount(owner, weights=sizes, minlength=len(parts)).astype(np.int64)
        cut = np.cumsum(per_text)
        skip = set(odd)
        for i, piece in enumerate(np.split(flat, cut[:-1])):
            if i not in skip:
                out[i] = piece
        return out
