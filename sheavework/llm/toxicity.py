"""Toxicity: a gap-weighted subsequence kernel on words with Nyström landmarks, and a support vector machine."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bulk
from .frames import narrow
from .language import held_out

SAMPLE_ROWS = 2000  # labelled rows of each class, about, that the machine is fitted on
POSITIVE_LANDMARKS, NEGATIVE_LANDMARKS = 32, 8
LANDMARK_BYTES = 10  # of a span that a landmark is made of
TRIED_SPANS = 400  # of the ranked spans, those that may become landmarks
INNER_SENTENCES = 4000  # sentences, about, that are not toxic and give all their spans to a round, not just the highest
DECAY = np.float32(0.8)  # weight of each byte that a subsequence of three spans
SHARPNESS = 3  # power of the normalised kernel, a kernel again, in which likeness of common endings counts for less
LIKE = 0.15  # landmarks are less alike than this
LONGEST = 28  # longer words are taken in overlapping windows of this many bytes
CACHED = 1_000_000  # word scores that a task remembers
_SENTENCE = re.compile(r"[.!?\n]+\s")


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts; starts, ends and text numbers of what is scored.

    These are the words without the ASCII punctuation at their ends and inside ("i.d.i.o.t"), runs of at least three single
    letters ("i d i o t") as one span, with and without the first, and windows of long words.
    """
    data, begins = bulk.joined([t.lower().encode("utf-8", "replace") for t in texts])
    solid = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    kept = solid | (data == 32) | ((data >= 9) & (data <= 13))
    begins = np.concatenate(([0], np.cumsum(kept)))[begins]
    data = data[kept]
    starts, ends, owner = bulk.words(data, begins)
    single = (ends - starts == 1) | ((ends - starts == 2) & (data[starts] >= 0xC3) & (data[starts] < 0xE0))
    step = np.diff(np.concatenate(([0], single.astype(np.int8), [0])))
    extra, at, size = [], [], len(data)
    for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
        if b - a >= 3 and owner[a] == owner[b - 1]:
            for begin in (a, a + 1):  # the first may be a word of its own, as in "a m o r o n"
                letters = np.concatenate([data[starts[k] : ends[k]] for k in range(begin, b)])
                extra.append(letters)
                at.append((size, size + len(letters), owner[a]))
                size += len(letters)
    if extra:
        data = np.concatenate([data, *extra])
        more = np.array(at, np.int64)
        starts, ends, owner = (np.concatenate((x, more[:, k])) for k, x in enumerate((starts, ends, owner)))
    long = ends - starts > LONGEST
    if long.any():
        stride = LONGEST // 2
        n = (ends[long] - starts[long] - 1) // stride
        at = np.repeat(starts[long], n) + stride * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        starts = np.concatenate((starts[~long], at))
        ends = np.concatenate((ends[~long], np.minimum(at + LONGEST, np.repeat(ends[long], n))))
        owner = np.concatenate((owner[~long], np.repeat(owner[long], n)))
    return data, starts, ends, owner


class SubsequenceKernel:
    """Normalised kernel values between byte strings and landmarks.

    The kernel counts common subsequences of three bytes, each weighted by ``DECAY`` to the number of bytes that it spans in
    either string. Strings of one length are worked on together, byte by byte.
    """

    def __init__(self, landmarks: list[bytes]) -> None:
        m = max(map(len, landmarks))
        table = np.zeros((len(landmarks), m), np.uint8)
        for row, mark in zip(table, landmarks, strict=True):
            row[: len(mark)] = np.frombuffer(mark, np.uint8)
        self.size, self.width = table.shape
        power = np.arange(m)[None, :] - np.arange(m)[:, None]
        self.spread = np.where(power >= 0, DECAY ** np.maximum(power, 0), 0).astype(np.float32)
        hits = (table[None] == np.arange(256)[:, None, None]) & (table[None] > 0)
        self.hits = hits.astype(np.float32) * DECAY * DECAY
        self.first = self.hits @ self.spread
        self.used = hits.any(axis=(1, 2))
        self.norms = np.sqrt([self.own(np.frombuffer(mark, np.uint8)[None])[0] for mark in landmarks]).astype(np.float32)

    def own(self, rows: np.ndarray) -> np.ndarray:
        """The kernel of each row with itself."""
        count, n = rows.shape
        power = np.arange(n)[None, :] - np.arange(n)[:, None]
        spread = np.where(power >= 0, DECAY ** np.maximum(power, 0), 0).astype(np.float32)
        one, two = np.zeros((count, n + 1), np.float32), np.zeros((count, n + 1), np.float32)
        total = np.zeros(count, np.float32)
        for k in range(n):
            hit = (rows == rows[:, k : k + 1]).astype(np.float32) * DECAY * DECAY
            total += (hit * two[:, :-1]).sum(axis=1)
            more = (hit * one[:, :-1]) @ spread
            two *= DECAY
            two[:, 1:] += more
            one *= DECAY
            one[:, 1:] += hit @ spread
        return total

    def against(self, rows: np.ndarray) -> np.ndarray:
        """Normalised values of equally long rows against all landmarks; rows shorter than three bytes give zeros."""
        out = np.zeros((len(rows), self.size), np.float32)
        if rows.shape[1] < 3:
            return out
        for start in range(0, len(rows), 2048):
            some = rows[start : start + 2048]
            one = np.zeros((len(some), self.size, self.width + 1), np.float32)
            two = np.zeros_like(one)
            total = np.zeros((len(some), self.size), np.float32)
            for k in range(rows.shape[1]):
                byte = some[:, k]
                hit = self.hits[byte]
                if k > 1:
                    total += np.einsum("abc,abc->ab", hit, two[:, :, :-1])
                if k < rows.shape[1] - 1:
                    if k:
                        two *= DECAY
                        two[:, :, 1:] += (hit * one[:, :, :-1]) @ self.spread
                    one *= DECAY
                    one[:, :, 1:] += self.first[byte]
            own = np.sqrt(np.maximum(self.own(some), 1e-12))
            out[start : start + 2048] = (total / (own[:, None] * self.norms)) ** SHARPNESS
        return out

    def of_strings(self, strings: list[bytes]) -> np.ndarray:
        out = np.zeros((len(strings), self.size), np.float32)
        lengths = np.array([len(s) for s in strings])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            out[at] = self.against(np.frombuffer(b"".join(strings[i] for i in at), np.uint8).reshape(len(at), n))
        return out


@dataclass
class ToxicityModel:
    """Landmarks, the machine's weights on kernel values with them, its bias, and the calibration of a text's score."""

    landmarks: list[bytes]
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


class TextScorer:
    """The decision of the highest-scoring span of each text. Distinct spans are scored once per task."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.kernel = SubsequenceKernel(model.landmarks)
        self.hasher = bulk.Hasher()
        self.known, self.values = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def _score(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.full(len(starts), self.model.bias, np.float32)
        lengths = ends - starts
        for n in np.unique(lengths):
            if n >= 3:
                at = np.flatnonzero(lengths == n)
                out[at] += self.kernel.against(data[starts[at][:, None] + np.arange(n)]) @ self.model.weights
        return out

    def decisions(self, texts: list[str]) -> np.ndarray:
        data, starts, ends, owner = word_spans(texts)
        result = np.full(len(texts), self.model.bias, np.float64)
        if not len(starts):
            return result
        keys, first, which = np.unique(self.hasher.slices(data, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        old = self.known[at] == keys if len(self.known) else np.zeros(len(keys), bool)
        scores = np.zeros(len(keys), np.float32)
        scores[old] = self.values[at[old]]
        fresh = np.flatnonzero(~old)
        scores[fresh] = self._score(data, starts[first[fresh]], ends[first[fresh]])
        if len(self.known) > CACHED:
            self.known, self.values = keys, scores
        else:
            joint = np.concatenate((self.known, keys[fresh]))
            by = np.argsort(joint)
            self.known, self.values = joint[by], np.concatenate((self.values, scores[fresh]))[by]
        np.maximum.at(result, owner, scores[which].astype(np.float64))
        return result


def _support_vectors(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    z = np.concatenate((x, np.ones((len(x), 1))), axis=1).astype(np.float64)
    w = np.zeros(z.shape[1])
    penalty = np.eye(len(w)) * ridge
    penalty[-1, -1] = 1e-6
    for _ in range(50):
        live = y * (z @ w) < 1
        zl, wl = z[live], weight[live]
        new = np.linalg.solve(penalty + (zl * wl[:, None]).T @ zl, (zl * wl[:, None]).T @ y[live])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w[:-1], float(w[-1])


def _platt(g: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through decisions and labels, lightly held back."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * g + b, -30, 30)))
        d, h = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-9)
        grad = np.array([(d * g).sum() + 1e-2 * (a - 1), d.sum() + 1e-4 * b])
        hess = np.array([[(h * g * g).sum() + 1e-2, (h * g).sum()], [(h * g).sum(), h.sum() + 1e-4]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def _spans_of(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct spans of three bytes and more; the number of the span and that of the text of each occurrence."""
    hasher, known, numbers, owners, base = bulk.Hasher(), {}, [], [], 0
    names: list[bytes] = []
    for group in bulk.text_batches(((t,) for t in texts)):
        data, starts, ends, owner = word_spans([t for (t,) in group])
        long = ends - starts > 2
        starts, ends, owner = starts[long], ends[long], owner[long]
        keys, first, which = np.unique(hasher.slices(data, starts, ends), return_index=True, return_inverse=True)
        place = np.empty(len(keys), np.int64)
        for k, (key, s, e) in enumerate(zip(keys.tolist(), starts[first].tolist(), ends[first].tolist(), strict=True)):
            if key not in known:
                known[key] = len(names)
                names.append(data[s:e].tobytes())
            place[k] = known[key]
        numbers.append(place[which])
        owners.append(owner + base)
        base += len(group)
    owner = np.concatenate([*owners, np.zeros(0, np.int64)]).astype(np.int64)
    by = np.argsort(owner, kind="stable")
    return names, np.concatenate([*numbers, np.zeros(0, np.int64)]).astype(np.int64)[by], owner[by]


def fit_texts(texts: list[str], toxic: np.ndarray, natural_share: float) -> ToxicityModel:
    """Fits on labelled texts. The sentences of a text carry its label, and a sentence speaks through one of its spans.

    Spans that toxic texts have and others lack become landmarks, with common spans of the others beside them. The machine
    learns from the witness of each toxic text's sentences, the span that it scores highest, and from the highest spans of the
    sentences that are not toxic; witnesses and machine are found in turn. Bounds of the fit, none of which touches what is scored:
    landmarks are the first ``LANDMARK_BYTES`` of their spans and come from the ``TRIED_SPANS`` highest ranked ones, and beside the
    highest span of every sentence all spans of about ``INNER_SENTENCES`` of them are learned from.
    """
    sentences, owner = [], []
    for i, t in enumerate(texts):
        own = [s for s in _SENTENCE.split(t) if s.strip()]
        sentences += own
        owner += [i] * len(own)
    owner = np.array(owner, np.int64)
    names, number, sentence = _spans_of(sentences)
    pairs = np.unique(owner[sentence] * len(names) + number) if len(number) else np.zeros(0, np.int64)
    marked = toxic[pairs // max(1, len(names))] == 1
    inside = np.bincount(pairs[marked] % max(1, len(names)), minlength=len(names))
    outside = np.bincount(pairs[~marked] % max(1, len(names)), minlength=len(names))
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    lift = np.log((inside + 0.1) / (n1 + 1)) - np.log((outside + 0.5) / (n0 + 1))
    # Ranked by how many toxic texts a span explains beyond what chance gives.
    ranked = [names[i] for i in np.lexsort((np.arange(len(names)), -inside * np.clip(lift, 0, 4))) if inside[i] and lift[i] > 0]
    marks: list[bytes] = []
    for w in ranked[:TRIED_SPANS]:
        w = w[:LANDMARK_BYTES]
        if len(marks) >= POSITIVE_LANDMARKS:
            break
        if not marks or SubsequenceKernel(marks).of_strings([w]).max() < LIKE:
            marks.append(w)
    common = np.lexsort((np.arange(len(names)), -outside))
    marks += [names[i][:LANDMARK_BYTES] for i in common[: NEGATIVE_LANDMARKS * 8 : 8] if outside[i]]
    marks = list(dict.fromkeys(marks)) or [b"none"]
    kernel = SubsequenceKernel(marks)
    k = kernel.of_strings(names)
    own = kernel.of_strings(marks)
    values, vectors = np.linalg.eigh((own + own.T) / 2 + 1e-4 * np.eye(len(marks)))
    root = vectors / np.sqrt(np.maximum(values, 1e-4))  # Nyström: features are kernel values times the inverse root
    features = k @ root.astype(np.float32)
    enough = 2 + 0.01 * n1
    counts = lift * np.where(inside > 1, 1.0, 0.3)
    telling = np.flatnonzero((inside > enough) & (lift > 3.0))
    inner = np.split(number, np.searchsorted(sentence, np.arange(1, len(sentences)))) if sentences else []
    decision, w, bias = counts, np.zeros(len(marks)), -1.0
    for _ in range(4):
        witness = np.array([s[decision[s].argmax()] if len(s) else -1 for s in inner], np.int64)
        height = np.where(witness >= 0, decision[witness], -np.inf)
        best: dict[int, int] = {}
        for j in np.flatnonzero(witness >= 0):
            if toxic[owner[j]] and (owner[j] not in best or height[j] > height[best[owner[j]]]):
                best[int(owner[j])] = int(j)
        good = np.union1d(witness[list(best.values())], telling) if best else telling
        plain = np.array([j for j in np.flatnonzero(witness >= 0) if not toxic[owner[j]]], np.int64)
        bad = np.unique(np.concatenate([witness[plain], *[inner[j] for j in plain[:: max(1, len(plain) // INNER_SENTENCES)]]])) if len(plain) else np.zeros(0, np.int64)
        good = np.setdiff1d(good, bad) if len(np.setdiff1d(good, bad)) else good
        if not len(good) or not len(bad):
            break
        rows = np.concatenate((good, bad))
        y = np.concatenate((np.ones(len(good)), -np.ones(len(bad))))
        # A witness counts as often as it is one; what one toxic text alone has counts for little.
        often = np.bincount(witness[list(best.values())], minlength=len(names)) * np.where(inside > enough, 1.0, 0.02)
        often = np.maximum(often, np.where(np.isin(np.arange(len(names)), telling), inside, 0))[good]
        weight = np.concatenate((0.5 * often / often.sum(), np.full(len(bad), 0.5 / len(bad)))) * 1000
        w, bias = _support_vectors(features[rows], y, weight)
        decision = features @ w + bias
    weights = (root @ w).astype(np.float32)
    model = ToxicityModel(marks, weights, bias, 1.0, 0.0)
    scorer = TextScorer(model)
    g = np.concatenate([scorer.decisions([t for _, t in group]) for group in bulk.text_batches(iter(enumerate(texts)))]) if texts else np.zeros(0)
    share = min(max(natural_share, 1e-3), 1 - 1e-3)
    weight = np.where(toxic == 1, share / n1, (1 - share) / n0) * len(texts)
    model.slope, model.shift = _platt(g, toxic.astype(float), weight)
    model.slope = max(model.slope, 0.0)
    return model


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fits on about ``sample_rows`` rows of each class of ``labelled`` (doc_id, text, toxic), taken by a hash of the id: a bounded
    sample of at least a millionth of a class, whose whole texts reach the driver."""
    rows = labelled.where("toxic in (0, 1) and text is not null")
    sizes = {int(r["toxic"]): r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for label, n in sizes.items():
        keep = keep | ((F.col("toxic") == label) & (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, sample_rows / n)))))
    few = rows.where(keep).select("doc_id", "text", "toxic").orderBy("doc_id", "text").collect()
    natural = sizes.get(1, 0) / max(1, sum(sizes.values()))
    return fit_texts([r["text"] for r in few], np.array([int(r["toxic"]) for r in few]), natural)


def scored(docs: DataFrame, model: ToxicityModel, *keep: str) -> DataFrame:
    """The kept columns of ``docs`` with score and predicted for its text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, "text")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        scorer = TextScorer(known)
        for batch in batches:
            parts = [scorer.decisions([t or "" for _, t in group]) for group in bulk.text_batches(iter(enumerate(batch.column(batch.num_columns - 1).to_pylist())))]
            g = np.concatenate([*parts, np.zeros(0)])
            score = 1 / (1 + np.exp(-np.clip(known.slope * g + known.shift, -30, 30)))
            columns = [*batch.columns[:-1], pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "score", "predicted"])

    return kept.mapInArrow(run, f"{out}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, rest: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, toxic).

    Rows whose id's checksum leaves ``rest`` are held out of learning. The score is a calibrated probability of the
    text's highest span; a null, empty or blank text has the score of a text without spans. Labels other than 0 and 1 and
    labels without a text are passed over; an id that has both labels counts as toxic. Repeated rows give repeated results; extra columns are ignored.
    """
    docs = narrow(docs, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), modulus, rest))
    marked = narrow(labels, "doc_id", "toxic").where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(~held_out(F.col("doc_id"), modulus, rest))
    model = fit(docs.where("not held_out").select("doc_id", "text").join(marked, "doc_id"))
    return scored(docs, model, "doc_id", "held_out")
