"""Language identification: interpolated Kneser-Ney character models in sorted hash arrays, with calibrated rejection."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import bulk
from .frames import narrow, pack, settle, unpack

ORDER = 4
MODEL_GRAMS = 2_000_000  # counts that the driver makes a model of at most; beyond it the model stays in tables
MODEL_BYTES = 128 << 20  # of a model, or of one of its parts, that a task holds
FOLDS = 2
HELD_GRAMS = 400_000  # grams that a task gathers before it passes them on
REJECT_SHARE = 0.0005  # of right documents, the share that may lie beyond the threshold
REJECT_ACCURACY = 100_000  # the rank of a threshold is right to this part of a language's documents
REJECT_MARGIN = 0.75  # and so many nats per character of slack
SHORT_SLACK = 4.0  # more of it for short texts, over the square root of their characters
UNKNOWN = "und"
_GAPS = re.compile(r"[\W\d_]+")


def plain_letters(text: str | None) -> str:
    """Lower-case letters, every other run of characters one space, with a space at both ends; empty without letters."""
    if not text:
        return ""
    inner = _GAPS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, inner)):
        return ""
    return f" {inner} "


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed 4-grams that end at each position but the first three, and the text that each belongs to.

    A gram is four 16-bit characters, the newest in the low bits. Characters beyond 16 bits are folded into them. Texts
    begin with three spaces, so that the first letters have a context.
    """
    padded = [f"  {t}" for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = (points ^ (points >> np.uint32(16)) * np.uint32(0x9E37)).astype(np.uint64) & np.uint64(0xFFFF)
    sizes = np.array([len(t) for t in padded], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    if len(points) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed = points[3:] | (points[2:-1] << np.uint64(16)) | (points[1:-2] << np.uint64(32)) | (points[:-3] << np.uint64(48))
    inside = owner[3:] == owner[:-3]
    return packed[inside], owner[3:][inside]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, fold, gram, n) over all texts of ``labelled`` (lang, fold, text): the whole corpus is counted, each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, fold), (keys, counts) in held.items():
                columns = [pa.repeat(lang, len(keys)), pa.repeat(pa.scalar(fold, pa.int32()), len(keys)), pa.array(keys.view(np.int64)), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "fold", "gram", "n"])

        for group in bulk.text_batches(bulk.rows_of(batches)):
            for kind in {r[:2] for r in group}:
                packed, _ = grams([t for t in (plain_letters(r[2]) for r in group if r[:2] == kind) if t])
                keys, counts = np.unique(packed, return_counts=True)
                if kind in held:
                    keys = np.concatenate((held[kind][0], keys))
                    keys, back = np.unique(keys, return_inverse=True)
                    counts = np.bincount(back, weights=np.concatenate((held[kind][1], counts))).astype(np.int64)
                held[kind] = [keys, counts]
            if sum(len(v[0]) for v in held.values()) > HELD_GRAMS:
                yield from out()
                held.clear()
        yield from out()

    found = labelled.select("lang", "fold", "text").mapInArrow(bulk.lean(run), "lang string, fold int, gram long, n long")
    return found.groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n"))


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def _summed(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    uniq, back = np.unique(keys, return_inverse=True)
    return uniq, np.bincount(back, weights=weights, minlength=len(uniq)).astype(np.float64)


def _at(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
    names, values = table
    if not len(names):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return np.where(names[at] == keys, values[at], missing)


class KneserNey:
    """Interpolated Kneser-Ney probabilities of one language from its 4-gram counts.

    The highest order takes counts, the lower ones numbers of distinct left neighbours; each order gives up the same discount per
    seen gram, and what it gives up is shared out by the order below, in the end evenly over the alphabet.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int) -> None:
        self.levels = []
        keys, counts = keys.astype(np.uint64), counts.astype(np.float64)
        for order in range(ORDER, 0, -1):
            discount = _discount(counts)
            context = keys >> np.uint64(16)
            total = _summed(context, counts)
            kinds = _summed(context)
            self.levels.append(((keys, counts), total, kinds, discount))
            shorter = keys & np.uint64((1 << 16 * (order - 1)) - 1)
            keys, counts = _summed(shorter)
        self.alphabet = alphabet

    def probability(self, grams_: np.ndarray) -> np.ndarray:
        result = np.full(len(grams_), 1.0 / self.alphabet)
        for order in range(1, ORDER + 1):
            table, total, kinds, discount = self.levels[ORDER - order]
            keys = grams_ & np.uint64((1 << 16 * order) - 1) if order < 4 else grams_
            context = keys >> np.uint64(16)
            whole = _at(total, context, 0.0)
            seen = np.maximum(_at(table, keys, 0.0) - discount, 0.0)
            left = discount * _at(kinds, context, 0.0)
            result = np.where(whole > 0, (seen + left * result) / np.maximum(whole, 1e-300), result)
        return result

    def share_below(self, order: int, context: np.ndarray) -> np.ndarray:
        """What the grams of an order give up behind each context: the weight of the order below, 1 where the context is unseen."""
        _, total, kinds, discount = self.levels[ORDER - order]
        whole = _at(total, context, 0.0)
        return np.where(whole > 0, discount * _at(kinds, context, 0.0) / np.maximum(whole, 1e-300), 1.0)


@dataclass
class LanguageModel:
    """Languages, and per order, from the highest, the sorted hashes of all grams with each language's log-probabilities, and
    those of all contexts with the logarithm of what each language hands down behind them.

    The entry of a gram of a lower order is its probability where no longer context was seen. A gram that no language has seen is
    looked up one order lower, and its context's weight is added. ``floor`` is what a character has that none has seen at all.
    """

    languages: list[str]
    hashes: list[np.ndarray]
    values: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: np.ndarray
    limits: list[float]

    def lookup(self) -> Lookup:
        return Lookup(self)


def named(keys: np.ndarray, order: int) -> np.ndarray:
    """Hashes of grams or contexts of an order."""
    return bulk.mix(keys + np.uint64(order))


class SortedHashes:
    """Finds hashes in a sorted array: the top bits of a hash point to a short run of entries."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.bits = max(1, int(len(hashes)).bit_length() + 1)
        tops = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.index = np.searchsorted(tops, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.index).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.index[(keys >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        found = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for step in range(self.longest):
            spot = at[todo] + step
            good = spot < len(self.hashes)
            todo, spot = todo[good], spot[good]
            same = self.hashes[spot]
            hit = same == keys[todo]
            found[todo[hit]] = spot[hit]
            todo = todo[same < keys[todo]]
            if not len(todo):
                break
        return found


class Lookup:
    """Log-probabilities of many grams at once, under all languages."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.grams = [SortedHashes(h) for h in model.hashes]
        self.contexts = [SortedHashes(h) for h in model.contexts]

    def sums(self, keys: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """Summed log-probabilities of the grams ``keys`` of each text under each language."""
        n = len(self.model.languages)
        sums = np.zeros((texts, n))

        def add(own: np.ndarray, values: np.ndarray, rows: np.ndarray) -> None:
            for k in range(n):
                sums[:, k] += np.bincount(own, weights=values[rows, k], minlength=texts)

        todo = np.arange(len(keys))
        for level, order in enumerate(range(ORDER, 0, -1)):
            part = keys[todo] & np.uint64((1 << 16 * order) - 1) if order < 4 else keys[todo]
            at = self.grams[level].find(named(part, order))
            hit = at >= 0
            add(owner[todo[hit]], self.model.values[level], at[hit])
            todo, part = todo[~hit], part[~hit]
            if order > 1 and len(todo):
                behind = self.contexts[level].find(named(part >> np.uint64(16), order))
                known = behind >= 0
                add(owner[todo[known]], self.model.weights[level], behind[known])
        sums += np.bincount(owner[todo], minlength=texts)[:, None] * self.model.floor
        return sums

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character of each text under each language; texts hold at least one character."""
        keys, owner = grams(texts)
        return -self.sums(keys, owner, len(texts)) / np.maximum(1, np.bincount(owner, minlength=len(texts)))[:, None]


PRIME = 1_000_003


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of a large model that a 4-gram is looked up in: by the two characters before its last, which the gram, the shorter gram
    and the contexts of both have in common."""
    return ((keys >> np.uint64(16)) & np.uint64(0xFFFFFFFF)) % np.uint64(PRIME) % np.uint64(parts)


@dataclass
class GramTables:
    """A model beyond what the driver holds: per order the tables (key, values) of a LanguageModel. Orders three and four are cut into ``parts``;
    the entries of shorter grams belong to each part."""

    languages: list[str]
    grams: list[DataFrame]
    contexts: list[DataFrame]
    floor: np.ndarray
    parts: int
    limits: list[float]

    def part(self, number: int) -> LanguageModel:
        """The arrays of one part, at most about ``MODEL_BYTES``."""

        def arrays(table: DataFrame, order: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
            if order > 2:
                pair = F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(0xFFFFFFFF)) if shift else F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
                table = table.where(pair % PRIME % self.parts == number)
            found = table.select("key", "values").toArrow()
            names = named(found.column("key").to_numpy().view(np.uint64), order)
            by = np.argsort(names)
            values = found.column("values").combine_chunks().flatten().to_numpy().reshape(-1, len(self.languages))
            return names[by], values[by].astype(np.float32)

        orders = range(ORDER, 0, -1)
        found = [arrays(t, o, 16) for t, o in zip(self.grams, orders, strict=True)]
        behind = [arrays(t, o, 0) for t, o in zip(self.contexts, orders, strict=False)]
        return LanguageModel(self.languages, [x for x, _ in found], [x for _, x in found], [x for x, _ in behind], [x for _, x in behind], self.floor, self.limits)


def gram_tables(counts: DataFrame, languages: list[str], part_bytes: int = MODEL_BYTES) -> GramTables:
    """The model of ``counts`` (lang, gram, n), all of them, worked out in Spark; the driver gets a few numbers per language and order."""
    each = lambda f: F.array(*[f(i) for i in range(len(languages))])
    count = lambda i: F.col("counts")[i]
    of_lang = lambda i: F.coalesce(F.sum(F.when(F.col("lang") == languages[i], F.col("n"))), F.lit(0).cast("long"))
    level, levels = settle(counts.groupBy(F.col("gram").alias("key")).agg(each(of_lang).alias("counts")), "level"), []
    for order in range(ORDER, 0, -1):
        context = level.groupBy(F.shiftrightunsigned("key", 16).alias("context")).agg(
            each(lambda i: F.sum(count(i))).alias("total"), each(lambda i: F.count_if(count(i) > 0)).alias("kinds"))
        seen = level.agg(each(lambda i: F.count_if(count(i) == 1)).alias("once"), each(lambda i: F.count_if(count(i) == 2)).alias("twice")).first()
        levels.append((order, level, settle(context, "contexts"), [a / (a + 2 * b) if a and b else 0.5 for a, b in zip(seen["once"], seen["twice"], strict=True)]))
        if order > 1:
            shorter = F.col("key").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))
            level = settle(level.groupBy(shorter.alias("key")).agg(each(lambda i: F.count_if(count(i) > 0)).alias("counts")), "level")
    alphabet = level.count() + 1
    tables, behind, lower, rows = [], [], None, 0
    for order, level, context, discounts in reversed(levels):
        # A context or a shorter gram has at most one row per character here, so no key is hot.
        both = level.withColumn("context", F.shiftrightunsigned("key", 16)).join(context, "context")
        if lower is None:
            both = both.withColumn("lower", each(lambda i: F.lit(1.0 / alphabet)))
        else:
            both = both.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1)))
            both = both.join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("lower")), "suffix")

        def p(i: int, discounts: list[float] = discounts) -> Column:
            whole, kinds, below = F.col("total")[i], F.col("kinds")[i], F.col("lower")[i]
            return F.when(whole > 0, (F.greatest(count(i) - discounts[i], F.lit(0.0)) + discounts[i] * kinds * below) / whole).otherwise(below)

        def weight(i: int, discounts: list[float] = discounts) -> Column:
            return F.when(F.col("total")[i] > 0, F.log(F.lit(discounts[i]) * F.col("kinds")[i] / F.col("total")[i])).otherwise(0.0)

        lower = settle(both.select("key", each(p).alias("p")), "probabilities")
        tables.insert(0, lower.select("key", F.transform("p", lambda x: F.log(x).cast("float")).alias("values")))
        weights = context.select(F.col("context").alias("key"), each(weight).cast("array<float>").alias("values"))
        if order > 1:
            behind.insert(0, weights)
        else:
            floor = np.array(weights.first()["values"], np.float64) - np.log(alphabet)
        rows += lower.count() + context.count()
    parts = max(1, -(-rows * (8 + 4 * len(languages)) // part_bytes))
    return GramTables(languages, tables, behind, floor, parts, [np.inf] * len(languages))


def _models(counts: DataFrame, max_grams: int) -> list[LanguageModel | GramTables]:
    """The model of all ``counts`` (lang, fold, gram, n), and for each fold that of the others, in arrays or in tables; both give the same
    values. The counts come to the driver once, if they are few enough."""
    sizes = counts.agg(F.count("*").alias("n"), F.count_distinct("gram").alias("g"), F.array_sort(F.collect_set("lang")).alias("l")).first()
    # Shorter grams and contexts are fewer than the longest grams, and mostly far fewer.
    if sizes["n"] <= max_grams and 3 * sizes["g"] * (8 + 4 * len(sizes["l"])) <= MODEL_BYTES:
        return _small_models(counts, sizes["l"])
    made = []
    for fold in (None, *range(FOLDS)):
        part = counts if fold is None else counts.where(F.col("fold") != fold)
        names = sizes["l"] if fold is None else sorted(r["lang"] for r in part.select("lang").distinct().collect())
        made.append(gram_tables(part.groupBy("lang", "gram").agg(F.sum("n").alias("n")), names))
    return made


def _small_models(counts: DataFrame, languages: list[str]) -> list[LanguageModel]:
    """Languages come as numbers, so that the driver holds no string per count."""
    number = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")) if languages else F.lit(0)
    table = counts.select(number.cast("byte").alias("lang"), F.col("fold").cast("byte").alias("fold"), "gram", "n").toArrow()
    lang, fold, gram, n = (table.column(c).to_numpy() for c in ("lang", "fold", "gram", "n"))
    made = []
    for left_out in (None, *range(FOLDS)):
        found = {}
        for k, name in enumerate(languages, start=1):
            own = (lang == k) & (fold != left_out) if left_out is not None else lang == k
            if own.any():
                found[name] = _summed(gram[own].view(np.uint64), n[own])
        made.append(_gram_arrays(found))
    return made


def fit(labelled: DataFrame, max_grams: int = MODEL_GRAMS) -> LanguageModel | GramTables:
    """A model of all texts of ``labelled`` (doc_id, lang, text); rows without language or letters are passed over.

    Counts cover every text and the model holds every gram. Up to ``max_grams`` counts and ``MODEL_BYTES`` it is made of arrays that are broadcast,
    beyond that of tables that are read in parts; both give the same values. Rejection limits come from texts that the model has not
    seen: rows fall into two folds by a hash of their text, and each is scored by a model of the other. The limit of a language is
    taken from all its rows that are recognised as it or, if none is, from all that bear its label; a language that the other fold
    lacks is scored by the whole model.
    """
    rows = labelled.where("lang is not null and text is not null").select("lang", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), "text")
    counts = settle(gram_counts(rows), "grams")
    model, *others = _models(counts, max_grams)
    if not model.languages:
        return model
    limit = lambda entropy: F.percentile_approx(entropy, 1 - REJECT_SHARE, REJECT_ACCURACY)
    right = F.when(F.col("lang") == F.col("lang_pred"), F.col("entropy"))

    def limits_of(seen: DataFrame) -> dict[str, float]:
        found = seen.groupBy("lang").agg(F.coalesce(limit(right), limit(F.col("entropy"))).alias("q"))
        return {r["lang"]: float(r["q"]) for r in found.collect() if r["q"] is not None}

    seen = None
    for fold, other in enumerate(others):
        part = scored(rows.where((F.col("fold") == fold) & F.col("lang").isin(other.languages)).select("lang", "text"), other, "lang")
        seen = part if seen is None else seen.unionByName(part)
    limits = limits_of(seen)
    if missing := [lang for lang in model.languages if lang not in limits]:
        limits |= limits_of(scored(rows.where(F.col("lang").isin(missing)).select("lang", "text"), model, "lang"))
    model.limits = [limits[lang] + REJECT_MARGIN for lang in model.languages]
    return model


def _gram_arrays(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
    """The model of each language's ascending 4-grams and their counts."""
    languages = sorted(counts)
    if not languages:
        none, empty = [np.zeros(0, np.uint64)] * ORDER, [np.zeros((0, 0))] * ORDER
        return LanguageModel([], none, empty, none[1:], empty[1:], np.zeros(0), [])
    all_keys = np.unique(np.concatenate([counts[lang][0] for lang in languages]))
    alphabet = len(np.unique(all_keys & np.uint64(0xFFFF))) + 1
    models = [KneserNey(*counts[lang], alphabet) for lang in languages]
    hashes, values, contexts, weights = [], [], [], []
    for order in range(ORDER, 0, -1):
        keys = np.unique(all_keys & np.uint64((1 << 16 * order) - 1) if order < 4 else all_keys)
        names = named(keys, order)
        by = np.argsort(names)
        hashes.append(names[by])
        # A gram of a lower order stands behind a context that no language has seen: the high part is set to one that none has.
        asked = keys[by] | np.uint64(((1 << 64) - 1) ^ ((1 << 16 * order) - 1)) if order < 4 else keys[by]
        values.append(np.stack([np.log(m.probability(asked)) for m in models], axis=1).astype(np.float32))
        if order > 1:
            behind = np.unique(keys >> np.uint64(16))
            names = named(behind, order)
            by = np.argsort(names)
            contexts.append(names[by])
            weights.append(np.stack([np.log(m.share_below(order, behind[by])) for m in models], axis=1).astype(np.float32))
    floor = np.array([np.log(m.share_below(1, np.zeros(1, np.uint64))[0] / alphabet) for m in models])
    return LanguageModel(languages, hashes, values, contexts, weights, floor, [np.inf] * len(languages))


def _scored_in_passes(docs: DataFrame, model: GramTables, *keep: str) -> DataFrame:
    """``scored`` for a model in tables: the texts are read once for each part of the model, every pass looks up the grams that belong
    to its part, and the sums of a text are added up. A text's grams never leave its task."""
    spark = docs.sparkSession
    kept = settle(docs.select(F.monotonically_increasing_id().alias("_id"), *keep, "text"), "texts")
    path = scratch_path(spark, "sums")
    parts = model.parts
    for number in range(parts):
        sent = spark.sparkContext.broadcast(model.part(number))

        def run(batches: Iterator[pa.RecordBatch], number: int = number, sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            lookup = sent.value.lookup()
            for group in bulk.text_batches(bulk.rows_of(batches)):
                group = [(i, letters) for i, t in group if (letters := plain_letters(t))]
                if not group:
                    continue
                keys, owner = grams([t for _, t in group])
                own = part_of(keys, parts) == number
                sums = lookup.sums(keys[own], owner[own], len(group))
                seen = np.bincount(owner[own], minlength=len(group))
                columns = [pa.array([i for i, _ in group], pa.int64()), pa.array(list(sums), pa.list_(pa.float64())), pa.array(seen), pa.array([len(t) for _, t in group], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "sums", "n", "size"])

        kept.select("_id", "text").mapInArrow(bulk.lean(run), "_id long, sums array<double>, n long, size long").write.parquet(f"{path}/pass={number}")
        sent.destroy()
    each = lambda f: F.array(*[f(i) for i in range(len(model.languages))])
    found = spark.read.parquet(path) if kept.limit(1).count() else spark.createDataFrame([], "_id long, sums array<double>, n long, size long")
    summed = found.groupBy("_id").agg(F.sum("n").alias("_n"), F.max("size").alias("_size"), each(lambda i: F.sum(F.col("sums")[i])).alias("_sums"))
    out = kept.join(summed, "_id", "left").withColumn("_h", F.transform("_sums", lambda x: -x / F.col("_n")))
    out = out.withColumn("_low", F.array_min("_h")).withColumn("_best", F.array_position("_h", F.col("_low")).cast("int"))
    share = 1 / F.aggregate("_h", F.lit(0.0), lambda a, x: a + F.exp(4 * (F.col("_low") - x)))
    name = F.element_at(F.array(*[F.lit(x) for x in model.languages]), F.col("_best"))
    limit = F.element_at(F.array(*[F.lit(float(x)) for x in model.limits]), F.col("_best"))
    known = F.col("_n").isNotNull()
    return out.select(
        *keep,
        F.when(known, name).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, share).otherwise(0.0).alias("score"),
        F.when(known, F.col("_low")).alias("entropy"),
        F.when(known, F.col("_low") > limit + SHORT_SLACK / F.sqrt("_size")).otherwise(True).alias("rejected"),
    )


def scored(docs: DataFrame, model: LanguageModel | GramTables, *keep: str) -> DataFrame:
    """The kept columns of ``docs`` (text and those) with lang_pred, score, entropy and rejected."""
    if isinstance(model, GramTables):
        return _scored_in_passes(docs, model, *keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, "text")
    schema = kept.schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        lookup = known.lookup()
        limits = np.array(known.limits)
        for batch in bulk.slices_of(batches):
            rows = list(enumerate(batch.column(batch.num_columns - 1).to_pylist()))
            n = batch.num_rows
            lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
            entropy, rejected = np.full(n, np.nan), np.ones(n, bool)
            for group in bulk.text_batches(iter(rows)):
                numbers, texts = [], []
                for i, t in group:
                    letters = plain_letters(t)
                    if letters and known.languages:
                        numbers.append(i), texts.append(letters)
                if not texts:
                    continue
                h = lookup.entropies(texts)
                at = np.array(numbers)
                best = h.argmin(axis=1)
                low = h[np.arange(len(h)), best]
                lang[at] = np.array(known.languages, object)[best]
                score[at] = 1 / np.exp(4 * (low[:, None] - h)).sum(axis=1)
                slack = SHORT_SLACK / np.sqrt([len(t) for t in texts])
                entropy[at], rejected[at] = low, low > limits[best] + slack
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "entropy", "rejected"],
            )

    return kept.mapInArrow(bulk.lean(run), out + ("," if out else "") + " lang_pred string, score double, entropy double, rejected boolean")


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """True where crc32 of the id as text leaves ``rest``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == rest


def predicted_languages(docs: DataFrame, modulus: int = 4, rest: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, entropy, rejected) of each row of ``docs`` (doc_id, text, lang).

    Models learn from rows that are not held out and have a language. The prediction is the language of the lowest
    cross-entropy per character; its score is the softmax share of the entropies. ``rejected`` says that even the best
    entropy lies beyond what documents of that language show. A text that is null or has no letter is ``und``, with
    score 0, and rejected; so is every text if nothing can be learned. Repeated rows give repeated results; ties go to
    the first language by name; extra columns are ignored.
    """
    docs = narrow(docs, "doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), modulus, rest))
    model = fit(docs.where("not held_out").select("doc_id", "lang", "text"))
    return scored(docs, model, "doc_id", "held_out")


def recognised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and others) that are not rejected, as they are; models learn from all rows
    that have a language. Texts without letters go, and texts beyond what any document of their language shows."""
    model = fit(narrow(docs, "doc_id", "lang", "text"))
    return unpack(scored(pack(docs, ["text"]), model, "_row").where("not rejected"), docs)
