"""Near-duplicates: bottom-k sketches of one hash function, inverted lists, union-sketch estimates, exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spread import first_n, salted_join
from . import bulk
from .frames import components, narrow, pack, settle, small_side, unpack

SKETCH = 48  # values kept for estimates
LISTED = 32  # smallest of them, which go to the inverted lists
COLD = 32  # a list up to this length is taken pair by pair
COVERED = 18  # documents with so many values in such lists have all their partners there
RARE = 32  # a difference that so many members of a group have, at most, gives pairs
TYPICAL = 3  # members of a group that all others are compared with
STEP = 8  # shingles by which members of a group are binned
KIN = 0.25  # estimates from here on make a star's pair worth comparing
PAIR_SCHEMA = "a long, b long"
BATCH_ROWS = 256  # rows of whole texts or sets that go to Python at a time


def shingle_sets(texts: list[str | None], words: int, hasher: bulk.Hasher) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text; empty where a text has no word."""
    data, begins = bulk.joined([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    data = bulk.lowered(data)
    starts, ends, owner = bulk.words(data, begins)
    hashes = hasher.slices(data, starts, ends)
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
    n = len(hashes) - words + 1
    runs = bulk.combined([hashes[i : n + i] for i in range(words)]) if n > 0 else hashes[:0]
    sets = []
    for first, behind in zip(offsets[:-1], offsets[1:], strict=True):
        if behind - first >= words:
            sets.append(np.unique(runs[first : behind - words + 1]))
        elif behind > first:
            short = hashes[first:behind]
            sets.append(bulk.mix(bulk.combined([short[i : i + 1] for i in range(len(short))]) + np.uint64(len(short))))
        else:
            sets.append(hashes[:0])
    return sets


def _identity(values: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers of a set."""
    place = bulk.mix(np.arange(len(values), dtype=np.uint64)) | np.uint64(1)
    two = [bulk.mix((x * place).sum(keepdims=True) + np.uint64(len(values))) for x in (values, bulk.mix(values + np.uint64(1)))]
    return tuple(int(x.view(np.int64)[0]) for x in two)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, h1, h2, low, top): size and 128 bits of each document's shingle set, its smallest hashes as numbers for the
    lists, and the upper halves of its smallest hashes as bytes for estimates. One pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = bulk.Hasher()
        for group in bulk.text_batches(bulk.rows_of(batches)):
            sets = shingle_sets([t for _, t in group], words, hasher)
            first, second = zip(*map(_identity, sets), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in group], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(first, pa.int64()),
                    pa.array(second, pa.int64()),
                    pa.array([s[:LISTED].view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([(s[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets], pa.binary()),
                ],
                names=["doc_id", "n", "h1", "h2", "low", "top"],
            )

    return docs.mapInArrow(bulk.lean(run), "doc_id long, n long, h1 long, h2 long, low array<long>, top binary")


def with_set_ids(sketched: DataFrame) -> DataFrame:
    """``sketched`` with ``sid``, one number for each different set: a hash of its 128 bits, of which no two are alike."""
    kinds = settle(sketched.where("n > 0").select("h1", "h2").distinct(), "kinds")
    count, salt = kinds.count(), 0
    while kinds.select(F.xxhash64(F.lit(salt), "h1", "h2").alias("sid")).distinct().count() < count:
        salt += 1
    return sketched.withColumn("sid", F.xxhash64(F.lit(salt), "h1", "h2"))


def _members(pairs: DataFrame, docs: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """(sid, members): the whole shingle sets that the pairs (a, b) need, as ascending 64-bit hashes. Only their texts are read into sets."""
    needed = settle(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "needed")
    holders = sets.join(needed, "sid", "left_semi").select("doc_id", "sid")
    read = docs.join(small_side(holders.where("doc_id is not null").select("doc_id").distinct()), "doc_id", "left_semi")
    if holders.where("doc_id is null").limit(1).count():
        read = read.unionByName(docs.where("doc_id is null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = bulk.Hasher()
        for group in bulk.text_batches(bulk.rows_of(batches)):
            found = shingle_sets([t for _, t in group], words, hasher)
            first, second = zip(*map(_identity, found), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["h1", "h2", "members"])

    found = read.mapInArrow(bulk.lean(run), "h1 long, h2 long, members binary").dropDuplicates(["h1", "h2"])
    named = sets.join(needed, "sid", "left_semi").select("sid", "h1", "h2")
    return _in_small_batches(found.join(named, ["h1", "h2"]).select("sid", "members"), "sets")


def union_estimate(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Estimated Jaccard similarity: the share of the k smallest values of the union that both sketches hold."""
    both = np.full((len(left), 2 * SKETCH), 1 << 32, np.uint64)
    for half, raws in ((0, left), (1, right)):
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        both[:, half * SKETCH : (half + 1) * SKETCH][np.arange(SKETCH) < sizes[:, None]] = np.frombuffer(b"".join(raws), np.uint32)
    both.sort(axis=1)
    twice = both[:, 1:] == both[:, :-1]
    fresh = np.concatenate((np.ones((len(left), 1), bool), ~twice), axis=1) & (both < (1 << 32))
    inside = np.cumsum(fresh, axis=1) <= SKETCH
    shared = (twice & inside[:, 1:] & (both[:, 1:] < (1 << 32))).sum(axis=1)
    return shared / np.maximum(1, (fresh & inside).sum(axis=1))


def _likely(pairs: DataFrame, sets: DataFrame, percent: int, kin: float = 1.0) -> DataFrame:
    """Pairs whose estimate is not more than about five standard errors under the threshold, or at least ``kin``."""
    least = min(kin, percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / SKETCH) ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bulk.slices_of(batches):
            if batch.num_rows:
                good = union_estimate(batch.column(2).to_pylist(), batch.column(3).to_pylist()) >= least
                yield batch.select([0, 1]).filter(pa.array(good))

    tops = sets.select("sid", "top")
    met = pairs.join(tops.toDF("a", "top_a"), "a").join(tops.toDF("b", "top_b"), "b")
    return met.select("a", "b", "top_a", "top_b").mapInArrow(bulk.lean(run), PAIR_SCHEMA)


def _in_small_batches(df: DataFrame, label: str) -> DataFrame:
    """``settle`` with few rows in an Arrow batch, as each holds a whole text or two whole sets."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS)
    try:
        return settle(df, label)
    finally:
        conf.set(name, before)


def _linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bulk.slices_of(batches):
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n, m = len(x) // 8, len(y) // 8
                shared = n + m - len(np.unique(np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))))
                linked.append(100 * shared >= percent * (n + m - shared))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    pairs = settle(pairs, "pairs")
    found = _members(pairs, docs, sets, words)
    met = pairs.join(found.toDF("a", "set_a"), "a").join(found.toDF("b", "set_b"), "b")
    return _in_small_batches(met.select("a", "b", "set_a", "set_b").mapInArrow(bulk.lean(run), PAIR_SCHEMA), "linked")


def _differences(pairs: DataFrame, docs: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """(centre, sid, parts): the shingles that just one of centre and set has, for pairs (a: centre, b: sid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bulk.slices_of(batches):
            parts = [np.setxor1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True).view(np.int64) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.int64()))], names=["centre", "sid", "parts"])

    found = _members(pairs, docs, sets, words)
    met = pairs.join(found.toDF("a", "set_a"), "a").join(found.toDF("b", "set_b"), "b")
    return _in_small_batches(met.select("a", "b", "set_a", "set_b").mapInArrow(bulk.lean(run), "centre long, sid long, parts array<long>"), "differences")


def _alike_in_size(percent: int) -> F.Column:
    return (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)


def _groups_apart(groups: DataFrame, docs: DataFrame, sets: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Of the members of groups ``(centre, sid, n)``: (centre, sid, part, c), their differences from the centre that c > 1 members have, and
    (centre, sid, n, d, f, far): how many differences they have, how many that more than ``RARE`` members have, and how far they are from
    what most members of the group have in common."""
    apart = _differences(groups.select(F.col("centre").alias("a"), F.col("sid").alias("b")).where("a <> b"), docs, sets, words)
    entries = apart.select("centre", "sid", F.explode("parts").alias("part"))
    often = settle(entries.groupBy("centre", "part").agg(F.count("*").alias("c")).where("c > 1"), "often")
    members = groups.groupBy("centre").agg(F.count("*").alias("g"))
    most = often.join(members, "centre").groupBy("centre").agg(F.max("g").alias("g"), F.count_if(F.col("c") * 2 > F.col("g")).alias("own"))
    marked = settle(entries.join(often, ["centre", "part"]).join(most.select("centre", "g"), "centre"), "marked")
    shared = marked.groupBy("centre", "sid").agg(F.count_if(F.col("c") > RARE).alias("f"), F.count_if(F.col("c") * 2 > F.col("g")).alias("q"))
    sizes = apart.select("centre", "sid", F.size("parts").alias("d"))
    zero = F.lit(0).cast("long")
    known = groups.join(sizes, ["centre", "sid"], "left").join(shared, ["centre", "sid"], "left").join(most.select("centre", "own"), "centre", "left")
    known = known.select("centre", "sid", "n", *[F.coalesce(c, zero).alias(c) for c in ("d", "f", "q", "own")])
    return marked, settle(known.withColumn("far", F.col("d") - 2 * F.col("q") + F.col("own")).drop("q", "own"), "known")


def _typical_pairs(known: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each member with the ``TYPICAL`` members of its group that are nearest to what most have in common."""
    best = first_n(known, ["centre"], [F.col("far"), F.col("sid")], TYPICAL, "_r").select("centre", F.col("sid").alias("sid2"), F.col("n").alias("m"))
    met = salted_join(known, best, ["centre"], ["sid"]).where((F.col("sid") != F.col("sid2")) & _alike_in_size(percent))
    met = met.select(F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b")).distinct()
    return _with_roots(_with_roots(met, roots, "a", "ra"), roots, "b", "rb").where("ra <> rb").select("a", "b")


def _within_groups(marked: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of a group with different roots that their differences from the centre allow to be linked.

    Sets of n and m shingles are linked if they differ in at most t = (n + m) (100 - p) / (100 + p). With x and y differences from
    the centre, z of them in common, they differ in x + y - 2 z; so z must reach (x + y - t) / 2. Of common differences,
    those that more than ``RARE`` members have are at most as many as either set has of these; the others are counted exactly,
    in their short lists. So a pair is left out only if it cannot be linked. Pairs that need no rare difference in common are found by
    their numbers alone: those of a set and of the bins of sets that are few enough differences away. Any set may be the centre of a
    group; the more alike it is to the members, the fewer pairs are left.
    """
    other = known.select("centre", *[F.col(c).alias(d) for c, d in (("sid", "sid2"), ("n", "m"), ("d", "d2"), ("f", "f2"), ("root", "root2"))])
    whole, part = 100 + percent, 100 - percent
    short = (F.col("d") + F.col("d2")) * whole - (F.col("n") + F.col("m")) * part  # twice the z that is needed, times ``whole``

    listed = marked.where(F.col("c") <= RARE).join(known.select("centre", "sid", "root"), ["centre", "sid"])
    lists = listed.groupBy("centre", "part").agg(F.array_sort(F.collect_list(F.struct("sid", "root"))).alias("l"))
    later = lambda x, i: F.filter(F.slice("l", i + 2, RARE), lambda y: y["root"] != x["root"])
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(later(x, i), lambda y: F.struct(x["sid"].alias("sid"), y["sid"].alias("sid2")))))
    shared = lists.select("centre", F.explode(pairs).alias("p")).groupBy("centre", "p.sid", "p.sid2").agg(F.count("*").alias("r"))
    rare = shared.join(known, ["centre", "sid"]).join(other, ["centre", "sid2"])
    rare = rare.where(_alike_in_size(percent) & (2 * whole * (F.col("r") + F.least("f", "f2")) >= short)).select("sid", "sid2")

    # Without a rare one: u(x) + v(y) <= 0 for u = d - t / 2 and v = u - 2 f, both ways round, in whole numbers. The members of the largest
    # component of a group are found by the others.
    u, v = F.col("d") * whole - F.col("n") * part, F.col("u") - 2 * whole * F.col("f")
    placed = settle(known.withColumn("u", u).withColumn("v", v).withColumn("bin", F.floor(F.col("v") / (STEP * whole))), "placed")
    parts = placed.groupBy("centre", "root").agg(F.count("*").alias("c"), F.min("bin").alias("low"))
    main = parts.groupBy("centre").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.min("low").alias("low"))
    asking = placed.join(main, "centre").where("root <> main").withColumn("high", F.floor(-F.col("u") / (STEP * whole))).where("high >= low")
    asking = asking.select("centre", F.explode(F.sequence("low", "high")).alias("bin"), "sid", "n", "root", "d", "f", "u", "v")
    bins = placed.groupBy("centre", "bin").agg(F.count("*").alias("_n")).drop("_n")
    asking = asking.join(bins, ["centre", "bin"], "left_semi")
    facing = placed.select("centre", "bin", *[F.col(c).alias(d) for c, d in (("sid", "sid2"), ("n", "m"), ("root", "root2"), ("u", "u2"), ("v", "v2"))])
    plain = salted_join(facing, asking, ["centre", "bin"], ["sid2"]).where(
        (F.col("root") != F.col("root2")) & _alike_in_size(percent) & (F.col("u") + F.col("v2") <= 0) & (F.col("v") + F.col("u2") <= 0)
    )
    found = rare.unionByName(plain.select("sid", "sid2"))
    return found.select(F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b")).distinct()


def _with_roots(df: DataFrame, roots: DataFrame, key: str, out: str) -> DataFrame:
    return df.join(roots.toDF(key, "_root"), key, "left").withColumn(out, F.coalesce("_root", key)).drop("_root")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    Two documents are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of lower-cased word shingles; a
    component's id is its smallest doc_id, and the row with that id is kept. A text of fewer words is one shingle; a null,
    empty or blank text has none and is linked with nothing. Equal sets are linked without comparison and stand as one set
    from there on, so copies cost one row each. Repeated rows are rows of one component and are all kept or all dropped;
    a null doc_id is no one's smallest, and its row is kept only if its whole component has none. Extra columns are ignored.

    Candidates come from the lists of the retained values. First each list gives stars: its members of like size against
    the most typical of them, the centre, which contracts groups of copies without their pairs. Then every pair of a list of up to
    ``COLD`` members that are not yet in one component is tested. A document with ``COVERED`` or more of its values in
    such lists has all its partners there, as a partner lacks at most a fifth of them; the others are also tested within the
    groups around the centres of their long lists, as far as their differences from the centre allow a link (``_within_groups``). No
    list is cut. Equal sets are known by 128 bits; sets are compared by 64 bits of every shingle. Members of a hot list, or around a
    hot centre, meet its one row in joins whose rows Spark divides at run time (skew join).
    """
    docs = narrow(docs, "doc_id", "text")
    sketched = settle(with_set_ids(_in_small_batches(sketches(docs, words), "sketches")), "named")
    sets = settle(
        sketched.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "h1", "h2", "low", "top")]),
        "distinct",
    )
    bucket = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)))
    listed = sets.select("sid", "n", bucket.alias("bucket"), F.explode("low").alias("value"))
    lengths = listed.groupBy("value").agg(F.count("*").alias("length")).where("length > 1")
    lists = listed.join(lengths, "value")
    lists = settle(lists.join(lists.groupBy("sid").agg(F.sum("length").alias("weight")), "sid"), "lists")

    # Sets of like size share one of their two buckets.
    placed = lists.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)))
    centres = placed.groupBy("value", "bucket").agg(F.max_by("sid", F.struct("weight", "sid")).alias("centre"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    centres = settle(centres, "centres")
    stars = placed.join(centres, ["value", "bucket"]).where("centre <> sid").select(F.col("centre").alias("a"), F.col("sid").alias("b")).distinct()
    links = _linked(_likely(stars, sets, percent, KIN), docs, sets, words, percent)
    roots = settle(components(links), "roots")

    member = F.struct("n", "sid")
    cold = lists.where(F.col("length") <= COLD).groupBy("value").agg(F.array_sort(F.collect_list(member)).alias("l"))
    larger = lambda x, i: F.filter(F.slice("l", i + 2, COLD), lambda y: y["n"] * percent <= x["n"] * 100)
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(larger(x, i), lambda y: F.struct(F.least(x["sid"], y["sid"]).alias("a"), F.greatest(x["sid"], y["sid"]).alias("b")))))
    near = cold.select(F.explode(pairs).alias("p")).select("p.*").distinct()

    long = lists.where(F.col("length") > COLD).groupBy("sid").agg(F.count("*").alias("often"))
    # Values in no one else's list are as good as those of short lists: what counts is how many are in long ones.
    open_ = long.join(sets.select("sid", F.size("low").alias("k")), "sid").where(F.col("k") - F.col("often") < F.least(F.lit(COVERED), F.col("k"))).select("sid")
    hot = _with_roots(placed.where(F.col("length") > COLD).join(open_, "sid", "left_semi").select("value", "bucket", "sid", "n"), roots, "sid", "root")
    # Centres of one component stand for each other: the one that most lists have serves for all, so a group of copies is one group.
    of_group = _with_roots(centres, roots, "centre", "group")
    chosen = of_group.groupBy("group", "centre").agg(F.count("*").alias("c")).groupBy("group").agg(F.max_by("centre", F.struct("c", "centre")).alias("centre"))
    serving = settle(of_group.drop("centre").join(chosen, "group").select("value", "bucket", "centre"), "centres")
    groups = hot.join(serving, ["value", "bucket"]).select("centre", "sid", "n", "root").distinct()
    mixed = groups.groupBy("centre").agg(F.min("root").alias("_x"), F.max("root").alias("_y")).where("_x <> _y").select("centre")
    groups = settle(groups.join(mixed, "centre", "left_semi").drop("root"), "groups")
    marked, known = _groups_apart(groups, docs, sets, words)
    # The centres were chosen by lists; what lies nearest to the middle of a group links more of it.
    links = settle(links.unionByName(_linked(_likely(_typical_pairs(known, roots, percent), sets, percent), docs, sets, words, percent)), "links")
    roots = settle(components(links), "roots")
    known = settle(_with_roots(known, roots, "sid", "root").select("centre", "sid", "n", "d", "f", "root"), "known")
    rest = _within_groups(marked, known, percent)

    more = near.unionByName(rest).distinct()
    more = _with_roots(_with_roots(more, roots, "a", "ra"), roots, "b", "rb").where("ra <> rb").select("a", "b")
    found = _linked(_likely(more, sets, percent), docs, sets, words, percent)
    final = components(links.unionByName(found))

    named = sets.select("sid", "doc_id").join(final.toDF("sid", "root"), "sid")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined_ = named.join(least, "root").select("sid", "component_id")
    alone = sets.select("sid", F.col("doc_id").alias("own"))
    of_set = alone.join(joined_, "sid", "left").select("sid", F.when(F.col("component_id").isNull(), F.col("own")).otherwise(F.col("component_id")).alias("component_id"))
    out = sketched.where("n > 0").select("doc_id", "n", "sid").join(of_set, "sid")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = sketched.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of each component the one with the smallest doc_id.

    Rows that share a doc_id stay or go together. A row without a doc_id stays, as no id names it.
    """
    found = near_duplicates(docs, words, percent).where("doc_id is not null")
    gone = settle(found.groupBy("doc_id").agg(F.max("kept").alias("_stays")).where("not _stays").select("doc_id"), "gone")
    return unpack(pack(docs, ["doc_id"]).join(small_side(gone), "doc_id", "left_anti"), docs)
