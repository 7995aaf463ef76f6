"""Prefix trie of conversations from padded matrices of turn ids; no group is held whole, however many share it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.spread import number_rows
from .frames import narrow, settle, spread_join

WIDTH = 16  # turns of one matrix; longer conversations go on in further matrices, found by the key of what came before
STRETCH = 1 << 14  # turns of a conversation that one group holds
MATRIX_ROWS = 1 << 15
IDS_IN_BLOCK = 1 << 13


def numbered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn_no, d1, d2, n_bytes): every turn at its place from 0, with 120 bits of the SHA-256 of role and text."""
    plain = narrow(conversations, conv, turn, role, text).toDF("conv_id", "turn", "role", "text").where("conv_id is not null")
    said, spoken = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, spoken), 256)
    light = plain.select("conv_id", "turn", digest.alias("_sha"), F.octet_length(spoken).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("_read"))
    half = lambda start: F.conv(F.substring("_sha", start, 15), 16, 10).cast("long")
    light = light.select("conv_id", "turn", half(1).alias("d1"), half(16).alias("d2"), "n_bytes", "_read")
    # Rows that repeat all of a turn are alike, so the order in which they were read may part them.
    placed = settle(number_rows(light, ["conv_id", "turn", "d1", "d2", "_read"], "_at").drop("_read", "turn"), "turns")
    starts = placed.groupBy("conv_id").agg(F.min("_at").alias("_first"), F.count("*").alias("n_turns"))
    stretched = placed.withColumn("_stretch", F.floor(F.col("_at") / STRETCH))
    met = stretched.select("conv_id", "_stretch").distinct().join(starts, "conv_id")
    return settle(stretched.join(met, ["conv_id", "_stretch"]).select("conv_id", (F.col("_at") - F.col("_first")).alias("turn_no"), "d1", "d2", "n_bytes", "n_turns"), "numbered")


def head_length(conv_id: Column, heads: int) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(heads)).cast("long")


def rebuilt(turns: DataFrame, group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, d1, d2, n_bytes, size) of the rebuilt conversations, and (conv_id, size) of all, turnless ones too.

    A conversation takes its first h turns from the one that begins its group of ``group`` ids, and its own from the h-th on.
    """
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(group))
    start = turns.where((F.col("turn_no") < heads - 1) & (F.col("conv_id") == base))
    bases = start.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("turn_no", "d1", "d2", "n_bytes"))).alias("first"))
    all_ids = turns.where("turn_no = 0").select("conv_id", "n_turns", base.alias("base"), head_length(F.col("conv_id"), heads).alias("h"))
    shaped = all_ids.join(bases, "base", "left").withColumn("first", F.coalesce(F.slice("first", F.lit(1), F.col("h").cast("int")), F.array()))
    shaped = shaped.withColumn("taken", F.size("first").cast("long"))
    shaped = settle(shaped.withColumn("size", F.col("taken") + F.greatest(F.lit(0), F.col("n_turns") - F.col("h"))), "shapes")
    front = shaped.select("conv_id", "size", F.explode("first").alias("t")).select("conv_id", F.col("t.turn_no").alias("pos"), "t.d1", "t.d2", "t.n_bytes", "size")
    own = turns.where(F.col("turn_no") >= head_length(F.col("conv_id"), heads)).withColumn("_stretch", F.floor(F.col("turn_no") / STRETCH))
    met = own.select("conv_id", "_stretch").distinct().join(shaped.select("conv_id", "h", "taken", "size"), "conv_id")
    rest = own.join(met, ["conv_id", "_stretch"]).select("conv_id", (F.col("turn_no") - F.col("h") + F.col("taken")).alias("pos"), "d1", "d2", "n_bytes", "size")
    return front.unionByName(rest), shaped.select("conv_id", "size")


def matrix_rows(flat: DataFrame) -> DataFrame:
    """(conv_id, block, p1, p2, x1, x2, ids, last): each conversation in blocks of ``WIDTH`` turns.

    A turn's id is a 128-bit hash of its place and content. The key of a prefix is the exclusive or of its turns' ids, which
    needs no order; p is the key before the block, x that of the block alone.
    """
    first, second = F.xxhash64("pos", "d1", "d2"), F.xxhash64(F.lit(1), "d2", "pos", "d1")
    # The lowest bit tells a turn from the padding.
    turns = flat.select(
        "conv_id", "size", F.floor(F.col("pos") / STRETCH).alias("stretch"), F.floor(F.col("pos") / WIDTH).alias("block"),
        F.struct("pos", first.bitwiseOR(F.lit(1)).alias("i1"), second.alias("i2"), "n_bytes").alias("id"),
    )
    blocks = turns.repartition("conv_id", "stretch").groupBy("conv_id", "stretch", "block").agg(
        F.array_sort(F.collect_list("id")).alias("ids"), F.bit_xor("id.i1").alias("x1"), F.bit_xor("id.i2").alias("x2"), F.max("size").alias("size")
    )
    blocks = settle(blocks, "blocks")
    whole = blocks.groupBy("conv_id", "stretch").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select("conv_id", "stretch", *[F.coalesce(F.bit_xor(f"s{i}").over(before), F.lit(0)).alias(f"s{i}") for i in (1, 2)])
    inside = Window.partitionBy("conv_id", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = blocks.select("*", *[F.coalesce(F.bit_xor(f"x{i}").over(inside), F.lit(0)).alias(f"w{i}") for i in (1, 2)])
    joined = within.join(starts, ["conv_id", "stretch"])
    last = F.col("block") == F.floor((F.col("size") - 1) / WIDTH)
    return settle(joined.select("conv_id", "block", *[F.col(f"w{i}").bitwiseXOR(F.col(f"s{i}")).alias(f"p{i}") for i in (1, 2)], "x1", "x2", "ids", last.alias("last"), "size"), "matrix-rows")


NODES = "depth long, k1 long, k2 long, q1 long, q2 long, conv_id long, n_convs long, n_bytes long"


def _matrix_nodes(conv: np.ndarray, block: np.ndarray, p1: np.ndarray, p2: np.ndarray, sizes: np.ndarray, parts: dict[str, np.ndarray]) -> pa.RecordBatch | None:
    """The nodes of one padded matrix: a row per conversation, a column per depth."""
    n, width = len(conv), int(sizes.max())
    inside = np.arange(width) < sizes[:, None]
    padded = {}
    for name, values in parts.items():
        padded[name] = np.zeros((n, width), np.int64)
        padded[name][inside] = values
    keys = [c for d in range(width - 1, -1, -1) for c in (padded["i2"][:, d], padded["i1"][:, d])]
    order = np.lexsort([*keys, p2, p1, block])
    conv, block, p1, p2, inside = conv[order], block[order], p1[order], p2[order], inside[order]
    padded = {name: values[order] for name, values in padded.items()}
    # A row starts a node of a depth where any column up to it differs from the row before: an OR down the columns.
    differs = np.ones((n, width + 1), bool)
    differs[1:, 0] = (block[1:] != block[:-1]) | (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])
    differs[1:, 1:] = (padded["i1"][1:] != padded["i1"][:-1]) | (padded["i2"][1:] != padded["i2"][:-1])
    starts = np.logical_or.accumulate(differs, axis=1)[:, 1:]
    k1 = np.bitwise_xor.accumulate(np.concatenate([p1[:, None], padded["i1"]], axis=1), axis=1)
    k2 = np.bitwise_xor.accumulate(np.concatenate([p2[:, None], padded["i2"]], axis=1), axis=1)
    found = []
    for d in range(width):
        rows = np.flatnonzero(inside[:, d])
        if not len(rows):
            continue
        at = np.flatnonzero(starts[rows, d])
        top = rows[at]
        members = np.diff(np.append(at, len(rows)))
        least = np.minimum.reduceat(conv[rows], at)
        found.append((block[top] * WIDTH + d + 1, k1[top, d + 1], k2[top, d + 1], k1[top, d], k2[top, d], least, members, padded["n_bytes"][top, d]))
    names = [x.split()[0] for x in NODES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)


def trie_nodes(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, q1, q2, conv_id, n_convs, n_bytes) of every node but the root: its key, its parent's, its smallest
    member and their number.

    Rows are dealt out by range of (block, key before, ids, conversation): a hot group fills several shards, each of which
    sorts and aggregates its own matrices. What matrices and shards have found of the same node is put together.
    """
    found = rows.select("block", "p1", "p2", F.transform("ids", lambda t: t["i1"]).alias("i1"), F.transform("ids", lambda t: t["i2"]).alias("i2"),
                        F.transform("ids", lambda t: t["n_bytes"]).alias("n_bytes"), "conv_id")
    shards = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            plain = {c: table.column(c).to_numpy() for c in ("block", "p1", "p2", "conv_id")}
            lists = {c: table.column(c).combine_chunks() for c in ("i1", "i2", "n_bytes")}
            sizes = lists["i1"].value_lengths().to_numpy()
            parts = {c: a.flatten().to_numpy() for c, a in lists.items()}
            return _matrix_nodes(plain["conv_id"], plain["block"], plain["p1"], plain["p2"], sizes, parts)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= MATRIX_ROWS:
                yield solved(held)
                held = []
        if held:
            yield solved(held)

    pieces = found.repartitionByRange(shards, "block", "p1", "p2", "i1", "conv_id").mapInArrow(run, NODES)
    return pieces.groupBy("depth", "k1", "k2").agg(
        F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("n_bytes").alias("n_bytes")
    )


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256, n_ends) from (depth, k1, k2, conv_id): SHA-256 of the ids in order, joined by commas.

    Ids are sorted by range over all nodes and joined to blocks of text where they lie; then the blocks of a node pass
    through one hash, one after the other. A digest cannot be split, but its task reads blocks and holds only one.
    """
    keys = ["depth", "k1", "k2"]
    shards = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
        d, a, b = (batch.column(i).to_numpy() for i in range(3))
        edge = np.flatnonzero((d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        for start, stop in zip(np.append(0, edge).tolist(), np.append(edge, len(d)).tolist(), strict=True):
            yield (int(d[start]), int(a[start]), int(b[start])), start, stop

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, IDS_IN_BLOCK):
                part = batch.slice(begin, IDS_IN_BLOCK)
                ids = part.column(3).to_pylist()
                rows = [(*key, ids[start], stop - start, ",".join(map(str, ids[start:stop]))) for key, start, stop in cut(part)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[*keys, "first", "n", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, n = None, None, 0
        for batch in batches:
            rows = []
            for key, start, stop in cut(batch) if batch.num_rows else ():
                if key != now:
                    if now is not None:
                        rows.append((*now, digest.hexdigest(), n))
                    now, digest, n = key, hashlib.sha256(), 0
                for i in range(start, stop):
                    digest.update((b"," if n else b"") + batch.column(5)[i].as_py().encode())
                    n += batch.column(4)[i].as_py()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[*keys, "ends_sha256", "n_ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, digest.hexdigest(), n)], names=[*keys, "ends_sha256", "n_ends"])

    ordered = ends.select(*keys, "conv_id").repartitionByRange(shards, *keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    blocks = ordered.mapInArrow(joined, "depth long, k1 long, k2 long, first long, n long, ids string")
    dealt = blocks.repartition(shards, *keys).sortWithinPartitions(*keys, "first")
    return dealt.mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string, n_ends long")


def subtree_totals(paths: DataFrame, root: int) -> DataFrame:
    """(conv_id, saved, leaves) summed over each path and all paths below, from (conv_id, up, saved, leaves).

    ``up`` is the conversation on whose path a path hangs. Jumps double: after round r a path has the sums of all paths
    less than 2**r steps below it and points 2**r steps up, so the rounds are the logarithm of the nesting.
    """
    now = settle(paths.select("conv_id", F.when(F.col("conv_id") != root, F.col("up")).alias("up"), "saved", "leaves"), "paths")
    while not now.where("up is not null").isEmpty():
        sums = now.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("_s"), F.sum("leaves").alias("_l"))
        # What points at the root is done after this step; the others learn where their target points.
        far = now.where(F.col("up") != root).select("conv_id", F.col("up").alias("_up"))
        jumps = spread_join(far, now.where("up is not null").select(F.col("conv_id").alias("_up"), "up"), ["_up"], "conv_id").select("conv_id", F.col("up").alias("_next"))
        added = now.join(sums, "conv_id", "left").join(jumps, "conv_id", "left")
        now = settle(
            added.select(
                "conv_id", F.col("_next").alias("up"), (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"),
                (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"),
            ),
            "paths",
        )
    return now.select("conv_id", "saved", "leaves")


def prefix_trie(conversations: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, n_ends) of every node of the
    trie of rebuilt conversations.

    ``conversations`` (conv_id, turn, role, text) are ordered by turn, null first; rows of one turn by the SHA-256 of role
    and text, and rows that repeat all of it are turns of their own. Null role or text becomes empty. Rows without
    conv_id are in no conversation. Conversation c is rebuilt from the first h turns of conversation c - pmod(c, group) (none
    if it is absent) and its own turns after its first h, h = crc32(decimal c) mod ``heads``. An empty table gives no nodes;
    other columns are ignored. Turns are told apart by 120 bits of their SHA-256, prefixes by 128 bits.

    A node is named by its smallest member and its depth. The nodes that a conversation names are a path to where it ends;
    a path hangs on a node of another, so sums over subtrees are sums along paths, and over the much smaller tree of
    paths. Every step is an aggregate with partial sums, a join on unique or salted keys, or a window over a bounded stretch.
    """
    turns = numbered_turns(conversations)
    flat, shapes = rebuilt(turns, group, heads)
    root = shapes.agg(F.min("conv_id").alias("c"), F.count("*").alias("n")).first()
    out = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, n_ends long"
    if root["c"] is None:
        return conversations.sparkSession.createDataFrame([], out)
    rows = matrix_rows(flat)
    zero = F.lit(0).cast("long")
    top = shapes.sparkSession.range(1).select(
        *[zero.alias(c) for c in ("depth", "k1", "k2")], *[F.lit(None).cast("long").alias(c) for c in ("q1", "q2")], F.lit(root["c"]).alias("conv_id"),
        F.lit(root["n"]).alias("n_convs"), zero.alias("n_bytes"),
    )
    nodes = settle(trie_nodes(rows).unionByName(top), "nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, ["depth", "k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("n_bytes")).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    nodes = settle(nodes, "nodes")

    paths = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "q1", "q2")).alias("first"), F.sum("own").alias("saved"), F.sum("leaf").alias("leaves"))
    paths = paths.select("conv_id", F.col("first.depth").alias("from"), (F.col("first.depth") - 1).alias("depth"), F.col("first.q1").alias("k1"), F.col("first.q2").alias("k2"), "saved", "leaves")
    paths = settle(paths, "paths")
    hung = spread_join(paths.where("from > 0"), nodes.select("depth", "k1", "k2", F.col("conv_id").alias("up")), ["depth", "k1", "k2"], "conv_id")
    hung = settle(hung.select("conv_id", "from", "up", "saved", "leaves").unionByName(paths.where("from = 0").select("conv_id", "from", F.lit(None).cast("long").alias("up"), "saved", "leaves")), "hung")
    totals = hung.select("conv_id", "from", "up").join(subtree_totals(hung.select("conv_id", "up", "saved", "leaves"), root["c"]), "conv_id")
    totals = settle(totals.where("up is not null"), "totals")

    # What a node learns from paths: the sums of those that hang on it, and, where its own path begins, whose path that hangs on.
    met = totals.select(F.col("up").alias("conv_id"), (F.col("from") - 1).alias("depth"), "saved", "leaves", F.lit(None).cast("long").alias("above"))
    met = met.unionByName(totals.select("conv_id", F.col("from").alias("depth"), zero.alias("saved"), zero.alias("leaves"), F.col("up").alias("above")))
    met = met.groupBy("conv_id", "depth").agg(F.sum("saved").alias("_s"), F.sum("leaves").alias("_l"), F.max("above").alias("above"))
    joined = nodes.join(met, ["conv_id", "depth"], "left")
    joined = joined.select(
        "conv_id", "depth", "k1", "k2", "n_convs", "n_children", (F.col("own") + F.coalesce("_s", zero)).alias("s"), (F.col("leaf") + F.coalesce("_l", zero)).alias("l"),
        F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"), F.floor(F.col("depth") / STRETCH).alias("stretch"),
    )
    joined = settle(joined, "joined")
    later = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    sums = joined.groupBy("conv_id", "stretch").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
    tails = sums.select("conv_id", "stretch", F.coalesce(F.sum("s").over(later), zero).alias("_s"), F.coalesce(F.sum("l").over(later), zero).alias("_l"))
    below = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = joined.withColumn("_is", F.sum("s").over(below)).withColumn("_il", F.sum("l").over(below)).join(tails, ["conv_id", "stretch"])

    ends = rows.where("last").select(F.col("size").alias("depth"), *[F.col(f"p{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"k{i}") for i in (1, 2)], "conv_id")
    ends = ends.unionByName(shapes.where("size = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id"))
    digests = end_digests(ends)
    empty = hashlib.sha256(b"").hexdigest()
    return summed.join(digests, ["depth", "k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("_il") + F.col("_l")).alias("n_leaves"), (F.col("_is") + F.col("_s")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), F.coalesce("n_ends", zero).alias("n_ends"),
    )
