"""Conversation prefix trie: each conversation's first owned depth by binary search, owned chains as the tree, sums bottom-up over chains."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, words

BLOCK = 1024
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered(scratch: Scratch, rows: DataFrame, key: str, order: Sequence[Column], name: str) -> DataFrame:
    """rows with `pos`: the place (from 0) among the rows of their key.

    Rows are dealt by ranges of key and order, so that one key may lie in many
    tasks; each numbers its own, and the counts of the ranges before are added.
    """
    dealt = scratch.save(rows.repartitionByRange(key, *order).withColumn("range", F.spark_partition_id()), name)
    inside = dealt.withColumn("pos", F.row_number().over(Window.partitionBy("range", key).orderBy(*order)))
    counts = dealt.groupBy("range", key).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    start = counts.select("range", key, F.coalesce(before, F.lit(0)).alias("start"))
    return inside.join(start, ["range", key]).withColumn("pos", F.col("start") + F.col("pos") - 1).drop("range", "start")


def running(rows: DataFrame, key: str, at: str, columns: Sequence[str], fold: Callable, reverse: bool = False) -> DataFrame:
    """rows with each column folded (sums, xors) over the rows of its key up to `at`, or from it on with `reverse`.

    Blocks of `at` are folded by themselves, then the totals of the blocks
    before: no task needs the rows of one key together.
    """
    way = F.desc if reverse else F.asc
    rows = rows.withColumn("block", F.floor(F.col(at) / BLOCK))
    inside = Window.partitionBy(key, "block").orderBy(way(at)).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(key, "block").agg(*[fold(c).alias(c) for c in columns])
    outside = Window.partitionBy(key).orderBy(way("block")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "block", *[F.coalesce(fold(c).over(outside), F.lit(0)).alias(f"{c}_before") for c in columns])
    add = (lambda a, b: a.bitwiseXOR(b)) if fold is F.bit_xor else (lambda a, b: a + b)
    out = rows.withColumns({c: fold(c).over(inside) for c in columns}).join(before, [key, "block"])
    return out.withColumns({c: add(F.col(c), F.col(f"{c}_before")) for c in columns}).drop("block", *[f"{c}_before" for c in columns])


def rebuilt(scratch: Scratch, conversations: DataFrame, group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) and (conv_id, depth, a, b, words): conversations that begin with turns of the first conversation of their group.

    Conversation c gets the first h turns of conversation c - c % group, then its
    own turns behind its first h; h is crc32(decimal c) % heads. a and b: 128 bits
    of a turn's role and text.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")).where("conv_id is not null")
    # The texts themselves stay behind: a digest and the number of words are all that is shuffled.
    turns = turns.select("conv_id", "turn", "role", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), F.size(words(F.col("text"))).cast("long").alias("words"))
    turns = scratch.save(numbered(scratch, turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("a"), F.col("b")], "dealt").select("conv_id", "pos", "a", "b", "words"), "turns")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = scratch.save(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    first = turns.where(F.col("pos") < heads - 1).withColumnRenamed("conv_id", "base")
    lent = first.join(convs.select("conv_id", "base", "h"), "base").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "a", "b", "words")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), "a", "b", "words")
    return convs.select("conv_id", "length"), lent.unionByName(own)


def first_owned(scratch: Scratch, convs: DataFrame, prefixes: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv_id, length, first, above): the least depth at which a conversation is the smallest with its prefix (length + 1 if at none), and the owner one depth above.

    Members of a prefix get fewer as it grows, so what a conversation owns is
    all of its path from one depth on. Every round halves what is open for all
    conversations, by two joins: its prefix at the middle, that prefix's minimum.
    """
    most = convs.agg(F.max("length").alias("m")).first()["m"]
    state = convs.select("conv_id", "length", F.lit(0).cast("long").alias("lo"), (F.col("length") + 1).alias("hi"), F.lit(None).cast("long").alias("above"))
    for i in range(0 if most is None else (most + 1).bit_length()):
        mid = state.withColumn("depth", F.when(F.col("lo") < F.col("hi"), F.floor((F.col("lo") + F.col("hi")) / 2)))
        probed = mid.where("depth is not null").join(prefixes.select("conv_id", "depth", "a", "b"), ["conv_id", "depth"]).join(minima.select("depth", "a", "b", "owner"), ["depth", "a", "b"])
        own = F.col("owner") == F.col("conv_id")
        moved = probed.select("conv_id", "length", F.when(own, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(own, F.col("depth")).otherwise(F.col("hi")).alias("hi"), F.when(own, F.col("above")).otherwise(F.col("owner")).alias("above"))
        state = scratch.save(moved.unionByName(mid.where("depth is null").drop("depth")), f"search{i}")
        scratch.drop(f"search{i - 1}")
    return state.select("conv_id", "length", F.col("lo").alias("first"), "above")


def up_the_chains(scratch: Scratch, chains: DataFrame, columns: Sequence[str]) -> DataFrame:
    """chains (conv_id, up, columns) with each column summed over a chain and all chains below it.

    Bottom-up by doubling: in round k every chain adds its sum over the 2^k levels
    from it on to the chain 2^k above, so the rounds are the logarithm of the height.
    """
    t, i = scratch.save(chains, "up0"), 0
    while not t.where("up is not null").isEmpty():
        below = t.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(*[F.sum(c).alias(f"{c}_below") for c in columns])
        above = t.where("up is not null").select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        summed = t.join(below, "conv_id", "left").join(above, "up", "left")
        i += 1
        t = scratch.save(summed.select("conv_id", F.col("next").alias("up"), *[(F.col(c) + F.coalesce(f"{c}_below", F.lit(0))).alias(c) for c in columns]), f"up{i}")
        scratch.drop(f"up{i - 1}")
    return t.select("conv_id", *columns)


def end_digests(ends: DataFrame, most: int = 8192) -> DataFrame:
    """(conv_id, depth, ends_sha256) of rows (conv_id, depth, member): the hash of the members' decimal ids in ascending order, joined by commas.

    Rows are dealt by ranges, so that a node's members may lie in many tasks;
    each joins runs of up to `most` of them, and the runs of a node are hashed in
    order as they stream by: no task holds more than a run.
    """
    keys = ["conv_id", "depth"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv_id": at[0], "depth": at[1], "first": held[0], "n": len(held), "ids": ",".join(map(str, held))}], schema=RUNS)

        for b in batches:
            done = []
            for c, d, m in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if (c, d) != at or len(held) >= most:
                    if held:
                        done.append(row())
                    at, held = (c, d), []
                held.append(m)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if held:
            yield row()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        for b in batches:
            rows = []
            for c, d, ids in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if (c, d) != at:
                    if at is not None:
                        rows.append((*at, h.hexdigest()))
                    at, h = (c, d), hashlib.sha256(ids.encode())
                else:
                    h.update(f",{ids}".encode())
            yield batch(rows)
        if at is not None:
            yield batch([(*at, h.hexdigest())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*keys, "ends_sha256"])

    RUNS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
    dealt = ends.select(*keys, "member").repartitionByRange(*keys, "member").sortWithinPartitions(*keys, "member")
    joined = dealt.mapInArrow(runs, "conv_id long, depth long, first long, n long, ids string")
    # Equal members of two ranges can't be: a member ends at one node.
    return joined.repartition(*keys).sortWithinPartitions(*keys, "first").select(*keys, "ids").mapInArrow(digests, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, *, group: int = 20, heads: int = 4) -> DataFrame:
    """NODE rows of the trie of conversations (conv_id, turn, role, text) that are rebuilt by rebuilt().

    A node is a distinct sequence of the first `depth` turns (role, text); the
    root (depth 0) has none. conv_id: the smallest conversation that begins with
    it, its owner; n_convs: how many do. What one conversation owns is a chain;
    chains hang at nodes of others and so form a tree of their own, over which
    sums go bottom-up. n_leaves: childless nodes at or below; saved_tokens: over
    the nodes at or below, (n_convs - 1) times the words of their last text;
    ends_sha256: of the conversations that end here.

    Turns are in order of turn, null first; of equal turns by role, then by
    digest of the text. Null role or text: empty. Rows without conv_id: left out.
    Repeated rows: turns like others. Conversations without turns of their own
    left: what their group lends them, or the root alone. Long texts: whole.
    Empty table: no rows, not even a root. Other columns are ignored.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    convs, turns = rebuilt(scratch, conversations, group, heads)
    # A prefix is the set of its turns with their places: digests of turns are xored up to each.
    placed = turns.select("conv_id", "depth", F.xxhash64("depth", "a", "b").alias("a"), F.xxhash64("b", "depth", "a", F.lit(1)).alias("b"), "words")
    zero = F.lit(0).cast("long")
    prefixes = scratch.save(running(placed, "conv_id", "depth", ["a", "b"], F.bit_xor).unionByName(convs.select("conv_id", *[zero.alias(c) for c in ("depth", "a", "b", "words")])), "prefixes")
    minima = scratch.save(prefixes.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("words").alias("words")), "minima")
    found = scratch.save(first_owned(scratch, convs, prefixes, minima), "found")
    chains = found.where("first <= length")
    hung = chains.where("first > 0").select(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("depth"), F.col("conv_id").alias("child"))
    nodes = minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    own = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"))
    tails = hung.select("conv_id", F.col("depth").alias("length")).distinct().withColumn("goes_on", F.lit(True))
    each = chains.join(own, "conv_id").join(tails, ["conv_id", "length"], "left")
    each = each.select("conv_id", F.when(F.col("first") > 0, F.col("above")).alias("up"), "saved", F.when(F.col("goes_on"), 0).otherwise(1).cast("long").alias("leaves"))
    sums = scratch.save(up_the_chains(scratch, each, ["saved", "leaves"]), "sums")
    below = hung.join(sums.withColumnRenamed("conv_id", "child"), "child").groupBy("conv_id", "depth").agg(F.count("*").alias("hung"), F.sum("saved").alias("saved_below"), F.sum("leaves").alias("leaves_below"))
    rows = nodes.join(below, ["conv_id", "depth"], "left").join(chains, "conv_id")
    n_children = F.coalesce("hung", F.lit(0)) + (F.col("depth") < F.col("length")).cast("long")
    parent = F.when(F.col("depth") > F.col("first"), F.col("conv_id")).when(F.col("depth") > 0, F.col("above"))
    rows = rows.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", n_children.alias("n_children"), (F.coalesce("leaves_below", F.lit(0)) + (n_children == 0).cast("long")).alias("n_leaves"), (F.col("saved") + F.coalesce("saved_below", F.lit(0))).alias("saved_tokens"))
    rows = running(rows, "conv_id", "depth", ["n_leaves", "saved_tokens"], F.sum, reverse=True)
    ends = found.select(F.when(F.col("first") <= F.col("length"), F.col("conv_id")).otherwise(F.col("above")).alias("conv_id"), F.col("length").alias("depth"), F.col("conv_id").alias("member"))
    rows = rows.join(end_digests(ends), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in NODE.split(", ")])
