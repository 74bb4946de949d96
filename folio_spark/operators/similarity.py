"""Similar works: rarity-weighted shared attributes of every pair, by blocks of works, the best few of each and why."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import idf
from .lineage import Rounds, cut

# How much each relation weighs.
WEIGHTS = {"series": 5.0, "contributor": 3.0, "tag": 2.0, "subject": 1.0}


@dataclass(frozen=True)
class Options:
    """weights by relation (others: 1); values that over max(2, share of all works) hold count nothing; bonuses for a language in common and for being held; subjects count up to `depth` hops up and one down, a hop at `decay`."""

    weights: Mapping[str, float] = field(default_factory=lambda: WEIGHTS)
    max_share: float = 0.2
    language: float = 20.0
    held: float = 0.3
    depth: int = 2
    decay: float = 0.5
    tree: str = "subject"


def expanded(attrs: DataFrame, edges: DataFrame | None, o: Options) -> DataFrame:
    """(work_id, rel, value, hop) of attrs (work_id, rel, value): itself at 1, and values of the tree relation around it at their best decay.

    edges: (child, parent). Upwards decay ** hops to o.depth hops, one hop down decay.
    """
    own = attrs.withColumn("hop", F.lit(1.0))
    if edges is None or o.depth <= 0:
        return own
    edges = cut(edges.select("child", "parent").distinct())
    terms = attrs.where(F.col("rel") == o.tree).select(F.col("value").alias("term")).distinct()
    near = terms.join(edges, F.col("term") == F.col("parent")).select("term", F.col("child").alias("value"), F.lit(o.decay).alias("hop"))
    step = terms.select("term", F.col("term").alias("value"))
    for hop in range(1, o.depth + 1):
        step = step.join(edges, F.col("value") == F.col("child")).select("term", F.col("parent").alias("value")).distinct()
        near = near.unionByName(step.withColumn("hop", F.lit(o.decay**hop)))
    near = near.groupBy("term", "value").agg(F.max("hop").alias("hop"))
    more = attrs.where(F.col("rel") == o.tree).withColumnRenamed("value", "term").join(near, "term").select("work_id", "rel", "value", "hop")
    return own.unionByName(more).groupBy("work_id", "rel", "value").agg(F.max("hop").alias("hop"))


def packing():
    """Functions that make bytes of a table and a table of bytes, and give a column as an array; nested, so that tasks need no module of this repository."""

    def dump(t: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(t)
        return sink.getvalue().to_pybytes()

    def load(b: bytes) -> pa.Table:
        return pa.ipc.open_stream(b).read_all()

    def flat(t: pa.Table, name: str) -> np.ndarray:
        return t.column(name).to_numpy()

    return dump, load, flat


def under_keys(weights: Mapping[str, float]):
    """A function of all rows (part, block, work_id, rel, value, size[, hop, own]) of some values that gives packed rows (block, rows) of (work_id, key, weight[, own]).

    A value gets a number and its rarity: as many works have it as `size` of its
    own rows add up to. Rows that aren't a work's own ask only.
    """
    dump, _, flat = packing()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        rel, value = (pc.dictionary_encode(t.column(c).combine_chunks()) for c in ("rel", "value"))
        many = len(value.dictionary)
        values, code = np.unique(rel.indices.to_numpy().astype(np.int64) * many + value.indices.to_numpy(), return_inverse=True)
        own = flat(t, "own") if "own" in t.column_names else np.ones(len(t), dtype=bool)
        df = np.bincount(code, weights=flat(t, "size") * own, minlength=len(values))
        weight = np.array([weights.get(r, 1.0) for r in rel.dictionary.to_pylist()])[values // many] * (1 / np.log2(df + 2))
        weight = weight[code] * flat(t, "hop") if "hop" in t.column_names else weight[code]
        key = (int(t.column("part")[0].as_py()) << 32) + code
        block = flat(t, "block")
        order = np.lexsort((key, block))
        order = order[(df[code] > 0)[order] & pc.is_valid(t.column("work_id")).to_numpy()[order]]
        if not len(order):
            return
        block = block[order]
        columns = {"work_id": t.column("work_id").combine_chunks().take(pa.array(order)), "key": key[order], "weight": weight[order]} | ({"own": own[order]} if "own" in t.column_names else {})
        rows, starts = pa.table(columns), np.flatnonzero(np.diff(block, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(block)], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([block[a]], pa.int32()), pa.array([dump(rows.slice(a, b - a))], pa.binary())], names=["block", "rows"])

    return run


def packed(asks: bool):
    """A function of a block's packed rows and its side rows (work_id, language; held: null) that gives one row of ids in order, rows (at, key[, weight]) and side rows by place.

    Blocks that ask are in the order of works, blocks that are asked in that of keys.
    """
    dump, load, flat = packing()

    def run(key: tuple, rows: pa.Table, side: pa.Table) -> pa.Table:
        schema = pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("side", pa.binary())])
        parts = [load(x.as_py()) for x in rows.column("rows")]
        if not parts:
            return schema.empty_table()
        t = pa.concat_tables(parts)
        if not asks and "own" in t.column_names:
            t = t.filter(t.column("own"))
        ids = pc.unique(t.column("work_id"))
        ids = ids.take(pc.sort_indices(ids))
        at = pc.index_in(t.column("work_id"), ids).to_numpy().astype(np.int32)
        keys = flat(t, "key")
        order = np.lexsort((keys, at) if asks else (at, keys))
        out = {"at": at[order], "key": keys[order]} | ({"weight": flat(t, "weight")[order]} if asks else {})
        told = pc.index_in(side.column("work_id"), ids)
        side = pa.table({"at": told, "language": side.column("language")}).filter(pc.is_valid(told))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *[pa.array([dump(x)], pa.binary()) for x in (pa.table({"id": ids}), pa.table(out), side)]], schema=schema)

    return run


def best_of_blocks(k: int, bonus: float, held: float, hits: int = 250_000):
    """A function of rows (block, its ids, rows and side; other_ids, other_rows, other_side): a block that asks beside each that is asked, one after another. Gives the k best others of each focus, itself among them.

    A focus and an other under one key are a hit; hits are sorted and added up
    about `hits` at a time, so that what they take doesn't grow with the works.
    Of each focus the best so far stay, and set the bar for later blocks.
    """
    _, load, flat = packing()

    def masks(many: int, at: np.ndarray, language: np.ndarray, words: int) -> np.ndarray:
        out = np.zeros((words, many), dtype=np.uint64)
        np.bitwise_or.at(out, (language // 64, at), np.uint64(1) << (language % 64).astype(np.uint64))
        return out

    def asking(b: pa.RecordBatch, r: int) -> dict:
        rows, side = load(b.column("rows")[r].as_py()), load(b.column("side")[r].as_py())
        weights, which = np.unique(flat(rows, "weight"), return_inverse=True)
        keys, under = np.unique(flat(rows, "key"), return_inverse=True)
        ids = load(b.column("ids")[r].as_py()).column("id").combine_chunks()
        told = side.filter(pc.is_valid(side.column("language")))
        names = pc.unique(told.column("language"))
        return {"ids": ids, "at": flat(rows, "at").astype(np.int64), "keys": keys, "under": under, "weights": weights, "which": which, "names": names, "speaks": masks(len(ids), flat(told, "at"), pc.index_in(told.column("language"), names).to_numpy().astype(np.int64), -(-len(names) // 64)), "bar": np.full(len(ids), -np.inf), "best": None}

    def trimmed(f: np.ndarray, o: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each f; rows are in the order of f, ties go by o."""
        starts = np.flatnonzero(np.diff(f, prepend=-1))
        ends = np.append(starts[1:], len(f))
        keep = np.ones(len(f), dtype=bool)
        for a, b in zip(starts[ends - starts > 8 * k], ends[ends - starts > 8 * k], strict=True):  # all that tie with the last one stay until they are in order
            keep[a:b] = score[a:b] >= -np.partition(-score[a:b], k - 1)[k - 1]
        f, o, score = f[keep], o[keep], score[keep]
        order = np.lexsort((o, -score, f))
        f, o, score = f[order], o[order], score[order]
        first = np.arange(len(f)) - np.searchsorted(f, f) < k
        return f[first], o[first], score[first]

    def meet(x: dict, others: pa.Array, rows: pa.Table, side: pa.Table) -> None:
        keys, at = flat(rows, "key"), flat(rows, "at")
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        known = keys[starts]
        ends = np.append(starts[1:], len(keys))
        place = np.minimum(np.searchsorted(known, x["keys"]), len(known) - 1)
        there = known[place] == x["keys"]
        lo = starts[place][x["under"]]
        count = np.where(there, ends[place] - starts[place], 0)[x["under"]]
        some = np.flatnonzero(count)
        if not len(some):
            return
        lo, count, of, which = lo[some], count[some], x["at"][some], x["which"][some]
        w_bits, o_bits = int(len(x["weights"])).bit_length(), int(len(others)).bit_length()
        told = side.filter(pc.is_valid(side.column("language")))
        common = pc.index_in(told.column("language"), x["names"])
        told, common = told.filter(pc.is_valid(common)), common.drop_null().to_numpy().astype(np.int64)
        spoken = masks(len(others), flat(told, "at"), common, len(x["speaks"])) if len(told) else None
        is_held = np.zeros(len(others))
        is_held[flat(side.filter(pc.is_null(side.column("language"))), "at")] = held
        more = bonus * (spoken is not None), float(is_held.max())
        found = []
        # A part ends where a focus does.
        last = np.append(np.flatnonzero(np.diff(of)) + 1, len(of))
        upto = np.cumsum(count)[last - 1]
        # Of 31 bits, what others and weights leave is for the focus; where that's little, 63.
        room = 31 - o_bits - w_bits
        room, number = (room, np.int32) if room >= 4 else (63 - o_bits - w_bits, np.int64)
        a = done = 0
        while a < len(of):
            fits = np.searchsorted(last, np.searchsorted(of, of[a] + (1 << room)), "right") - 1
            b = last[min(max(np.searchsorted(upto, done + hits, "right") - 1, np.searchsorted(last, a, "right")), fits)]
            c = count[a:b]
            n = int(c.sum())
            code = np.repeat((((of[a:b] - of[a]) << (o_bits + w_bits)) | which[a:b]).astype(number), c)
            code += at[np.repeat(lo[a:b] - np.cumsum(c) + c, c) + np.arange(n)].astype(number) << w_bits
            code.sort()
            pair = code >> w_bits
            ends = np.append(np.flatnonzero(pair[1:] != pair[:-1]), n - 1)
            pair = pair[ends]
            f = (pair >> o_bits) + of[a]
            size = np.diff(ends, prepend=-1)
            # A pair's last weight is its largest: few pairs may reach the bar, those are added up.
            able = np.flatnonzero(size * x["weights"][code[ends] & ((1 << w_bits) - 1)] + sum(more) >= x["bar"][f] - 1e-6)
            if not len(able):
                done, a = done + n, b
                continue
            f, pair, size, starts = f[able], pair[able], size[able], (ends - size + 1)[able]
            first = np.cumsum(size) - size
            score = np.add.reduceat(x["weights"][code[np.repeat(starts - first, size) + np.arange(int(size.sum()))] & ((1 << w_bits) - 1)], first)
            able = np.flatnonzero((score + sum(more) >= x["bar"][f] - 1e-6) & (score > 0))
            f, o, score = f[able], (pair[able] & ((1 << o_bits) - 1)).astype(np.int64), score[able]
            if spoken is not None:
                score = score + bonus * np.any(x["speaks"][:, f] & spoken[:, o], axis=0)
            score = np.round(score + is_held[o], 6)
            able = np.flatnonzero(score >= x["bar"][f])
            found.append(trimmed(f[able], o[able], score[able]))
            done, a = done + n, b
        if not found:
            return
        f, o, score = (np.concatenate(c) for c in zip(*found, strict=True))
        new = pa.table({"f": f, "id": others.take(pa.array(o)), "score": score})
        if x["best"] is not None:
            new = pa.concat_tables([x["best"], new])
        new = new.take(pc.sort_indices(new, [("f", "ascending"), ("score", "descending"), ("id", "ascending")]))
        nth = np.arange(len(new)) - np.searchsorted(flat(new, "f"), flat(new, "f"))
        x["best"] = new.filter(pa.array(nth < k)).combine_chunks()
        full = np.flatnonzero(nth == k - 1)
        x["bar"][flat(new, "f")[full]] = flat(new, "score")[full]

    def told(x: dict) -> Iterator[pa.RecordBatch]:
        if x and x["best"] is not None:
            best = x["best"]
            yield from pa.table([x["ids"].take(best.column("f").combine_chunks()), best.column("id"), best.column("score")], names=["work_id", "other_id", "score"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, block = {}, None
        for b in batches:
            for r in range(len(b)):
                if b.column("block")[r].as_py() != block:
                    yield from told(x)
                    x, block = asking(b, r), b.column("block")[r].as_py()
                others = load(b.column("other_ids")[r].as_py()).column("id").combine_chunks()
                if len(others):
                    meet(x, others, load(b.column("other_rows")[r].as_py()), load(b.column("other_side")[r].as_py()))
        yield from told(x)

    return run


def too_common(attrs: DataFrame, most: int) -> DataFrame:
    """(rel, value) that more than `most` works have: values are counted only where a sum over some of them all is as large."""
    some = attrs.select("rel", "value", F.pmod(F.xxhash64("rel", "value"), F.lit(1 << 16)).alias("some"))
    large = some.groupBy("some").agg(F.count("*").alias("n")).where(F.col("n") > most).select("some")
    return some.join(F.broadcast(large), "some", "left_semi").groupBy("rel", "value").agg(F.count("*").alias("n")).where(F.col("n") > most).select("rel", "value")


def similar_works(attrs: DataFrame, k: int = 8, *, languages: DataFrame | None = None, held: DataFrame | None = None, edges: DataFrame | None = None, options: Options = Options(), block_rows: int = 400_000, task_rows: int = 64_000_000, explain: int = 0) -> DataFrame:
    """(work_id, other_id, score, rank): the k works most like each by weighted, rarity-discounted attributes in common; exact.

    attrs: (work_id, rel, value), distinct, live works; languages: (work_id,
    language); held: (work_id). A shared value adds weight of its relation, decay
    by hops of the tree (on the side of work_id) and idf of its count. A language
    in common and being held add to works that share something. Scores are
    rounded to 6 places; ties by other_id.

    Works with equal attributes, languages and holding are one class: they have
    equal scores, so classes meet by their first works, and their members come
    back at the end. A common value's pairs are never formed as rows: classes are
    dealt over packed blocks of about block_rows attributes, and each block goes
    through all others, ten times as large, as they are read from the shared
    folder; nothing is shuffled or written for two blocks that meet. A task holds
    two blocks, and the packed rows of about task_rows attributes. With explain,
    `shared`: that many values in common, the weightiest first, of the k best alone.

    Null or empty values count nothing. Works without a shared value have no row.
    """
    o, spark = options, attrs.sparkSession
    rounds = Rounds(spark)
    attrs = rounds.save(attrs.where("value is not null and cast(value as string) <> ''").select("work_id", "rel", F.col("value").cast("string").alias("value")))
    works = attrs.agg(F.count_distinct("work_id")).first()[0]
    most = max(2, int(works * o.max_share)) if 0 < o.max_share < 1 else works + 1
    common = cut(too_common(attrs.where("rel is not null"), most))
    spoken = languages.select("work_id", "language").where("language <> ''").distinct() if languages is not None else None
    available = held.select("work_id").distinct() if held is not None else None
    members, reps = classes(attrs, spoken, available)
    copies = cut(members.groupBy("rep").agg(F.count("*").alias("size")).where("size > 1"))
    alone = copies.isEmpty()
    own = attrs
    if not alone:
        own = own.join(members.where("work_id <> rep").select("work_id"), "work_id", "left_anti")
    rows = reps.agg(F.sum("size")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-rows // block_rows), min(parts, -(-rows // 20_000)))
    slabs = max(1, -(-rows // (10 * block_rows)))
    # Values of some rows are numbered and weighed where they meet, and leave as packed rows of blocks.
    block = F.pmod(F.xxhash64("work_id"), F.lit(blocks)).cast("int").alias("block")
    asked = own if edges is None or o.depth <= 0 else expanded(own, edges, o).join(own.withColumn("own", F.lit(True)), ["work_id", "rel", "value"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    asked = asked.join(common, ["rel", "value"], "left_anti").where("rel is not null")
    size = F.lit(1.0)
    if not alone:
        asked, size = asked.join(copies.withColumnRenamed("rep", "work_id"), "work_id", "left"), F.coalesce("size", F.lit(1)).cast("double")
    asked = asked.repartition(max(parts, -(-rows // 500_000)), "rel", "value").withColumns({"size": size, "part": F.spark_partition_id(), "block": block})
    pieces = rounds.save(asked.mapInArrow(under_keys(dict(o.weights)), "block int, rows binary"))
    if not explain:
        rounds.drop(attrs)
    kind = dict(attrs.dtypes)["work_id"]
    side = spark.createDataFrame([], f"work_id {kind}, language string")
    if spoken is not None:
        side = side.unionByName(spoken)
    if available is not None:
        side = side.unionByName(available.withColumn("language", F.lit(None).cast("string")))
    side = side.select("work_id", "language", block)
    schema = "block int, ids binary, rows binary, side binary"
    ask = rounds.save(pieces.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(packed(True), schema))
    slab = F.pmod("block", F.lit(slabs)).alias("block")
    answer = rounds.save(pieces.select(slab, "rows").groupBy("block").cogroup(side.select("work_id", "language", slab).groupBy("block")).applyInArrow(packed(False), schema))
    rounds.drop(pieces)
    # Each block that asks goes by itself through all that are asked, in the order in which a task reads them.
    through = answer.select(*[F.col(c).alias(f"other_{c}") for c in ("ids", "rows", "side")]).coalesce(max(1, -(-rows // task_rows)))
    both = ask.repartitionByRange(blocks, "block").crossJoin(through.hint("shuffle_replicate_nl"))
    found = rounds.save(both.mapInArrow(best_of_blocks(k + 1, o.language, o.held), f"work_id {kind}, other_id {kind}, score double"), spark_sql_execution_arrow_maxRecordsPerBatch="1")
    rounds.drop(ask, answer)
    best = lambda rows, whose, other, most: rows.withColumn("rank", F.row_number().over(Window.partitionBy(whose).orderBy(F.desc("score"), other))).where(F.col("rank") <= most)
    # Any of the k + 1 best works is in one of the k + 1 best classes; of these a class has its k + 1 smallest to offer. One more than k, for a work isn't like itself.
    pairs = found.select(F.col("work_id").alias("rep"), F.col("other_id").alias("other_rep"), "score")
    if explain:
        weight = F.lit(1.0)
        for rel, w in o.weights.items():
            weight = F.when(F.col("rel") == rel, w).otherwise(weight)
        keys = attrs.groupBy("rel", "value").agg(F.count("*").alias("df")).where(F.col("df") <= most)
        keys = cut(keys.select("rel", "value", (weight * idf(F.col("df"))).alias("w")).withColumn("key", F.monotonically_increasing_id()))
        asks = expanded(own, edges, o).join(keys, ["rel", "value"]).select(F.col("work_id").alias("focus"), "key", (F.col("w") * F.col("hop")).alias("weight"))
        pairs = cut(explained(cut(best(pairs, "rep", "other_rep", k + 1).drop("rank")), own, asks, keys, explain))
    shared = ["shared"] if explain else []
    if alone:
        return best(pairs.where("rep <> other_rep").withColumnsRenamed({"rep": "work_id", "other_rep": "other_id"}), "work_id", "other_id", k).select("work_id", "other_id", "score", "rank", *shared)
    pairs = cut(best(pairs, "rep", "other_rep", k + 1).drop("rank"))
    first = members.withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy("work_id"))).where(F.col("nth") <= k + 1)
    offered = pairs.join(first.select(F.col("rep").alias("other_rep"), F.col("work_id").alias("other_id")), "other_rep").drop("other_rep")
    offered = best(offered, "rep", "other_id", k + 1).drop("rank")
    return best(members.join(offered, "rep").where("work_id <> other_id").drop("rep"), "work_id", "other_id", k).select("work_id", "other_id", "score", "rank", *shared)


def classes(attrs: DataFrame, spoken: DataFrame | None, held: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """((work_id, rep), (work_id, size)): each work with the smallest one whose attributes, languages and holding are the same, and these with how many they have.

    Sums of two hashes and the number stand for the set, so that a work with many attributes is counted in parts.
    """
    said = attrs.select("work_id", F.lit("a").alias("kind"), "rel", "value")
    none = F.lit("").alias("rel")
    if spoken is not None:
        said = said.unionByName(spoken.select("work_id", F.lit("l").alias("kind"), none, F.col("language").alias("value")))
    if held is not None:
        said = said.unionByName(held.select("work_id", F.lit("h").alias("kind"), none, F.lit("").alias("value")))
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20,0)"))
    own = F.count_if(F.col("kind") == "a")
    prints = cut(said.groupBy("work_id").agg(total("kind", "rel", "value").alias("a"), total(F.lit(1), "value", "rel", "kind").alias("b"), F.count("*").alias("size"), own.alias("own")).where("own > 0"))
    same = ["a", "b", "size", "own"]
    reps = cut(prints.groupBy(*same).agg(F.min("work_id").alias("rep")))
    return cut(prints.join(reps, same).select("work_id", "rep")), reps.select(F.col("rep").alias("work_id"), "size")


def explained(pairs: DataFrame, attrs: DataFrame, asks: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """pairs (rep, other_rep, ...) with `shared`: up to `most` distinct values in common, the weightiest first."""
    mine = pairs.select("rep", "other_rep").join(asks.withColumnRenamed("focus", "rep"), "rep").join(keys.select("key", "rel", "value"), "key")
    both = mine.join(attrs.withColumnRenamed("work_id", "other_rep"), ["other_rep", "rel", "value"])
    values = both.groupBy("rep", "other_rep", "value").agg(F.max("weight").alias("weight"))
    shared = values.groupBy("rep", "other_rep").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "value"))), 1, most).alias("s"))
    return pairs.join(shared, ["rep", "other_rep"]).withColumn("shared", F.transform("s", lambda x: x["value"])).drop("s")
