"""N-gram Jaccard join: prefixes of shingle sets, single rare tokens, pairs of frequent ones, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

# Fixed values of the hashes: odd multipliers.
BASE, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
MASK = (1 << 64) - 1


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, as far as texts have needed them."""

    def __init__(self):
        self.up, self.down = (np.ones(1, dtype=np.uint64) for _ in "ab")

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(BASE, -k, 1 << 64))])
        return self.up[:n], self.down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], powers: Powers, size: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingles of `size` words as sorted int64 hashes; with fewer words, the whole sequence as one.

    The words of all texts are hashed at once: a word's hash is a difference of
    running sums of bytes times powers, moved to power 0.
    """
    joined = b" ".join(t or b"" for t in texts).lower()  # of bytes: A-Z only
    raw = np.frombuffer(joined, dtype=np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])
    space = np.concatenate([[True], IS_SPACE[raw], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    words = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, begins)  # the first word of each text
    count = np.diff(first)

    def run(w: np.ndarray, n: int) -> np.ndarray:
        total = np.full(len(w) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            total += mixed(w[j : len(w) - n + 1 + j] + np.uint64(j + 1)) * np.uint64(2 * j + 3)
        return mixed(total).view(np.int64)

    whole = run(words, size) if len(words) >= size else np.zeros(0, dtype=np.int64)
    out = []
    for i, k in zip(first[:-1], count, strict=True):
        if k >= size:
            t = np.sort(whole[i : i + k - size + 1])
            t = t[np.concatenate([[True], t[1:] != t[:-1]])] if len(t) > 1 else t
        else:
            t = run(words[i : i + k], k) if k else np.zeros(0, dtype=np.int64)
        out.append(t)
    return out


def nodes_of(sets: list[np.ndarray]) -> list[int | None]:
    """The id of each set: equal sets are one node; none for an empty one."""
    sizes = np.array([len(t) for t in sets], dtype=np.int64)
    if not sizes.any():
        return [None] * len(sets)
    x = np.concatenate(sets).view(np.uint64)
    at = (np.cumsum(sizes) - sizes)[sizes > 0]
    total = np.add.reduceat(mixed(x + np.uint64(7)), at) * np.uint64(MIX1) + np.bitwise_xor.reduceat(mixed(x ^ np.uint64(BASE)), at) + sizes[sizes > 0].astype(np.uint64)
    found = iter(mixed(total).view(np.int64).tolist())
    return [next(found) if n else None for n in sizes]


def slack(n: int) -> int:
    """How many tokens of a set of n the other set of a pair may lack (Jaccard 3/4: it holds ceil(3n/4) at least)."""
    return n - -(-3 * n // 4)


def slices(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[tuple[list[int | None], list[int | None], list[np.ndarray]]]:
    """(doc ids, nodes, sets) of rows (doc_id, text) in slices of about 1 MB of text."""
    powers = Powers()
    for b in batches:
        ids, texts = b.column(0), b.column(1).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(ids):
            end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), most)) + at)
            sets = shingle_sets(texts.slice(at, end - at).to_pylist(), powers)
            yield ids.slice(at, end - at).to_pylist(), nodes_of(sets), sets
            at = end


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    columns = [c.split() for c in schema.split(", ")]
    types = [pa.list_(pa.int64()) if t == "array<long>" else pa.int64() for _, t in columns]
    values = zip(*rows, strict=True) if rows else [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(values, types, strict=True)], names=[n for n, _ in columns])


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def survey(docs: DataFrame, group: int = 4_000_000, least: int = 3) -> DataFrame:
    """One pass: rows (doc_id, node, n) of all documents, and rows (token, count) of tokens that `least` different sets of a group of about `group` tokens hold.

    The second kind finds the tokens that are frequent everywhere, in bounded
    memory; it decides on cost only, never on results.
    """
    schema = "doc_id long, node long, n long, token long, count long"

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(held), return_counts=True)
        often = count >= least
        nothing = pa.nulls(int(often.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([nothing, nothing, nothing, pa.array(token[often]), pa.array(count[often].astype(np.int64))], names=[c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0
        for ids, nodes, sets in slices(batches):
            yield batch([(i, node, len(t), None, None) for i, node, t in zip(ids, nodes, sets, strict=True)], schema)
            for node, t in zip(nodes, sets, strict=True):
                if node is not None and node not in seen:
                    seen.add(node)
                    held.append(t)
                    size += len(t)
            if size >= group:
                yield frequent(held)
                held, seen, size = [], set(), 0
        if held:
            yield frequent(held)

    return texts_of(docs).mapInArrow(run, schema)


INDEX = "node long, cluster long, n long, p long, f long, singles long, level long, own long, ranks array<long>, sigs array<long>"


def signatures(tokens: np.ndarray, often: np.ndarray) -> tuple[int, int, int, int, int, list[int], np.ndarray]:
    """(p, f, singles, level, own, ranks, signatures) of a set: rare tokens singly, frequent ones in pairs.

    Order: rare tokens by hash, then frequent ones by hash. Frequent tokens are
    dealt into classes, about one for every 8 tokens of a set, and pairs are made
    within a class. With r rare tokens and n_c of class c in its prefix, a set
    that lacks at most slack tokens of another shares a rare token or two of one
    class with it once r + sum(n_c - 1) > slack; the prefix is extended up to
    there. Classes depend on a level of sizes; as two near sets are at most one
    level apart, each makes the pairs of its own level (`own` of them) and of the
    next. p: tokens of the prefix, f: the frequent ones among them.

    A smaller slack needs less of the prefix: with a slack of k, the signatures of
    rank k at most. The rank of a single is its place; that of a pair is r plus
    what has been gained before it. ranks: those of the pairs.
    """
    n = len(tokens)
    need = slack(n) + 1
    single = tokens[~often][:need]
    if len(single) == need:
        return need, 0, need, 0, 0, [], single
    common, most, out, ranks = tokens[often], 0, [single], []
    level = int(np.log(n) / np.log(4 / 3))
    x = common.view(np.uint64)
    for at in (level, level + 1):
        classes = max(1, int((4 / 3) ** at / 8))
        kind = (mixed(x + np.uint64(at + 1)) % np.uint64(classes)).tolist()
        held: dict[int, list[int]] = {}
        left, right, gained, used = [], [], 0, len(kind)
        for k, c in enumerate(kind):
            if gained >= need - len(single):
                used = k
                break
            have = held.setdefault(c, [])
            left += have
            right += [k] * len(have)
            ranks += [len(single) + gained] * len(have)
            gained += bool(have)
            have.append(k)
        most = max(most, used)
        out.append(mixed(x[left] * np.uint64(MIX1) ^ mixed(x[right] + np.uint64(at))).view(np.int64) if left else np.zeros(0, dtype=np.int64))
    return len(single) + most, most, len(single), level, len(out[1]), ranks, np.concatenate(out)


def first_index(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """INDEX rows of all sets of 3 tokens or more (smaller ones have no near copies but themselves); equal sets of a slice once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, nodes, sets in slices(batches):
            own = {node: t for node, t in zip(nodes, sets, strict=True) if len(t) > 2}
            yield batch([(node, node, len(t), *signatures(t, among(t, frequent))) for node, t in own.items()], INDEX)

    return texts_of(docs).mapInArrow(run, INDEX)


def among(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(tokens), dtype=bool)
    return frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens


def next_index(sets: DataFrame, frequent: np.ndarray) -> DataFrame:
    """INDEX rows of sets (node, cluster, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for node, cluster, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                t = tokens.values.to_numpy()
                rows.append((node, cluster, len(t), *signatures(t, among(t, frequent))))
            yield batch(rows, INDEX)

    return sets.select("node", "cluster", "tokens").mapInArrow(run, INDEX)


BITMAP_BITS = 1 << 25  # 4 MB, whatever the number of nodes: a full bitmap only lets more rows through to the exact join


def bitmap_of(nodes: DataFrame) -> np.ndarray:
    bit = F.pmod("node", F.lit(BITMAP_BITS))
    parts = nodes.select((bit / 64).cast("int").alias("i"), F.expr(f"shiftleft(1L, cast(pmod(node, {BITMAP_BITS}) % 64 as int))").alias("w"))
    rows = parts.groupBy("i").agg(F.bit_or("w").alias("w")).toPandas()  # BITMAP_BITS / 64 rows at most
    out = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    out[rows["i"].to_numpy(dtype=np.int64)] = rows["w"].to_numpy(dtype=np.int64)
    return out


def in_bitmap(bitmap: np.ndarray, node: int) -> bool:
    k = node % BITMAP_BITS
    return bool(int(bitmap[k // 64]) >> (k % 64) & 1)


def token_arrays(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, tokens) of the nodes asked for. The bitmap leaves most others out before the exact join."""
    bitmap, schema = bitmap_of(nodes), "node long, tokens array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found, sets in slices(batches):
            yield batch(list({node: t for node, t in zip(found, sets, strict=True) if node is not None and in_bitmap(bitmap, node)}.items()), schema)

    return texts_of(docs).mapInArrow(run, schema).join(nodes, "node", "left_semi").groupBy("node").agg(F.first("tokens").alias("tokens"))


def distances(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """(a, b, d, near) of pairs: the Jaccard distance, and whether 100 * intersection >= 75 * union."""
    left, right = (arrays.select(F.col("node").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    both = both.select("a", "b", (F.size("ta") + F.size("tb")).alias("sum"), F.size(F.array_intersect("ta", "tb")).alias("s"))
    return both.select("a", "b", (1 - F.col("s") / (F.col("sum") - F.col("s"))).alias("d"), (100 * F.col("s") >= 75 * (F.col("sum") - F.col("s"))).alias("near"))


def clustered(rows: DataFrame, clusters: DataFrame | None) -> DataFrame:
    """rows with the cluster of their node (itself, if it has no link yet)."""
    if clusters is None:
        return rows.withColumn("cluster", F.col("node"))
    return rows.join(clusters.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("cluster", F.coalesce("component", "node")).drop("component")


def flat_rows(index: DataFrame, *keys: str) -> DataFrame:
    """(keys, sig, kind, rank, level) of an index: kind is -1 of a single token, else the level of a pair."""
    i, own = F.col("i"), F.col("singles") + F.col("own")
    kind = F.when(i < F.col("singles"), -1).when(i < own, F.col("level")).otherwise(F.col("level") + 1)
    rank = F.when(i < F.col("singles"), i).otherwise(F.get("ranks", (i - F.col("singles")).cast("int")))
    rows = index.select(*keys, "singles", "own", "level", "ranks", F.posexplode("sigs").alias("i", "sig"))
    return rows.select(*keys, "sig", kind.cast("int").alias("kind"), rank.cast("int").alias("rank"), "level")


def cross_pairs(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) from rows (sig, kind, rank, node, cluster, n, p, f, level, m, held): a signature in common, different clusters.

    Pairs in one cluster are linked already, so that of each signature only the
    nodes outside its largest cluster meet all others: work grows with the size
    of a group of copies, not with its square. n: tokens of a node, p: tokens of
    its prefix, f: those of p that are indexed in pairs or left out here. Most
    pairs are ruled out before they are formed. Each set of a pair must hold the
    signature at a rank that the slack of their two sizes allows. A pair shares no more
    single tokens than either has here (held), no more of the others than either
    has (f), and behind the prefix what is left; and no more tokens in all than
    either has in common with any other set (m), as a text with edits of its own.
    Pairs of tokens count at the higher of both levels only. pivots (node, pivot,
    d): Jaccard distance is a metric, so two nodes whose distances to one pivot
    differ by over 1/4 are no near copies.
    """
    rows = rows.join(pivots, "node", "left")
    per = rows.groupBy("sig", "cluster").agg(F.count("*").alias("k")).groupBy("sig").agg(F.max_by("cluster", F.struct("k", "cluster")).alias("major"), F.count("*").alias("kinds")).where("kinds > 1").select("sig", "major")
    mixed_rows = rows.join(per, "sig")
    of = {"su": "sig", "u": "node", "cu": "cluster", "lu": "level", "vu": "pivot", "du": "d"} | {f"{c}u": c for c in ("n", "p", "f", "m", "held", "rank")}
    minor = mixed_rows.where("cluster <> major").select(*[F.col(c).alias(x) for x, c in of.items()])
    other = mixed_rows.withColumn("main", F.col("cluster") == F.col("major")).drop("major")
    far = F.coalesce((F.col("pivot") == F.col("vu")) & (F.abs(F.col("d") - F.col("du")) > 0.25 + 1e-9), F.lit(False))
    level = (F.col("kind") == -1) | (F.col("kind") == F.greatest("level", "lu"))
    sizes = F.col("n") + F.col("nu")
    enough = 7 * (F.least("held", "heldu") + F.least("f", "fu") + F.greatest(F.col("n") - F.col("p"), F.col("nu") - F.col("pu"))) >= 3 * sizes
    rank = 7 * F.least(F.col("n") - F.col("rank"), F.col("nu") - F.col("ranku")) >= 3 * sizes
    apart = (F.col("cu") != F.col("cluster")) & (F.col("main") | (F.col("u") < F.col("node")))
    met = minor.join(other, (F.col("su") == F.col("sig")) & apart & (4 * F.least("n", "nu") >= 3 * F.greatest("n", "nu")) & rank & (7 * F.least("m", "mu") >= 3 * sizes) & enough & ~far & level)
    return met.select(F.least("u", "node").alias("a"), F.greatest("u", "node").alias("b")).distinct()


def links(scratch: Scratch, docs: DataFrame, frequent: np.ndarray, most: int, max_frequent: int) -> DataFrame | None:
    """Links (a, b) between nodes, enough of them for all connected components; None if there is none.

    1. Each node indexes the signatures of its prefix. Those of one node only
       are left out.
    2. A node is compared with the node it shares most first places with: that
       ties up groups of copies with one comparison each.
    3. Signatures that up to `most` nodes hold: all pairs across clusters.
    4. Nodes with a signature that more nodes in different clusters hold go
       through a second index over exact counts of all their tokens: those above
       `most` (the max_frequent commonest of them) come last and are indexed as
       pairs. Two nodes that share no signature of step 3 have both such a one
       in their prefixes, so both take part.
    """
    index = scratch.save(first_index(docs, frequent).withColumn("rid", F.monotonically_increasing_id()), "index")
    sizes = scratch.save(index.drop("sigs", "ranks", "cluster"), "sizes")
    # Short row ids stand for nodes here: these are the largest shuffles.
    flat = flat_rows(index, "rid")
    seen = flat.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1").select("sig")
    live = scratch.save(flat.drop("level").join(seen, "sig", "left_semi"), "several")
    scratch.drop("index")
    live = live.join(sizes.select("rid", "node"), "rid").select("sig", "node", "kind", "rank").dropDuplicates(["sig", "node"])
    shared = live.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1")
    live = scratch.save(live.join(shared, "sig"), "live")
    scratch.drop("several")
    if live.isEmpty():
        return None
    sizes = sizes.drop("rid", "own").dropDuplicates(["node"])
    # The leader of a signature is its most central node: the one whose signatures most others hold, for its size.
    weight = live.groupBy("node").agg(F.sum("c").alias("w")).join(sizes.select("node", "n"), "node").select("node", (F.col("w") / F.col("n")).alias("w"))
    leaders = live.join(weight, "node").groupBy("sig").agg(F.max_by("node", F.struct("w", "node")).alias("first"))
    best = live.join(leaders, "sig").where("node <> first").groupBy("node", "first").agg(F.count("*").alias("k")).groupBy("node").agg(F.max_by("first", F.struct("k", "first")).alias("b"), F.max("k").alias("k"))
    # A fifth of the single places or more: fewer are most often chance, and step 3 looks at those.
    stars = scratch.save(best.join(sizes, "node").where("5 * k >= singles").select(F.col("node").alias("a"), "b"), "stars")
    nodes = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    apart = scratch.save(distances(stars, token_arrays(docs, nodes(stars))), "apart")
    found = apart.where("near").select("a", "b")
    pivots = apart.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "d")
    clusters = None if found.isEmpty() else scratch.save(components(scratch, found, "early"), "clusters")
    rows = clustered(live.select("sig", "node", "kind", "rank"), clusters)
    stats = rows.groupBy("sig").agg(F.count("*").alias("c"), F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).where("lo <> hi").select("sig", "c")
    rows = scratch.save(rows.join(stats, "sig"), "mixed")
    scratch.drop("live")
    left, held = F.col("c") > most, (F.col("c") <= most) & (F.col("kind") == -1)
    per = scratch.save(rows.groupBy("node").agg(F.sum(left.cast("long")).alias("left"), F.sum(held.cast("long")).alias("held")), "per")
    hot = per.where("left > 0")
    few = rows.where(F.col("c") <= most).join(sizes, "node").join(per, "node")
    few = few.select("sig", "node", "cluster", "kind", "rank", "n", "p", "level", (F.col("f") + F.col("left")).alias("f"), "held", F.col("n").alias("m"))
    pairs = scratch.save(cross_pairs(few, pivots), "pairs1")
    out = found
    if not pairs.isEmpty():
        out = out.unionByName(scratch.save(distances(pairs, token_arrays(docs, nodes(pairs))).where("near").select("a", "b"), "links1"))
    if not hot.isEmpty():
        whole = scratch.save(token_arrays(docs, hot.select("node")), "whole")
        sets = clustered(whole, clusters)
        each = sets.select("node", "cluster", F.explode("tokens").alias("sig"))
        counts = scratch.save(each.groupBy("sig").agg(F.count("*").alias("c"), F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).where("c > 1"), "counts")
        common = each.join(counts.select("sig"), "sig").groupBy("node").agg(F.count("*").alias("m"))
        # A near copy holds three quarters of a set, so a set with fewer tokens in common with any other has none.
        common = scratch.save(common.join(sizes.select("node", "n"), "node").where("4 * m >= 3 * n").select("node", "m"), "common")
        top = counts.where((F.col("c") > most) & (F.col("lo") != F.col("hi"))).orderBy(F.desc("c"), "sig").limit(max_frequent)
        again = scratch.save(next_index(sets.join(common.select("node"), "node"), np.sort(np.array([r["sig"] for r in top.select("sig").collect()], dtype=np.int64))), "again")
        flat = flat_rows(again, "node", "cluster", "n", "p", "f")
        single = flat.where("kind = -1").join(counts.select("sig"), "sig").groupBy("node").agg(F.count("*").alias("held"))
        flat = flat.join(common, "node").join(single, "node", "left").withColumn("held", F.coalesce("held", F.lit(0)))
        pairs = scratch.save(cross_pairs(flat, pivots), "pairs2")
        if not pairs.isEmpty():
            out = out.unionByName(scratch.save(distances(pairs, whole).where("near").select("a", "b"), "links2"))
    return out


def jaccard_components(docs: DataFrame, *, most: int = 48, max_frequent: int = 200_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: classes of documents linked by shingle sets of Jaccard 0.75 or more.

    A document's set: distinct shingles of five words (A-Z lower-cased, split at
    ASCII white space), as 64-bit hashes; with fewer words, all of them as one.
    Equal sets are one node. Candidates come from prefixes that are indexed by
    single rare tokens and by pairs of frequent ones; each is verified on the
    whole sets, and no link that a component needs is lost. component_id is the
    smallest doc_id of the component.

    Up to `most` nodes may share a signature of which all pairs are made; tokens
    that are commoner count as frequent (up to max_frequent of them are sent to
    the tasks; any beyond count as rare, which costs time but loses nothing).

    Null or blank text: 0 shingles, linked with nothing, component_id its own
    doc_id. Null doc_id: takes part with its text; component_id is the smallest
    doc_id that there is in its component, or null. Repeated rows: one result
    each, in one component. Empty table: no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    passed = scratch.save(survey(docs), "survey")
    rows = passed.where("token is null").select("doc_id", "node", F.col("n").alias("n_shingles"))
    often = passed.where("token is not null").groupBy("token").agg(F.sum("count").alias("c")).where(F.col("c") > most / 4)
    top = [r["token"] for r in often.orderBy(F.desc("c"), "token").limit(max_frequent).select("token").collect()]  # max_frequent numbers at most
    edges = links(scratch, docs, np.sort(np.array(top, dtype=np.int64)), most, max_frequent)
    if edges is not None:
        groups = clustered(rows.where("node is not null"), components(scratch, edges, "late"))
    else:
        groups = rows.where("node is not null").withColumn("cluster", F.col("node"))
    least = groups.groupBy("cluster").agg(F.min("doc_id").alias("component_id"))
    linked = groups.join(least, "cluster").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, without documents in whose component a smaller doc_id is; rows without doc_id stay."""
    found = jaccard_components(docs, **options).where("doc_id is not null")
    out = found.groupBy("doc_id").agg(F.min("component_id").alias("least")).where("least <> doc_id").select("doc_id")
    return docs.join(out, "doc_id", "left_anti").select(docs.columns)
