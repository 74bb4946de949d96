"""b-bit MinHash: bands of minima give candidates, packed low bits estimate their similarity, whole sets confirm."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components
from .jaccard import BASE, MIX1, MIX2, Powers, bitmap_of, clustered, in_bitmap, mixed, shingle_sets, texts_of

LOW = (1 << 32) - 1
EACH = 32  # minima whose 2 low bits one long holds
PAIRS_OF_BITS = 0x5555555555555555


def slices(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """(doc ids, shingle sets) of rows (doc_id, text) in slices of about `most` bytes of text."""
    powers = Powers()
    for b in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(b.column(0), b.column(1).cast(pa.binary()), strict=True):
            ids.append(doc_id.as_py()), texts.append(text.as_py())
            size += len(texts[-1] or b"")
            if size >= most:
                yield ids, shingle_sets(texts, powers)
                ids, texts, size = [], [], 0
        if ids:
            yield ids, shingle_sets(texts, powers)


def set_keys(sets: list[np.ndarray]) -> list[tuple[int, int] | None]:
    """A key of 128 bits for each set, equal for equal sets; none for an empty one."""
    sizes = np.array([len(t) for t in sets], dtype=np.int64)
    if not sizes.any():
        return [None] * len(sets)
    x, at = np.concatenate(sets).view(np.uint64), (np.cumsum(sizes) - sizes)[sizes > 0]
    n = sizes[sizes > 0].astype(np.uint64)
    halves = [mixed(np.add.reduceat(mixed(x + np.uint64(salt)), at) + n).view(np.int64).tolist() for salt in (MIX1, MIX2)]
    found = iter(zip(*halves, strict=True))
    return [next(found) if k else None for k in sizes]


class Sketcher:
    """Minima of rows * bands hash functions over sets, as one key a band and the low bits packed."""

    def __init__(self, rows: int, bands: int):
        self.rows, self.bands, k = rows, bands, rows * bands
        draws = mixed(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(BASE))
        self.times, self.plus = (draws[:k] | np.uint64(1)).astype(np.uint32), draws[k:].astype(np.uint32)
        self.salt = (np.arange(1, k + 1, dtype=np.uint64) << np.uint64(32))[:, None]

    def __call__(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(band keys, packed bits), one row for each set; no set may be empty."""
        x = (np.concatenate(sets).view(np.uint64) & np.uint64(LOW)).astype(np.uint32)
        sizes = np.array([len(t) for t in sets])
        at, h = np.cumsum(sizes) - sizes, np.empty_like(x)
        low = np.empty((len(self.times), len(sets)), dtype=np.uint32)
        for i, (a, b) in enumerate(zip(self.times, self.plus, strict=True)):
            np.multiply(x, a, out=h)
            np.add(h, b, out=h)
            np.minimum.reduceat(h, at, out=low[i])
        each = mixed(low.astype(np.uint64) + self.salt)  # the bits of one minimum tell nothing of another's
        keys = mixed(each.reshape(self.bands, self.rows, -1).sum(axis=1, dtype=np.uint64))
        longs = -(-len(each) // EACH)
        bits = np.zeros((longs * EACH, len(sets)), dtype=np.uint64)
        bits[: len(each)] = each & np.uint64(3)
        shifts = (np.arange(EACH, dtype=np.uint64) * np.uint64(2))[None, :, None]
        packed = np.bitwise_or.reduce(bits.reshape(longs, EACH, -1) << shifts, axis=1)
        return keys.T.view(np.int64) if keys.T.flags.c_contiguous else np.ascontiguousarray(keys.T).view(np.int64), np.ascontiguousarray(packed.T).view(np.int64)


SKETCH = "doc_id long, hi long, lo long, n long, bands array<long>, bits array<long>"


def sketches(docs: DataFrame, rows: int, bands: int, least: int) -> DataFrame:
    """SKETCH rows of all documents; bands and bits only of sets of `least` shingles or more, once for equal sets of a slice."""
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(rows, bands)
        for ids, sets in slices(batches):
            found = set_keys(sets)
            own: dict[tuple[int, int], int] = {}
            for i, key in enumerate(found):
                if key is not None and len(sets[i]) >= least:
                    own.setdefault(key, i)
            of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            if own:
                keys, bits = sketch([sets[i] for i in own.values()])
                of = {i: (keys[j], bits[j]) for j, i in enumerate(own.values())}
            columns = [pa.array(ids, pa.int64()), *[pa.array([k and k[j] for k in found], pa.int64()) for j in (0, 1)], pa.array([len(t) for t in sets], pa.int64())]
            columns += [pa.array([of[i][j] if i in of else None for i in range(len(ids))], longs) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SKETCH.split(", ")])

    return texts_of(docs).mapInArrow(run, SKETCH)


def token_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, tokens) of nodes (node, hi, lo). A bitmap leaves most others out before the exact join."""
    bitmap, schema = bitmap_of(nodes.select(F.col("lo").alias("node"))), "hi long, lo long, tokens array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in slices(batches):
            own = {k: t for k, t in zip(set_keys(sets), sets, strict=True) if k is not None and in_bitmap(bitmap, k[1])}
            columns = [pa.array([k[j] for k in own], pa.int64()) for j in (0, 1)] + [pa.array(list(own.values()), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["hi", "lo", "tokens"])

    found = texts_of(docs).mapInArrow(run, schema).join(nodes, ["hi", "lo"])
    return found.groupBy("node").agg(F.first("tokens").alias("tokens"))


def mismatches(a: str, b: str, longs: int) -> Column:
    """How many of the minima behind the packed bits a and b (array columns) differ in their two bits."""
    total = F.lit(0)
    for i in range(longs):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(PAIRS_OF_BITS)))
    return total


def most_mismatches(threshold: int, k: int, sigmas: float) -> int:
    """How many of k minima may differ for an estimate within `sigmas` standard deviations of the threshold.

    Two bits of different minima agree by chance once in four, so a similarity J
    shows as P = J + (1 - J) / 4, and the estimate is (P - 1/4) / (3/4).
    """
    p = 1 - 3 / 4 * (1 - threshold / 100)
    return math.ceil(k * (1 - p) + sigmas * math.sqrt(k * p * (1 - p)))


def confirmed(pairs: DataFrame, arrays: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= threshold * union of their whole sets."""
    left, right = (arrays.select(F.col("node").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    both = both.select("a", "b", (F.size("ta") + F.size("tb")).alias("sum"), F.size(F.array_intersect("ta", "tb")).alias("s"))
    return both.where(100 * F.col("s") >= threshold * (F.col("sum") - F.col("s"))).select("a", "b")


def links(scratch: Scratch, docs: DataFrame, nodes: DataFrame, threshold: int, differ: int, longs: int) -> DataFrame | None:
    """Links (a, b) between nodes (node, hi, lo, n, bands, bits), enough of them for all connected components; None if there is none.

    1. Candidates: nodes that share the key of a band. Keys of one node only are left out.
    2. A node is compared with the most central node among those it shares keys
       with: that ties up groups of copies with one comparison each.
    3. Of each key, the nodes outside its largest cluster meet all others, if
       the tokens that each has in common with any other set leave room for the
       threshold: a copy with too many edits of its own meets nobody. Two nodes
       meet once, however many keys they share.
    In 2 and 3 the packed bits rule out pairs before whole sets are compared.
    """
    flat = nodes.where("bands is not null").select("node", F.explode("bands").alias("sig"))
    shared = flat.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1")
    live = scratch.save(flat.join(shared, "sig"), "live")
    if live.isEmpty():
        return None
    bits, keys, sizes = nodes.select("node", "bits"), nodes.select("node", "hi", "lo"), nodes.select("node", "n")
    named = lambda df, x: df.select(*[F.col(c).alias(f"{c}_{x}") for c in df.columns])
    near = mismatches("bits_a", "bits_b", longs) <= differ
    fits = 100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    weight = live.groupBy("node").agg(F.sum("c").alias("w"))
    leaders = live.join(weight, "node").groupBy("sig").agg(F.max_by("node", F.struct("w", "node")).alias("first"))
    best = live.join(leaders, "sig").where("node <> first").groupBy("node", "first").agg(F.count("*").alias("k")).groupBy("node").agg(F.max_by("first", F.struct("k", "first")).alias("b"))
    both = best.join(named(bits.join(sizes, "node"), "a"), F.col("node") == F.col("node_a")).join(named(bits.join(sizes, "node"), "b"), F.col("b") == F.col("node_b"))
    stars = scratch.save(both.where(near & fits).select(F.col("node").alias("a"), "b"), "stars")
    found = scratch.save(confirmed(stars, token_sets(docs, keys.join(ends(stars), "node")), threshold), "found")
    clusters = None if found.isEmpty() else scratch.save(components(scratch, found, "early"), "clusters")
    rows = clustered(live.select("sig", "node"), clusters)
    kinds = rows.groupBy("sig", "cluster").agg(F.count("*").alias("k")).groupBy("sig").agg(F.max_by("cluster", F.struct("k", "cluster")).alias("major"), F.count("*").alias("kinds")).where("kinds > 1").select("sig", "major")
    rows = scratch.save(rows.join(kinds, "sig"), "mixed")
    scratch.drop("live")
    if rows.isEmpty():
        return found
    # A link takes threshold / 100 of a set's tokens; those of one set alone are in no intersection.
    sets = scratch.save(token_sets(docs, keys.join(rows.select("node").distinct(), "node")), "sets")
    each = sets.select("node", F.explode("tokens").alias("token"))
    several = each.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    room = each.join(several, "token", "left_semi").groupBy("node").agg(F.count("*").alias("m")).join(sizes, "node").where(100 * F.col("m") >= threshold * F.col("n"))
    room = scratch.save(room.join(nodes.select("node", "bits", "bands"), "node"), "room")
    rows = rows.join(room, "node")
    minor, other = named(rows.where("cluster <> major").drop("major"), "a"), named(rows.withColumn("main", F.col("cluster") == F.col("major")).drop("major"), "b")
    apart = (F.col("cluster_a") != F.col("cluster_b")) & (F.col("main_b") | (F.col("node_a") < F.col("node_b")))
    enough = (100 + threshold) * F.least("m_a", "m_b") >= threshold * (F.col("n_a") + F.col("n_b"))
    # Of the keys that two nodes share, the first alone brings them together.
    once = F.get(F.array_intersect("bands_a", "bands_b"), 0) == F.col("sig_a")
    met = minor.join(other, (F.col("sig_a") == F.col("sig_b")) & apart & fits & enough & near & once)
    pairs = scratch.save(met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), "pairs")
    if pairs.isEmpty():
        return found
    return found.unionByName(scratch.save(confirmed(pairs, sets, threshold), "late"))


def minhash_components(docs: DataFrame, *, threshold: int = 85, rows: int = 6, bands: int = 48, sigmas: float = 6.0) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: classes of documents linked by shingle sets with 100 * intersection >= threshold * union.

    A document's set: distinct shingles of five words (A-Z lower-cased, split at
    ASCII white space), as 64-bit hashes; with fewer words, all of them as one.
    Equal sets are one node, under a key of 128 bits. Each node keeps the keys of
    its bands (`rows` minima each) and the two low bits of all minima, packed 32
    to a long. Nodes that share a band are candidates; the count of bits that
    differ gives their similarity, corrected for chance agreement; those within
    `sigmas` standard deviations of the threshold or above are confirmed on whole
    sets. A pair at 85 shares none of 48 bands of 6 with a probability of 1.4e-10
    and is ruled out by its bits with 1e-9; pairs above, less often.

    component_id: the smallest doc_id of the component; kept: doc_id is that.
    Null or blank text: 0 shingles, linked with nothing. Null doc_id: takes part
    with its text; component_id is the smallest doc_id that there is in its
    component, or null; not kept, unless it has none. Repeated rows: one result
    each. Empty table: no rows. Long texts: whole. Other columns are ignored.
    """
    scratch, k = Scratch(docs.sparkSession, "minhash"), rows * bands
    # Two different sets with fewer tokens than this are below the threshold: n tokens against n + 1 at best.
    least = next(n for n in range(1, 10_000) if 100 * n >= threshold * (n + 1))
    passed = scratch.save(sketches(docs, rows, bands, least), "sketches")
    held = passed.where("hi is not null").groupBy("hi", "lo").agg(F.first("n").alias("n"), F.first("bands", ignorenulls=True).alias("bands"), F.first("bits", ignorenulls=True).alias("bits"), F.min("doc_id").alias("doc_id"))
    nodes = scratch.save(held.withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges = links(scratch, docs, nodes, threshold, most_mismatches(threshold, k, sigmas), -(-k // EACH))
    groups = nodes.select("node", "hi", "lo", "doc_id")
    if edges is None or edges.isEmpty():
        groups = groups.withColumn("component_id", F.col("doc_id"))
    else:
        groups = clustered(groups, scratch.save(components(scratch, edges, "all"), "classes"))
        least_id = groups.groupBy("cluster").agg(F.min("doc_id").alias("component_id"))
        groups = groups.join(least_id, "cluster")
    rows_of = passed.select("doc_id", F.col("n").alias("n_shingles"), "hi", "lo")
    linked = rows_of.where("hi is not null").join(groups.select("hi", "lo", "component_id"), ["hi", "lo"]).select("doc_id", "n_shingles", "component_id")
    out = linked.unionByName(rows_of.where("hi is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, without documents in whose component a smaller doc_id is; rows without doc_id stay."""
    out = minhash_components(docs, **options).where("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.join(out, "doc_id", "left_anti").select(docs.columns)
