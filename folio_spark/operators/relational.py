"""Facets, similarity, audits, merges, search and hierarchy over catalog tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def facet_counts(attrs: DataFrame) -> DataFrame:
    """(dim, value, n) from (work_id, dim, value): distinct works a value."""
    return attrs.where("value is not null and value <> ''").groupBy("dim", "value").agg(F.count_distinct("work_id").alias("n"))


def self_excluding_facets(works: DataFrame, dims: Mapping[str, Column], chosen: Mapping[str, Sequence[str]], top: int = 20) -> DataFrame:
    """(dim, value, n): counts of each dimension over works that pass the filters of all others; the top values and all chosen ones.

    One scan: each work's passes become columns, and a dimension counts a work if the others hold.
    """
    passes = {d: F.coalesce(c.isin(list(chosen[d])), F.lit(False)) if chosen.get(d) else F.lit(True) for d, c in dims.items()}
    rows = works.select(F.array(*[F.struct(F.lit(d).alias("dim"), c.cast("string").alias("value"), _all(p for e, p in passes.items() if e != d)) for d, c in dims.items()]).alias("a"))
    hit = rows.select(F.explode("a").alias("a")).select("a.dim", "a.value", F.col("a.ok").alias("ok")).where("ok and value is not null").groupBy("dim", "value").agg(F.count("*").alias("n"))
    ranked = hit.withColumn("r", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("n"), "value")))
    picked = [(d, v) for d, vs in chosen.items() for v in vs]
    pins = works.sparkSession.createDataFrame(picked, "dim string, value string") if picked else works.sparkSession.createDataFrame([], "dim string, value string")
    pinned = pins.withColumn("pin", F.lit(True))
    both = ranked.join(F.broadcast(pinned), ["dim", "value"], "full_outer")
    return both.where((F.col("r") <= top) | F.col("pin")).select("dim", "value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _all(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out.alias("ok")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, started, ended, n): runs of events of one actor without a longer gap; a gap of exactly that length stays."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((F.col("ts") - F.lag("ts").over(w) > F.expr(f"interval {gap}")).cast("int"), F.lit(1))
    numbered = events.where("user_id is not null").withColumn("new", new).withColumn("s", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "s").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n")).drop("s")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def override_shadow(feed: DataFrame, editorial: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Editorial rows, and feed rows whose keys no editorial row has."""
    return feed.join(editorial.select(*keys).distinct(), list(keys), "left_anti").select(feed.columns).unionAll(editorial.select(feed.columns))


def merge_feeds(rows: DataFrame, key: str, rank: str, fields: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """One row a key: of each field the first non-empty value by rank; flags are or-ed."""
    first = lambda f: F.min_by(F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), F.col(f)), F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), F.col(rank))).alias(f)
    return rows.groupBy(key).agg(*[first(f) for f in fields], *[F.bool_or(f).alias(f) for f in flags])


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}]+)"), 1)


def term_index(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf) of lower-cased words."""
    return docs.select(key, F.explode(words_of(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def query_hits(docs: DataFrame, key: str, text: Column, query: Sequence[str]) -> DataFrame:
    """(key, len, hits: array of (term, tf)) of all documents: a text is taken apart once, and no posting is shuffled; key is unique."""
    terms = F.array(*map(F.lit, sorted(set(query))))

    def counted(w: Column) -> Column:
        tf = F.transform(terms, lambda t: F.struct(t.alias("term"), F.size(F.filter(w, lambda x: x == t)).cast("long").alias("tf")))
        return F.struct(F.size(w).cast("long").alias("len"), F.filter(tf, lambda h: h["tf"] > 0).alias("hits"))

    found = F.get(F.transform(F.array(F.coalesce(words_of(text), F.array().cast("array<string>"))), counted), 0)
    return docs.select(key, found.alias("found")).select(key, "found.len", "found.hits")


def bm25(docs: DataFrame, key: str, text: Column, query: Sequence[str], k: int, k1: float = 1.2, b: float = 0.75, least: int = 1) -> DataFrame:
    """(key, score) of the k best documents with at least `least` of the query's terms; statistics cover all documents with a word.

    Lengths and hits are saved, a few bytes a document; statistics and scores
    both read them, so that the texts themselves are read once.
    """
    passed = cut(query_hits(docs, key, text, query)).where("len > 0")
    terms = sorted(set(query))
    held = lambda t: F.sum(F.exists("hits", lambda h: h["term"] == t).cast("long"))
    row = passed.agg(F.count("*"), F.avg("len"), *[held(t) for t in terms]).first()  # one row
    n, mean = row[0], row[1] or 1.0
    weight = {t: math.log(1 + (n - df + 0.5) / (df + 0.5)) for t, df in zip(terms, row[2:], strict=True) if df}
    hits = passed.where(F.size("hits") >= max(1, least)).select(key, "len", F.explode("hits").alias("h")).select(key, "len", "h.*")
    w = F.lit(0.0)
    for t, v in weight.items():
        w = F.when(F.col("term") == t, v).otherwise(w)
    score = w * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean))
    return hits.groupBy(key).agg(F.round(F.sum(score), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def all_terms(docs: DataFrame, key: str, text: Column, query: Sequence[str]) -> DataFrame:
    """Keys of the documents that hold every term: a filter of one narrow pass."""
    return query_hits(docs, key, text, query).where(F.size("hits") == len(set(query))).select(key)


def trigram_search(rows: DataFrame, key: str, text: Column, query: str, missing: int) -> DataFrame:
    """(key, hits): rows that hold the query's trigrams but for `missing` of them."""
    grams = sorted({query[i : i + 3] for i in range(len(query) - 2)})
    hits = sum((F.contains(F.lower(text), F.lit(g)).cast("int") for g in grams[1:]), F.contains(F.lower(text), F.lit(grams[0])).cast("int"))
    return rows.select(key, hits.cast("long").alias("hits")).where(F.col("hits") >= len(grams) - missing)


def vector_topk(vectors: DataFrame, k: int = 5, every: int = 100, block_bytes: int = 16_000_000) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the k nearest of all rows for each query row (vec_id divisible by `every`), by brute force.

    Queries go to the tasks in blocks of at most block_bytes, one block after
    another; a task multiplies its rows with the block and keeps the best k of
    each query, so only those are shuffled. Rows of another length than a block's
    queries, of length 0 or without a vector have no cosine with it and are left out.
    """
    rows = vectors.where("embedding is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    asked = rows.where((F.col("vec_id") % every == 0) & (F.size("e") > 0)).withColumn("size", F.size("e"))
    plan = asked.groupBy("size").agg(F.count("*").alias("n")).orderBy("size").collect()  # a row for each length of vectors
    found = []
    for size, n in plan:
        many = -(-n // max(1, block_bytes // (8 * size)))
        for i in range(many):
            block = asked.where((F.col("size") == size) & (F.pmod(F.xxhash64("vec_id"), F.lit(many)) == i)).select("vec_id", "e").collect()
            if block:
                found.append(rows.where(F.size("e") == size).mapInArrow(_nearest([r["vec_id"] for r in block], np.array([r["e"] for r in block]), k), "query_id long, vec_id long, cosine double"))
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, cosine double, rank int")
    return top_per_group(reduce(DataFrame.unionByName, found), ["query_id"], [F.desc("cosine"), F.col("vec_id")], k)


def _nearest(ids: list[int], queries: np.ndarray, k: int):
    """A function of a task's rows (vec_id, e) that gives the k nearest to each query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array(ids, dtype=np.int64)
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        best = np.zeros((0, 3))
        for b in batches:
            if not len(b):
                continue
            vec = b.column(0).to_numpy().astype(np.int64)
            e = b.column(1).values.to_numpy(zero_copy_only=False)[b.column(1).offsets[0].as_py() : b.column(1).offsets[-1].as_py()].reshape(len(b), -1)
            with np.errstate(invalid="ignore", divide="ignore"):
                cosine = np.round(unit @ (e / np.linalg.norm(e, axis=1, keepdims=True)).T, 6)
            for q in range(len(own)):
                right = np.flatnonzero((vec != own[q]) & ~np.isnan(cosine[q]))
                if len(right) > k:  # all that tie with the last one stay
                    right = right[cosine[q][right] >= -np.partition(-cosine[q][right], k - 1)[k - 1]]
                best = np.concatenate([best, np.stack([np.full(len(right), q), vec[right], cosine[q][right]], axis=1)])
            order = np.lexsort((best[:, 1], -best[:, 2], best[:, 0]))
            best = best[order]
            first = np.searchsorted(best[:, 0], best[:, 0])
            best = best[np.arange(len(best)) - first < k]
        if len(best):
            yield pa.RecordBatch.from_arrays([pa.array(own[best[:, 0].astype(np.int64)]), pa.array(best[:, 1].astype(np.int64)), pa.array(best[:, 2])], names=["query_id", "vec_id", "cosine"])

    return run


def closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, ancestor, hops) from (child, parent): the shortest way up, however long or of at most `depth` hops; cycles end.

    Each round is saved and finds what lies one hop further up.
    """
    edges = cut(edges.select("child", "parent").distinct())
    step = edges.select(F.col("child").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).alias("hops"))
    out, d = step, 1
    while depth is None or d < depth:
        d += 1
        step = step.join(edges, F.col("ancestor") == F.col("child")).select("id", F.col("parent").alias("ancestor"), F.lit(d).alias("hops")).distinct()
        step = cut(step.join(out.select("id", "ancestor"), ["id", "ancestor"], "left_anti").where("id <> ancestor"))
        if step.isEmpty():
            break
        out = out.unionByName(step)
    return out


def rollup_hierarchy(items: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(term, n) from items (item_id, term): distinct items of a term and of all below it."""
    up = ancestors.select(F.col("id").alias("term"), "ancestor").unionByName(items.select("term", F.col("term").alias("ancestor")).distinct())
    return items.join(up, "term").groupBy(F.col("ancestor").alias("term")).agg(F.count_distinct("item_id").alias("n"))


def runs_of_failures(rows: DataFrame, key: str, order: Sequence[str], failed: Column, least: int) -> DataFrame:
    """(key, run): the longest run of failures in a row, where it reaches `least`."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.select(key, *order, failed.cast("int").alias("bad")).withColumn("island", F.sum(1 - F.col("bad")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("bad = 1").groupBy(key, "island").agg(F.count("*").alias("run")).groupBy(key).agg(F.max("run").alias("run")).where(F.col("run") >= least)


def latest(rows: DataFrame, key: str, order: Column, live: Column) -> DataFrame:
    """Replays a change feed: of each key the last row, unless that row deletes it."""
    fields = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*fields, live.alias("live__")), order).alias("r"))
    return last.where("r.live__").select(key, *[F.col(f"r.{f}").alias(f) for f in fields])


def listing_diff(old: DataFrame, new: DataFrame, key: str, tag: str) -> DataFrame:
    """(key, change): added, changed or removed between two listings (key, tag)."""
    a, b = old.select(key, F.col(tag).alias("was")), new.select(key, F.col(tag).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def bridges(works: DataFrame, keys: Sequence[str], feed: str, work: str) -> DataFrame:
    """(a, b): works of two feeds that share a key which names one work in each of them and none elsewhere; a is of the smaller feed."""
    one = works.groupBy(*keys).agg(F.count_distinct(work).alias("n"), F.count_distinct(feed).alias("feeds"), F.count_distinct(work, feed).alias("both"), F.min_by(work, feed).alias("a"), F.max_by(work, feed).alias("b"))
    return one.where("n = 2 and feeds = 2 and both = 2").select("a", "b")
