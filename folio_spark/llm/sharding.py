"""Sharding by extendible hashing: only oversized buckets split on another hash bit."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BITS = 32
# The most rows of a directory table that every task may hold; larger ones are joined by sorting, where skewed buckets are split at run time.
SMALL = 100_000


def held(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def directory(sizes: DataFrame, max_bytes: int, low: int, high: int) -> DataFrame:
    """(d, p, bytes, lo, hi, ends): the buckets of `low` to `high` bits, from rows (hash, bytes, lo, hi).

    A bucket ends if it holds max_bytes at most, or one hash value only, or has
    all the bits. Sums are made once at the finest depth and halved from there,
    so rows are read once and not copied.
    """
    finest = sizes.groupBy(F.shiftright("hash", BITS - high).alias("p")).agg(F.sum("bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    levels = finest.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(high)))).select("d", F.expr(f"shiftright(p, {high} - d)").alias("p"), "bytes", "lo", "hi")
    sums = levels.groupBy("d", "p").agg(F.sum("bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ends = (F.col("bytes") <= max_bytes) | (F.col("lo") == F.col("hi")) | (F.col("d") == BITS)
    return sums.withColumn("ends", ends)


def shard(docs: DataFrame, *, max_bytes: int = 8 << 20, start_bits: int | None = None, step: int = 4) -> DataFrame:
    """docs' doc_id with shard (bits of the hash as a string), depth and n_bytes (UTF-8 bytes of text).

    The hash is the first 32 bits of md5(doc_id). The directory starts at a depth
    where a bucket holds about a quarter of max_bytes (`start_bits` sets another);
    only buckets that are still oversized there are deepened, `step` bits a round,
    from one row for each hash value in them. A row finds its leaf through the
    hash bits at the starting depth. A shard exceeds max_bytes only if all its
    rows share one hash value, which no bit can split.

    Null doc_id: hashed as an empty string. Null text: 0 bytes. Repeated rows: the
    same shard. Empty table: no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    hashed = scratch.save(
        docs.select(
            "doc_id",
            F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long").alias("hash"),
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        ),
        "hashed",
    )
    if start_bits is None:
        total = hashed.agg(F.sum("n_bytes")).first()[0] or 0
        start_bits = min(BITS - step, max(1, math.ceil(math.log2(max(1, total / max_bytes))) + 2))
    sizes = hashed.select("hash", F.col("n_bytes").alias("bytes"), F.col("hash").alias("lo"), F.col("hash").alias("hi"))
    every = scratch.save(directory(sizes, max_bytes, 0, start_bits), "sums")
    depth, last, rest = start_bits, every, sizes
    while depth < BITS:
        wide = last.where((F.col("d") == depth) & ~F.col("ends")).select(F.col("p").alias("w"))
        n_wide = wide.count()
        if not n_wide:
            break
        # One row for each hash value of an oversized bucket: rows of one hot document are summed before they move.
        inside = rest.join(held(wide, n_wide), F.shiftright("hash", BITS - depth) == F.col("w"), "left_semi")
        rest = scratch.save(inside.groupBy("hash").agg(F.sum("bytes").alias("bytes")), f"rest{depth}")
        low, depth = depth + 1, min(depth + step, BITS)
        last = scratch.save(directory(rest.select("hash", "bytes", F.col("hash").alias("lo"), F.col("hash").alias("hi")), max_bytes, low, depth), f"sums{depth}")
        every = every.unionByName(last)
    # A leaf ends a path that nothing above it ends: the first end along the path.
    ends = every.where("ends").select("d", "p")
    above = every.where(~F.col("ends")).select((F.col("d") + 1).alias("d"), F.col("p").alias("q"))
    leaves = ends.join(above, (ends.d == above.d) & (F.shiftright(ends.p, 1) == above.q), "left_semi").unionByName(ends.where("d = 0"))
    # Directory entries at start_bits: one leaf for all rows below, or several deeper ones.
    span = F.when(F.col("d") < start_bits, F.expr(f"sequence(shiftleft(p, cast({start_bits} - d as int)), shiftleft(p + 1, cast({start_bits} - d as int)) - 1)")).otherwise(F.array(F.expr(f"shiftright(p, cast(greatest(d - {start_bits}, 0) as int))")))
    entries = leaves.select("d", "p", F.explode(span).alias("slot")).groupBy("slot").agg(F.collect_list(F.struct("d", "p")).alias("leaves"))
    entries = scratch.save(entries, "entries")
    n_leaves = entries.agg(F.sum(F.size("leaves"))).first()[0] or 0
    found = hashed.withColumn("slot", F.shiftright("hash", BITS - start_bits)).join(held(entries, n_leaves), "slot")
    leaf = F.filter("leaves", lambda x: (F.floor(F.col("hash") / F.pow(F.lit(2.0), BITS - x["d"])).cast("long") == x["p"]))[0]
    return found.withColumn("leaf", leaf).select("doc_id", F.lpad(F.when(F.col("leaf.d") == 0, "").otherwise(F.bin("leaf.p")), F.col("leaf.d"), F.lit("0")).alias("shard"), F.col("leaf.d").cast("int").alias("depth"), "n_bytes")
