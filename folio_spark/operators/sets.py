"""Sets that are equal, whatever the order of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def fingerprints(members: DataFrame, key: str, member: str) -> DataFrame:
    """(key, size, a, b) of sets given as rows (key, member): sums of two hashes, so that a set is added up in parts."""
    one = members.select(key, F.col(member).alias("m")).where("m is not null").distinct()
    total = lambda h: F.sum(h.cast("decimal(20,0)"))
    return one.groupBy(key).agg(F.count("*").alias("size"), total(F.xxhash64("m")).alias("a"), total(F.xxhash64(F.lit(1), "m")).alias("b"))


def equal_sets(asked: DataFrame, held: DataFrame, key: str, target: str, member: str) -> DataFrame:
    """(key, target) of asked sets (key, member) and the smallest held set (target, member) that has exactly their members.

    Sets meet by size and fingerprint; equal held sets stand for one another by
    their smallest target, and a meeting counts once every member is found on
    both sides. Null members don't count; empty sets equal nothing.
    """
    left = cut(fingerprints(asked, key, member))
    # One held set a fingerprint: those behind it are equal to it, or none of them is what was asked.
    right = cut(fingerprints(held, target, member).groupBy("size", "a", "b").agg(F.min(target).alias(target)))
    met = cut(left.join(right, ["size", "a", "b"]).select(key, target, "size"))
    own = asked.select(key, F.col(member).alias("m")).where("m is not null").distinct()
    theirs = held.select(target, F.col(member).alias("m")).where("m is not null").distinct()
    found = met.join(own, key).join(theirs, [target, "m"]).groupBy(key, target, "size").agg(F.count("*").alias("n"))
    return found.where("n = size").select(key, target)


def split_match(pins: DataFrame, asked: DataFrame) -> DataFrame:
    """(ask, work_id) of asked (ask, instance_id): the work that an earlier split gave exactly these instances, from pins (instance_id, work_id)."""
    return equal_sets(asked, pins, "ask", "work_id", "instance_id")


def retired_works(merges: DataFrame) -> DataFrame:
    """(work_id): works that a merge (from_id, to_id) has folded into another."""
    return merges.where("from_id <> '' and from_id <> to_id").select(F.col("from_id").alias("work_id")).distinct()
