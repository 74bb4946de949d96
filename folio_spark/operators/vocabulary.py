"""Terms of vocabularies: matching by identifier and label, equivalents, rewriting of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canon_uri, norm_label
from .lineage import cut

# The strength of a link; a pivot is as strong as its weaker link.
STRENGTH = {"exact": 2, "close": 1}


def match_identifiers(uris: DataFrame, terms: DataFrame, links: DataFrame) -> DataFrame:
    """(uri, scheme, id): the live term that a URI names itself, else one that links to it exactly, else closely; within a tier the smallest (scheme, id).

    terms: (scheme, id), live ones. links: (src, rel exact/close, dst).
    """
    own = terms.select(canon_uri(F.col("id")).alias("key"), F.lit(0).alias("tier"), "scheme", "id")
    linked = links.join(terms, links.src == terms.id).select(canon_uri(F.col("dst")).alias("key"), F.when(F.col("rel") == "exact", 1).otherwise(2).alias("tier"), "scheme", "id")
    best = own.unionByName(linked).where("key <> ''").groupBy("key").agg(F.min(F.struct("tier", "scheme", "id")).alias("t"))
    return uris.withColumn("key", canon_uri(F.col("uri"))).join(best, "key").select("uri", "t.scheme", "t.id")


def equivalents(links: DataFrame) -> DataFrame:
    """(src, dst, strength): terms linked directly in either direction, or through one other; the strongest way wins.

    A pivot goes through a shared target, a shared source or a chain; equi-joins
    on the canonical identifier. Links aren't transitive beyond one pivot.
    """
    strength = F.when(F.col("rel") == "exact", STRENGTH["exact"]).otherwise(STRENGTH["close"])
    out = links.select(canon_uri(F.col("src")).alias("a"), canon_uri(F.col("dst")).alias("b"), strength.alias("w")).where("a <> '' and b <> '' and a <> b")
    both = out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.max("w").alias("w"))
    nxt = both.select(F.col("a").alias("via"), F.col("b").alias("c"), F.col("w").alias("v"))
    pivots = both.join(nxt, both.b == nxt.via).where("a <> c").select("a", F.col("c").alias("b"), F.least("w", "v").alias("w"), F.lit(0).alias("direct"))
    found = both.withColumn("direct", F.lit(1)).unionByName(pivots).groupBy("a", "b").agg(F.max(F.struct("w", "direct")).alias("x"))
    return found.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.when(F.col("x.w") == 2, "exact").otherwise("close").alias("strength"), (F.col("x.direct") == 1).alias("direct"))


def match_labels(headings: DataFrame, labels: DataFrame) -> DataFrame:
    """(heading, id, confidence): equal labels; 0.9 by a preferred one, 0.75 by an alternative; the best, then the smallest id. labels: (id, label, alt)."""
    norm = norm_label
    known = labels.select(norm(F.col("label")).alias("norm"), "id", F.when(F.col("alt"), 0.75).otherwise(0.9).alias("confidence")).where("norm <> ''")
    best = known.groupBy("norm").agg(F.min(F.struct(-F.col("confidence"), F.col("id"))).alias("m"))
    return headings.withColumn("norm", norm(F.col("heading"))).join(best, "norm").select("heading", "m.id", (-F.col("m.col1")).alias("confidence"))


def rewrite_references(links: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """links with losers in a column replaced by winners, once each; mapping: (loser, winner)."""
    out = links.join(mapping, links[column] == mapping.loser, "left").withColumn(column, F.coalesce("winner", column))
    return out.select(links.columns).distinct()


def unambiguous(pairs: DataFrame, key: str, target: str) -> DataFrame:
    """(key, target) of keys that name one target alone."""
    return pairs.groupBy(key).agg(F.min(target).alias(target), F.max(target).alias("other")).where(F.col(target) == F.col("other")).select(key, target)


def running_total(rows: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """rows with the sum of value over all rows up to each, by order.

    Rows are added up within the ranges of a sort; the totals of the ranges, one
    row a task, are added on. The sort is saved, so that both read the same ranges.
    """
    part = cut(rows.withColumn("value__", value).orderBy(*order).withColumn("part__", F.spark_partition_id()))
    local = part.withColumn(name, F.sum("value__").over(Window.partitionBy("part__").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    ahead = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    totals = local.groupBy("part__").agg(F.sum("value__").alias("total__")).withColumn("before__", F.coalesce(F.sum("total__").over(ahead), F.lit(0)))
    return local.join(totals, "part__").withColumn(name, F.col("before__") + F.col(name)).drop("part__", "value__", "total__", "before__")


def next_numbers(wanted: DataFrame, order: str, top: int, used: DataFrame | None = None) -> DataFrame:
    """wanted with number: the numbers from top + 1 on that aren't used (number), by order.

    The n-th free number lies behind as many used ones as leave less than n free
    before them; these are counted for all rows at once, in one more sort.
    """
    numbered = running_total(wanted, [order], F.lit(1), "number")
    if used is None:
        return numbered.withColumn("number", F.col("number") + top)
    taken = used.select(F.col("number").cast("long").alias("number")).where(F.col("number") > top).distinct()
    # With i used numbers up to u, u - top - i numbers before it are free.
    free = running_total(taken, ["number"], F.lit(1), "i").select((F.col("number") - top - F.col("i")).alias("n"))
    both = numbered.withColumnRenamed("number", "n").withColumn("taken__", F.lit(0)).unionByName(free.withColumn("taken__", F.lit(1)), allowMissingColumns=True)
    shifted = running_total(both, ["n", "taken__"], F.col("taken__"), "shift__").where("taken__ = 0")
    return shifted.withColumn("number", F.col("n") + F.col("shift__") + top).drop("n", "taken__", "shift__")
