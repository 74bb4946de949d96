"""Hierarchies and link chains: paths, expansion, redirects, reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def root_paths(edges: DataFrame) -> DataFrame:
    """(id, path) from (child, parent): the shortest way from a node to a root, of equally long ones the smallest, however deep; what no root lies above is left out."""
    edges = cut(edges.select("child", "parent").distinct())
    roots = edges.select(F.col("parent").alias("id")).join(edges.select(F.col("child").alias("id")), "id", "left_anti").distinct()
    step = cut(roots.select("id", F.array("id").alias("path")))
    out = step
    while True:
        # One hop down a round, so the first path that reaches a node is a shortest one.
        step = edges.join(step, F.col("parent") == F.col("id")).select(F.col("child").alias("id"), F.concat(F.array("child"), "path").alias("path"))
        step = cut(step.join(out.select("id"), "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        if step.isEmpty():
            return out
        out = out.unionByName(step)


def expand_concepts(seeds: DataFrame, ancestors: DataFrame, edges: DataFrame, decay: float = 0.5, task_rows: int = 4_000_000) -> DataFrame:
    """(item_id, term, weight) from seeds (item_id, term): 1 for itself, decay ** hops for what lies above, decay for what lies one hop below; the best weight wins.

    Items with equal sets of terms have equal results, so each set is expanded
    once, to one list; items only meet that list, and no row of theirs is shuffled.
    What meets is small however long the result, so it is dealt by the rows that
    come of it: a set's items lie in slots, each with its copy of the list, and a
    task gets slots of about task_rows rows of the result.
    """
    parts = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A struct keeps null terms. As many parts as that, since small items may have long lists.
    items = seeds.repartition(parts, "item_id").groupBy("item_id").agg(F.sort_array(F.collect_set(F.struct("term"))).alias("terms"))
    sets = cut(items.groupBy("terms").agg(F.count("*").alias("n")))
    asked = sets.select("terms", F.explode("terms").alias("t")).select("terms", "t.term")
    own = asked.select("terms", "term", F.lit(1.0).alias("weight"))
    up = asked.join(ancestors, asked.term == ancestors.id).select("terms", F.col("ancestor").alias("term"), F.pow(F.lit(decay), F.col("hops")).alias("weight"))
    down = asked.join(edges, asked.term == edges.parent).select("terms", F.col("child").alias("term"), F.lit(decay).alias("weight"))
    best = own.unionByName(up).unionByName(down).groupBy("terms", "term").agg(F.max("weight").alias("weight"))
    # Long lists come in pieces.
    piece = F.pmod(F.xxhash64("term"), F.lit(16))
    lists = cut(best.groupBy("terms", piece.alias("piece")).agg(F.collect_list(F.struct("term", "weight")).alias("found")))
    sizes = sets.join(lists.groupBy("terms").agg(F.sum(F.size("found")).alias("size")), "terms").withColumn("rows", F.col("n") * F.col("size"))
    slots = cut(sizes.select("terms", "rows", F.least(F.col("n"), F.ceil(F.col("rows") * 4 / task_rows)).cast("int").alias("slots")))
    tasks = max(parts, min(-(-(slots.agg(F.sum("rows")).first()[0] or 0) // task_rows), 100_000))
    slots = slots.select("terms", "slots")
    dealt = items.join(slots, "terms").select("item_id", "terms", F.pmod(F.xxhash64("item_id"), F.col("slots")).cast("int").alias("slot"))
    copies = lists.join(slots, "terms").select("terms", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "found")
    met = dealt.repartition(tasks, "terms", "slot").join(copies.repartition(tasks, "terms", "slot"), ["terms", "slot"])
    return met.select("item_id", F.explode("found").alias("f")).select("item_id", "f.term", "f.weight")


def redirects(merges: DataFrame, depth: int = 60, cycles: bool = False) -> DataFrame:
    """(from_id, to_id) with chains collapsed to their ends, however long.

    merges: (from_id, to_id), one row a from_id. Each round joins the mapping with
    itself, so the hops that a row spans double; it's a RuntimeError if 2 ** depth
    hops don't suffice. Chains that lead into a cycle are left out, or with
    `cycles` get the first id on it; ids on a cycle are redirected nowhere.
    """
    spans = cut(merges.select("from_id", "to_id"))
    left, hops = None, 1
    for _ in range(depth):
        nxt = spans.select(F.col("from_id").alias("n"), F.col("to_id").alias("m"))
        going = spans.join(nxt, F.col("to_id") == F.col("n"), "left")
        spans = cut(going.select("from_id", F.coalesce("m", "to_id").alias("to_id")))
        hops *= 2
        open_ = cut(spans.join(merges.select(F.col("from_id").alias("to_id")), "to_id", "left_semi"))
        n = open_.count()
        # A chain with an end that is still open gets shorter every round; if none does, all are cycles. After as many hops as there are rows, each is on its cycle.
        if n == 0 or (n == left and hops >= n):
            break
        left = n
    else:
        raise RuntimeError("redirects did not settle")
    if n == 0:
        return spans
    ended = spans.join(open_.select("from_id"), "from_id", "left_anti")
    if not cycles:
        return ended
    # Without the hops of the ids on cycles, what leads into one ends at the first of them.
    on = open_.select(F.col("to_id").alias("from_id")).distinct()
    into = merges.join(open_.select("from_id"), "from_id", "left_semi").join(on, "from_id", "left_anti")
    return ended.unionByName(redirects(into, depth))


def closes_cycle(proposed: DataFrame, ancestors: DataFrame) -> DataFrame:
    """proposed (child, parent) with would_cycle: whether the parent lies below the child already, or is the child."""
    below = ancestors.select(F.col("id").alias("parent"), F.col("ancestor").alias("child"), F.lit(True).alias("hit")).distinct()
    return proposed.join(below, ["child", "parent"], "left").select("child", "parent", (F.coalesce("hit", F.lit(False)) | (F.col("child") == F.col("parent"))).alias("would_cycle"))
