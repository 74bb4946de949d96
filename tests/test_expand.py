"""Expansion of items by the terms around theirs, against all of them one by one."""

from folio_spark.operators.graph import expand_concepts
from folio_spark.operators.relational import closure

EDGES = [("a1", "a"), ("a2", "a"), ("a", "top"), ("b", "top")]


def test_same_as_one_by_one(spark):
    seeds = [(1, "a"), (1, "b"), (2, "a1"), (2, "a"), (2, "a"), (3, "b"), (4, "b"), (5, None), (6, "none"), (None, "b")]
    want = {}
    for item, term in seeds:
        up, at, hops = dict(EDGES), term, 0
        near = [(term, 1.0)] + [(c, 0.5) for c, p in EDGES if p == term]
        while (at := up.get(at)) is not None:
            hops += 1
            near.append((at, 0.5**hops))
        for t, w in near:
            want[item, t] = max(w, want.get((item, t), 0))
    e = spark.createDataFrame(EDGES, "child string, parent string")
    out = expand_concepts(spark.createDataFrame(seeds, "item_id long, term string"), closure(e), e)
    rows = [((r.item_id, r.term), r.weight) for r in out.collect()]
    assert len(rows) == len(want) and dict(rows) == want


def test_no_expanded_row_is_shuffled(spark):
    """Items meet the lists of their set of terms: nothing is grouped behind that."""
    e = spark.createDataFrame(EDGES, "child string, parent string")
    out = expand_concepts(spark.createDataFrame([(1, "a"), (2, "a")], "item_id long, term string"), closure(e), e)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Aggregate" not in above and "Generate" in above


def test_long_results_are_dealt_over_tasks(spark):
    """600 items of one term with 300 rows each are small, but no task gets more than a few times its share of the 180,000 rows."""
    from pyspark.sql import functions as F

    e = spark.createDataFrame([(f"c{i}", "t") for i in range(299)], "child string, parent string")
    seeds = spark.range(600).select(F.col("id").alias("item_id"), F.lit("t").alias("term"))
    out = expand_concepts(seeds, closure(e), e, task_rows=6_000)
    tasks = out.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(t["count"] for t in tasks) == 180_000 == out.select("item_id", "term").distinct().count()
    assert len(tasks) >= 15 and max(t["count"] for t in tasks) < 36_000


def test_by_default_results_use_all_parts(spark):
    """However small the rows that meet, one task doesn't give the whole result."""
    from pyspark.sql import functions as F

    e = spark.createDataFrame([(f"c{i}", f"t{i % 25}") for i in range(2_500)], "child string, parent string")
    seeds = spark.range(5_000).select(F.col("id").alias("item_id"), F.concat(F.lit("t"), F.col("id") % 25).alias("term"))
    tasks = expand_concepts(seeds, closure(e), e).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(t["count"] for t in tasks) == 5_000 * 101 and len(tasks) == 4
