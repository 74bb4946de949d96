"""Operators on small fixtures that the registered queries don't reach."""

import math
import random

import pytest
from pyspark.sql import functions as F

from folio_spark.functions import text as T
from folio_spark.operators import graph as G
from folio_spark.operators import relational as R
from folio_spark.operators import vocabulary as V
from folio_spark.operators import works as W
from folio_spark.streaming.activity import live, upsert


def test_closure_deep_and_cyclic(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "c"), ("d", "b"), ("a", "c"), ("a", "c")] + [(f"n{i}", f"n{i + 1}") for i in range(14)]
    want: dict = {}
    for start in {c for c, _ in rows}:
        seen, front, hops = {}, {start}, 0
        while front := {p for c, p in rows if c in front} - set(seen) - {start}:
            hops += 1
            seen |= dict.fromkeys(front, hops)
        want |= {(start, k): v for k, v in seen.items()}
    got = R.closure(spark.createDataFrame(rows, "child string, parent string"))
    assert {(r.id, r.ancestor): r.hops for r in got.collect()} == want and want["n0", "n14"] == 14
    assert R.closure(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_ambiguous_keys_bridge_nothing(spark):
    rows = [("t", "a", 1), ("t", "b", 2), ("u", "a", 3), ("u", "a", 4), ("u", "b", 5), ("v", "a", 6), ("v", "b", 7), ("v", "c", 8), ("w", "a", 9), ("x", "a", 10), ("x", "a", 10), ("x", "b", 11)]
    got = R.bridges(spark.createDataFrame(rows, "key string, feed string, work int"), ["key"], "feed", "work")
    assert sorted(map(tuple, got.collect())) == [(1, 2), (10, 11)]


def test_root_paths_and_numbers(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("c", "x"), ("x", "a"), ("p", "q"), ("q", "p")], "child string, parent string")
    assert {r.id: r.path for r in G.root_paths(edges).collect()} == {"a": ["a"], "b": ["b", "a"], "x": ["x", "a"], "c": ["c", "b", "a"]}
    wanted = spark.range(5, 400, 7).select("id")
    assert [r.number for r in V.next_numbers(wanted, "id", 100).orderBy("id").collect()] == list(range(101, 101 + wanted.count()))
    used = {90, 100, 101, 102, 105, 106, 107, 300, 10**9, *range(120, 140, 2)}
    free = [x for x in range(101, 1000) if x not in used][: wanted.count()]
    got = V.next_numbers(wanted, "id", 100, spark.createDataFrame([(u,) for u in [*used, 105]], "number long"))
    assert [r.number for r in got.orderBy("id").collect()] == free and got.columns == [*wanted.columns, "number"]


def test_upsert_keeps_deleted_keys_deleted(spark, tmp_path):
    schema = "id int, at int, value string, deleted boolean"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    target = f"{tmp_path}/out"

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        upsert(stream, target, "id", "at", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    put(0, [(1, 1, "a", False), (2, 1, "b", False)])
    run()
    put(1, [(1, 5, None, True), (2, 2, "c", False)])
    run()
    put(2, [(1, 3, "late", False), (3, 1, "d", False)])
    run()
    assert sorted((r.id, r.value) for r in live(spark.read.parquet(f"{target}/v2")).collect()) == [(2, "c"), (3, "d")]


def test_near_duplicates_against_pairs(spark):
    r = random.Random(4)
    rows = [(i, r.choice("abc"), r.choice(["x", "y", "", None]), r.choice("pqr"), r.choice(["m", "n", None])) for i in range(60)]
    works = spark.createDataFrame(rows, "id int, a string, b string, c string, who string")
    got = {}
    for x in W.near_duplicates(works, "id", {"a": F.concat("a", "b"), "b": F.col("b"), "c": F.concat("c", "a"), "d": F.col("c")}, {"d": F.col("who")}).collect():
        got.setdefault((x.tier, x.key), set()).add(x.id)
    want, covered = {}, set()
    for tier, key in [("a", lambda x: x[1] + x[2] if x[2] is not None else None), ("b", lambda x: x[2]), ("c", lambda x: x[3] + x[1]), ("d", lambda x: x[3])]:
        groups: dict = {}
        for x in rows:
            if key(x):
                groups.setdefault(key(x), []).append(x)
        for k, g in groups.items():
            pairs = {(p[0], q[0]) for p in g for q in g if p[0] < q[0]}
            if tier == "d" and len({x[4] or "" for x in g}) < 2:
                continue
            if pairs - covered:
                want[tier, k] = {x[0] for x in g}
            covered |= pairs
    assert got == want
    assert W.near_duplicates(works.limit(0), "id", {"a": F.col("a")}).count() == 0


def test_no_author_is_a_value_of_its_own(spark):
    works = spark.createDataFrame([(1, "t", None), (2, "t", "Byrd"), (3, "s", None), (4, "s", None)], "id int, t string, who string")
    got = {(x.tier, x.key, x.id) for x in W.near_duplicates(works, "id", {"title": F.col("t")}, {"title": F.col("who")}).collect()}
    assert got == {("title", "t", 1), ("title", "t", 2)}


def test_category_members(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("z", "y"), ("d", "b")], "child string, parent string")
    roots = spark.createDataFrame([("k", "a"), ("m", "b"), ("n", "lone")], "category string, root string")
    got = {tuple(x) for x in W.category_members(roots, edges).collect()}
    assert got == {(k, x) for k in "km" for x in "abcd"} | {("n", "lone")}


def test_pages_labels_and_headings(spark):
    works = spark.createDataFrame([(i, i % 3 == 0, None if i % 2 else False) for i in range(12)], "id int, hit boolean, gone boolean")
    for limit in (0, 501, 50):  # outside of 1 to 500: 50
        page = W.works_page(works, F.col("hit"), F.col("gone"), ["id"], limit=limit).collect()
        assert [(x.id, x.total, x.matched) for x in page] == [(i, 12, 4) for i in (0, 3, 6, 9)]
    assert [x.id for x in W.works_page(works, F.col("hit"), F.col("gone"), ["id"], limit=1).collect()] == [0]
    with pytest.raises(ValueError):
        W.works_page(works, F.col("hit"), F.col("gone"), ["id"], mode="some")
    labels = spark.createDataFrame([("u", "Cat  Food"), ("u", "cat"), ("v", None), ("w", "dog"), ("x", "Cat\u00a0\u2003nap")], "uri string, label string")
    assert sorted(tuple(x) for x in W.prefix_hits(labels, " CAT").collect()) == [("u", "cat"), ("x", "cat nap")] and W.prefix_hits(labels, " ").count() == 0
    more = spark.createDataFrame([("a", "x", "Cats"), ("b", "y", "catalog"), ("c", "x", "Cat"), ("d", "x", "cats")], "uri string, scheme string, label string")
    assert [tuple(x) for x in W.prefix_hits(more, "cat", "x", 2).collect()] == [("c", "cat"), ("a", "cats")]
    heads = spark.createDataFrame([("Drag queens (Fiction)", "stories", "story"), ("dragqueen", "boxes", "box"), (None, "plates", "plate"), ("x drag queenses", "glass", "glass")], "h string, a string, b string")
    got = heads.select(T.has_keywords(F.col("h"), "drag-queen"), T.plural_equal(F.col("a"), F.col("b"))).collect()
    assert [tuple(x) for x in got] == [(True, True), (False, True), (False, False), (False, True)]


def test_vector_topk_in_blocks(spark):
    """Blocks of a few queries give what all pairs give; ties by id; vectors of other lengths, of zeros or missing are left out."""
    r = random.Random(2)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(3)]) for i in range(60)] + [(100, [1.0, 0.0]), (110, [0.0, 2.0]), (61, None), (120, []), (70, [0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    norm = lambda e: math.sqrt(sum(x * x for x in e))
    want = {}
    for q, e in rows:
        if q % 10 == 0 and e and norm(e):
            near = [(-round(sum(x * y for x, y in zip(e, f, strict=True)) / norm(e) / norm(f), 6), v) for v, f in rows if v != q and f and len(f) == len(e) and norm(f)]
            want[q] = [v for _, v in sorted(near)[:4]]
    for size in (50, 1 << 20):
        got = {}
        for x in R.vector_topk(table, 4, 10, size).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append(x.vec_id)
        assert got == want
    assert R.vector_topk(table.limit(0)).count() == 0


def test_bm25_counts_only_documents_with_words(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat"), (3, None), (4, " !"), (5, "bird bird")], "id int, text string")
    got = R.bm25(docs, "id", F.col("text"), ["cat", "none"], 5).collect()
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    want = [(2, round(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 1 / (5 / 3))), 6)), (1, round(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / (5 / 3))), 6))]
    assert [(x.id, x.score) for x in got] == want
    assert [x.id for x in R.bm25(docs, "id", F.col("text"), ["cat", "dog", "none"], 5, least=2).collect()] == [1]
    assert [x.id for x in R.all_terms(docs, "id", F.col("text"), ["cat", "dog"]).collect()] == [1]
