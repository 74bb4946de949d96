"""Equal sets against a comparison of all."""

import random

from folio_spark.operators.sets import equal_sets, retired_works, split_match


def test_same_as_comparing_all(spark):
    r = random.Random(6)
    draw = lambda n, most: [(f"{n}{i}", m) for i in range(60) for m in r.choices("pqrst", k=r.randint(0, most))]
    left, right = [*draw("a", 4), ("a_none", None)], [*draw("w", 4), ("w_none", None)]
    sets = lambda rows: {k: {m for x, m in rows if x == k} for k, _ in rows}
    want = {}
    for k, s in sets(left).items():
        same = [t for t, u in sets(right).items() if u == s and None not in s]
        if same:
            want[k] = min(same)
    got = equal_sets(spark.createDataFrame(left, "k string, m string"), spark.createDataFrame(right, "t string, m string"), "k", "t", "m")
    assert {r.k: r.t for r in got.collect()} == want


def test_split_match(spark):
    pins = spark.createDataFrame([("i1", "w1"), ("i2", "w1"), ("i3", "w2"), ("i1", "w3"), ("i2", "w3"), ("i3", "w3")], "instance_id string, work_id string")
    asked = spark.createDataFrame([("exact", "i2"), ("exact", "i1"), ("part", "i1"), ("more", "i3"), ("more", "i4"), ("all", "i1"), ("all", "i2"), ("all", "i3"), ("all", "i3")], "ask string, instance_id string")
    assert {tuple(r) for r in split_match(pins, asked).collect()} == {("exact", "w1"), ("all", "w3")}
    assert split_match(pins.limit(0), asked).count() == 0


def test_retired(spark):
    merges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c"), ("", "c"), ("a", "b")], "from_id string, to_id string")
    assert {r.work_id for r in retired_works(merges).collect()} == {"a", "b"}
