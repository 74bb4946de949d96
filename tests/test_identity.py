"""Identity of records against a fold that takes one record after another."""

import random

import pytest
from pyspark.sql import functions as F

from folio_spark.operators.identity import Prior, conflicts, cross_feed_merges, fold_groups, minted, resolve, scoped_anchors, work_for_keys, work_key

RECORD = "ord long, keys array<string>, cluster_key string, anchors array<string>, title string"
SCHEMAS = {
    "instances": "ord long, instance_id string, work_id string, keys array<string>",
    "works": "ord long, work_id string, cluster_key string",
    "anchors": "ord long, anchor string, work_id string",
    "merges": "ord long, from_id string, to_id string",
    "pins": "ord long, instance_id string, work_id string",
}


def prior(spark, **rows):
    return Prior(**{k: spark.createDataFrame([(i, *r) for i, r in enumerate(rows.get(k, []))], s) for k, s in SCHEMAS.items()})


def frame(spark, records):
    return spark.createDataFrame([(*r, f"t{r[0]}") for r in records], RECORD)


def one_by_one(records, instances=(), works=(), anchors=(), merges=(), pins=()):
    """ord -> (instance, work, new instance, new work); new ids are named by their record. And the keys in conflict."""
    of_key, of_instance, of_cluster, of_anchor, pin, onward, clash = {}, {}, {}, {}, {}, dict(merges), set()
    for i, w, keys in instances:
        of_instance[i] = w
        of_key |= dict.fromkeys(keys, i)
    of_cluster |= {k: w for w, k in works if k}
    for a, w in anchors:
        of_anchor.setdefault(a, w)
    for i, w in pins:
        pin.setdefault(i, w)

    def end(w):
        seen = set()
        while w in onward and w not in seen:
            seen.add(w)
            w = onward[w]
        return w

    out = {}
    for ord_, keys, cluster, marks in sorted(records, key=lambda r: r[0]):
        keys, marks = [k for k in keys or [] if k], [a for a in marks or [] if a]
        i = next((of_key[k] for k in keys if k in of_key), None)
        new_i = i is None
        i = ("i", ord_) if new_i else i
        for k in keys:
            if of_key.setdefault(k, i) != i:
                clash.add((ord_, k))
        new_w = False
        if i in pin:
            w = pin[i]
        elif i in of_instance:
            w = of_instance[i]
        else:
            w = next((of_anchor[a] for a in marks if a in of_anchor), None)
            if w is None:
                w = of_cluster.get(cluster) if cluster else None
                if w is None:
                    w, new_w = ("w", ord_), True
                    if cluster:
                        of_cluster[cluster] = w
            for a in marks:
                of_anchor.setdefault(a, w)
        of_instance[i] = w
        out[ord_] = (i, end(w), new_i, new_w)
    return out, clash


def same(spark, records, **seeds):
    """The operator's result under the fold's names of new ids."""
    p, df = prior(spark, **seeds), frame(spark, records)
    assigned = resolve(df, p, "run").cache()
    got = {r.ord: tuple(r)[1:] for r in assigned.collect()}
    want, clash = one_by_one(records, **seeds)
    names = {v[0]: ("i", k) for k, v in got.items() if v[2]} | {v[1]: ("w", k) for k, v in got.items() if v[3]}
    assert {k: (names.get(i, i), names.get(w, w), a, b) for k, (i, w, a, b) in got.items()} == want
    assert {(r.ord, r.key) for r in conflicts(df, p, assigned).collect()} == clash
    return got, assigned, df


def test_mints_then_clusters(spark):
    got, *_ = same(spark, [(1, ["a:1", "isbn:A"], "k", []), (2, ["a:2", "isbn:B"], "k", []), (3, ["b:9", "isbn:A"], "other", [])])
    assert got[1][1] == got[2][1] and got[1][0] != got[2][0] and got[3][:2] == got[1][:2] and not got[3][3]


def test_anchor_ahead_of_cluster_key(spark):
    rows = [(1, ["c:1"], "k1", ["oc:1\x1feng"]), (2, ["c:2"], "k2", ["oc:1\x1feng"]), (3, ["c:3"], "k3", ["oc:1\x1fspa"]), (4, ["c:4"], "k2", [])]
    got, *_ = same(spark, rows)
    assert got[1][1] == got[2][1] != got[3][1] and got[4][3]  # an anchored record binds no cluster key


def test_seeds_pins_merges(spark):
    seeds = {
        "instances": [("i1", "w1", ["isbn:1"]), ("i2", "w1", ["isbn:2"])], "works": [("w1", "k"), ("w0", "")], "anchors": [("oc:9", "w7"), ("oc:9", "w8")],
        "merges": [("w7", "w6"), ("w6", "w5"), ("x1", "x2"), ("x2", "x1")], "pins": [("i2", "wnew"), ("i2", "wlate")],
    }
    rows = [(1, ["isbn:1"], "k", []), (2, ["isbn:2"], "k", []), (3, ["n:1"], "z", ["oc:9"]), (4, ["n:2"], "k", []), (5, ["n:3"], "", []), (6, [], None, None), (7, None, "", []), (8, ["isbn:1", "isbn:2"], "k", [])]
    got, *_ = same(spark, rows, **seeds)
    assert [got[k][1] for k in (1, 2, 3, 4)] == ["w1", "wnew", "w5", "w1"] and len({got[k][1] for k in (5, 6, 7)}) == 3


@pytest.mark.parametrize("seed", range(3))
def test_random_corpora(spark, seed):
    r = random.Random(seed)
    keys, clusters, marks = [f"k:{i}" for i in range(40)], ["", *[f"c{i}" for i in range(12)]], [f"a{i}" for i in range(8)]
    some = lambda xs, most: r.sample(xs, r.randint(0, most))
    seeds = {
        "instances": [(f"i{i}", f"w{r.randrange(5)}", some(keys, 3)) for i in range(6)], "works": [(f"w{r.randrange(5)}", r.choice(clusters)) for _ in range(4)],
        "anchors": [(r.choice(marks), f"w{r.randrange(5)}") for _ in range(3)], "merges": [("w1", "w2"), ("w2", "w3")], "pins": [(f"i{r.randrange(6)}", f"p{i}") for i in range(2)],
    }
    same(spark, [(i, some(keys, 4) + some(keys, 1), r.choice(clusters), some(marks, 2)) for i in r.sample(range(500), 120)], **seeds)


def test_long_chain(spark):
    """10,000 records, each known by a key of the one before: one instance, one work; a second chain holds by anchors."""
    n = 10_000
    rows = [(i, [f"k{i}", f"k{i - 1}"] if i % 2 else [f"k{i - 1}", f"k{i}"], "", []) for i in range(n)] + [(n + i, [f"x{i}"], "", [f"a{i - 1}", f"a{i}"]) for i in range(300)]
    got, *_ = same(spark, rows)
    assert len({got[i][:2] for i in range(n)}) == 1 and len({got[n + i][1] for i in range(300)}) == 1


def test_empty(spark):
    assert resolve(frame(spark, []), Prior.empty(spark), "run").collect() == []


def test_again_the_same_ids(spark):
    """A second run that is seeded with the first gives its ids and mints nothing."""
    rows = [(1, ["a:1", "isbn:A"], "k", []), (2, ["a:2"], "k", ["oc:1"]), (3, ["a:3"], "", [])]
    first = {r.ord: r for r in resolve(frame(spark, rows), Prior.empty(spark), "run").collect()}
    seeds = {"instances": [(first[o].instance_id, first[o].work_id, keys) for o, keys, *_ in rows], "works": [(first[1].work_id, "k")]}
    again = {r.ord: r for r in resolve(frame(spark, rows), prior(spark, **seeds), "later").collect()}
    assert all((again[o].instance_id, again[o].work_id, again[o].minted_instance, again[o].minted_work) == (first[o].instance_id, first[o].work_id, False, False) for o in first)


def test_ids_in_use_are_drawn_anew(spark):
    rows = spark.createDataFrame([(1,), (2,)], "ord long")
    first = {r.ord: r.id for r in minted(rows, "w", "run", spark.createDataFrame([], "id string")).collect()}
    again = {r.ord: r.id for r in minted(rows, "w", "run", spark.createDataFrame([(first[1],)], "id string")).collect()}
    assert again[2] == first[2] and again[1] != first[1] and len(again[1]) == 17


def test_fold_groups(spark):
    rows = [(5, ["a"], "k", []), (3, ["b"], "k", []), (9, ["a"], "k", []), (1, ["z"], "", [])]
    _, assigned, df = same(spark, rows)
    groups, members = fold_groups(df, assigned, ["title"])
    assert sorted((g.first_ord, g.title, g.n_records, g.n_instances, g.minted) for g in groups.collect()) == [(1, "t1", 1, 1, True), (3, "t3", 3, 2, True)]
    assert sorted(m.ord for m in members.collect()) == [1, 3, 5]


def test_work_for_keys(spark):
    """Exact keys follow merges; a bare key finds its buckets if all are one work; 'c:51' isn't the beginning of 'c:518'."""
    seeds = {"instances": [("i1", "w1", ["id:c:518:ebook"]), ("i2", "w1", ["id:c:518:audio"]), ("i3", "w2", ["id:c:7:a"]), ("i4", "w3", ["id:c:7:b"]), ("i5", "w4", ["id:x"]), ("i6", "w9", ["id:x:1"])], "merges": [("w1", "w8")]}
    asked = spark.createDataFrame([(k,) for k in ("id:c:518", "id:c:518:ebook", "id:c:51", "id:c:7", "id:x", "id:none")], "key string")
    assert {tuple(r) for r in work_for_keys(asked, prior(spark, **seeds)).collect()} == {("id:c:518", "w8"), ("id:c:518:ebook", "w8"), ("id:x", "w4")}


@pytest.mark.parametrize(
    "matches, works, feeds, want",
    [
        ([("n1", "k")], [("w1", "k")], [("w1", "other")], {("n1", "w1")}),
        ([("n1", "k")], [("w1", "k")], [("w1", "own")], set()),
        ([("n1", "k")], [("w1", "k"), ("w2", "k")], [("w1", "other"), ("w2", "third")], set()),
        ([("n1", "k"), ("n2", "k")], [("w1", "k")], [("w1", "other")], set()),
        ([("n1", "k")], [("w1", "k")], [("w1", "other"), ("w1", "own")], set()),
        ([("n1", "")], [("w1", "")], [("w1", "other")], set()),
        ([("n1", "k")], [("w1", "k"), ("w2", "k")], [("w1", "own"), ("w2", "third")], {("n1", "w2")}),
    ],
)
def test_cross_feed_merges(spark, matches, works, feeds, want):
    got = cross_feed_merges(spark.createDataFrame(matches, "work_id string, match_key string"), prior(spark, works=works), spark.createDataFrame(feeds, "work_id string, feed string"), "own")
    assert {tuple(r) for r in got.collect()} == want


def test_keys(spark):
    rows = spark.createDataFrame([("Byrd, Lee", " Night--Ferry ", [" ENG", "spa", "eng", None]), (None, "!!", ["eng"]), (None, "X", None)], "a string, t string, l array<string>")
    got = rows.select(work_key(F.col("a"), F.col("t"), F.col("l")).alias("k"), scoped_anchors(F.array(F.lit("oc:1")), F.col("l")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("byrd lee\x1fnight ferry\x1feng spa", ["oc:1\x1feng spa"]), ("", ["oc:1\x1feng"]), ("\x1fx\x1f", ["oc:1\x1f"])]
