"""The folded change feed against a rebuild from all changes."""

import json
import os
import random
from pathlib import Path

import pytest

from folio_spark.streaming.feed import Feed, signed_counts

SCHEMA = "id long, at long, tags array<string>, lang string, gone boolean"
DIMS = {"tag": "tags", "lang": "array(lang)"}


def changes(seed, n, keys):
    r = random.Random(seed)
    return [(r.randrange(keys), i, r.sample(["x", "y", "z"], r.randint(0, 2)), r.choice(["en", "de", None]), r.random() < 0.2) for i in range(n)]


def rebuilt(rows):
    """(rows by key, counts) from all changes at once."""
    last = {}
    for row in sorted(rows, key=lambda x: x[1]):
        last[row[0]] = row
    counts = {}
    for _, _, tags, lang, gone in last.values():
        for d, v in [("tag", t) for t in tags] + [("lang", lang)]:
            if not gone and v is not None:
                counts[d, v] = counts.get((d, v), 0) + 1
    return last, counts


def state(feed, spark):
    return {r.id: tuple(r) for r in feed.rows(spark).select("id", "at", "tags", "lang", "gone").collect()}, {(r.dim, r.value): r.n for r in feed.counts(spark).collect()}


def size(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


@pytest.mark.parametrize("fold_rows", [1, 15, 10_000])
def test_batches_same_as_rebuild(spark, tmp_path, fold_rows):
    """Late rows, repeated batches and deletions included; counts come from differences alone."""
    feed, rows = Feed(str(tmp_path), "id", "at", "gone", DIMS, fold_rows), changes(1, 60, 12)
    random.Random(2).shuffle(rows)
    for n in range(6):
        batch = spark.createDataFrame(rows[10 * n : 10 * n + 10], SCHEMA)
        feed.apply(batch, n)
        if n == 3:
            feed.apply(batch, n)  # the batch runs again
        assert state(feed, spark) == rebuilt(rows[: 10 * n + 10])
    base, deltas = feed.state(spark)
    assert (base, deltas) == {1: (5, []), 10_000: (-1, [0, 1, 2, 3, 4, 5])}.get(fold_rows, (base, deltas)) and base + len(deltas) == 5


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    feed = Feed(str(tmp_path), "id", "at", "gone", DIMS, 5_000)
    feed.apply(spark.createDataFrame([(i, i, ["x"], f"l{i % 50}", False) for i in range(20_000)], SCHEMA), 0)
    assert feed.state(spark) == (0, [])
    before = size(tmp_path)
    feed.apply(spark.createDataFrame([(i, 30_000 + i, ["y"], "en", False) for i in range(5)], SCHEMA), 1)
    assert feed.state(spark) == (0, [1]) and size(tmp_path) - before < before / 5
    assert {(r.dim, r.value): r.n for r in feed.counts(spark).where("dim = 'tag'").collect()} == {("tag", "x"): 19_995, ("tag", "y"): 5}


def test_since_a_cursor(spark, tmp_path):
    feed = Feed(str(tmp_path), "id", "at", "gone", DIMS, 4)
    for n, rows in enumerate([[(1, 1), (2, 2), (3, 3), (4, 4)], [(1, 5)], [(1, 6), (9, 7)]]):
        feed.apply(spark.createDataFrame([(k, at, [], "en", False) for k, at in rows], SCHEMA), n)
    assert feed.state(spark) == (0, [1, 2])
    assert {(r.id, r.at) for r in feed.since(spark, 0).collect()} == {(1, 6), (9, 7)} == {(r.id, r.at) for r in feed.since(spark, 1).collect()}
    assert feed.since(spark, 2).count() == 0 and feed.since(spark, -1) is None


def test_a_folder_that_isnt_whole_is_not_read(spark, tmp_path):
    feed = Feed(str(tmp_path), "id", "at", "gone", DIMS)
    feed.apply(spark.createDataFrame([(1, 1, ["x"], "en", False)], SCHEMA), 0)
    spark.createDataFrame([(1, 9, ["broken"], "en", False)], SCHEMA).write.parquet(f"{tmp_path}/delta-1")  # no counts: the batch broke off
    assert state(feed, spark)[0][1][1] == 1
    feed.apply(spark.createDataFrame([(1, 5, ["y"], "de", False)], SCHEMA), 1)
    assert state(feed, spark) == ({1: (1, 5, ["y"], "de", False)}, {("tag", "y"): 1, ("lang", "de"): 1})


def test_stream_over_restarts(spark, tmp_path):
    feed, rows = Feed(f"{tmp_path}/feed", "id", "at", "gone", DIMS, 12), changes(3, 30, 8)
    os.mkdir(tmp_path / "in")
    for n in range(3):
        lines = [dict(zip(("id", "at", "tags", "lang", "gone"), row, strict=True)) for row in rows[10 * n : 10 * n + 10]]
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, lines)))
        feed.run(spark.readStream.schema(SCHEMA).json(f"{tmp_path}/in"), f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        assert state(feed, spark) == rebuilt(rows[: 10 * n + 10])


def test_signed_counts(spark):
    df = lambda rows: spark.createDataFrame(rows, "dim string, value string")
    got = signed_counts(df([("a", "x"), ("a", "x"), ("b", "y")]), df([("a", "x"), ("b", "y"), ("b", "z")]))
    assert {tuple(r) for r in got.collect()} == {("a", "x", -1), ("b", "z", 1)}
