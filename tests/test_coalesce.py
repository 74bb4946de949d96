"""Bursts as a table and as a stream that is restarted."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folio_spark.streaming.coalesce import coalesce_changes, coalesce_stream

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def seconds(rows):
    return sorted((r.key, (r.started - START).total_seconds(), (r.ended - START).total_seconds(), r.n, r.reason) for r in rows)


def bursts(spark, changes):
    return seconds(coalesce_changes(spark.createDataFrame([(k, at(s)) for k, s in changes], "key string, at timestamp")).collect())


def test_a_burst_is_one(spark):
    assert bursts(spark, [("a", 0), ("a", 1), ("a", 4.5), ("b", 2), ("a", 30)]) == [("a", 0, 4.5, 3, "quiet"), ("a", 30, 30, 1, "quiet"), ("b", 2, 2, 1, "quiet")]


def test_a_busy_key_ends_after_the_longest_delay(spark):
    """A change every 4 seconds never leaves it quiet; after 60 seconds it ends all the same."""
    got = bursts(spark, [("a", 4 * i) for i in range(20)])
    assert got == [("a", 0, 56, 15, "max delay"), ("a", 60, 76, 5, "quiet")]


def test_at_the_very_end_the_next_begins(spark):
    assert bursts(spark, [("a", 0), ("a", 5), ("a", 5)]) == [("a", 0, 0, 1, "quiet"), ("a", 5, 5, 2, "quiet")]


def test_nulls_and_empty(spark):
    rows = spark.createDataFrame([(None, START), ("a", None)], "key string, at timestamp")
    assert coalesce_changes(rows).collect() == []


@pytest.mark.parametrize("cuts", [[3], [1, 2, 9, 14]])
def test_stream_same_as_table_over_restarts(spark, tmp_path, cuts):
    """The stream is stopped and started between files; what is still open stays open, and a later change of another key sets its timer off."""
    changes = [("a", 0), ("b", 1), ("a", 3), ("a", 7), ("b", 30), ("a", 31), *[("c", 32 + 4 * i) for i in range(16)]]
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for n, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(changes)], strict=True)):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"key": k, "at": at(s).isoformat()}) for k, s in changes[i:j]))
        stream = spark.readStream.schema("key string, at timestamp").json(str(source))
        coalesce_stream(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(target).awaitTermination()
    got = seconds(spark.read.parquet(target).collect())
    want = bursts(spark, changes)
    assert [b for b in want if b not in got] == [("c", 92, 92, 1, "quiet")] and [b for b in got if b not in want] == []


def test_stream_timer_without_later_changes_of_the_key(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps({"key": k, "at": at(s).isoformat()}) for k, s in [("a", 0), ("z", 100)]))
    stream = spark.readStream.schema("key string, at timestamp").json(f"{tmp_path}/in")
    coalesce_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert seconds(spark.read.parquet(f"{tmp_path}/out").where(F.col("key") == "a").collect()) == [("a", 0, 0, 1, "quiet")]


def test_one_frame_a_batch(monkeypatch):
    """Bursts that end in one batch leave in one frame: none is a frame of its own."""
    from folio_spark.streaming import coalesce

    made, real = [], coalesce.pd.DataFrame
    batches = [real({"key": ["a"] * 4 + ["b"] * 2, "at": [0, 1, 50, 100, 0, 3]}), real({"key": ["b", "c"], "at": [4, 9]})]
    monkeypatch.setattr(coalesce.pd, "DataFrame", lambda *a, **k: made.append(1) or real(*a, **k))
    rows = [tuple(r) for f in coalesce.bursts_by_key(iter(batches), 10, 30) for r in f.itertuples(index=False)]
    assert rows == [("a", 0, 1, 2, "quiet"), ("a", 50, 50, 1, "quiet"), ("a", 100, 100, 1, "quiet"), ("b", 0, 4, 3, "quiet"), ("c", 9, 9, 1, "quiet")]
    assert len(made) == 3
