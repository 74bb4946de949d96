"""Bursts of changes as one: a burst ends when its key has been quiet for a while, and at the latest some time after it began."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUIET, TIMES = timedelta(seconds=5), 12  # a burst lasts TIMES quiet windows at most
BURST = "key string, started long, ended long, n long, reason string"
COLUMNS = ["key", "started", "ended", "n", "reason"]


class Burst:
    """The burst at hand of one key: microseconds of its first and last change, and how many there were."""

    def __init__(self, quiet: int, most: int, held: tuple[int, int, int] | None = None):
        self.quiet, self.most, self.held = quiet, most, held

    def ends(self) -> tuple[int, str]:
        """When the burst is over if nothing follows, and why."""
        first, last, _ = self.held
        return (last + self.quiet, "quiet") if last + self.quiet < first + self.most else (first + self.most, "max delay")

    def add(self, at: int) -> tuple[int, int, int, str] | None:
        """Takes a change in; the burst that it finds ended, if any. A change at the very end begins the next one; one of before counts with the burst at hand."""
        done = None
        if self.held and at >= self.ends()[0]:
            done = (*self.held, self.ends()[1])
            self.held = None
        first, last, n = self.held or (at, at, 0)
        self.held = (min(first, at), max(last, at), n + 1)
        return done


def _rows(key: str, bursts: list[tuple[int, int, int, str]]) -> pd.DataFrame:
    return pd.DataFrame([(key, *b) for b in bursts], columns=COLUMNS)


def bursts_by_key(batches: Iterator[pd.DataFrame], wait: int, most: int) -> Iterator[pd.DataFrame]:
    """The bursts of rows (key, at) in order of both: one frame a batch, however many bursts end in it."""
    key, burst = None, Burst(wait, most)
    for b in batches:
        out = []
        for k, at in zip(b["key"].tolist(), b["at"].tolist(), strict=True):
            if k != key:
                if burst.held:
                    out.append((key, *burst.held, burst.ends()[1]))
                key, burst = k, Burst(wait, most)
            if done := burst.add(at):
                out.append((key, *done))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)
    if burst.held:
        yield pd.DataFrame([(key, *burst.held, burst.ends()[1])], columns=COLUMNS)


def _timed(bursts: DataFrame) -> DataFrame:
    """Microseconds as timestamps, whatever the session's time zone."""
    return bursts.withColumns({c: F.timestamp_micros(c) for c in ("started", "ended")})


def _micros(d: timedelta) -> int:
    return d // timedelta(microseconds=1)


def coalesce_changes(changes: DataFrame, quiet: timedelta = QUIET, times: int = TIMES) -> DataFrame:
    """(key, started, ended, n, reason) of changes (key, at), as a table: rows are dealt by key and stream by in order of time; a task holds one burst.

    Where a burst ends depends on where the one before did, so no window frame
    gives it. Null keys and times: left out. Repeated rows: changes of their own.
    """
    wait, most = _micros(quiet), times * _micros(quiet)
    rows = changes.where("key is not null and at is not null").select(F.col("key").cast("string").alias("key"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"))

    run = lambda batches: bursts_by_key(batches, wait, most)
    parts = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _timed(rows.repartition(parts, "key").sortWithinPartitions("key", "at").mapInPandas(run, BURST))


def coalesce_stream(changes: DataFrame, delay: str = "0 seconds", quiet: timedelta = QUIET, times: int = TIMES) -> DataFrame:
    """The same over a stream, in append mode: a key's burst is state with a timer at its end, which the watermark of `at` (less `delay`) sets off.

    Survives restarts with the query's checkpoint. Changes of a key must come in
    order up to the delay; an earlier one counts with the burst at hand.
    """
    wait, most = _micros(quiet), times * _micros(quiet)

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        burst = Burst(wait, most, tuple(state.get) if state.exists else None)
        if state.hasTimedOut:
            done = [(*burst.held, burst.ends()[1])]
            state.remove()
        else:
            times_ = sorted(int(x) for b in batches for x in b["micros"])
            done = [d for at in times_ if (d := burst.add(at))]
            state.update(burst.held)
            # The timer is in milliseconds, and never before the watermark.
            state.setTimeoutTimestamp(max(-(-burst.ends()[0] // 1000), state.getCurrentWatermarkMs() + 1))
        if done:
            yield _rows(key[0], done)

    rows = changes.where("key is not null and at is not null").withColumn("key", F.col("key").cast("string")).withWatermark("at", delay).withColumn("micros", F.unix_micros("at"))
    return _timed(rows.groupBy("key").applyInPandasWithState(step, BURST, "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout))
