"""Streaming forms of the activity reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream of (ts, user_id); ts is a timestamp. Rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n")).drop("session_window")


def stream_rates(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each actor and tumbling window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "user_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "user_id", "n")


def upsert(changes: DataFrame, target: str, key: str, order: str, checkpoint: str):
    """Applies a stream of change rows (deleted boolean) to a Parquet snapshot: each batch writes the next version, a replay writes the same.

    A version keeps the last row of every key, deleted ones too, so that a row
    that comes late can't bring a key back; live() leaves them out. Versions
    before the last but one are removed.
    """
    from ..operators.relational import latest

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{target}/v{n - 1}") if n else batch.limit(0)
        latest(before.unionByName(batch), key, F.col(order), F.lit(True)).write.mode("overwrite").parquet(f"{target}/v{n}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v{n - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def live(snapshot: DataFrame) -> DataFrame:
    return snapshot.where("not deleted").drop("deleted")
