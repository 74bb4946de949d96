"""Cutting the lineage of loops: each round is a table in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only a session whose tasks all run in the driver's own process gets a folder
    of its own if none is named; on a cluster that is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="folio-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder: later rounds read it and never run earlier ones again, whatever executors are lost.

    Results may read a round for as long as the driver runs; when it ends, its
    rounds are removed.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(where)
    atexit.register(_remove, spark, where)
    return spark.read.schema(df.schema).parquet(where)


class Rounds:
    """Rounds that go before the driver ends: drop() frees those that no later plan reads.

    They are packed densely, and the shuffle files behind a round go as soon as it is written.
    """

    # Spark's own setting: a query's shuffle files go when it ends.
    FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}", 0
        atexit.register(_remove, spark, self.root)

    def save(self, df: DataFrame, **conf: str) -> DataFrame:
        """df as a table; conf: settings that hold while it is made, with _ for dots."""
        self.n += 1
        held = {self.FREE: "true"} | {k.replace("_", "."): v for k, v in conf.items()}
        before = {k: self.spark.conf.get(k) for k in held}
        try:
            for k, v in held.items():
                self.spark.conf.set(k, v)
            df.write.option("compression", "zstd").parquet(f"{self.root}/{self.n}")
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.n}")
        out.round = self.n
        return out

    def drop(self, *rounds: DataFrame) -> None:
        for r in rounds:
            _remove(self.spark, f"{self.root}/{r.round}")


def _remove(spark: SparkSession, where: str) -> None:
    if spark.sparkContext._jsc is not None:  # the session still runs
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
