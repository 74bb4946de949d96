"""A change feed folded into a snapshot: small batches write small deltas, counts follow from signed differences, a fold now and then."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import latest


def signed_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(dim, value, n): by how much counts of (dim, value) rows change from before to after; changes of 0 are left out."""
    both = before.select("dim", "value", F.lit(-1).alias("n")).unionByName(after.select("dim", "value", F.lit(1).alias("n")))
    return both.groupBy("dim", "value").agg(F.sum("n").alias("n")).where("n <> 0")


@dataclass
class Feed:
    """Rows by key in a folder: `snapshot-N` (state after batch N) and `delta-M` (what batch M changed, M > N), each with counts of the same name.

    order: the column by which later rows of a key win; deleted: its boolean
    column of deletions, whose rows stay, so that a late row brings nothing back.
    dims: name -> SQL expression of an array of a row's values, whose live rows are counted.
    A fold follows once the deltas hold fold_rows rows; what a batch writes follows
    the batch between folds. Only folders that are written whole are read, and a
    batch that runs again writes the same.
    """

    target: str
    key: str
    order: str
    deleted: str
    dims: dict[str, str]
    fold_rows: int = 4096

    def _fs(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.target)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        """The batches of whole folders of a kind; a batch has two, and the counts are written last."""
        found = self._fs(spark).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{self.target}/{kind}-*-counts/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName().split("-")[1]) for f in found or [])

    def state(self, spark: SparkSession) -> tuple[int, list[int]]:
        """(batch of the last snapshot or -1, batches of the deltas behind it)."""
        base = max(self._numbers(spark, "snapshot"), default=-1)
        return base, [n for n in self._numbers(spark, "delta") if n > base]

    def _read(self, spark: SparkSession, base: int, deltas: list[int], tail: str = "") -> DataFrame | None:
        paths = [f"{self.target}/snapshot-{base}{tail}"] * (base >= 0) + [f"{self.target}/delta-{n}{tail}" for n in deltas]
        return spark.read.parquet(*paths) if paths else None

    def rows(self, spark: SparkSession) -> DataFrame:
        """The last row of every key, deleted ones too."""
        return latest(self._read(spark, *self.state(spark)), self.key, F.col(self.order), F.lit(True))

    def counts(self, spark: SparkSession) -> DataFrame:
        """(dim, value, n) over live rows, from the saved counts alone."""
        return self._read(spark, *self.state(spark), "-counts").groupBy("dim", "value").agg(F.sum("n").alias("n")).where("n <> 0")

    def values(self, rows: DataFrame) -> DataFrame:
        """(dim, value) of all live rows."""
        live = rows.where(~F.coalesce(F.col(self.deleted), F.lit(False)))
        named = lambda d, c: F.transform(F.expr(c), lambda v: F.struct(F.lit(d).alias("dim"), v.cast("string").alias("value")))
        every = [named(d, c) for d, c in self.dims.items()]
        return live.select(F.explode(F.concat(*every)).alias("x")).select("x.dim", "x.value").where("value is not null")

    def since(self, spark: SparkSession, cursor: int) -> DataFrame | None:
        """The last rows of keys that batches behind the cursor have changed; None if a fold has taken those in, so that all has to be built anew."""
        base, deltas = self.state(spark)
        if cursor < base:
            return None
        paths = [f"{self.target}/delta-{n}" for n in deltas if n > cursor]
        if not paths:
            return self._read(spark, base, deltas).limit(0)
        return latest(spark.read.parquet(*paths), self.key, F.col(self.order), F.lit(True))

    def apply(self, batch: DataFrame, n: int) -> None:
        """Takes batch n in; batches come in order, and one that a snapshot holds already is passed over."""
        spark = batch.sparkSession
        base, deltas = self.state(spark)
        if n <= base:
            return
        deltas = [m for m in deltas if m < n]
        last = latest(batch, self.key, F.col(self.order), F.lit(True))
        old = self._read(spark, base, deltas)
        before = last.limit(0)
        if old is not None:
            touched = old.join(last.select(self.key), self.key, "left_semi")
            before = latest(touched, self.key, F.col(self.order), F.lit(True)).select(batch.columns)
            was = before.select(self.key, F.col(self.order).alias("was"))
            last = last.join(was, self.key, "left").where(F.col("was").isNull() | (F.col(self.order) > F.col("was")))
        last.select(batch.columns).write.mode("overwrite").parquet(f"{self.target}/delta-{n}")
        new = spark.read.parquet(f"{self.target}/delta-{n}")
        replaced = before.join(new.select(self.key), self.key, "left_semi")
        signed_counts(self.values(replaced), self.values(new)).write.mode("overwrite").parquet(f"{self.target}/delta-{n}-counts")
        if spark.read.parquet(*[f"{self.target}/delta-{m}" for m in [*deltas, n]]).count() >= self.fold_rows:
            self.fold(spark, n)

    def fold(self, spark: SparkSession, n: int) -> None:
        """Writes the state after batch n as a snapshot, then removes what it replaces."""
        base, deltas = self.state(spark)
        self.rows(spark).write.mode("overwrite").parquet(f"{self.target}/snapshot-{n}")
        self.counts(spark).write.mode("overwrite").parquet(f"{self.target}/snapshot-{n}-counts")
        for kind, m in [("snapshot", base)] * (base >= 0) + [("delta", m) for m in deltas]:
            for tail in ("-counts", ""):  # counts first: without them a folder isn't read
                self._fs(spark).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.target}/{kind}-{m}{tail}"), True)

    def run(self, changes: DataFrame, checkpoint: str):
        """A stream writer that takes the batches of a stream of changes in."""
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
