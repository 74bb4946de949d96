"""Helpers shared by the operators: expressions, shared scratch tables, table access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, as a regular expression and as characters.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
# Spark's own setting: a query's shuffle files go when it ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row.

    A lambda variable is bound once, whereas the optimizer may copy a column's
    expression into a lambda and run it for every element.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; null or blank text: an empty array."""
    one = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        one = F.replace(one, F.lit(c), F.lit(" "))
    # A split at one character needs no regular expression; it's the dearest step over a whole corpus.
    return F.array_remove(F.split(one, " "), "")


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from all columns."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share (spark.checkpoint.dir).

    Only a session whose tasks all run in the driver's own process gets a folder
    of its own if none is named; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folio-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and outlive executors.

    Tables that a result still reads can't go before it does; those are removed
    when the driver ends, all others by drop().
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.remove)

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        df.write.options(**options).parquet(f"{self.root}/{name}")
        return self.load(name, df.schema)

    def save_alone(self, df: DataFrame, name: str) -> DataFrame:
        """save(), and the shuffle files behind the table go at once: for plans that nothing else runs."""
        before = self.spark.conf.get(FREE)
        self.spark.conf.set(FREE, "true")
        try:
            return self.save(df, name)
        finally:
            self.spark.conf.set(FREE, before)

    def load(self, name: str, schema=None) -> DataFrame:
        """A saved table; joins with it sort both sides: it grows with the input, and loops of broadcasts would fill the driver."""
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(f"{self.root}/{name}").hint("merge")

    def delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *names: str) -> None:
        """Frees tables that no later plan reads."""
        for name in names:
            self.delete(f"{self.root}/{name}")

    def remove(self) -> None:
        """At the driver's end: whatever is left, if the session still runs."""
        if self.spark.sparkContext._jsc is not None:
            self.delete(self.root)


def components(scratch: Scratch, edges: DataFrame, name: str = "cc", limit: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that edges (a, b) name.

    Alternates large-star and small-star steps, so that chains shorten
    logarithmically and a group around a hub stays linear in its edges. Each
    round is written to the shared folder; the loop ends when nothing changes.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.save(e, f"{name}0")
    done = 0
    for i in range(1, limit):
        # Large star: every neighbour above a node links to the smallest id around it.
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: a node and its smaller neighbours link to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.withColumnRenamed("a", "n"), F.col("a") == F.col("n"))
        small = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        new = scratch.save(small.select("x.a", "x.b").where("a <> b").distinct(), f"{name}{i}")
        # A checksum of the edges tells when a round has changed nothing.
        state = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(f"{name}{i - 1}")
        e = new
        if state == done:
            break
        done = state
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(roots)
