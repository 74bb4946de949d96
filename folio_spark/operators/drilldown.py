"""Facet counts for any selection from words of bits: 64 rows of a value stand in one number, and no row is read again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def facet_bits(attrs: DataFrame) -> DataFrame:
    """(dim, value, word, bits) of attrs (row, dim, value): bit row % 64 of word row / 64 says that the row has the value.

    row: a dense number from 0 on, so that words fill up; values may be several a
    row. Null and empty values have no bits. Meant to be saved, by dim and value.
    """
    bit = F.expr("shiftleft(1L, cast(row % 64 as int))")
    return attrs.where("value is not null and value <> ''").groupBy("dim", "value", F.floor(F.col("row") / 64).cast("long").alias("word")).agg(F.bit_or(bit).alias("bits"))


def rows_chosen(index: DataFrame, chosen: Mapping[str, Sequence[str]]) -> DataFrame:
    """(word, one column a dimension with a choice): the rows that have any of the dimension's chosen values."""
    picked = {d: list(v) for d, v in chosen.items() if v}
    ors = [F.bit_or(F.when((F.col("dim") == d) & F.col("value").isin(v), F.col("bits"))).alias(f"c{i}") for i, (d, v) in enumerate(picked.items())]
    wanted = F.lit(False)
    for d, v in picked.items():
        wanted = wanted | ((F.col("dim") == d) & F.col("value").isin(v))
    return index.where(wanted).groupBy("word").agg(*ors)


def facets_drilldown(index: DataFrame, chosen: Mapping[str, Sequence[str]], among: DataFrame | None = None) -> DataFrame:
    """(dim, value, n): how many rows have a value, of those that pass the choices of all other dimensions; values without any are left out.

    Within a dimension any chosen value will do, across dimensions all must hold;
    a dimension's own choice doesn't narrow its counts. among: (row) a ranked or
    searched set to count in. Words meet words: one join, then bits are counted.
    """
    dims = [d for d, v in chosen.items() if v]
    rows = index
    if among is not None:
        held = among.groupBy(F.floor(F.col("row") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(row % 64 as int))")).alias("among"))
        rows = rows.join(held, "word").withColumn("bits", F.col("bits").bitwiseAND(F.col("among"))).drop("among")
    if dims:
        rows = rows.join(rows_chosen(index, chosen), "word", "left")
    mask = F.lit(-1).cast("long")
    for i, d in enumerate(dims):
        own = F.when(F.col("dim") == d, F.lit(-1).cast("long")).otherwise(F.coalesce(F.col(f"c{i}"), F.lit(0).cast("long")))
        mask = mask.bitwiseAND(own)
    counts = rows.groupBy("dim", "value").agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(mask)).cast("long")).alias("n"))
    return counts.where("n > 0")


def chosen_rows(index: DataFrame, chosen: Mapping[str, Sequence[str]]) -> DataFrame:
    """(row): the rows that pass all choices, from the bits alone; all rows with any value if nothing is chosen."""
    dims = [d for d, v in chosen.items() if v]
    words = rows_chosen(index, chosen) if dims else index.groupBy("word").agg(F.bit_or("bits").alias("c0"))
    mask = F.lit(-1).cast("long")
    for i in range(max(1, len(dims))):
        mask = mask.bitwiseAND(F.coalesce(F.col(f"c{i}"), F.lit(0).cast("long")))
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.bit_get(F.col("m"), b) == 1)
    found = words.select("word", mask.alias("m")).select("word", F.explode(places).alias("place"))
    return found.select((F.col("word") * 64 + F.col("place")).alias("row"))
