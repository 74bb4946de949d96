"""Catalog sources: N-Quads text and mapped CSV."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The terms of an N-Quads line; escapes are those of the format, without surrogates.
ESCAPE = r"\\[tbnrf\"'\\]|\\u(?![dD][89a-fA-F])[0-9A-Fa-f]{4}|\\U00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4}"
IRI = rf"<(?:[^\x00-\x20<>\"{{}}|^`\\]|{ESCAPE})*>"
BLANK = r"_:[^\s<>\"]+"
LITERAL = rf'"(?:[^"\\]|{ESCAPE})*"'
TERM = rf"({IRI}|{BLANK}|{LITERAL}(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^{IRI})?)"
QUAD = rf"^\s*({IRI}|{BLANK})\s*({IRI})\s*{TERM}\s*({IRI}|{BLANK})?\s*\.\s*(?:#.*)?$"
SHORT = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def unescaped(text: Column) -> Column:
    """A term's text with its escapes decoded; a row without a backslash takes no part in that."""

    def decoded(x: Column) -> Column:
        sign = F.substring(x, 2, 1)
        out = F.when(sign.isin("u", "U"), F.decode(F.unhex(F.lpad(F.substr(x, F.lit(3)), 8, "0")), "UTF-32"))
        for k, v in SHORT.items():
            out = out.when(sign == k, v)
        return F.when(~x.startswith("\\"), x).otherwise(out.otherwise(sign))

    parts = F.regexp_extract_all(text, F.lit(r"(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), 1)
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(parts, decoded), "")).otherwise(text)


def parse_quads(lines: DataFrame) -> DataFrame:
    """(s, p, o, o_kind, o_lang, o_type, g, and all other columns) of lines (value, ...).

    Blank and comment lines are skipped. Any other line that isn't a quad fails
    every query over the result, whatever columns it reads: validity is a filter.
    IRIs stand without their brackets, blank nodes with their `_:`.
    """
    lines = lines.where(F.col("value").isNotNull() & ~F.col("value").rlike(r"^\s*(#.*)?$"))
    valid = F.when(F.col("value").rlike(QUAD), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("malformed quad: "), F.col("value"))).cast("boolean"))
    part = lambda i: F.regexp_extract("value", QUAD, i)
    bare = lambda c: F.when(c.startswith("<"), unescaped(F.regexp_replace(c, r"^<|>$", ""))).otherwise(c)
    rest = [c for c in lines.columns if c != "value"]
    raw = lines.where(valid).select(*rest, part(1).alias("s"), part(2).alias("p"), part(3).alias("t"), part(4).alias("g"))
    kind = F.when(F.col("t").startswith("<"), "iri").when(F.col("t").startswith("_:"), "blank").otherwise("literal")
    inner = F.regexp_extract("t", r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)
    value = F.when(kind == "literal", unescaped(inner)).otherwise(bare(F.col("t")))
    of = lambda pattern: F.when(kind == "literal", F.nullif(F.regexp_extract("t", pattern, 1), F.lit("")))
    return raw.select(bare(F.col("s")).alias("s"), bare(F.col("p")).alias("p"), value.alias("o"), kind.alias("o_kind"), of(r'"@([A-Za-z0-9-]+)$').alias("o_lang"), unescaped(of(r'"\^\^<([^>]*)>$')).alias("o_type"), bare(F.col("g")).alias("g"), *rest)


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    """parse_quads() of N-Quads files, with `file` and `ord`: (block, id), ascending in the order of a file's lines."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.nq*").text(path)
    ord_ = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return parse_quads(lines.select("value", F.col("_metadata.file_path").alias("file"), ord_.alias("ord")))


def read_grains(spark: SparkSession, path: str, bulk: str = "catalog.nq") -> DataFrame:
    """read_quads() of a tree with a file for each record, named in `grain`; files named `bulk` repeat them and are left out."""
    quads = read_quads(spark, path)
    return quads.where(F.substring_index("file", "/", -1) != bulk).withColumnRenamed("file", "grain")


def read_mapped_csv(spark: SparkSession, path: str, mapping: Mapping[str, str], many: str = ";", sep: str = ",") -> DataFrame:
    """Columns by mapping (field -> header); every field is an array of its trimmed, non-empty parts. A missing header is an error."""
    raw = spark.read.csv(path, header=True, sep=sep)
    if absent := sorted(set(mapping.values()) - set(raw.columns)):
        raise ValueError(f"headers not in the file: {', '.join(absent)}")
    parts = lambda h: F.filter(F.transform(F.split(F.coalesce(F.col(f"`{h}`"), F.lit("")), many), lambda x: F.trim(x)), lambda x: x != "")
    return raw.select(*[parts(h).alias(f) for f, h in mapping.items()])
