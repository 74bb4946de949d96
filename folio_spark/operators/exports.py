"""Public exports: what may be shown of the grains, and files of it with their digests."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canonical import TERMS, canonical_grains, merged_corpus
from .lineage import cut
from .projection import BF, OWN, TYPE


def hidden_works(quads: DataFrame, own: str = OWN) -> DataFrame:
    """(grain, iri): works with a tombstone, or suppressed, by statements of any graph."""
    gone = (F.col("p") == own + "tombstoned") | ((F.col("p") == own + "suppressed") & (F.col("o_kind") == "literal") & (F.col("o") == "true"))
    return quads.where(gone & F.col("s").startswith("#") & F.col("s").endswith("Work")).select("grain", F.col("s").alias("iri")).distinct()


def public_quads(quads: DataFrame, *, extras: Collection[str] | None = None, sources: Collection[str] | None = None, own: str = OWN) -> DataFrame:
    """The quads that may be published: of grains whose works all show, without any mention of a hidden work.

    extras: the keys of extra statements that are public (None: all); the key
    `sources` always is, but of its comma list only public sources stay (None:
    all), and without any of them the statement goes. Grains without a work of
    their own aren't exported. A ValueError if every work is hidden: an empty
    catalog is never published by mistake.
    """
    works = quads.where((F.col("p") == TYPE) & (F.col("o") == BF + "Work") & F.col("s").startswith("#") & F.col("s").endswith("Work")).select("grain").distinct()
    hidden = cut(hidden_works(quads, own))
    shown = cut(works.join(hidden, "grain", "left_anti"))
    if shown.isEmpty() and not works.isEmpty():
        raise ValueError("all works are hidden: nothing is published")
    # Which hidden works a grain mentions is found from names of works alone; then all quads meet their grain's list once.
    is_name = lambda c: c.startswith("#") & c.endswith("Work")
    names = F.filter(F.array("s", "o"), lambda c: F.coalesce(is_name(c), F.lit(False)))
    mentions = quads.where(is_name(F.col("s")) | is_name(F.col("o"))).select("grain", F.explode(names).alias("iri")).distinct()
    mentions = mentions.join(hidden.select("iri").distinct(), "iri", "left_semi").groupBy("grain").agg(F.collect_set("iri").alias("hidden__"))
    shown = cut(shown.join(mentions, "grain", "left"))
    none = lambda c: F.coalesce(~F.array_contains("hidden__", F.col(c)), F.lit(True))
    rows = quads.join(shown, "grain").where(none("s") & none("o"))
    key = F.when(F.startswith("p", F.lit(own + "extra/")), F.substr("p", F.lit(len(own) + 7)))
    if extras is not None:
        rows = rows.where(key.isNull() | (key == "") | key.isin("sources", *extras))
    if sources is not None:
        listed = F.filter(F.transform(F.split("o", ","), lambda x: F.trim(x)), lambda x: x.isin(*sources))
        told = F.coalesce(key == "sources", F.lit(False)) & (F.col("o_kind") == "literal")
        rows = rows.withColumn("o", F.when(told, F.array_join(listed, ", ")).otherwise(F.col("o"))).where(~told | (F.col("o") != ""))
    return rows.select(quads.columns)


def export_nquads(quads: DataFrame, path: str, **options) -> DataFrame:
    """Writes public_quads() as gzipped N-Quads in order of grain, and gives (file, bytes, sha256) of what it wrote.

    Grains are in canonical form under blank names of their own, so equal
    catalogs give equal lines; each task writes a file for its range of grains.
    """
    rows = public_quads(quads, **options)
    for c in TERMS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    texts = merged_corpus(canonical_grains(rows)).select(F.regexp_replace("text", r"\n$", "").alias("value"))
    texts.write.option("compression", "gzip").text(path)
    files = quads.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
