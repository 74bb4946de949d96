"""Record sources: MARC, vendor JSON pages, RDF/XML concepts, edition dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_isbn
from ..operators.vocabulary import unambiguous

RECORD_END, FIELD_END, SUBFIELD = "\x1d", "\x1e", "\x1f"


def read_marc(spark: SparkSession, path: str) -> DataFrame:
    """(file, control_number, leader, fields) of UTF-8 ISO 2709 files.

    Records end with 0x1D, so Spark cuts large files between them. fields: array
    of (tag, ind1, ind2, value, subfields (code, value)); control fields have a
    value, the others have subfields. Directory offsets count bytes. A record
    whose directory can't be read fails the read.
    """
    raw = spark.read.option("lineSep", RECORD_END).text(path).select(F.col("_metadata.file_path").alias("file"), F.ltrim("value", F.lit("\r\n")).alias("text")).where("text <> ''")
    number = lambda c, i, n: F.substring(c, i, n).try_cast("int")
    rec = raw.select("file", "text", F.encode("text", "UTF-8").alias("b"), F.substring("text", 1, 24).alias("leader"), number("text", 13, 5).alias("base"))
    rec = rec.withColumn("base", F.when((F.col("base") > 24) & ((F.col("base") - 25) % 12 == 0), F.col("base")).otherwise(F.raise_error(F.concat(F.lit("malformed MARC leader: "), "leader")).cast("int")))
    entries = F.filter(F.sequence(F.lit(0), (F.col("base") - 25).cast("int")), lambda i: (i % 12 == 0) & (i + 12 <= F.col("base") - 25))

    def field(i):
        at = lambda k, n: F.decode(F.substr("b", i + 25 + k, F.lit(n)), "UTF-8")
        body = F.decode(F.substr("b", F.col("base") + at(7, 5).cast("int") + 1, at(3, 4).cast("int")), "UTF-8")
        return F.struct(at(0, 3).alias("tag"), F.rtrim(body, F.lit(FIELD_END)).alias("body"))

    def parsed(x):
        control = x["tag"] < "010"
        subfields = F.transform(F.slice(F.split(x["body"], SUBFIELD), 2, 9999), lambda s: F.struct(F.substring(s, 1, 1).alias("code"), F.substr(s, F.lit(2)).alias("value")))
        return F.struct(
            x["tag"].alias("tag"),
            F.when(~control, F.substring(x["body"], 1, 1)).alias("ind1"),
            F.when(~control, F.substring(x["body"], 2, 1)).alias("ind2"),
            F.when(control, x["body"]).alias("value"),
            F.when(~control, subfields).alias("subfields"),
        )

    rec = rec.withColumn("fields", F.transform(F.transform(entries, field), parsed))
    return rec.select("file", F.filter("fields", lambda f: f["tag"] == "001")[0]["value"].alias("control_number"), "leader", "fields")


def read_vendor_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row an item of JSON pages {"items": [...]}: (id, title, subtitle, creators, languages, isbns)."""
    schema = "items array<struct<id string, title string, subtitle string, creators array<struct<name string, role string>>, languages array<struct<id string>>, formats array<struct<identifiers array<struct<type string, value string>>>>>>"
    items = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("items").alias("i"))
    values = F.transform(F.filter(F.flatten(F.transform(F.col("i.formats"), lambda f: f["identifiers"])), lambda x: x["type"] == "ISBN"), lambda x: norm_isbn(x["value"]))
    return items.select("i.id", "i.title", "i.subtitle", "i.creators", F.col("i.languages.id").alias("languages"), F.array_distinct(F.array_compact(F.coalesce(values, F.array().cast("array<string>")))).alias("isbns"))


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, lang) of the skos:Concept elements of RDF/XML files: labels and broader terms."""
    label = "array<struct<_VALUE string, `_xml:lang` string>>"
    schema = f"`_rdf:about` string, `skos:prefLabel` {label}, `skos:altLabel` {label}, `skos:broader` array<struct<`_rdf:resource` string>>"
    rows = spark.read.format("xml").option("rowTag", "skos:Concept").schema(schema).load(path)
    text = lambda p: F.transform(F.coalesce(F.col(f"`{p}`"), F.array().cast(label)), lambda x: F.struct(F.lit(p).alias("p"), x["_VALUE"].alias("o"), x["_xml:lang"].alias("lang")))
    up = F.transform(F.coalesce(F.col("`skos:broader`"), F.array().cast("array<struct<`_rdf:resource` string>>")), lambda x: F.struct(F.lit("skos:broader").alias("p"), x["_rdf:resource"].alias("o"), F.lit(None).cast("string").alias("lang")))
    return rows.select(F.col("`_rdf:about`").alias("s"), F.explode(F.concat(text("skos:prefLabel"), text("skos:altLabel"), up)).alias("t")).select("s", "t.*")


def read_editions(spark: SparkSession, path: str) -> DataFrame:
    """(isbn, work) of an edition dump (tab-separated, JSON in the fifth column); an ISBN of several works is left out."""
    body = F.from_json(F.get(F.split("value", "\t"), F.lit(4)), "isbn_10 array<string>, isbn_13 array<string>, works array<struct<key string>>")
    rows = spark.read.text(path).select(body.alias("j")).where("j.works[0].key is not null")
    none = F.array().cast("array<string>")
    isbns = F.concat(F.coalesce("j.isbn_10", none), F.coalesce("j.isbn_13", none))
    pairs = rows.select(F.explode(F.transform(isbns, norm_isbn)).alias("isbn"), F.col("j.works")[0]["key"].alias("work")).where("isbn is not null")
    return unambiguous(pairs, "isbn", "work")
