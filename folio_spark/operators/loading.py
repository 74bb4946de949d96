"""Loading a part of a corpus: terms that something reaches, enrichment that a run must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .projection import BF, BROADER, LABEL, OWN, PREF_LABEL, Paths, closure_from, fragment, graph_maps
from .identity import Prior, scoped_anchors, work_key

BITS = 1 << 25  # 4 MB of bits, whatever the number of keys: a full filter only lets more rows through to the exact join


def key_bits(keys: DataFrame, key: str) -> DataFrame:
    """(bucket, bits): a bit for the hash of each key, in at most BITS / 32768 rows of 4 KB."""
    at = F.pmod(F.xxhash64(key), F.lit(BITS)) + 1
    return keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def may_hold(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """The rows whose key's bit is set: all whose key is there, and few others. The bits are broadcast; BITS bounds them."""
    at = F.pmod(F.xxhash64(key), F.lit(BITS)) + 1
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.bit_get(byte, (place % 8).cast("int")) == 1
    rows = rows.withColumn("bucket__", F.bitmap_bucket_number(at))
    named = bits.withColumnRenamed("bucket", "bucket__")
    return rows.join(F.broadcast(named), "bucket__").where(held).drop("bucket__", "bits")


def is_authority(g: Column, prefix: str = "authority:") -> Column:
    return F.startswith(g, F.lit(prefix))


def reachable(quads: DataFrame, prefix: str = "authority:") -> DataFrame:
    """(uri): the terms that vocabulary graphs describe and other graphs name, and all that lies above them by broader links of the vocabularies."""
    edges = quads.where(is_authority(F.col("g"), prefix) & (F.col("p") == BROADER) & (F.col("o_kind") == "iri") & ~F.startswith("s", F.lit("_:"))).select(F.col("s").alias("child"), F.col("o").alias("parent"))
    own = quads.where(~is_authority(F.col("g"), prefix))
    ends = F.array(F.when(~F.startswith("s", F.lit("_:")), F.col("s")), F.when(F.col("o_kind") == "iri", F.col("o")))
    terms = quads.where(is_authority(F.col("g"), prefix) & ~F.startswith("s", F.lit("_:"))).select(F.col("s").alias("uri"))
    named = own.select(F.explode(ends).alias("uri")).where("uri is not null")
    # What isn't described by a vocabulary leads nowhere: its names, most of all, end at the scan.
    named = may_hold(named, "uri", cut(key_bits(terms, "uri"))).distinct().join(terms.distinct(), "uri", "left_semi")
    return closure_from(named, edges)


def selective_load(quads: DataFrame, *, prefix: str = "authority:", own: str = OWN) -> DataFrame:
    """quads without the vocabulary statements that no projection of them reads: what is left projects as the whole does.

    All graphs but vocabularies stay whole. Of a vocabulary stay labels, broader
    links and tag aliases of terms that other graphs name, or that lie above one.
    Reachability comes first, from edges and names alone; its terms' bits filter
    the scan of the vocabularies where they are read, and an exact join drops the
    few that the bits let through. Columns: those of quads, (s, p, o, o_kind, g) among them.
    """
    wanted = reachable(quads, prefix)
    read = quads.where(is_authority(F.col("g"), prefix) & F.col("p").isin(PREF_LABEL, LABEL, BROADER, own + "tagAlias") & ~F.startswith("s", F.lit("_:")))
    told = may_hold(read, "s", key_bits(wanted, "uri")).join(wanted.withColumnRenamed("uri", "s"), "s", "left_semi")
    return quads.where(~is_authority(F.col("g"), prefix)).unionByName(told.select(quads.columns))


def load_counts(quads: DataFrame, loaded: DataFrame) -> DataFrame:
    """(g, scanned, kept): quads of each graph before and after."""
    n = lambda df, c: df.groupBy("g").agg(F.count("*").alias(c))
    return n(quads, "scanned").join(n(loaded, "kept"), "g", "left").select("g", "scanned", F.coalesce("kept", F.lit(0)).alias("kept"))


def prior_state(quads: DataFrame, *, own: str = OWN, editorial: str = "editorial:", feed_prefix: str = "feed:", anchor_sources: tuple[str, ...] = (), schemes: dict[str, str] | None = None) -> tuple[Prior, DataFrame]:
    """(what resolve() starts from, (work_id, feed)) of committed grains: quads (grain, ord, s, p, o, o_kind, g).

    Instances with the keys of their identifiers, works with cluster keys and
    anchors, all a graph; merges (`mergedInto`) and pins (`pinnedTo`) of the
    editorial graph. An identifier's key is its scheme, a colon and its value:
    isbn and issn by type, the schemes given by source label, else id.
    Anchors: identifiers of a work whose source is in anchor_sources.
    """
    p, graphs = Paths(), graph_maps(quads)
    at = F.struct("grain", "g").alias("ord")
    label = lambda node: F.coalesce(F.get(F.transform(F.filter(F.array(p.first(node, BF + "source")), lambda x: x.isNotNull()), lambda x: p.text(x, LABEL)), 0), F.lit(""))
    value = lambda node: p.text(node, "http://www.w3.org/1999/02/22-rdf-syntax-ns#value")

    def scheme(node: Column) -> Column:
        out = F.when(p.is_a(node, BF + "Isbn"), "isbn").when(p.is_a(node, BF + "Issn"), "issn")
        for source, name in (schemes or {}).items():
            out = out.when(label(node) == source, name)
        return out.otherwise("id")

    minted = lambda kind: lambda n: n.startswith("#") & n.endswith(kind) & (F.length(n) > len(kind) + 1)

    def instance(node: Column) -> Column:
        of = F.coalesce(F.get(p.values(node, BF + "instanceOf"), 0), F.lit(""))
        keys = F.transform(F.filter(p.values(node, BF + "identifiedBy"), lambda x: value(x) != ""), lambda x: F.concat(scheme(x), F.lit(":"), value(x)))
        return F.struct(fragment(node, "Instance").alias("instance_id"), fragment(of, "Work").alias("work_id"), keys.alias("keys"))

    def work(node: Column) -> Column:
        lead = F.filter(p.values(node, BF + "contribution"), lambda c: p.is_a(c, "http://id.loc.gov/ontologies/bflc/PrimaryContribution"))
        names = F.filter(F.transform(lead, lambda c: F.get(F.transform(F.slice(p.values(c, BF + "agent"), 1, 1), lambda a: F.get(p.literals(a, LABEL), 0)), 0)), lambda x: x.isNotNull())
        titles = F.filter(F.transform(p.values(node, BF + "title"), lambda t: F.get(p.literals(t, BF + "mainTitle"), 0)), lambda x: x.isNotNull())
        langs = F.transform(p.values(node, BF + "language"), lambda x: F.regexp_extract(x, r"[^/#]*$", 0))
        marks = F.transform(F.filter(p.values(node, BF + "identifiedBy"), lambda x: (value(x) != "") & label(x).isin(*anchor_sources)), lambda x: F.concat(label(x), F.lit(":"), value(x)))
        return F.struct(fragment(node, "Work").alias("work_id"), F.get(names, 0).alias("author"), F.get(titles, 0).alias("title"), langs.alias("langs"), marks.alias("marks"))

    # Both kinds of nodes in one pass over the grains: they meet by one shuffle.
    found = lambda nodes, kind, one: F.transform(F.filter(nodes, minted(kind)), one).alias(nodes)
    told = cut(graphs.select(at, "g", found("instances", "Instance", instance), found("works", "Work", work)))
    instances = told.select("ord", F.explode("instances").alias("i")).select("ord", "i.*")
    named = told.select("ord", "g", F.explode("works").alias("w")).select("ord", "g", "w.*")
    works = cut(named.select("ord", "g", "work_id", work_key(F.col("author"), F.col("title"), F.col("langs")).alias("cluster_key"), scoped_anchors(F.col("marks"), F.col("langs")).alias("anchors")))
    edited = quads.where((F.col("g") == editorial) & (F.col("o_kind") == "iri"))
    line = F.struct("grain", F.col("ord").cast("string").alias("at")) if "ord" not in quads.columns else F.struct("grain", F.col("ord").alias("at"))
    merges = edited.where(F.col("p") == own + "mergedInto").select(line.alias("ord"), fragment(F.col("s"), "Work").alias("from_id"), fragment(F.col("o"), "Work").alias("to_id"))
    pins = edited.where(F.col("p") == own + "pinnedTo").select(line.alias("ord"), fragment(F.col("s"), "Instance").alias("instance_id"), fragment(F.col("o"), "Work").alias("work_id"))
    feeds = works.where(F.startswith("g", F.lit(feed_prefix))).select("work_id", F.substring("g", len(feed_prefix) + 1, 1 << 20).alias("feed")).distinct()
    return Prior(instances, works.select("ord", "work_id", "cluster_key"), works.select("ord", F.explode("anchors").alias("anchor"), "work_id"), merges, pins), feeds


def preserved_editorial(quads: DataFrame, feed: str) -> DataFrame:
    """The statements of a grain that a run of the feed must not lose: those of all graphs but its own."""
    return quads.where(F.col("g") != feed)


def with_preserved_enrichment(existing: DataFrame, fresh: DataFrame, resolved: DataFrame) -> DataFrame:
    """fresh and what an enrichment graph must keep beside it: the statements of works that this run didn't resolve, and of all terms that they lead to.

    existing, fresh: quads (grain, s, p, o, o_kind, ...) of one enrichment graph
    with equal columns; resolved: (grain, work_id). A term of fresh is described
    by fresh alone, and nothing is followed through it. References are followed
    within a grain, through blank nodes too; each round joins only the terms that
    the one before has found, and cycles end.
    """
    columns = existing.columns
    is_work = F.startswith("s", F.lit("#")) & F.endswith("s", F.lit("Work"))
    own = existing.where(is_work).withColumn("work_id", fragment(F.col("s"), "Work"))
    kept = cut(own.join(resolved.select("grain", "work_id").distinct(), ["grain", "work_id"], "left_anti").select(columns))
    fresh_terms = fresh.where(~is_work).select("grain", F.col("s").alias("term")).distinct()
    terms = cut(existing.where(~is_work).join(fresh_terms.withColumnRenamed("term", "s"), ["grain", "s"], "left_anti").select(columns))
    edges = terms.where("o_kind <> 'literal'").select("grain", F.col("s").alias("term"), F.col("o").alias("next")).distinct()
    described = cut(terms.select("grain", F.col("s").alias("term")).distinct())
    named = kept.where("o_kind <> 'literal'").select("grain", F.col("o").alias("term")).distinct()
    frontier = seen = cut(named.join(described, ["grain", "term"], "left_semi"))
    while not frontier.isEmpty():
        step = frontier.join(edges, ["grain", "term"]).select("grain", F.col("next").alias("term")).distinct()
        frontier = cut(step.join(described, ["grain", "term"], "left_semi").join(seen, ["grain", "term"], "left_anti"))
        seen = seen.unionByName(frontier)
    described_kept = terms.join(seen.withColumnRenamed("term", "s"), ["grain", "s"], "left_semi").select(columns)
    return fresh.select(columns).unionByName(kept).unionByName(described_kept)
