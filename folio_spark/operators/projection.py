"""Works from quads: one shuffle by grain, then paths through each grain's own statements; labels and hierarchy by reference."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import scheme_of
from .lineage import cut

# Public vocabularies.
BF, BFLC = "http://id.loc.gov/ontologies/bibframe/", "http://id.loc.gov/ontologies/bflc/"
RDF, RDFS, SKOS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2004/02/skos/core#"
TYPE, VALUE, LABEL, PREF_LABEL, BROADER = RDF + "type", RDF + "value", RDFS + "label", SKOS + "prefLabel", SKOS + "broader"
SERIES_RELATIONS = ["http://id.loc.gov/vocabulary/relationship/series", "http://id.loc.gov/vocabulary/relationship/subseries"]
TRACED = "http://id.loc.gov/vocabulary/mstatus/tr"
# Media types as formats.
FORMATS = {"audio": "audiobook", "computer": "ebook", "video": "video", "unmediated": "print"}
# The catalog's own predicates lie in a name space of its own, which is a parameter.
OWN = "urn:catalog:ns#"

OBJECT = "array<struct<o:string,kind:string>>"


def group_grains(quads: DataFrame, feed: str, editorial: str = "editorial:", own: str = OWN) -> DataFrame:
    """(grain, work, m, extras): each work node of a grain with the grain's statements as a map, subject and predicate -> objects in order.

    quads: (grain, ord, s, p, o, o_kind, o_lang, g). The view is the feed's graph
    and the editorial graph: feed first, then editorial, each by ord. A feed
    statement is hidden where the editorial graph claims its subject and
    predicate. Statements of a grain meet by one shuffle; a grain is one record
    and becomes rows of the result, so it isn't split. Equal statements count once.
    """
    view = quads.where(F.col("g").isin(feed, editorial)).select("grain", (F.col("g") == editorial).alias("edited"), "ord", "s", "p", "o", F.col("o_kind").alias("kind"))
    view = view.repartition("grain")  # both steps below group within it
    one = F.struct("edited", "ord", "o", "kind")
    lists = view.groupBy("grain", "s", "p").agg(F.sort_array(F.collect_list(one)).alias("objects"))
    work = (F.col("p") == TYPE) & F.exists("objects", lambda x: (x["o"] == BF + "Work") & (x["kind"] == "iri")) & F.col("s").startswith("#") & F.col("s").endswith("Work")
    node = lambda c: F.concat("s", F.lit(" "), c)
    iri = ~F.col("s").startswith("_:")
    claims = F.transform(F.filter("objects", lambda x: x["edited"] & (x["kind"] == "iri")), lambda x: node(x["o"]))
    extra = F.transform(F.filter("objects", lambda x: x["kind"] == "literal"), lambda x: F.struct(F.col("s").alias("s"), F.substr("p", F.lit(len(own) + 7)).alias("key"), x["edited"].alias("edited"), x["ord"].alias("ord"), x["o"].alias("o")))
    grains = lists.groupBy("grain").agg(
        F.collect_list(F.struct(node(F.col("p")).alias("key"), iri.alias("iri"), "objects")).alias("entries"),
        F.flatten(F.collect_list(F.when(iri & (F.col("p") == own + "overrides"), claims))).alias("claims"),
        F.collect_list(F.when(work, F.col("s"))).alias("works"),
        F.flatten(F.collect_list(F.when(iri & F.col("p").startswith(own + "extra/") & (F.length("p") > len(own) + 6), extra))).alias("extras"),
    )
    shown = lambda e: F.filter(e["objects"], lambda x: x["edited"] | ~e["iri"] | ~F.array_contains("claims", e["key"]))
    plain = lambda e: F.array_distinct(F.transform(shown(e), lambda x: F.struct(x["o"].alias("o"), x["kind"].alias("kind"))))
    m = F.map_from_entries(F.transform("entries", lambda e: F.struct(e["key"], plain(e))))
    return grains.where(F.size("works") > 0).select("grain", F.explode("works").alias("work"), m.alias("m"), "extras")


def graph_maps(quads: DataFrame) -> DataFrame:
    """(grain, g, m, works, instances): each graph of a grain as a map, subject and predicate -> objects in order, and its nodes of both types."""
    kind = F.col("o_kind").alias("kind")
    lists = quads.repartition("grain").groupBy("grain", "g", "s", "p").agg(F.sort_array(F.collect_list(F.struct("ord", "o", kind))).alias("objects"))
    plain = F.array_distinct(F.transform("objects", lambda x: F.struct(x["o"].alias("o"), x["kind"].alias("kind"))))
    typed = lambda name: F.collect_list(F.when((F.col("p") == TYPE) & F.exists("objects", lambda x: x["o"] == BF + name), F.col("s")))
    entry = F.struct(F.concat("s", F.lit(" "), "p"), plain)
    return lists.groupBy("grain", "g").agg(F.map_from_entries(F.collect_list(entry)).alias("m"), typed("Work").alias("works"), typed("Instance").alias("instances"))


class Paths:
    """Expressions over a row of group_grains(): objects, first literals, types."""

    def objects(self, node: Column, predicate: str) -> Column:
        return F.coalesce(F.try_element_at(F.col("m"), F.concat(node, F.lit(f" {predicate}"))), F.array().cast(OBJECT))

    def values(self, node: Column, predicate: str) -> Column:
        return F.transform(self.objects(node, predicate), lambda x: x["o"])

    def first(self, node: Column, predicate: str) -> Column:
        return F.get(self.values(node, predicate), 0)

    def literals(self, node: Column, predicate: str) -> Column:
        return F.transform(F.filter(self.objects(node, predicate), lambda x: x["kind"] == "literal"), lambda x: x["o"])

    def text(self, node: Column, predicate: str) -> Column:
        """The first literal, or ''."""
        return F.coalesce(F.get(self.literals(node, predicate), 0), F.lit(""))

    def is_a(self, node: Column, kind: str) -> Column:
        return F.array_contains(self.values(node, TYPE), kind)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.get(F.transform(F.array(value), body), 0)


def filled(texts: Column) -> Column:
    return F.filter(texts, lambda x: x.isNotNull() & (x != ""))


def fragment(iri: Column, suffix: str) -> Column:
    """The id in a grain's own IRI `#<id><suffix>`."""
    return F.regexp_replace(F.regexp_replace(iri, "^#", ""), f"{suffix}$", "")


def contributors(p: Paths, w: Column) -> Column:
    """Distinct (name, role): primary contributions first, each part by name and role; what is primary anywhere is primary."""

    def entry(node: Column) -> Column:
        name = let(p.first(node, BF + "agent"), lambda a: p.text(a, LABEL))
        role = let(p.first(node, BF + "role"), lambda r: F.when(r.isNull(), "").otherwise(p.text(r, LABEL)))
        return F.struct(F.coalesce(name, F.lit("")).alias("name"), role.alias("role"), p.is_a(node, BFLC + "PrimaryContribution").alias("first"))

    bare = lambda x: F.struct(x["name"].alias("name"), x["role"].alias("role"))
    found = F.filter(F.transform(p.values(w, BF + "contribution"), entry), lambda x: x["name"] != "")
    return let(found, lambda f: let(F.array_distinct(F.transform(F.filter(f, lambda x: x["first"]), bare)), lambda lead: F.concat(F.sort_array(lead), F.sort_array(F.array_except(F.transform(f, bare), lead)))))


def subject_ids(p: Paths, w: Column) -> Column:
    """Sorted IRIs of the controlled subjects: those that aren't nodes of the grain itself."""
    outer = F.filter(p.objects(w, BF + "subject"), lambda x: (x["kind"] == "iri") & ~x["o"].startswith("#"))
    return F.sort_array(F.array_distinct(F.transform(outer, lambda x: x["o"])))


def tag_texts(p: Paths, w: Column, own: str) -> Column:
    """Sorted labels of the grain's own subject nodes, and the tags given as texts."""
    inner = F.filter(p.objects(w, BF + "subject"), lambda x: (x["kind"] == "blank") | ((x["kind"] == "iri") & x["o"].startswith("#")))
    return F.sort_array(F.array_distinct(filled(F.concat(F.transform(inner, lambda x: p.text(x["o"], LABEL)), p.literals(w, own + "tag")))))


def classifications(p: Paths, w: Column) -> Column:
    """(value, label) by value: of a value's labels the first that isn't empty."""
    coded = F.transform(p.values(w, BF + "classification"), lambda c: F.struct(p.text(c, BF + "classificationPortion").alias("value"), p.text(c, LABEL).alias("label")))
    label = lambda f, v: F.coalesce(F.get(filled(F.transform(F.filter(f, lambda x: x["value"] == v), lambda x: x["label"])), 0), F.lit(""))
    values = lambda f: F.sort_array(F.array_distinct(filled(F.transform(f, lambda x: x["value"]))))
    return let(coded, lambda f: F.transform(values(f), lambda v: F.struct(v.alias("value"), label(f, v).alias("label"))))


def series(p: Paths, w: Column) -> Column:
    """(title, enumeration, issn, traced) by title: relations that name one series (case and closing punctuation apart) are one membership.

    Of such relations the title is the last without closing punctuation (else the
    first), enumeration and ISSN the first given, traced if any is. Works without
    any take the flat statements of their instances.
    """
    res = lambda rel: p.first(rel, BF + "associatedResource")
    title = lambda r: F.coalesce(F.get(filled(F.transform(p.values(r, BF + "title"), lambda t: p.text(t, BF + "mainTitle"))), 0), F.lit(""))
    issn = lambda r: F.coalesce(F.get(filled(F.transform(F.filter(p.values(r, BF + "identifiedBy"), lambda i: p.is_a(i, BF + "Issn")), lambda i: p.text(i, VALUE))), 0), F.lit(""))
    traced = lambda r: p.is_a(r, BF + "Hub") | F.array_contains(p.values(r, BF + "status"), TRACED)
    trimmed = lambda t: F.regexp_replace(t, r"[ ;:,.]+$", "")
    is_series = lambda rel: F.coalesce(p.first(rel, BF + "relationship").isin(SERIES_RELATIONS), F.lit(False)) & res(rel).isNotNull()
    entry = lambda rel: let(res(rel), lambda r: F.struct(title(r).alias("title"), p.text(rel, BF + "seriesEnumeration").alias("enumeration"), issn(r).alias("issn"), traced(r).alias("traced")))
    found = F.filter(F.transform(F.filter(p.values(w, BF + "relation"), is_series), entry), lambda x: x["title"] != "")
    key = lambda x: F.lower(trimmed(x["title"]))
    of = lambda g, c: F.coalesce(F.get(filled(F.transform(g, lambda x: x[c])), 0), F.lit(""))

    def merged(g: Column) -> Column:
        clean = F.filter(F.transform(g, lambda x: x["title"]), lambda t: trimmed(t) == t)
        best = F.when(F.size(clean) > 0, F.try_element_at(clean, F.lit(-1))).otherwise(g[0]["title"])
        return F.struct(best.alias("title"), of(g, "enumeration").alias("enumeration"), of(g, "issn").alias("issn"), F.exists(g, lambda x: x["traced"]).alias("traced"))

    joined = let(found, lambda f: F.transform(F.array_distinct(F.transform(f, key)), lambda k: let(F.filter(f, lambda x: key(x) == k), merged)))
    flat = lambda predicate: filled(F.flatten(F.transform(p.values(w, BF + "hasInstance"), lambda i: p.literals(i, predicate))))
    number = F.coalesce(F.get(flat(BF + "seriesEnumeration"), 0), F.lit(""))
    legacy = let(number, lambda n: F.transform(F.sort_array(F.array_distinct(flat(BF + "seriesStatement"))), lambda t: F.struct(t.alias("title"), n.alias("enumeration"), F.lit("").alias("issn"), F.lit(False).alias("traced"))))
    return let(F.sort_array(joined), lambda j: F.when(F.size(j) > 0, j).otherwise(legacy))


def instances(p: Paths, w: Column, own: str, available: Sequence[str]) -> Column:
    """The work's instances by id: format, identifiers by scheme, publication, items, and whether it is held.

    Published: the first provision by node that is a publication. Held: an item,
    or an identifier of a scheme in `available` while the work isn't withdrawn.
    """
    withdrawn = F.size(p.objects(w, own + "withdrawnFromFeed")) > 0
    label = lambda node, predicate: let(p.first(node, predicate), lambda x: F.when(x.isNull(), "").otherwise(p.text(x, LABEL)))

    def form(i: Column) -> Column:
        known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
        return let(label(i, BF + "media"), lambda m: F.when(m != "", F.coalesce(F.try_element_at(known, m), m)).when(label(i, BF + "carrier") == "volume", "print").otherwise(""))

    def ids(i: Column) -> Column:
        one = lambda x: F.struct(label(x, BF + "source").alias("source"), p.text(x, VALUE).alias("value"), p.is_a(x, BF + "Isbn").alias("isbn"))
        return F.filter(F.transform(p.values(i, BF + "identifiedBy"), one), lambda x: x["value"] != "")

    def published(i: Column) -> Column:
        node = F.get(F.filter(F.sort_array(p.values(i, BF + "provisionActivity")), lambda x: p.is_a(x, BF + "Publication")), 0)
        date = lambda n: let(p.text(n, BF + "date"), lambda d: F.when(d != "", d).otherwise(p.text(n, BFLC + "simpleDate")))
        return let(node, lambda n: F.when(n.isNull(), F.struct(*[F.lit("").alias(c) for c in ("publisher", "place", "published")])).otherwise(F.struct(p.text(n, BFLC + "simpleAgent").alias("publisher"), p.text(n, BFLC + "simplePlace").alias("place"), date(n).alias("published"))))

    item = lambda n: F.struct(p.text(n, BF + "shelfMark").alias("call_number"), p.text(n, BF + "physicalLocation").alias("location"), p.text(n, own + "barcode").alias("barcode"), p.text(n, own + "itemNote").alias("note"))
    items = lambda i: F.transform(F.sort_array(p.values(i, BF + "hasItem")), item)

    def one(i: Column) -> Column:
        def built(x: Column) -> Column:
            isbns = F.sort_array(F.transform(F.filter(x["ids"], lambda d: d["isbn"]), lambda d: d["value"]))
            others = F.sort_array(F.transform(F.filter(x["ids"], lambda d: ~d["isbn"]), lambda d: F.struct(d["source"].alias("source"), d["value"].alias("value"))))
            held = (F.size(x["items"]) > 0) | (~withdrawn & F.exists(others, lambda d: d["source"].isin(*available)))
            pub = x["pub"]
            return F.struct(fragment(i, "Instance").alias("id"), form(i).alias("format"), isbns.alias("isbns"), others.alias("provider_ids"), pub["publisher"].alias("publisher"), pub["place"].alias("place"), pub["published"].alias("published"), x["items"].alias("items"), held.alias("held"))

        return let(F.struct(ids(i).alias("ids"), items(i).alias("items"), published(i).alias("pub")), built)

    return F.array_sort(F.transform(p.values(w, BF + "hasInstance"), one), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))


def term_index(quads: DataFrame, own: str = OWN) -> DataFrame:
    """(uri, labels: language -> label, broader, aliases) of all graphs: the preferred label (the last given) before other labels (the first given)."""
    told = quads.where(~F.col("s").startswith("_:") & F.col("p").isin(LABEL, PREF_LABEL, BROADER, own + "tagAlias"))
    text, at = (F.col("o_kind") == "literal") & (F.col("o") != ""), F.struct("grain", "ord")
    lang = F.when(text & F.col("p").isin(LABEL, PREF_LABEL), F.coalesce("o_lang", F.lit("")))
    pref, other = (F.when(text & (F.col("p") == x), at) for x in (PREF_LABEL, LABEL))
    per = told.groupBy(F.col("s").alias("uri"), lang.alias("lang")).agg(
        F.coalesce(F.max_by("o", pref), F.min_by("o", other)).alias("label"),
        F.collect_set(F.when((F.col("p") == BROADER) & (F.col("o_kind") == "iri") & (F.col("o") != ""), F.col("o"))).alias("broader"),
        F.collect_set(F.when((F.col("p") == own + "tagAlias") & text, F.col("o"))).alias("aliases"),
    )
    labels = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", "label")))))
    flat = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return per.groupBy("uri").agg(labels.alias("labels"), flat("broader"), flat("aliases"))


def project_works(quads: DataFrame, feed: str, *, editorial: str = "editorial:", own: str = OWN, available: Sequence[str] = ("overdrive-reserve",), schemes: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """One row a visible work: its fields from the feed's and the editorial statements.

    quads: (grain, ord, s, p, o, o_kind, o_lang, g). Columns: work_id, title,
    subtitle, summary, contributors, subjects (id, labels, broader, scheme), tags,
    languages, classifications, formats, instances, held, extras, has_part,
    part_of, series. schemes: (prefix, scheme) of subject ids, the first that fits. A work with a tombstone, or suppressed, has no row. Of
    several values the first counts, feed before editorial; where the editorial
    graph claims a property, its own alone. A tag goes where the subject that it
    was promoted to stands. Links lead to works of the result only. Labels and
    hierarchy come from all graphs, joined by reference.

    Null objects count as ''. No quads: no rows. Other columns are ignored.
    """
    p, w = Paths(), F.col("work")
    quads = quads.withColumn("o", F.coalesce("o", F.lit("")))
    rows = group_grains(quads, feed, editorial, own)
    rows = rows.where((F.size(p.objects(w, own + "tombstoned")) == 0) & (p.text(w, own + "suppressed") != "true"))
    title = lambda c: let(p.first(w, BF + "title"), lambda t: F.when(t.isNull(), "").otherwise(p.text(t, BF + c)))
    summary = F.coalesce(F.get(filled(F.transform(p.values(w, BF + "summary"), lambda s: p.text(s, LABEL))), 0), F.lit(""))
    languages = F.sort_array(F.array_distinct(filled(F.transform(p.values(w, BF + "language"), lambda x: F.regexp_extract(x, r"[^/#]*$", 0)))))
    targets = lambda c: F.sort_array(F.transform(F.filter(p.objects(w, BF + c), lambda x: (x["kind"] == "iri") & x["o"].rlike("^#.+Work$")), lambda x: fragment(x["o"], "Work")))
    own_extras = F.filter("extras", lambda x: x["s"] == w)
    last = lambda k: F.array_max(F.transform(F.filter(own_extras, lambda x: x["key"] == k), lambda x: F.struct(x["edited"].alias("edited"), x["ord"].alias("ord"), x["o"].alias("o"))))["o"]
    extras = F.map_from_entries(F.transform(F.sort_array(F.array_distinct(F.transform(own_extras, lambda x: x["key"]))), lambda k: F.struct(k, last(k))))
    works = rows.select(
        fragment(w, "Work").alias("work_id"), title("mainTitle").alias("title"), title("subtitle").alias("subtitle"), summary.alias("summary"),
        contributors(p, w).alias("contributors"), subject_ids(p, w).alias("subject_ids"), tag_texts(p, w, own).alias("tags"), languages.alias("languages"),
        classifications(p, w).alias("classifications"), instances(p, w, own, available).alias("instances"), extras.alias("extras"),
        targets("hasPart").alias("has_part"), targets("partOf").alias("part_of"), series(p, w).alias("series"),
    )
    works = works.withColumn("formats", F.sort_array(F.array_distinct(filled(F.transform("instances", lambda i: i["format"])))))
    # Saved once: subjects and links are looked up beside it, and the paths are walked one time only.
    works = cut(works.withColumn("held", F.exists("instances", lambda i: i["held"])))
    return with_links(with_terms(works, subjects_of(works, term_index(quads, own), schemes)), links_of(works))


def subjects_of(works: DataFrame, terms: DataFrame, schemes: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(work_id, subjects, aliases): what is told of the works' subject_ids, and the tags that they replace."""
    asked = works.select("work_id", F.explode("subject_ids").alias("uri")).join(terms, "uri", "left")
    subject = F.struct(F.col("uri").alias("id"), F.coalesce("labels", F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))).alias("labels"), F.coalesce("broader", F.array().cast("array<string>")).alias("broader"), scheme_of(F.col("uri"), schemes).alias("scheme"))
    return asked.groupBy("work_id").agg(F.collect_list(subject).alias("subjects"), F.flatten(F.collect_list("aliases")).alias("aliases"))


def with_terms(works: DataFrame, subjects: DataFrame) -> DataFrame:
    """works with subjects for subject_ids, and without the tags that they replace."""
    # Maps have no order, so the rows are ordered by the id beside them.
    by_id = F.array_sort("subjects", lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    out = works.join(subjects, "work_id", "left")
    return out.withColumn("subjects", F.coalesce(by_id, F.filter(F.array(subject_like()), lambda x: F.lit(False)))).withColumn("tags", F.array_except("tags", F.coalesce("aliases", F.array().cast("array<string>")))).drop("aliases", "subject_ids")


def subject_like() -> Column:
    """A subject of the right type, for an empty array."""
    return F.struct(F.lit("").alias("id"), F.create_map(F.lit(""), F.lit("")).alias("labels"), F.array(F.lit("")).alias("broader"), F.lit("").alias("scheme"))


def links_of(works: DataFrame) -> DataFrame:
    """(work_id, met): the links of has_part and part_of that lead to a work of the result, as (kind, id, title)."""
    link = lambda kind: F.transform(kind, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("id")))
    asked = works.select("work_id", F.explode(F.concat(link("has_part"), link("part_of"))).alias("l")).select("work_id", "l.kind", "l.id")
    titles = works.select(F.col("work_id").alias("id"), "title")
    return asked.join(titles, "id").groupBy("work_id").agg(F.sort_array(F.collect_list(F.struct("kind", "id", "title"))).alias("met"))


def with_links(works: DataFrame, links: DataFrame) -> DataFrame:
    """works with links in has_part and part_of, as (id, title) by id."""
    none = F.array().cast("array<struct<kind:string,id:string,title:string>>")
    of = lambda kind: F.transform(F.filter(F.coalesce("met", none), lambda x: x["kind"] == kind), lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title")))
    return works.join(links, "work_id", "left").withColumns({k: of(k) for k in ("has_part", "part_of")}).drop("met")


def term_sideband(works: DataFrame, terms: DataFrame, schemes: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(id, labels, broader, scheme) of the works' subjects and all that lies above them, where anything is told of them."""
    edges = terms.select(F.col("uri").alias("child"), F.explode("broader").alias("parent"))
    asked = works.select(F.explode("subjects").alias("s")).select(F.col("s.id").alias("uri")).distinct()
    up = closure_from(asked, edges)
    told = terms.join(up, "uri", "left_semi").where((F.size("labels") > 0) | (F.size("broader") > 0))
    return told.select(F.col("uri").alias("id"), "labels", "broader", scheme_of(F.col("uri"), schemes).alias("scheme"))


def closure_from(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(uri): all of start (uri) and what lies above it by edges (child, parent). A round joins only what the one before has found."""
    seen = frontier = cut(start.select("uri").distinct())
    while not frontier.isEmpty():
        step = frontier.join(edges, F.col("uri") == F.col("child")).select(F.col("parent").alias("uri")).distinct()
        frontier = cut(step.join(seen, "uri", "left_anti"))
        seen = seen.unionByName(frontier)
    return seen

