"""Equivalent terms across vocabularies: direct links, links through one other term, and the rules that hold the second kind back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canon_uri, norm_label, singular
from .lineage import cut
from .relational import closure

# Kinds of equivalence, the strongest first.
STRENGTHS = ["exact", "close", "pivot-exact", "pivot-close"]
EXACT, CLOSE = 2, 1


def label_form(c: Column) -> Column:
    """Lower-case words of ASCII letters and digits without plural endings: labels agree if their forms are equal."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, singular), " ")


def pivots(terms: DataFrame, links: DataFrame, deal: int = 1000) -> DataFrame:
    """(src, cand, via, w) from keyed links (a, b, w): terms that link to what src links to, what those link to that link to src, and chains.

    Each link meets all others at its node; a node's links are dealt over as many
    pieces as hold `deal` of them, so that no task gets a node's pairs alone.
    """
    ends = links.select(F.col("a").alias("end")).unionByName(links.select(F.col("b").alias("end")))
    pieces = cut(ends.groupBy("end").agg(F.ceil(F.count("*") / deal).cast("int").alias("n")).where("n > 1"))
    for end in ("a", "b"):
        links = links.join(pieces.select(F.col("end").alias(end), F.col("n").alias(f"n_{end}")), end, "left").withColumn(f"n_{end}", F.coalesce(f"n_{end}", F.lit(1)))
    links = cut(links)
    other = {"a": "b", "b": "a"}

    def meet(of: str, at: str) -> DataFrame:
        """Links by their end `of`, with all links whose end `at` is that node."""
        piece = F.pmod(F.xxhash64(other[of]), F.col(f"n_{of}"))
        mine = links.select(F.col(of).alias("via"), piece.cast("int").alias("piece"), F.col(other[of]).alias("src"), "w")
        theirs = links.select(F.col(at).alias("via"), F.explode(F.sequence(F.lit(0), F.col(f"n_{at}") - 1)).alias("piece"), F.col(other[at]).alias("cand"), F.col("w").alias("v"))
        return mine.join(theirs, ["via", "piece"]).where("src <> cand").select("src", "cand", "via", F.least("w", "v").alias("w"))

    known = terms.select("key")
    chain = meet("b", "a").join(known.withColumnRenamed("key", "via"), "via", "left_semi").select("src", "cand", "via", "w")
    every = meet("b", "b").unionByName(meet("a", "a")).unionByName(chain).join(known.withColumnRenamed("key", "src"), "src", "left_semi")
    return every.groupBy("src", "cand", "via").agg(F.max("w").alias("w"))


def hub_pivots(links: DataFrame, forms: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(links that meet in pairs, pivots of the rest): a node that more than `limit` terms are linked with equates only those whose labels agree."""
    ends = links.select(F.col("a").alias("end")).unionByName(links.select(F.col("b").alias("end")))
    hubs = cut(ends.groupBy("end").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("end"))
    calm = links.join(hubs.withColumnRenamed("end", "a"), "a", "left_anti").join(hubs.withColumnRenamed("end", "b"), "b", "left_anti")
    at_hub = links.select(F.col("a").alias("key"), F.col("b").alias("via"), "w").unionByName(links.select(F.col("b").alias("key"), F.col("a").alias("via"), "w"))
    at_hub = at_hub.join(hubs.withColumnRenamed("end", "via"), "via", "left_semi").join(forms, "key").select("via", "form", "key", "w")
    other = at_hub.select("via", "form", F.col("key").alias("cand"), F.col("w").alias("v"))
    agreed = at_hub.join(other, ["via", "form"]).where("key <> cand").groupBy(F.col("key").alias("src"), "cand", "via").agg(F.max(F.least("w", "v")).alias("w"))
    return calm, agreed


def two_smallest(plain: DataFrame) -> DataFrame:
    """Of (key, norm, scheme) the two smallest keys of each label in each scheme: the smallest but any one term is among them, however many share the label."""
    order = Window.partitionBy("scheme", "norm").orderBy("key")
    return plain.withColumn("nth", F.row_number().over(order)).where("nth <= 2").drop("nth")


def guarded_equivalents(terms: DataFrame, labels: DataFrame, links: DataFrame, edges: DataFrame, *, depth: int = 12, hub: int | None = 1000) -> DataFrame:
    """(src, dst, strength) of every term: terms linked directly in either direction, and through one other as far as the rules let it.

    terms: (id, scheme); labels: (id, label, alt); links: (src, dst, rel), rel
    exact or close; edges: (child, parent) within schemes. An indirect
    equivalence is as strong as its weaker link, and weaker than any direct one.
    At a node in the middle (via) a candidate whose preferred label agrees with
    the source's, plurals apart, stays as it is; one that agrees by other labels
    is pivot-close at best. Of all others there
    - goes one that has an ancestor in its scheme among the candidates at via;
    - go all if an ancestor of the source is among them: via is broader;
    - goes one in whose scheme another term has a label of the source's, unless
      that term is linked to via;
    - are demoted, exact to close and close away: two or more left of one scheme,
      all where two or more terms are candidates, and those beside such a term.
    Candidates that aren't among terms stay as they are. Identifiers are compared
    without protocol and closing slash.

    With hub None the result is whole: at a node of n terms all n * n pairs are
    judged, dealt over many tasks. With a number, nodes of more links than that
    equate only terms whose labels agree, found by label, and leave the others out.
    """
    key = canon_uri(F.trim("id"))
    terms = cut(terms.select(key.alias("key"), "scheme", "id").where("key <> ''").groupBy("key").agg(F.min("scheme").alias("scheme"), F.min("id").alias("id")))
    links = links.select(canon_uri(F.trim("src")).alias("a"), canon_uri(F.trim("dst")).alias("b"), F.when(F.col("rel") == "exact", EXACT).otherwise(CLOSE).alias("w"))
    links = cut(links.where("a <> '' and b <> '' and a <> b").groupBy("a", "b").agg(F.max("w").alias("w")))
    told = labels.select(key.alias("key"), "label", F.coalesce("alt", F.lit(False)).alias("alt")).where("label is not null")
    forms = cut(told.select("key", label_form(F.col("label")).alias("form"), "alt").where("form <> ''").groupBy("key", "form").agg(F.min("alt").alias("alt")))
    if hub is None:
        found = pivots(terms, links)
    else:
        calm, agreed = hub_pivots(links, forms.select("key", "form"), hub)
        found = pivots(terms, calm).unionByName(agreed.join(terms.select(F.col("key").alias("src")), "src", "left_semi")).groupBy("src", "cand", "via").agg(F.max("w").alias("w"))
    named = lambda x, *c: terms.select(F.col("key").alias(x), *[F.col(a).alias(f"{x}_{a}") for a in c])
    every = cut(found.join(named("src", "scheme"), "src").join(named("cand", "scheme"), "cand", "left"))
    pairs = every.where("cand_scheme is not null").select("src", "cand").distinct()
    mine, theirs = (forms.select(F.col("key").alias(x), "form", F.col("alt").alias(f"{x}_alt")) for x in ("src", "cand"))
    alike = pairs.join(mine, "src").join(theirs, ["cand", "form"]).groupBy("src", "cand").agg(F.bool_or(~F.col("src_alt") & ~F.col("cand_alt")).alias("matched"))
    up = cut(closure(edges.select(canon_uri(F.trim("child")).alias("child"), canon_uri(F.trim("parent")).alias("parent")), depth).select("id", "ancestor"))
    rows = every.where("cand_scheme is not null").join(alike, ["src", "cand"], "left")
    rows = cut(rows.withColumns({"matched": F.coalesce("matched", F.lit(False)), "exempt": F.col("matched").isNotNull()}))
    # Below an ancestor in the same scheme at the same node.
    above = rows.select("src", "via", F.col("cand").alias("ancestor"), F.col("cand_scheme").alias("above_scheme"))
    below = rows.select("src", "via", "cand", "cand_scheme").join(up, F.col("cand") == F.col("id")).join(above, ["src", "via", "ancestor"]).where("cand_scheme = above_scheme").select("src", "via", "cand").distinct().withColumn("below", F.lit(True))
    # Of the source's own ancestors at the node.
    narrow = rows.where("cand_scheme = src_scheme").join(up.select(F.col("id").alias("src"), F.col("ancestor").alias("cand")), ["src", "cand"], "left_semi").select("src", "via").distinct().withColumn("narrow", F.lit(True))
    rows = rows.join(below, ["src", "via", "cand"], "left").join(narrow, ["src", "via"], "left")
    scheme, node = Window.partitionBy("src", "via", "cand_scheme"), Window.partitionBy("src", "via")
    gone = ~F.col("exempt") & F.coalesce("below", F.lit(False))
    rows = rows.withColumn("gone", gone).withColumns({"left": F.sum((~F.col("gone")).cast("int")).over(scheme), "claims": F.count("*").over(node)})
    # The term in the candidate's scheme that has one of the source's labels as it is.
    plain = told.select("key", norm_label(F.col("label")).alias("norm")).where("norm <> ''").distinct().join(terms.select("key", "scheme"), "key")
    wanted = rows.where(~F.col("exempt")).select("src", F.col("cand_scheme").alias("scheme")).distinct()
    own = told.select(F.col("key").alias("src"), norm_label(F.col("label")).alias("norm")).where("norm <> ''").distinct()
    partner = wanted.join(own, "src").join(two_smallest(plain), ["scheme", "norm"]).where("key <> src").groupBy("src", F.col("scheme").alias("cand_scheme")).agg(F.min("key").alias("partner"))
    linked = links.select(F.col("a").alias("partner"), F.col("b").alias("via")).withColumn("claims_via", F.lit(True))
    rows = rows.join(partner, ["src", "cand_scheme"], "left").join(linked, ["partner", "via"], "left")
    other = F.col("partner").isNotNull() & (F.col("partner") != F.col("cand"))
    free = ~F.col("exempt")
    drop = F.col("gone") | (free & F.coalesce("narrow", F.lit(False))) | (free & other & F.col("claims_via").isNull())
    demote = free & ((F.col("left") >= 2) | (F.col("claims") >= 2) | other)
    weak = F.col("exempt") & ~F.col("matched")
    strength = F.when(drop | (demote & (F.col("w") == CLOSE)), None).when(demote | weak | (F.col("w") == CLOSE), 4).otherwise(3)
    strong = rows.select("src", F.col("cand").alias("dst"), strength.alias("rank")).where("rank is not null")
    loose = every.where("cand_scheme is null").select("src", F.col("cand").alias("dst"), F.when(F.col("w") == EXACT, 3).otherwise(4).alias("rank"))
    direct = links.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))
    direct = direct.join(named("src"), "src", "left_semi").select("src", "dst", F.when(F.col("w") == EXACT, 1).otherwise(2).alias("rank"))
    best = strong.unionByName(loose).unionByName(direct).groupBy("src", "dst").agg(F.min("rank").alias("rank"))
    ids = terms.select(F.col("key").alias("dst"), "id")
    out = best.join(ids, "dst", "left").join(terms.select(F.col("key").alias("src"), F.col("id").alias("src_id")), "src")
    return out.select(F.col("src_id").alias("src"), F.coalesce("id", "dst").alias("dst"), F.element_at(F.array(*map(F.lit, STRENGTHS)), F.col("rank")).alias("strength"))
