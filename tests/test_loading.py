"""Selective load, prior state and preserved enrichment."""

from graph_text import WORK, frame
from pyspark.sql import functions as F

from folio_spark.operators.identity import resolve
from folio_spark.operators.loading import key_bits, load_counts, may_hold, prior_state, selective_load, with_preserved_enrichment
from folio_spark.operators.projection import project_works, term_index, term_sideband

MORE = """
http://terms.example/t0 skos:prefLabel "All"@en @ authority:t
http://terms.example/t2 skos:altLabel "Vessels"@en @ authority:t
http://terms.example/lone skos:prefLabel "Lone"@en @ authority:t
http://terms.example/lone skos:broader http://terms.example/t1 @ authority:t
http://terms.example/t1 skos:broader http://terms.example/t2 @ authority:t
_:n skos:prefLabel "Nobody"@en @ authority:t
#w1Work own:note "kept whole" @ enrichment:x
"""


def plain(df):
    return sorted((repr(r.asDict(recursive=True)) for r in df.collect()))


def test_projects_as_the_whole_does(spark):
    whole = frame(spark, WORK + MORE)
    part = selective_load(whole)
    for read in (lambda q: project_works(q, "feed:a"), lambda q: term_sideband(project_works(q, "feed:a"), term_index(q))):
        assert plain(read(whole)) == plain(read(part)) != []


def test_what_is_kept(spark):
    """Ancestors that no work names stay; terms that none reaches and predicates that none reads go; a cycle ends; other graphs stay whole."""
    whole = frame(spark, WORK + MORE)
    part = selective_load(whole)
    kept = {(r.s[-2:], r.p.split("#")[1]) for r in part.where("g = 'authority:t'").collect()}
    assert kept == {("t2", "prefLabel"), ("t2", "label"), ("t2", "broader"), ("t1", "prefLabel"), ("t1", "broader"), ("t0", "prefLabel")}
    assert plain(part.where("g <> 'authority:t'")) == plain(whole.where("g <> 'authority:t'"))
    counts = {r.g: (r.scanned, r.kept) for r in load_counts(whole, part).collect()}
    assert counts["authority:t"] == (12, 8) and counts["enrichment:x"] == (1, 1)


def test_bits_let_every_key_through(spark):
    keys = spark.range(0, 40_000, 7).select(F.concat(F.lit("k"), "id").alias("k"))
    rows = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("k"))
    got = {r.k for r in may_hold(rows, "k", key_bits(keys, "k")).collect()}
    assert {r.k for r in keys.collect()} <= got and len(got) < 6_000


def test_prior_state(spark):
    """A second run over committed grains gives their ids back, by key, by anchor and by cluster key."""
    text = WORK + """
#i1Instance rdf:type bf:Instance
#i1Instance bf:instanceOf #w1Work
#w1Work bf:identifiedBy _:an
_:an rdf:value "555"
_:an bf:source _:as
_:as rdfs:label "workid"
#w8Work own:mergedInto #w9Work @ editorial:
#i7Instance own:pinnedTo #w7Work @ editorial:
_:stub rdf:type bf:Work
"""
    prior, feeds = prior_state(frame(spark, text), anchor_sources=("workid",), schemes={"vendor": "shop"})
    assert [(r.instance_id, r.work_id, sorted(r["keys"])) for r in prior.instances.collect()] == [("i1", "w1", ["isbn:9780000000002", "shop:77"])]
    assert [(r.work_id, r.cluster_key) for r in prior.works.collect()] == [("w1", "moss ada\x1fnight ferry\x1feng")]
    assert [(r.anchor, r.work_id) for r in prior.anchors.collect()] == [("workid:555\x1feng", "w1")]
    assert [(r.from_id, r.to_id) for r in prior.merges.collect()] == [("w8", "w9")] and [(r.instance_id, r.work_id) for r in prior.pins.collect()] == [("i7", "w7")]
    assert [tuple(r) for r in feeds.collect()] == [("w1", "a")]
    rows = [(1, ["isbn:9780000000002"], "", []), (2, ["n:1"], "", ["workid:555\x1feng"]), (3, ["n:2"], "moss ada\x1fnight ferry\x1feng", []), (4, ["n:3"], "", ["workid:555\x1fspa"])]
    got = {r.ord: r for r in resolve(spark.createDataFrame(rows, "ord long, keys array<string>, cluster_key string, anchors array<string>"), prior, "run").collect()}
    assert [got[k].work_id for k in (1, 2, 3)] == ["w1"] * 3 and got[1].instance_id == "i1" and got[4].minted_work


QUAD = "grain string, s string, p string, o string, o_kind string"


def kept(spark, existing, fresh, resolved):
    q = lambda rows: spark.createDataFrame(rows, QUAD)
    out = with_preserved_enrichment(q(existing), q(fresh), spark.createDataFrame(resolved, "grain string, work_id string"))
    return sorted(map(tuple, out.collect()))


def test_enrichment_of_unresolved_works_stays(spark):
    old = [
        ("g", "#w1Work", "about", "t1", "iri"), ("g", "#w2Work", "about", "t2", "iri"), ("g", "t1", "label", "One", "literal"), ("g", "t1", "near", "_:b", "blank"), ("g", "_:b", "to", "t3", "iri"),
        ("g", "t3", "label", "Three", "literal"), ("g", "t3", "back", "t1", "iri"), ("g", "t2", "label", "Two", "literal"), ("g", "t9", "label", "Loose", "literal"), ("h", "t1", "label", "Elsewhere", "literal"),
    ]
    fresh = [("g", "#w2Work", "about", "t4", "iri"), ("g", "t4", "label", "Four", "literal")]
    got = kept(spark, old, fresh, [("g", "w2")])
    assert got == sorted(fresh + [old[i] for i in (0, 2, 3, 4, 5, 6)])
    assert kept(spark, old, [*fresh, ("g", "t1", "label", "Anew", "literal")], [("g", "w2")]) == sorted([*fresh, ("g", "t1", "label", "Anew", "literal"), old[0]])
    assert kept(spark, [], [], []) == []


def test_enrichment_follows_a_long_chain(spark):
    chain = [("g", f"t{i}", "next", f"t{(i + 1) % 60}", "iri") for i in range(60)] + [("g", "x", "next", "y", "iri")]
    got = kept(spark, [("g", "#w1Work", "about", "t0", "iri"), *chain], [], [])
    assert len(got) == 61
