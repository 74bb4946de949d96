"""Works projected from quads: the record of a work, what shadows what, labels, series, links, terms."""

import random

import pytest

from graph_text import WORK, frame, lines

from folio_spark.operators.projection import closure_from, project_works, term_index, term_sideband
from folio_spark.sources.catalog import parse_quads, read_grains, read_quads

def works(spark, *texts, **options):
    return {r.work_id: r.asDict(recursive=True) for r in project_works(frame(spark, *texts), "feed:a", **options).collect()}


def test_record(spark):
    w = works(spark, WORK, schemes=[("http://terms.example/", "example")])["w1"]
    assert (w["title"], w["subtitle"], w["summary"]) == ("Night Ferry", "A Novel", "")
    assert w["contributors"] == [{"name": "Moss, Ada", "role": "author"}, {"name": "Byrd, Lee", "role": ""}]
    assert w["subjects"] == [{"id": "http://terms.example/t2", "labels": {"en": "Ships", "de": "Schiffe"}, "broader": ["http://terms.example/t1"], "scheme": "example"}]
    assert (w["tags"], w["languages"], w["formats"], w["held"]) == (["Fiction"], ["eng"], ["ebook", "print"], True)
    assert w["classifications"] == [{"value": "FIC1", "label": "Fiction / Sea"}]
    one, two = w["instances"]
    assert one == {"id": "i1", "format": "ebook", "isbns": ["9780000000002"], "provider_ids": [{"source": "vendor", "value": "77"}], "publisher": "House", "place": "Oslo", "published": "2021", "items": [], "held": False}
    assert two["items"] == [{"call_number": "QA 1", "location": "", "barcode": "b1", "note": ""}] and two["held"] and two["format"] == "print"
    assert (w["extras"], w["has_part"], w["part_of"], w["series"]) == ({}, [], [], [])


def test_other_graphs_and_stubs_are_no_works(spark):
    stub = "_:x rdf:type bf:Work\nhttp://else.example/Work rdf:type bf:Work\n#w9Work rdf:type bf:Work @ feed:b"
    assert works(spark, stub) == {}
    assert project_works(frame(spark, []), "feed:a").collect() == []


def test_editorial_claims_and_overlays(spark):
    got = works(
        spark,
        WORK + "#w1Work own:overrides bf:subject @ editorial:\n#w1Work own:overrides bf:title @ editorial:\n#w1Work bf:title #tt @ editorial:\n#tt bf:mainTitle \"Mended\" @ editorial:\n"
        + '#w1Work own:extra/cover "feed.jpg"\n#w1Work own:extra/cover "own.jpg" @ editorial:\n#w1Work own:extra/rating "5"',
    )["w1"]
    assert (got["title"], got["tags"], [s["id"] for s in got["subjects"]]) == ("Mended", [], ["http://terms.example/t2"])
    assert got["extras"] == {"cover": "own.jpg", "rating": "5"}


def test_tags(spark):
    """A grain's own node is a tag; a tag that was promoted goes where its subject stands, and only there."""
    extra = '#w1Work bf:subject #s7\n#s7 rdfs:label "Skolem"\n#w1Work own:tag "Boats" @ editorial:\nhttp://terms.example/t2 own:tagAlias "Boats" @ authority:t'
    other = '#w2Work rdf:type bf:Work\n#w2Work own:tag "Boats" @ editorial:'
    got = works(spark, WORK + extra, other)
    assert got["w1"]["tags"] == ["Fiction", "Skolem"] and got["w2"]["tags"] == ["Boats"] and got["w2"]["subjects"] == []


def test_visibility_and_links(spark):
    extra = "#w1Work bf:hasPart #w2Work @ editorial:\n#w1Work bf:hasPart #w3Work @ editorial:\n#w1Work bf:hasPart #w4Work @ editorial:\n#w1Work bf:partOf #w5Work @ editorial:"
    others = ['#w2Work rdf:type bf:Work\n#w2Work bf:title _:t\n_:t bf:mainTitle "Part"', "#w3Work rdf:type bf:Work\n#w3Work own:tombstoned \"x\" @ editorial:", '#w4Work rdf:type bf:Work\n#w4Work own:suppressed "true" @ editorial:', '#w6Work rdf:type bf:Work\n#w6Work own:suppressed "false" @ editorial:']
    got = works(spark, WORK + extra, *others)
    assert sorted(got) == ["w1", "w2", "w6"]
    assert got["w1"]["has_part"] == [{"id": "w2", "title": "Part"}] and got["w1"]["part_of"] == []


def test_contributors_same_in_any_order(spark):
    text = lines(WORK + '#w1Work bf:contribution _:c3\n_:c3 bf:agent _:a3\n_:a3 rdfs:label "Byrd, Lee"\n_:c3 rdf:type bflc:PrimaryContribution\n#w1Work bf:contribution _:c4\n_:c4 bf:role _:r1')
    want = [{"name": "Byrd, Lee", "role": ""}, {"name": "Moss, Ada", "role": "author"}]
    for seed in range(3):
        random.Random(seed).shuffle(text)
        assert works(spark, text)["w1"]["contributors"] == want


def relation(n, title, enum="", issn="", status="t", kind="series", hub=False):
    out = f'#w1Work bf:relation _:rel{n}\n_:rel{n} bf:relationship http://id.loc.gov/vocabulary/relationship/{kind}\n_:rel{n} bf:associatedResource _:res{n}\n_:res{n} bf:status http://id.loc.gov/vocabulary/mstatus/{status}\n'
    out += f'_:res{n} bf:title _:st{n}\n_:st{n} bf:mainTitle "{title}"\n' if title else ""
    out += f'_:rel{n} bf:seriesEnumeration "{enum}"\n' if enum else ""
    out += f'_:res{n} bf:identifiedBy _:x{n}\n_:x{n} rdf:value "not"\n_:res{n} bf:identifiedBy _:is{n}\n_:is{n} rdf:type bf:Issn\n_:is{n} rdf:value "{issn}"\n' if issn else ""
    return out + (f"_:res{n} rdf:type bf:Hub\n" if hub else "")


@pytest.mark.parametrize(
    "parts, want",
    [
        ([(1, "Sea tales", "bk. 2"), (2, "Harbours", "v. 1")], [("Harbours", "v. 1", "", False), ("Sea tales", "bk. 2", "", False)]),
        ([(1, "Sea tales ;", "bk. 2"), (2, "SEA tales", "", "1234-5678", "t", "series", True)], [("SEA tales", "bk. 2", "1234-5678", True)]),
        ([(1, "Sea tales", "", "", "tr")], [("Sea tales", "", "", True)]),
        ([(1, "", "bk. 2"), (2, "Other", "", "", "t", "translationof")], []),
        ([(1, "Below", "", "", "t", "subseries")], [("Below", "", "", False)]),
    ],
)
def test_series(spark, parts, want):
    got = works(spark, WORK + "".join(relation(*p) for p in parts))["w1"]["series"]
    assert [tuple(s[c] for c in ("title", "enumeration", "issn", "traced")) for s in got] == want


def test_series_of_instances_alone(spark):
    flat = '#i1Instance bf:seriesStatement "Old line"\n#i2Instance bf:seriesStatement "Old line"\n#i2Instance bf:seriesEnumeration "3"'
    assert works(spark, WORK + flat)["w1"]["series"] == [{"title": "Old line", "enumeration": "3", "issn": "", "traced": False}]


@pytest.mark.parametrize("withdrawn, held", [(False, True), (True, False)])
def test_held_by_availability(spark, withdrawn, held):
    text = '#w1Work rdf:type bf:Work\n#w1Work bf:hasInstance #i1Instance\n#i1Instance bf:identifiedBy _:d\n_:d rdf:value "1"\n_:d bf:source _:s\n_:s rdfs:label "lend"\n' + ('#w1Work own:withdrawnFromFeed "2024"' if withdrawn else "")
    got = works(spark, text, available=["lend"])["w1"]
    assert (got["held"], got["instances"][0]["held"]) == (held, held)


def test_sideband(spark):
    """Terms above those that works have, where anything is told of them; one that is only named is left out."""
    quads = frame(spark, WORK + 'http://terms.example/lone skos:prefLabel "Lone"@en @ authority:t')
    terms = term_index(quads)
    got = {r.id: r.labels for r in term_sideband(project_works(quads, "feed:a"), terms).collect()}
    assert got == {"http://terms.example/t2": {"en": "Ships", "de": "Schiffe"}, "http://terms.example/t1": {"en": "Vehicles"}}


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "child string, parent string")
    assert {r.uri for r in closure_from(spark.createDataFrame([("a",)], "uri string"), edges).collect()} == {"a", "b", "c"}


def test_terms_and_escapes(spark):
    rows = [r'<#w> <p:x> "say \"hi\"\n\\n é \U0001F600"@en-GB <g:> .', r'_:b1 <p:yA> "5"^^<http://t/int> . # note', "  # all comment", "", r'<#w> <p:z> _:b1 <g:> .']
    got = parse_quads(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [tuple(r) for r in got] == [("#w", "p:x", 'say "hi"\n\\n é 😀', "literal", "en-GB", None, "g:"), ("_:b1", "p:yA", "5", "literal", None, "http://t/int", ""), ("#w", "p:z", "_:b1", "blank", None, None, "g:")]


@pytest.mark.parametrize("bad", ["<#w> <p:x> \"cut", "<#w> <p:x> .", r'<#w> <p:x> "bad \q" .', "<#w> <p x> <o> ."])
def test_malformed_line_fails_whatever_is_read(spark, tmp_path, bad):
    (tmp_path / "a.nq").write_text(f"<#w> <p:x> <o:> .\n{bad}\n")
    quads = read_quads(spark, str(tmp_path))
    for read in (quads.count, quads.select("file").collect, quads.select("s").collect):
        with pytest.raises(Exception, match="malformed quad"):
            read()


def test_grains_leave_the_bulk_file_out(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "w1.nq").write_text("\n".join(lines(WORK)))
    (tmp_path / "catalog.nq").write_text("\n".join(lines(WORK)))
    quads = read_grains(spark, str(tmp_path))
    assert quads.count() == len(lines(WORK))
    assert [r.title for r in project_works(quads, "feed:a").collect()] == ["Night Ferry"]
