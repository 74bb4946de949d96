"""Record sources on small files, and chains with cycles."""

import json

from folio_spark.operators import graph as G
from folio_spark.sources import records as S


def marc(fields):
    """An ISO 2709 record of (tag, body)."""
    directory, data = "", b""
    for tag, body in fields:
        b = body.encode() + b"\x1e"
        directory += f"{tag}{len(b):04d}{len(data):05d}"
        data += b
    base = 24 + len(directory) + 1
    return f"{base + len(data) + 1:05d}nam a22{base:05d} a 4500".encode() + directory.encode() + b"\x1e" + data + b"\x1d"


def test_marc(spark, tmp_path):
    records = [[("001", "id1"), ("245", "10\x1faÉtude\x1fbü"), ("650", " 0\x1faCats")], [("001", "id2"), ("245", "00\x1faB")]]
    (tmp_path / "a.mrc").write_bytes(b"\n".join(map(marc, records)) + b"\n")
    got = {r.control_number: r.fields for r in S.read_marc(spark, str(tmp_path)).collect()}
    assert set(got) == {"id1", "id2"} and [f.tag for f in got["id1"]] == ["001", "245", "650"]
    title = got["id1"][1]
    assert (title.ind1, title.ind2, [tuple(s) for s in title.subfields]) == ("1", "0", [("a", "Étude"), ("b", "ü")])
    assert got["id1"][0].value == "id1" and got["id1"][2].subfields[0].value == "Cats"


def test_vendor_pages(spark, tmp_path):
    item = {"id": "7", "title": "T", "creators": [{"name": "N", "role": "Author"}], "languages": [{"id": "en"}], "formats": [{"identifiers": [{"type": "ISBN", "value": "978-0-00-000000-1"}, {"type": "ASIN", "value": "x"}]}]}
    (tmp_path / "p.json").write_text(json.dumps({"items": [item, {"id": "8"}]}, indent=1))
    got = {r.id: r for r in S.read_vendor_pages(spark, str(tmp_path)).collect()}
    assert got["7"].isbns == ["9780000000001"] and got["7"].languages == ["en"] and got["8"].isbns == []


def test_concepts(spark, tmp_path):
    (tmp_path / "c.rdf").write_text('<rdf:RDF xmlns:rdf="r" xmlns:skos="s"><skos:Concept rdf:about="u1"><skos:prefLabel xml:lang="en">Cats</skos:prefLabel><skos:broader rdf:resource="u0"/></skos:Concept><skos:Concept rdf:about="u0"><skos:prefLabel xml:lang="en">Pets</skos:prefLabel></skos:Concept></rdf:RDF>')
    assert {tuple(r) for r in S.read_concepts(spark, str(tmp_path)).collect()} == {("u1", "skos:prefLabel", "Cats", "en"), ("u1", "skos:broader", "u0", None), ("u0", "skos:prefLabel", "Pets", "en")}


def test_editions(spark, tmp_path):
    row = lambda work, *isbns: "\t".join(["/type", "k", "1", "d", json.dumps({"isbn_13": isbns, "works": [{"key": work}]})])
    (tmp_path / "d.tsv").write_text("\n".join([row("w1", "9780000000001", "9780000000002"), row("w2", "9780000000002"), row("w1", "9780000000001")]))
    assert [tuple(r) for r in S.read_editions(spark, str(tmp_path)).collect()] == [("9780000000001", "w1")]


def test_redirects_with_cycle(spark):
    merges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x")], "from_id string, to_id string")
    assert {tuple(r) for r in G.redirects(merges, depth=6).collect()} == {("a", "c"), ("b", "c")}


def test_redirects_long_chain_and_cycle(spark):
    def follow(raw, cur):
        seen = set()
        while cur in raw and cur not in seen:
            seen.add(cur)
            cur = raw[cur]
        return cur

    raw = {f"c{k}": f"c{k + 1}" for k in range(130)} | {"x": "y", "y": "z", "z": "x", "s": "s"} | {f"t{k}": f"t{k + 1}" for k in range(9)} | {"t9": "y"}
    merges = spark.createDataFrame(list(raw.items()), "from_id string, to_id string")
    want = {(k, to) for k in raw if (to := follow(raw, k)) != k}
    assert {tuple(r) for r in G.redirects(merges, cycles=True).collect()} == want
    assert {tuple(r) for r in G.redirects(merges).collect()} == {x for x in want if x[0][0] == "c"}


def test_mapped_csv(spark, tmp_path):
    from folio_spark.sources.catalog import read_mapped_csv

    (tmp_path / "c.csv").write_text("Name,Topics\nA b, cats ; dogs;;\n")
    assert [tuple(r) for r in read_mapped_csv(spark, str(tmp_path), {"title": "Name", "subject": "Topics"}).collect()] == [(["A b"], ["cats", "dogs"])]
