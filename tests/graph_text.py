"""Quads in short terms, for the tests of projection and loading."""

from folio_spark.operators.projection import BF, BFLC, OWN, RDF, RDFS, SKOS
from folio_spark.sources.catalog import parse_quads

NAMES = {"bf": BF, "bflc": BFLC, "rdf": RDF, "rdfs": RDFS, "skos": SKOS, "own": OWN}


def term(t):
    if t.startswith(("_:", '"')):
        return t
    if t.startswith("<"):
        return t
    head, _, tail = t.partition(":")
    return f"<{NAMES[head]}{tail}>" if head in NAMES else f"<{t}>"


def lines(text, graph="feed:a"):
    """Quads from lines of short terms; a fourth term names another graph."""
    out = []
    for line in filter(str.strip, text.splitlines()):
        s, p, rest = line.split(None, 2)
        o, _, g = rest.partition(" @ ")
        out.append(f"{term(s)} {term(p)} {term(o.strip())} <{g.strip() or graph}> .")
    return out


WORK = """
#w1Work rdf:type bf:Work
#w1Work bf:title _:t
_:t bf:mainTitle "Night Ferry"
_:t bf:subtitle "A Novel"
#w1Work bf:contribution _:c1
_:c1 rdf:type bflc:PrimaryContribution
_:c1 bf:agent _:a1
_:a1 rdfs:label "Moss, Ada"
_:c1 bf:role _:r1
_:r1 rdfs:label "author"
#w1Work bf:contribution _:c2
_:c2 bf:agent _:a2
_:a2 rdfs:label "Byrd, Lee"
#w1Work bf:subject _:s1
_:s1 rdfs:label "Fiction"
#w1Work bf:subject http://terms.example/t2 @ editorial:
#w1Work bf:language http://id.loc.gov/vocabulary/languages/eng
#w1Work bf:classification _:k1
_:k1 bf:classificationPortion "FIC1"
#w1Work bf:classification _:k2
_:k2 bf:classificationPortion "FIC1"
_:k2 rdfs:label "Fiction / Sea"
#w1Work bf:hasInstance #i2Instance
#w1Work bf:hasInstance #i1Instance
#i1Instance bf:identifiedBy _:d1
_:d1 rdf:type bf:Isbn
_:d1 rdf:value "9780000000002"
#i1Instance bf:identifiedBy _:d2
_:d2 rdf:value "77"
_:d2 bf:source _:sc
_:sc rdfs:label "vendor"
#i1Instance bf:media _:m
_:m rdfs:label "computer"
#i1Instance bf:provisionActivity _:p9
_:p9 rdf:type bf:Distribution
_:p9 bflc:simpleAgent "Carrier"
#i1Instance bf:provisionActivity _:p8
_:p8 rdf:type bf:Publication
_:p8 bflc:simpleAgent "House"
_:p8 bflc:simplePlace "Oslo"
_:p8 bflc:simpleDate "2021"
#i2Instance bf:carrier _:ca
_:ca rdfs:label "volume"
#i2Instance bf:hasItem #x1
#x1 bf:shelfMark "QA 1"
#x1 own:barcode "b1"
http://terms.example/t2 rdfs:label "Ships (other)"@en @ authority:t
http://terms.example/t2 skos:prefLabel "Ships"@en @ authority:t
http://terms.example/t2 skos:prefLabel "Schiffe"@de @ authority:t
http://terms.example/t2 skos:broader http://terms.example/t1 @ authority:t
http://terms.example/t1 skos:prefLabel "Vehicles"@en @ authority:t
http://terms.example/t1 skos:broader http://terms.example/t0 @ authority:t
"""


def frame(spark, *texts):
    """One grain a text; ord is the place of the line."""
    rows = [(f"g{k}", i, line) for k, t in enumerate(texts) for i, line in enumerate(t if isinstance(t, list) else lines(t))]
    return parse_quads(spark.createDataFrame(rows, "grain string, ord long, value string")).cache()
