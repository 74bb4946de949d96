"""Equivalents through a term in the middle, and what holds them back."""

import pytest

from folio_spark.operators import pivots as operator
from folio_spark.operators.pivots import guarded_equivalents, two_smallest

TERMS = "id string, scheme string"
A, B, G = "urn:a:", "urn:b:", "urn:g:"
# Sources of scheme a; nodes urn:n: belong to no vocabulary at hand.
LABELS = [
    (A + "birds", "Birds"), (B + "birds", "Bird"), (B + "owls", "Owls"), (A + "groups", "Groups"), (B + "bands", "Small bands"), (B + "clubs", "Clubs"), (G + "gruppe", "Gruppe"),
    (A + "rite", "Wedding rite"), (B + "rite", "Wedding rite"), (B + "pairs", "Pairs"), (A + "boys", "Boys"), (B + "lads", "Lads"), (B + "boys", "Boys"), (A + "manner", "Manner"), (B + "manners", "Manners"),
]
LINKS = [
    (A + "birds", "n:birds"), (B + "birds", "n:birds"), (B + "owls", "n:birds"), (A + "groups", "n:groups"), (B + "bands", "n:groups"), (B + "clubs", "n:groups"), (G + "gruppe", "n:groups"),
    (A + "rite", "n:rite"), (B + "rite", "n:rite"), (B + "pairs", "n:rite"), (A + "boys", "n:boys"), (B + "lads", "n:boys"), (B + "boys", "n:elsewhere"), (A + "manner", "n:manner"), (B + "manners", "n:manner"),
]


def found(spark, labels=LABELS, links=LINKS, edges=((B + "owls", B + "birds"),), alts=(), **options):
    ids = sorted({i for i, _ in [*labels, *alts]})
    rows = [(i, x, False) for i, x in labels] + [(i, x, True) for i, x in alts]
    links = [(x if len(x) == 3 else (*x, "exact")) for x in links]
    out = guarded_equivalents(spark.createDataFrame([(i, i.split(":")[1]) for i in ids], TERMS), spark.createDataFrame(rows, "id string, label string, alt boolean"), spark.createDataFrame(links, "src string, dst string, rel string"), spark.createDataFrame(list(edges), "child string, parent string"), **options)
    return {(r.src, r.dst): r.strength for r in out.collect()}


@pytest.fixture(scope="module")
def got(spark):
    return found(spark)


@pytest.mark.parametrize(
    "src, dst, strength",
    [
        (A + "birds", "n:birds", "exact"),
        (A + "birds", B + "birds", "pivot-exact"),  # labels agree, plurals apart
        (A + "birds", B + "owls", None),  # its ancestor stands at the node
        (A + "groups", B + "bands", "pivot-close"),
        (A + "groups", B + "clubs", "pivot-close"),
        (A + "groups", G + "gruppe", "pivot-close"),  # alone in its scheme, but three claim the node
        (A + "rite", B + "rite", "pivot-exact"),
        (A + "rite", B + "pairs", "pivot-close"),  # its scheme's own term for the label stands there too
        (A + "manner", B + "manners", "pivot-exact"),
        (B + "owls", A + "birds", None),  # the source's own ancestor stands at the node: it's broader
        (B + "owls", B + "birds", None),
        (A + "boys", B + "lads", None),  # its scheme has the label elsewhere
    ],
)
def test_rules(got, src, dst, strength):
    assert got.get((src, dst)) == strength


def test_other_labels_are_see_also(spark):
    labels = [(A + "birds", "Birds"), (B + "birds", "Birds"), (B + "fowl", "Fowl")]
    links = [(A + "birds", "n:x"), (B + "birds", "n:x"), (B + "fowl", "n:x")]
    got = found(spark, labels, links, [("x", "y")], [(A + "birds", "Fowl")])
    assert got[A + "birds", B + "birds"] == "pivot-exact" and got[A + "birds", B + "fowl"] == "pivot-close"


def test_strength_of_the_weaker_link_and_direct_links(spark):
    labels = [(A + "x", "One"), (B + "x", "One"), (G + "x", "One")]
    got = found(spark, labels, [(A + "x", B + "x", "close"), (B + "x", G + "x", "exact"), ("https://h.org/t/", A + "x", "exact")], [("p", "q")])
    assert got[A + "x", B + "x"] == got[B + "x", A + "x"] == "close" and got[A + "x", G + "x"] == "pivot-close" and got[A + "x", "h.org/t"] == "exact"
    assert not {s for s, _ in got} - {A + "x", B + "x", G + "x"}


def test_a_hub_stays_linear(spark):
    """A node that 3,000 terms claim: those whose labels agree are equated, the other nine million pairs never are."""
    n = 3_000
    labels = [(f"urn:{'ab'[i % 2]}:{i}", f"Label {i // 2}") for i in range(n)]
    got = found(spark, labels, [(i, "n:hub") for i, _ in labels], [("p", "q")])
    assert len(got) == 2 * n and got["urn:a:0", "urn:b:1"] == "pivot-exact" and got["urn:a:0", "n:hub"] == "exact"


def test_empty(spark):
    assert found(spark, [("urn:a:x", "X")], [("urn:c:p", "urn:c:q")], [("p", "q")]) == {}


def test_shared_labels_dont_meet_in_pairs(spark):
    """Of 500 terms with one label two stand for it, and the smallest other one is still found."""
    plain = spark.createDataFrame([(f"k{i:03}", "x", s) for i in range(500) for s in "ab"], "key string, norm string, scheme string")
    assert sorted(map(tuple, two_smallest(plain).select("scheme", "norm", "key").collect())) == [(s, "x", k) for s in "ab" for k in ("k000", "k001")]
    labels = [(f"{s}{i}", "Same") for s in (A, B) for i in range(3)]
    links = [(A + "0", "n:1"), (B + "2", "n:1"), (A + "1", "n:1")]
    assert found(spark, labels, links)[A + "0", "n:1"] == "exact"


def test_the_registered_query_leaves_no_pair_out(spark, monkeypatch):
    """Not even at nodes that the operator by itself would take for hubs: its six terms a node equal those found without a bound."""
    from folio_spark.graph_queries import guarded_equivalents as registered

    rows = lambda: sorted(map(tuple, registered(spark, "/root/testdata/sf0.001").collect()))
    want = rows()
    monkeypatch.setitem(guarded_equivalents.__kwdefaults__, "hub", 3)
    assert len(want) > 400 and rows() == want


def test_without_a_hub_all_pairs_are_judged(spark, monkeypatch):
    """45 terms at a node, no label shared: each pair is there, and dealing the node's links over pieces changes nothing."""
    labels = [(f"urn:{'ab'[i % 2]}:{i}", f"Label {i}x") for i in range(45)]
    links = [(i, "n:hub", "exact") for i, _ in labels]
    whole = found(spark, labels, links, [("p", "q")], hub=None)
    assert len(whole) == 45 + 45 * 44 and {s for (_, d), s in whole.items() if d != "n:hub"} == {"pivot-close"}
    monkeypatch.setattr(operator.pivots, "__defaults__", (4,))
    assert found(spark, labels, links, [("p", "q")], hub=None) == whole


def test_dealt_links_meet_as_one_by_one(spark):
    """All three ways through a node, links to terms and nodes of several pieces among them."""
    links = {(f"t{i}", f"{'nt'[i % 2]}{i * 7 % 3}"): 1 + i % 2 for i in range(40)} | {("t1", f"x{i}"): 2 for i in range(9)}
    links = {k: w for k, w in links.items() if k[0] != k[1]}
    known = {a for a, _ in links}
    want = {}
    for (a, b), w in links.items():
        for (x, y), v in links.items():
            for hit, src, cand, via in ((b == y, a, x, b), (a == x, b, y, a), (b == x and b in known, a, y, b)):
                if hit and src != cand and src in known:
                    want[src, cand, via] = max(min(w, v), want.get((src, cand, via), 0))
    terms = spark.createDataFrame([(k,) for k in known], "key string")
    rows = spark.createDataFrame([(*k, w) for k, w in links.items()], "a string, b string, w int")
    for deal in (3, 1000):
        got = [((r.src, r.cand, r.via), r.w) for r in operator.pivots(terms, rows, deal).collect()]
        assert dict(got) == want and len(got) == len(want)
