"""What queries over derived quads shuffle: how often whole tables move, counted in plans."""

import pytest

from folio_spark import graph_queries as Q
from folio_spark.operators import exports
from folio_spark.operators import loading as L
from folio_spark.operators.canonical import canonical_grains

DIR = "/root/testdata/sf0.001"
QUADS = "grain string, ord long, s string, p string, o string, o_kind string, o_lang string, g string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def some(spark):
    rows = [
        ("w1", 1, "#w1Work", Q.P.TYPE, Q.P.BF + "Work", "iri", None, "feed:parts"),
        ("w1", 2, "#w1Work", Q.P.BF + "subject", "http://t/a", "iri", None, "feed:parts"),
        ("w1", 3, "#w1Work", Q.P.BF + "subject", "http://t/unknown", "iri", None, "feed:parts"),
        ("au", 1, "http://t/a", Q.P.BROADER, "http://t/b", "iri", None, "authority:t"),
        ("au", 2, "http://t/c", Q.P.PREF_LABEL, "C", "literal", "en", "authority:t"),
    ]
    return spark.createDataFrame(rows, QUADS)


def test_instances_are_grouped_once(spark):
    """Statements of instances come from a saved table, so making quads shuffles nothing."""
    assert "Exchange" not in plan(Q.quads(spark, DIR))


def test_names_without_a_vocabulary_end_at_the_scan(some):
    assert {x.uri for x in L.reachable(some).collect()} == {"http://t/a", "http://t/b"}


def test_prior_state_meets_grains_once(some, monkeypatch):
    seen, cut = [], L.cut
    monkeypatch.setattr(L, "cut", lambda df: seen.append(plan(df)) or cut(df))
    L.prior_state(some)
    assert sum("Exchange" in x for x in seen) == 1


def test_public_quads_meet_a_list_once(some):
    found = exports.public_quads(some)
    assert "LeftAnti" not in plan(found) and found.count() == 3


def test_grains_in_a_row_are_those_by_joins(spark):
    q = lambda grain, s, p, o, kind: (grain, s, p, o, kind, None, None, "g")
    rows = [x for i in range(3) for x in (q(f"a{i}", "#w", "has", f"_:x{i}", "blank"), q(f"a{i}", f"_:x{i}", "to", f"_:y{i}", "blank"), q(f"a{i}", f"_:y{i}", "v", "1", "literal"))]
    rows += [q("alike", "#w", "has", "_:p", "blank"), q("alike", "#w", "has", "_:q", "blank"), q("none", "#w", "v", "_:no", "literal")]
    df = spark.createDataFrame(rows, "grain string, s string, p string, o string, o_kind string, o_lang string, o_type string, g string")
    by_row, by_joins, mixed = ({x.grain: x.text for x in canonical_grains(df, small=n).collect()} for n in (256, -1, 1))
    assert by_row == by_joins == mixed and by_row["a0"] == by_row["a1"] and len(by_row) == 5
