"""Cleaning of texts and tags."""

import pytest

from folio_spark.functions.cleaning import clean_text, folk_tag, xml_text


@pytest.mark.parametrize(
    "raw, want",
    [
        ("plain  text stays\n", "plain  text stays\n"),
        ("<p>One &amp; two</p><br/>three", "One & two three"),
        ("a &amp;lt;b&amp;gt; c", "a c"),
        ("&amp;amp;amp;quot;", '&quot;'),  # three times over is as far as it goes
        ("2 < 3 &nbsp; x", "2 < 3 x"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_text(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(clean_text("t")).first()[0] == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("  Sea  Songs ", "sea songs"),
        ("ﬁne Ⅷ", "fine viii"),
        ("É", None),  # too short
        ("x" * 60, "x" * 60),
        ("x" * 61, None),
        ("see http://a.b", None),
        ("WWW.a.b", None),
        ("a <b>", None),
        ("bell\x07", None),
        ("{x}", None),
        ("", None),
        (None, None),
    ],
)
def test_folk_tag(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(folk_tag("t")).first()[0] == want


def test_xml_text(spark):
    row = spark.createDataFrame([("a\x00b\x0b\tc￾😀é\n",)], "t string").select(xml_text("t")).first()
    assert row[0] == "ab\tc😀é\n"
