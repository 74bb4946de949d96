"""Public exports: hidden works leave no trace, private extras stay private, files match their digests."""

import gzip
import hashlib
from pathlib import Path

import pytest
from graph_text import WORK, frame

from folio_spark.operators.exports import export_nquads, public_quads
from folio_spark.operators.projection import OWN, project_works
from folio_spark.sources.catalog import parse_quads

MORE = WORK + """
#w1Work bf:hasPart #w2Work @ editorial:
#w1Work bf:hasPart #w3Work @ editorial:
#w1Work bf:hasPart #w4Work @ editorial:
#w1Work own:extra/cover "a.jpg"
#w1Work own:extra/price "9"
#w1Work own:extra/sources "alpha, secret,beta"
"""
OTHERS = [
    '#w2Work rdf:type bf:Work\n#w2Work bf:title _:t\n_:t bf:mainTitle "Part"\n#w2Work own:extra/sources "secret"\n#w2Work own:suppressed "false" @ editorial:',
    '#w3Work rdf:type bf:Work\n#w3Work own:tombstoned "2024" @ editorial:\n#w3Work bf:partOf #w1Work',
    '#w4Work rdf:type bf:Work\n#w4Work own:suppressed "true" @ editorial:',
]


def texts(df):
    return {(r.s, r.p.removeprefix(OWN), r.o) for r in df.collect()}


def test_hidden_works_leave_no_trace(spark):
    quads = frame(spark, MORE, *OTHERS)
    got = texts(public_quads(quads))
    assert not [q for q in got if "#w3Work" in q or "#w4Work" in q]
    assert {q for q in got if q[1].endswith("hasPart")} == {("#w1Work", "http://id.loc.gov/ontologies/bibframe/hasPart", "#w2Work")}
    assert ("#w1Work", "extra/price", "9") in got and ("#w1Work", "extra/sources", "alpha, secret,beta") in got


def test_private_extras(spark):
    got = {q for q in texts(public_quads(frame(spark, MORE, *OTHERS), extras=["cover"], sources=["alpha", "beta"])) if q[1].startswith("extra/")}
    assert got == {("#w1Work", "extra/cover", "a.jpg"), ("#w1Work", "extra/sources", "alpha, beta")}


def test_nothing_left_is_refused(spark):
    with pytest.raises(ValueError, match="all works are hidden"):
        public_quads(frame(spark, *OTHERS[1:]))
    assert public_quads(frame(spark, [])).count() == 0


def test_files_match_their_digests_and_read_back(spark, tmp_path):
    quads = frame(spark, MORE, *OTHERS)
    manifest = {r.file: (r.bytes, r.sha256) for r in export_nquads(quads, f"{tmp_path}/out", extras=[]).collect()}
    files = {f.name: f for f in Path(f"{tmp_path}/out").glob("*.gz")}
    assert manifest == {n: (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for n, f in files.items()}
    lines = [x for n in sorted(files) for x in gzip.decompress(files[n].read_bytes()).decode().splitlines()]
    back = parse_quads(spark.createDataFrame([("g", i, x) for i, x in enumerate(lines)], "grain string, ord long, value string"))
    titles = lambda q: {r.work_id: r.title for r in project_works(q, "feed:a").collect()}
    assert titles(back) == titles(quads) == {"w1": "Night Ferry", "w2": "Part"}
