"""The queries with SQL give the rows that DuckDB gives, on whole tables."""

import os

import duckdb
import pytest

from folio_spark.llm import queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_same_rows(spark, duck, name):
    got = queries.queries()[name](spark, DIR)
    names = sorted(got.columns)
    found = duck.execute(queries.oracle_sql()[name])
    order = [[c[0] for c in found.description].index(n) for n in names]
    want = sorted([tuple(r[i] for i in order) for r in found.fetchall()], key=repr)
    assert sorted((tuple(r) for r in got.select(names).collect()), key=repr) == want


def test_sharding_sql_splits(spark, duck):
    """A small byte limit, so that the directory has many depths."""
    from folio_spark.llm.sharding import shard
    from folio_spark.llm.sql import SHARDING

    got = shard(spark.read.parquet(f"{DIR}/documents.parquet"), max_bytes=20_000, start_bits=4)
    want = duck.execute(SHARDING.format(max_bytes=20_000)).fetchall()
    assert len({r[1] for r in want}) > 3 and sorted(map(tuple, got.collect())) == sorted(want)
